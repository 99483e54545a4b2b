"""Every query over records, payloads, hashes and stored folders against its SQL, on the smallest tables; and budgets, circuits and expansion in detail."""

import math
import os

import pytest

from siftgraph.operators import discovery as di
from siftgraph.operators import usage as us
from siftgraph.plans import hashes, network, payloads, records, stored

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "customer", "nation", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")
QUERIES = {name: (module, f) for module in (records, payloads, hashes, network, stored) for name, f in module.QUERIES.items()}


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    module, query = QUERIES[name]
    got = query(spark, DATA)
    cols = sorted(got.columns)
    rel = con.execute(module.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in rel.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in cols)) for r in got.collect()) == want != []


def test_budgets(spark):
    rows = [("a", 1, 0.1, True), ("a", 2, 0.2, True), ("a", 3, 5.0, True), ("a", 4, 9.0, False), ("b", 1, 0.3, True), ("b", 2, None, True)]
    d = spark.createDataFrame(rows, "k string, n int, cost double, paid boolean")
    ids = lambda df: sorted((r.k, r.n) for r in df.collect())
    assert ids(us.admitted(d, "k", "cost", ["n"], 0.3, billable="paid")) == [("a", 1), ("a", 2), ("a", 4), ("b", 1), ("b", 2)]  # 0.1 + 0.2 fits 0.3
    assert ids(us.admitted(d, "k", "cost", ["n"], 0.3, max_calls=1)) == [("a", 1), ("b", 1)]
    assert ids(us.admitted(d, "k", "cost", ["n"], -1)) == ids(d)


def test_explore_caps(spark):
    web = spark.createDataFrame([("a", f"n{i}") for i in range(6)] + [("n0", "a"), ("n0", "z")], "domain string, child string")

    def step(front):
        x = web.join(front, "domain")
        return x.selectExpr("domain", "child", "'l' as relation_type", "'s' as source", "1.0D as confidence", "depth + 1 as depth", "true as enqueue")

    root = spark.createDataFrame([("a",), ("a",)], "domain string")
    met, links = di.explore(root, step, 3, queue_cap=2)
    assert sorted((r.domain, r.depth) for r in met.collect()) == [("a", 0), ("n0", 1), ("n1", 1), ("z", 2)] and links.count() == 8
    met, links = di.explore(root, step, 3, node_cap=3)
    assert met.count() == 7 and links.count() == 6  # the cap is tested between waves
    met, links = di.explore(root, step, 3, node_cap=1)
    assert met.count() == 1 and links.count() == 0
