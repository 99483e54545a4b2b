import pytest
from pyspark.sql import functions as F

from siftgraph.functions import domains as dom
from siftgraph.plans import network, payloads, records

QUERIES = records.QUERIES | payloads.QUERIES | network.QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("narrow")
    k = spark.range(25_000)
    k.select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey")).coalesce(1).write.parquet(f"{at}/customer.parquet")
    k.select(F.col("id").alias("o_orderkey"), F.expr("id div 3").alias("o_custkey")).coalesce(1).write.parquet(f"{at}/orders.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["legal_links", "model_evidence", "address_guard"])
def test_rows_of_a_small_file_are_spread(spark, tables, name):
    assert QUERIES[name](spark, tables).rdd.getNumPartitions() >= 3


@pytest.mark.parametrize("name", ["reverse_expansion", "search_hits"])
def test_rows_are_spread_before_they_are_joined(spark, tables, name, capsys):
    QUERIES[name](spark, tables).explain()
    assert "RoundRobinPartitioning(3)" in capsys.readouterr().out


def test_a_domain_is_computed_once(spark):
    """An expression that repeats its argument repeats its work: the owner of a host, whether it is noise."""
    x = dom.normalized_domain(F.col("x"))
    for made in (dom.registrable(x), dom.noise_domain(x), dom.host_in(x, ("a.com",))):
        assert str(made).count("://([^") == 1
    rows = [("https://A.co.uk/x", "a.co.uk", False), ("www.reddit.com.", "reddit.com", True), ("x.y.html", "y.html", True), ("nodot", None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "x string, owner string, noise boolean")
    got = df.select("owner", dom.registrable(x), "noise", dom.noise_domain(x)).collect()
    assert [(r[1], r[3]) for r in got] == [(r[0], r[2]) for r in got]
