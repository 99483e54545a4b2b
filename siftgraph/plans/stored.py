"""Queries that write given tables to folders as they occur outside, and read them back: captured payloads, exports, stores and backups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import backups, connector, scans
from ..sources.manifest import Store
from .streams import place
from .views import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@query("""select page_id, case page_id % 3 when 1 then 'http-html' else 'http html' end as source, date '2024-01-01' + (page_id % 7)::int as day, case when page_id % 10 <> 5 then url end as domain,
case when page_id % 10 <> 5 and strlen(html) <= 4000 then html end as payload, case when strlen(html) > 4000 then 'payload too large' when page_id % 10 = 5 then 'no domain' end as problem
from pages where page_id % 3 <> 0 and page_id % 7 >= 2""")
def captured_pages(spark, sf_dir):
    """Every page as a captured answer of one of three sources and seven days; two sources and five days are read back, with payloads up to 4,000 bytes."""
    at = place(spark, "captured")
    p = table(spark, sf_dir, "pages").select("page_id", "html", F.when(F.col("page_id") % 10 != 5, F.col("url")).alias("domain"))
    source = F.when(F.col("page_id") % 3 == 0, "rdap").when(F.col("page_id") % 3 == 1, "http-html").otherwise("http html")
    day = F.expr("date_add(date '2024-01-01', cast(page_id % 7 as int))")
    # The time of capture carries the page's number, which the format has no field for.
    connector.write(p.select(source.alias("source"), day.alias("day"), "domain", F.expr("timestamp '2024-01-01' + make_dt_interval(cast(page_id as int))").alias("captured_at"), F.col("html").alias("payload")), at)
    rows = connector.read(spark, at, maxBytes=4000).where(F.col("source").isin("http-html", "http html") & (F.col("day") >= F.lit("2024-01-03").cast("date")))
    page = F.datediff("captured_at", F.lit("2024-01-01")).cast("long")
    return rows.select(page.alias("page_id"), "source", "day", "domain", "payload", "problem")


@query("""with c as (select c_custkey as k, c_nationkey as n, c_mktsegment as m from customer),
b as (select *, case when k % 11 = 3 then 'graph' when k % 11 = 4 then 'run' end as bad, k % 5 = 2 as string_node, k % 5 = 3 as untyped, k % 7 = 1 as list_edge, k % 7 = 2 as no_end from c)
select 'good' as kind, 'nodes' as part, '' as reason, sum(2 - (string_node or untyped)::int)::bigint as n from b where bad is null
union all select 'good', 'edges', '', sum(1 - (list_edge or no_end)::int) from b where bad is null
union all select 'refused', 'graph', case bad when 'graph' then 'not a graph' else 'no run' end, count(*) from b where bad is not null group by 3
union all select 'refused', 'nodes', case when string_node then 'not an object' else 'no node_type' end, count(*) from b where bad is null and (string_node or untyped) group by 3
union all select 'refused', 'edges', case when list_edge then 'not an object' else 'no to_node_id' end, count(*) from b where bad is null and (list_edge or no_end) group by 3""")
def scanned_graphs(spark, sf_dir):
    """Each customer as a graph export, some broken as a whole, some in one node or edge; what is read and what is refused, counted."""
    at = place(spark, "graphs")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("m"))
    node = lambda id_, kind, value: F.to_json(F.struct(id_.alias("id"), kind.alias("node_type"), value.alias("value_norm")))
    first = F.when(F.col("k") % 5 == 2, F.to_json(F.array(F.lit("c")))).otherwise(node(F.concat(F.lit("c"), "k"), F.when(F.col("k") % 5 != 3, F.lit("domain")), F.concat(F.lit("é "), "m")))
    edge = F.to_json(F.struct(F.concat(F.lit("c"), "k").alias("from_node_id"), F.when(F.col("k") % 7 != 2, F.concat(F.lit("n"), "n")).alias("to_node_id"), F.lit("in").alias("relation_type"), F.lit(0.5).alias("confidence")))
    edge = F.when(F.col("k") % 7 == 1, F.lit("[1, 2]")).otherwise(edge)
    run = F.when(F.col("k") % 11 != 4, F.concat(F.lit("r"), "k"))
    text = F.concat(F.lit('{"run":'), F.to_json(F.struct(run.alias("id"), F.lit("a.com").alias("root_domain"))), F.lit(',"nodes":['), first, F.lit(","), node(F.concat(F.lit("n"), "n"), F.lit("org"), F.lit("x")), F.lit('],"edges":['), edge, F.lit("]}"))
    c.select(F.when(F.col("k") % 11 == 3, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text).alias("value")).write.text(at)
    nodes, edges, refused = scans.graphs(spark, at, lines=True)
    good = [x.agg(F.count("*").alias("n")).select(F.lit("good").alias("kind"), F.lit(part).alias("part"), F.lit("").alias("reason"), "n") for part, x in (("nodes", nodes), ("edges", edges))]
    told = refused.groupBy("part", "reason").agg(F.count("*").alias("n")).select(F.lit("refused").alias("kind"), "part", "reason", "n")
    return good[0].union(good[1]).union(told)


@query("""with c as (select c_custkey as k, case when c_custkey % 9 = 1 then 'not a case' when c_custkey % 9 = 2 then 'version' when c_custkey % 9 = 3 then 'classification' when c_custkey % 9 = 4 then 'conflicting labels' when c_custkey % 9 = 5 then 'root is labelled' end as problem from customer)
select case when problem = 'not a case' then null else concat('case', k) end as case_id, coalesce(problem, 'good') as state from c""")
def scanned_cases(spark, sf_dir):
    """Each customer as an evaluation case, some broken: the state of each."""
    at = place(spark, "cases")
    k = F.col("c_custkey")
    host = lambda n: F.concat(F.lit(f"{n}"), k, F.lit(".com"))
    label = lambda domain, kind: F.struct(domain.alias("domain"), kind.alias("classification"), F.lit("owner").alias("relationship"), F.array(F.lit("s")).alias("source_refs"))
    second = F.when(k % 9 == 4, host("a")).when(k % 9 == 5, host("root")).otherwise(host("b"))
    labels = F.array(label(host("a"), F.when(k % 9 == 3, "maybe").otherwise("positive")), label(second, F.lit("negative")))
    case = F.to_json(F.struct(F.when(k % 9 == 2, 2).otherwise(1).alias("schema_version"), F.concat(F.lit("case"), k).alias("case_id"), host("root").alias("root_domain"), labels.alias("labels")))
    table(spark, sf_dir, "customer").select(F.when(k % 9 == 1, F.concat(F.lit("["), case, F.lit("]"))).otherwise(case).alias("value")).write.text(at)
    good, bad = scans.cases(spark, at, lines=True)
    return good.select("case_id", F.lit("good").alias("state")).union(bad.select("key", "problem"))


def _waves(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("value"))
    return nodes, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("node"))


@query("""with n as (select c_custkey as id, c_custkey % 3 as w, 'nodes' as name from customer), e as (select o_orderkey as id, o_custkey % 3 as w, 'edges' as name from orders), x as (select * from n union all select * from e)
select 1 as version, name, count(*) as n, sum(id)::bigint as ids from x where w = 0 group by 2 union all select 2, name, count(*), sum(id) from x where w <= 1 and (w = 0 or id % 2 = 0) group by 2 union all
select 3, name, count(*), sum(id) from x where w <= 1 group by 2 union all select 4, name, count(*), sum(id) from x group by 2""")
def transactional_waves(spark, sf_dir):
    """Nodes and edges in waves: one, a second written in part and again in full, one that fails between its tables, and a third; what each version holds."""
    store = Store(spark, place(spark, "store"))
    nodes, edges = _waves(spark, sf_dir)
    wave = lambda k: {"nodes": nodes.where(f"id % 3 = {k}"), "edges": edges.where(f"node % 3 = {k}")}
    store.commit(wave(0), "wave-0")
    store.commit({n: x.where("id % 2 = 0") for n, x in wave(1).items()}, "wave-1")
    store.commit(wave(1), "wave-1")
    broken = edges.withColumn("node", F.when(F.col("id") >= 0, F.raise_error(F.lit("lost on the way")).cast("long")))
    try:
        store.commit({"nodes": wave(2)["nodes"], "edges": broken}, "wave-2")
    except Exception as e:  # Spark's own error, raised by the task
        if "lost on the way" not in str(e):
            raise
    store.commit(wave(2), "wave-2")
    held = [store.read(name, v).agg(F.count("*").alias("n"), F.sum("id").alias("ids")).select(F.lit(v).alias("version"), F.lit(name).alias("name"), "n", "ids") for v in store.versions() for name in store.tables(v)]
    out = held[0]
    for x in held[1:]:
        out = out.union(x)
    return out


@query("""select 'whole' as backup, 'none' as part, 'none' as problem, 0 as n where false
union all select 'altered', 'customer', 'contents', 1 union all select 'altered', 'nation', 'rows', -count(*) from nation where n_nationkey % 5 = 4 union all select 'altered', 'nation', 'contents', 1
union all select 'altered', 'customer.c_nationkey', 'no nation.n_nationkey', count(*) from customer where c_nationkey % 5 = 4 and c_custkey % 100 <> 7
union all select 'altered', 'orders', 'rows', count(*) from orders where o_orderkey % 97 = 3 union all select 'altered', 'orders', 'contents', 1 union all select 'altered', 'orders', 'repeated keys', count(*) from orders where o_orderkey % 97 = 3
union all select 'restored', 'orders', 'rows', count(*) from orders union all select 'restored', 'customer', 'rows', count(*) from customer""")
def refused_backups(spark, sf_dir):
    """A backup of three tables as it was written and after changes: rows changed, lost with others left without a parent, repeated; and what a restore of the first gives."""
    at = place(spark, "backup")
    tables = {n: table(spark, sf_dir, n) for n in ("nation", "customer", "orders")}
    keys, references = {"nation": ["n_nationkey"], "customer": ["c_custkey"], "orders": ["o_orderkey"]}, [("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey")]
    for name in ("whole", "altered"):
        backups.backup(tables, f"{at}/{name}", keys, references)
    n, c, o = tables.values()
    # Rows of 100 customers' nations that go are given another nation, so that they change without losing it.
    changed = c.withColumn("c_nationkey", F.when((F.col("c_custkey") % 100 == 7), F.lit(0).cast(c.schema["c_nationkey"].dataType)).otherwise(F.col("c_nationkey")))
    for name, rows in (("nation", n.where("n_nationkey % 5 <> 4")), ("customer", changed), ("orders", o.union(o.where("o_orderkey % 97 = 3")))):
        rows.write.mode("overwrite").parquet(f"{at}/altered/{name}")
    told = [backups.problems(spark, f"{at}/{name}").select(F.lit(name).alias("backup"), "part", "problem", "n") for name in ("whole", "altered")]
    store = Store(spark, f"{at}/store")
    version = backups.restore(store, f"{at}/whole", "restore")
    back = [store.read(t, version).agg(F.count("*").alias("n")).select(F.lit("restored").alias("backup"), F.lit(t).alias("part"), F.lit("rows").alias("problem"), "n") for t in ("orders", "customer")]
    return told[0].union(told[1]).union(back[0]).union(back[1])
