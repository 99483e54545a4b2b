"""The driver's tables seen as evidence-graph tables, in Spark and as DuckDB SQL of the same names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a narrow table that a task takes.
ROWS = 10_000


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a stored table over tasks by their number. Narrow rows take few bytes, by which files are cut, however much is made of each."""
    n = -(-rows.count() // ROWS)
    return rows.repartition(n) if n > 1 else rows


#: Each view in SQL that both engines read alike.
SQL = {
    "calls": """select event_id as id, concat('p', cast(user_id % 7 as string)) as provider, concat('c', cast(user_id % 3 as string)) as capability,
        case when event_type in ('view', 'click') then 'success' when event_type = 'signup' then 'empty' when event_type = 'purchase' then 'auth' else 'error' end as status,
        user_id % 2 = 0 as billable, event_id % 3 + 1 as attempts, event_id % 5 as upstream_requests, event_id % 4 as pages, value as units, cast(floor(value * 10) as bigint) as latency_ms,
        ts as started_at, concat('r', cast(user_id % 5 as string)) as run_id from events""",
    "leases": """select event_id as id, concat('p', cast(user_id % 7 as string)) as provider, ts as created_at, ts + interval 2 hours as expires_at from events""",
    "tasks": """select o_orderkey as id, o_custkey % 50 as run_id, case o_orderstatus when 'O' then 'pending' when 'F' then 'succeeded' else 'in_progress' end as status,
        6 - cast(substring(o_orderpriority, 1, 1) as int) as priority, o_orderdate as created_at, o_orderkey % 4 as attempts, 3 as max_attempts from orders""",
    "relations": """select l_orderkey * 10 + l_linenumber as seq, case l_linenumber % 4 when 0 then 'domain_has_ip' when 1 then 'acquisition_completed' when 2 then 'identifier_reused_on_domain' else 'domain_redirects_to' end as relation_type,
        'domain' as subject_type, concat('s', cast(l_suppkey as string)) as subject_value_norm, case l_linenumber % 4 when 0 then 'ip' else 'domain' end as object_type, concat('p', cast(l_partkey % 40 as string)) as object_value_norm,
        l_discount * 12 - 0.1 as score, concat(l_returnflag, l_linestatus) as source from lineitem""",
    "claims": """select l_orderkey as claim_id, case min(l_linenumber) % 4 when 1 then 'verified' when 2 then 'probable' when 3 then 'rejected' else 'candidate' end as confidence_class, 'rel' as claim_type,
        'domain' as subject_type, concat('s', cast(min(l_suppkey) as string)) as subject_value_norm, case when min(l_partkey) % 3 = 0 then 'ip' else 'domain' end as object_type, concat('d', cast(min(l_partkey) as string)) as object_value_norm from lineitem group by l_orderkey""",
    "evidence": """select l_orderkey as claim_id, case concat(l_returnflag, l_linestatus) when 'AF' then 'rdap-iana' when 'NF' then 'python-whois' when 'NO' then 'http-html' when 'RF' then 'sec-edgar' when 'AO' then ' Wayback ' else case when l_partkey % 2 = 0 then 'subfinder:x' else 'mystery' end end as source,
        case when l_linenumber % 5 = 0 then 'contradicts' else 'supports' end as polarity from lineitem""",
    "nodes": """select concat('n', cast(n_nationkey as string)) as node_id, 'identifier' as node_type, n_name as value_norm, case n_nationkey % 4 when 0 then 'tracker' when 1 then 'email' when 2 then 'org' else 'other' end as identifier_type from nation
        union all select concat('c', cast(c_custkey as string)), 'domain', concat(lower(c_mktsegment), cast(c_custkey % 40 as string), '.com'), cast(null as string) from customer""",
    "edges": """select case when c_custkey % 2 = 0 then concat('c', cast(c_custkey as string)) else concat('n', cast(c_nationkey as string)) end as from_node_id, case when c_custkey % 2 = 0 then concat('n', cast(c_nationkey as string)) else concat('c', cast(c_custkey as string)) end as to_node_id from customer where c_custkey % 3 <> 0""",
    "labelled": """select doc_id % 5 as case_id, concat('d', cast(doc_id as string)) as domain, quality = 1 as positive from labels""",
    "predicted_a": """select doc_id % 5 as case_id, concat('d', cast(doc_id as string)) as domain from documents where n_chars > 1500""",
    "predicted_b": """select doc_id % 5 as case_id, concat('d', cast(doc_id as string)) as domain from documents where n_chars > 700 and lang <> 'fr'""",
    "usage": """select user_id % 5 as case_id, event_id % 2 = 0 as candidate, 1 as calls, event_id % 5 as upstream_requests, cast(floor(value * 10) as bigint) as latency_ms, event_id % 3 as units from events""",
    "pivots": """select p_brand as domain, case p_partkey % 7 when 0 then 'email' when 1 then 'phone' when 2 then 'tracker' when 3 then 'ns' when 4 then 'org' when 5 then 'name' else 'other' end as id_type, p_name as value, p_size / 50.0 as score, p_partkey as ord from part""",
    "tied_pivots": """select p_brand as domain, case p_partkey % 4 when 0 then 'email' when 1 then 'phone' when 2 then 'tracker' else 'org' end as id_type, p_name as value, p_partkey % 129 / 128e0 as score, p_partkey as ord from part""",
    "captures": """select concat('u', cast(user_id as string)) as domain, ts as captured_at, event_id as digest from events where event_type <> 'error'""",
    "links": """select concat('r', cast(r_regionkey as string)) as from_domain, concat('n', cast(n_nationkey as string)) as to_domain from region join nation on n_regionkey = r_regionkey
        union all select concat('n', cast(s_nationkey as string)), concat('s', cast(s_suppkey as string)) from supplier
        union all select concat('s', cast(s_suppkey as string)), concat('n', cast((s_nationkey + 1) % 25 as string)) from supplier""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return over(spark, sf_dir, SQL[name])


def over(spark: SparkSession, sf_dir: str, text: str, wide: bool = False) -> DataFrame:
    """SQL over the tables it names, each read under a name of its own; ``wide``: spread over tasks by rows."""
    import re
    import zlib

    tag = f"{zlib.crc32(sf_dir.encode()):08x}"
    for t in ("events", "orders", "lineitem", "nation", "customer", "labels", "documents", "part", "region", "supplier"):
        if re.search(rf"\b(from|join) {t}\b", text):
            own = f"sift_{t}_{tag}"
            rows = table(spark, sf_dir, t)
            (spread(rows) if wide else rows).createOrReplaceTempView(own)
            text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {own}", text)
    return spark.sql(text)


def with_views(body: str, *names: str) -> str:
    """DuckDB SQL over the named views."""
    return "with " + ", ".join(f"v_{n} as ({SQL[n]})" for n in names) + "\n" + body
