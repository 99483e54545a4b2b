"""Queries of operators over runs, cases, benchmarks and plans. Those over small tables of rows, written here to reach each rule, are the ones that ``payloads`` has not replaced yet.

Each table is one SQL text that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import ledger as le
from ..operators import models as mo
from ..operators import quality as qu
from ..operators import usage as us
from ..operators import validation as va
from ..sources import exports as out
from ..sources import registry as reg
from . import schemas
from .views import spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
ROWS: dict[str, str] = {}


def rows(name: str, columns: str, *values: str) -> str:
    ROWS[name] = f"select * from (values {', '.join(f'({v})' for v in values)}) t({columns})"
    return name


def read(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(ROWS[name])


def query(sql: str, *names: str):
    """Registers a query with its SQL over the named tables (as v_<name>)."""

    def keep(f):
        QUERIES[f.__name__] = f
        body = f"select * from ({sql})" if sql.startswith("with ") else sql
        ORACLE_SQL[f.__name__] = "with " + ", ".join(f"v_{n} as ({ROWS[n]})" for n in names) + "\n" + body if names else sql
        return f

    return keep


# --- ledger ---------------------------------------------------------------------------------------------


@query("select event_id as id, event_type from events where event_id % 5 <> 0")
def appended_calls(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), "event_type")
    return le.append_calls(e.union(e.where("id % 3 = 0")), e.where("id % 5 = 0"))


@query("select c_custkey as id, (c_custkey % 3)::int as wave from customer where c_custkey % 3 < 2")
def committed_waves(spark, sf_dir):
    """Two waves, the second written twice."""
    from .streams import place

    path = place(spark, "waves")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
    le.commit_wave(c.where("id % 3 = 0"), path, 0)
    le.commit_wave(c.where("id % 3 = 2"), path, 1)
    return le.commit_wave(c.where("id % 3 = 1"), path, 1)


rows("versions", "version, checksum", *[f"{v}, '{schemas.checksum(v) if v == 1 else 'x'}'" for v in (1, 2, 9)])


@query("select * from (values (1, 'applied'), (2, 'changed'), (3, 'pending'), (9, 'unknown')) t(version, state)")
def schema_versions(spark, sf_dir):
    return schemas.states(spark, read(spark, "versions"))


@query("select event_id::varchar as id, cast(null as varchar) as run_id, cast(null as bigint) as pages from events")
def upgraded_calls(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"))
    return schemas.upgraded(e, "calls").select("id", "run_id", "pages")


# --- candidates and model outputs -----------------------------------------------------------------------------


@query("select count(*) as calls, sum(value)::double as units, 0::bigint as missing from events")
def budget_use(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("value").alias("units"), F.lit(None).cast("long").alias("missing"))
    return mo.budget_use(e, ["units", "missing"]).withColumn("units", F.col("units").cast("double"))


@query("select concat('mail ', c_custkey) as domain, cast(null as varchar) as registrant_org, case when c_custkey % 2 = 0 then 249 else 3 end::bigint as hosts from customer")
def model_evidence(spark, sf_dir):
    c = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"))
    host = F.transform(F.sequence(F.lit(1), F.when(F.col("c_custkey") % 2 == 0, 300).otherwise(4)), lambda i: F.when(i == 2, "").otherwise(F.concat(F.lit("h"), i.cast("string"))))
    blank = {k: F.lit("") for k in ("registrant_org", "creation_date", "expiration_date", "title", "description", "copyright_org", "redirect_domain")}
    none = F.array().cast("array<string>")
    r = c.select(F.concat(F.lit("  mail\x01 "), F.col("c_custkey").cast("string"), F.lit("\n")).alias("domain"), host.alias("subdomains"), *[v.alias(k) for k, v in blank.items()], *[none.alias(k) for k in ("nameservers", "aliases", "tracker_ids", "legal_entities")])
    return out.model_evidence(r, cloud=True).select("domain", "registrant_org", F.size("subdomains").cast("long").alias("hosts"))


# --- cases and benchmarks ----------------------------------------------------------------------------------------


def _columns(ddl: str) -> list[str]:
    """The columns of a schema text, cut at commas outside brackets."""
    parts, depth = [""], 0
    for x in ddl:
        depth += (x == "<") - (x == ">")
        if x == "," and not depth:
            parts.append("")
        else:
            parts[-1] += x
    return parts


_EVIDENCE = '{"domain": "a.com", "whois": {"registrant_org": "Acme", "nameservers": ["n"]}, "basic_intel": {"aliases": ["A"]}, "subdomains": ["x"]}'
_MODEL = '{"schema_version": 1, "case_id": "%s", "domain": "%s", "corpus_class": "%s", "expected_abstain": %s, "expected_pivots": [%s]}'
_P = '{"id_type": "org", "value": "%s", "acceptable_values": [%s], "source_refs": [%s]}'
_ONE = _P % ("Acme", '"Acme Inc"', '"r"')
_MODELS = {
    "fine": (_MODEL % ("fine", "a.com", "held_out", "false", _ONE), _EVIDENCE),
    "fine2": (_MODEL % ("fine2", "a.com", "synthetic", "true", ""), _EVIDENCE),
    "abstention": (_MODEL % ("abstention", "a.com", "held_out", "true", _ONE), _EVIDENCE),
    "corpus_class": (_MODEL % ("corpus_class", "a.com", "other", "false", _ONE), _EVIDENCE),
    "evidence domain": (_MODEL % ("evidence domain", "b.com", "held_out", "false", _ONE), _EVIDENCE),
    "unknown evidence": (_MODEL % ("unknown evidence", "a.com", "held_out", "false", _ONE), _EVIDENCE.replace('"subdomains"', '"hosts"')),
    "evidence kinds": (_MODEL % ("evidence kinds", "a.com", "held_out", "false", _ONE), _EVIDENCE.replace('["n"]', '"n"')),
    "pivot references": (_MODEL % ("pivot references", "a.com", "held_out", "false", _P % ("Acme", "", "")), _EVIDENCE),
    "fine3": (_MODEL % ("fine3", "a.com", "held_out", "false", _P % ("Acme", '"B", "D"', '"r"')), _EVIDENCE),
    "acceptable values": (_MODEL % ("acceptable values", "a.com", "held_out", "false", _P % ("Acme", '" "', '"r"')), _EVIDENCE),
    "pivots repeat": (_MODEL % ("pivots repeat", "a.com", "held_out", "false", ", ".join((_ONE, _P % ("ACME  inc", "", '"r"')))), _EVIDENCE),
}
rows("model_cases", "case_id, payload, evidence", *[f"'{k}', '{p}', '{e}'" for k, (p, e) in _MODELS.items()])


def _model_cases(spark):
    ddl = f"struct<{','.join(c.strip().replace(' ', ':', 1) for c in _columns(va.MODEL_CASE) if not c.strip().startswith('evidence'))}>"
    return read(spark, "model_cases").select(F.from_json("payload", ddl).alias("c"), "evidence").select("c.*", "evidence")


@query("select case_id as key, case_id as problem from v_model_cases where case_id not like 'fine%' union all select 'acceptable values', 'pivot'", "model_cases")
def model_case_problems(spark, sf_dir):
    return va.model_case_problems(_model_cases(spark))


@query("""select event_id as key, problem from (select event_id, unnest([case when value < 0 or value > 1 then 'units outside 0 to 1' end, case when event_type not in ('view', 'click') then 'kind is unknown' end]) as problem from events) where problem is not null""")
def value_problems(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("value").alias("units"), F.col("event_type").alias("kind"))
    return va.value_problems(e, "event_id", ("units",), ("kind",), {"kind": ("view", "click")})


@query("select user_id % 5 as case_id, count(*) as calls, sum(event_id % 5)::bigint as upstream_requests, sum(event_id % 3)::bigint as latency_ms, 0::double as units from events group by 1")
def usage_totals(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    use = e.select((F.col("user_id") % 5).alias("case_id"), F.lit(1).alias("calls"), (F.col("event_id") % 5).alias("upstream_requests"), (F.col("event_id") % 3).alias("latency_ms"), F.lit(None).cast("double").alias("units"))
    return qu.usage_totals(use, ["case_id"]).withColumn("units", F.col("units").cast("double"))


rows("bench_cases", "case_id, corpus_class, expected_abstain", *[f"{i}, '{'synthetic' if i == 0 else 'held_out'}', {'true' if i % 4 == 3 else 'false'}" for i in range(12)])
rows("bench_expected", "case_id, id_type, value, grp", *[x for i in range(12) if i % 4 != 3 for x in (f"{i}, 'org', 'Acme {i}', 'g1'", f"{i}, 'org', 'Acme {i} Inc', 'g1'", f"{i}, 'email', 'a{i}@a.com', 'g2'")])
rows("bench_rules", "case_id, id_type, value, score", *[x for i in range(12) for x in (f"{i}, 'org', 'ACME  {i}', 0.7", f"{i}, 'org', 'Wrong {i}', {0.5 if i % 3 == 0 else 0.3}")])
rows("bench_model", "case_id, id_type, value, score", *[x for i in range(12) if i % 2 for x in (f"{i}, 'email', 'A{i}@a.com', 0.9", f"{i}, 'email', 'abuse@a.com', 0.9")])
rows("bench_calls", "case_id, disposition, tokens, cost", *[f"{i}, '{'abstained' if i in (3, 7) else 'invalid' if i == 4 else 'accepted'}', {10 * i}, {'cast(null as double)' if i == 5 else i}" for i in range(11)])


@query("""with e as (select case_id, id_type, lower(value) as value, grp from v_bench_expected), b as (select distinct case_id, id_type, lower(regexp_replace(value, ' +', ' ', 'g')) as value from v_bench_rules where score >= 0.4),
a as (select * from b union select case_id, id_type, lower(value) from v_bench_model where not contains(value, 'abuse')), g as (select count(*) as groups from (select distinct case_id, grp from e)),
s as (select (select count(*) from (select distinct b.case_id, grp from b join e using (case_id, id_type, value))) as bt, (select count(*) from b anti join e using (case_id, id_type, value)) as bf, (select count(*) from (select distinct a.case_id, grp from a join e using (case_id, id_type, value))) as tt, (select count(*) from a anti join e using (case_id, id_type, value)) as tf),
k as (select count(*) as cases, count(*) filter (expected_abstain) as ab, count(*) filter (expected_abstain and coalesce(disposition, 'missing') = 'abstained') as ok, count(*) filter (coalesce(disposition, 'missing') in ('invalid', 'error', 'missing')) as bad from v_bench_cases left join v_bench_calls using (case_id))
select groups, bt as baseline_tp, bf as baseline_fp, bt / (bt + bf) as baseline_precision, bt / groups as baseline_recall, tt as assisted_tp, tf as assisted_fp, tt / (tt + tf) as assisted_precision, tt / groups as assisted_recall, cases, ab as abstention_cases, ok / ab as abstention_accuracy, bad as invalid_or_error_count,
tt / groups - bt / groups as recall_lift, tt / (tt + tf) - bt / (bt + bf) as precision_delta, cast(null as bigint) as tokens, 7::bigint as n_reasons, false as eligible from g, s, k""", "bench_cases", "bench_expected", "bench_rules", "bench_model", "bench_calls")
def pivot_benchmark(spark, sf_dir):
    score = lambda n: read(spark, n).withColumn("score", F.col("score").cast("double"))
    calls = read(spark, "bench_calls").withColumn("cost", F.col("cost").cast("double"))
    b = qu.pivot_benchmark(read(spark, "bench_cases"), read(spark, "bench_expected").withColumnRenamed("grp", "group"), score("bench_rules"), score("bench_model"), calls, cloud=True)
    n = F.size("reasons").cast("long").alias("n_reasons")
    return b.select("groups", *[f"{p}_{c}" for p in ("baseline", "assisted") for c in ("tp", "fp", "precision", "recall")], "cases", "abstention_cases", "abstention_accuracy", "invalid_or_error_count", "recall_lift", "precision_delta", "tokens", n, "eligible")


# --- runs, errors, plans -----------------------------------------------------------------------------------------------


@query("""select r.run_id, 'root' as root_domain, 'running' as status, coalesce(d, 0) as domains, coalesce(i, 0) as identifiers, coalesce(e, 0) as edges from (select distinct n_regionkey as run_id from nation union all select 99) r
left join (select c_nationkey % 5 as run_id, count(*) filter (c_custkey % 2 = 0) as d, count(*) filter (c_custkey % 2 = 1) as i from customer group by 1) n using (run_id) left join (select s_nationkey % 5 as run_id, count(*) as e from supplier group by 1) x using (run_id)""")
def run_summary(spark, sf_dir):
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    runs = t("nation").select(F.col("n_regionkey").alias("run_id")).distinct().union(spark.createDataFrame([(99,)], "run_id long"))
    runs = runs.withColumn("root_domain", F.lit("root")).withColumn("status", F.lit("running"))
    nodes = t("customer").select((F.col("c_nationkey") % 5).alias("run_id"), F.when(F.col("c_custkey") % 2 == 0, "domain").otherwise("identifier").alias("node_type"))
    return us.run_summary(runs, nodes, t("supplier").select((F.col("s_nationkey") % 5).alias("run_id")))


@query("""select coalesce(n.run_id, t.run_id) as run_id, coalesce(nodes, 0) as nodes, coalesce(processed, 0) as processed, coalesce(runnable, 0) as runnable from (select c_nationkey as run_id, count(*) as nodes, count(*) filter (c_custkey % 4 = 0) as processed from customer group by 1) n
full join (select o_custkey % 50 as run_id, count(*) filter (o_orderstatus = 'O' and o_orderkey % 4 < 3) as runnable from orders group by 1) t on n.run_id = t.run_id""")
def run_progress(spark, sf_dir):
    from .views import view

    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("run_id"), "c_custkey")
    return us.progress(c, c.where("c_custkey % 4 = 0"), view(spark, sf_dir, "tasks"))


@query("select user_id % 5 as run_id, event_type as source, count(*) as observations from events group by all")
def observations_by_source(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return us.observations_by_source(e.select((F.col("user_id") % 5).alias("run_id"), F.col("event_type").alias("source")))


@query("select concat('p', user_id % 7) as provider, min(ts + interval 2 hours) as expires_at from events where ts + interval 2 hours > (select max(ts) from events) group by 1")
def next_expiry(spark, sf_dir):
    from .views import view

    leases = view(spark, sf_dir, "leases")
    now = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("ts")).first()[0]
    return us.next_expiry(leases, F.lit(now).cast("timestamp_ntz"))


@query("select o_custkey as root_domain, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as run_id from orders where o_orderstatus in ('O', 'P') group by 1")
def resumable_runs(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = F.when(F.col("o_orderstatus") == "O", "interrupted").when(F.col("o_orderstatus") == "P", "partial").otherwise("completed")
    return us.resumable(o.select(F.col("o_custkey").alias("root_domain"), F.col("o_orderkey").alias("run_id"), status.alias("status"), F.col("o_orderdate").alias("created_at")))


@query("""select o_orderkey as id, case when o_orderstatus = 'P' then case when o_orderkey % 4 >= 3 then 'failed' else 'pending' end when o_orderstatus = 'O' then 'pending' else 'succeeded' end as status, case when o_orderstatus = 'P' and o_orderkey % 4 >= 3 then 'run stopped after maximum attempts' end as last_error from orders""")
def requeued_tasks(spark, sf_dir):
    from .views import view

    t = view(spark, sf_dir, "tasks").withColumn("last_error", F.lit(None).cast("string"))
    return us.requeued(t).select("id", "status", "last_error")


@query("select * from (values ('subdomains', 'subfinder', 1), ('subdomains', 'hackertarget', 2), ('reverse_whois', 'whoxy', 1), ('reverse_whois', 'duckduckgo', 2), ('dns', 'stdlib', 1)) t(capability, name, place)")
def source_choice(spark, sf_dir):
    picks = reg.choices(reg.sources(spark, ("crtsh",)), {"dns": "stdlib"})
    return picks.where(F.col("capability").isin("subdomains", "reverse_whois", "dns")).select("capability", "name", "place")


@query("select c_custkey as id, case when c_custkey % 2 = 0 then 'whoxy' else 'crtsh' end as source, c_custkey % 2 = 1 as cache_allowed, case when c_custkey % 2 = 0 then 'none' else 'normalized' end as export_scope, case when c_custkey % 2 = 0 then 'none' else 'hash_only' end as raw_retention from customer")
def policies_of_observations(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "whoxy").otherwise("crtsh").alias("source"))
    p = spark.createDataFrame([("whoxy", False, "none", "none")], "source string, cache_allowed boolean, export_scope string, raw_retention string")
    return reg.with_policy(c, p)


@query("select event_id as id from events where event_id % 10 > (event_id % 2 + 1) * 6")
def calls_over_limits(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.lit("crtsh").alias("provider"), (F.col("event_id") % 2 + 1).alias("attempts"), (F.col("event_id") % 10).alias("upstream_requests"))
    return reg.over_limits(e, reg.sources(spark)).select("id")


@query("select c_nationkey as node, count(*) as rows from customer group by 1 having count(*) > 1")
def repeated_keys(spark, sf_dir):
    return out.duplicate_keys(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("node")), ["node"])


@query("select c_custkey from customer where c_custkey % 25 >= 20")
def missing_parents(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (F.col("c_custkey") % 25).alias("node"))
    return out.orphans(c, spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey < 20"), "node", "n_nationkey").select("c_custkey")


@query("select c_nationkey as run_id, c_mktsegment as child_node_id, min(c_custkey) as depth from customer group by 1, 2")
def first_lineage(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows_ = c.select(F.col("c_nationkey").alias("run_id"), F.col("c_mktsegment").alias("child_node_id"), F.lit("p").alias("parent_node_id"), F.col("c_custkey").alias("depth"), F.col("c_custkey").alias("seq"))
    return ev.append(rows_, le.LINEAGE_KEY).select("run_id", "child_node_id", "depth")


_OLD = "select o_orderkey from orders where o_orderdate < timestamp '1996-01-01' and o_orderstatus <> 'P'"


@query(f"select l_orderkey as run_id, l_linenumber from lineitem where l_orderkey in ({_OLD})")
def retention_rows(spark, sf_dir):
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    runs = t("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("completed").alias("status"))
    gone = us.retention(runs, F.lit("1996-01-01").cast("timestamp_ntz"))
    return le.rows_of(gone, t("lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber"))


@query(f"select l_orderkey as run_id, count(*) as n from lineitem where l_orderkey not in ({_OLD}) group by 1")
def retained_rows(spark, sf_dir):
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    gone = t("orders").where("o_orderdate < timestamp_ntz '1996-01-01' and o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("run_id"))
    left = le.without_runs(gone, {"lines": t("lineitem").select(F.col("l_orderkey").alias("run_id"))})["lines"]
    return left.groupBy("run_id").agg(F.count("*").alias("n"))


@query("select concat('p', user_id % 7) as provider, arg_min(event_id, (ts, event_id)) as id from events where ts >= timestamp '2024-01-05' group by 1")
def patient_heads(spark, sf_dir):
    from .views import view

    return us.fifo_heads(view(spark, sf_dir, "leases"), F.lit("2024-01-05").cast("timestamp_ntz")).select("provider", "id")


@query("select user_id as request_key, min(event_id) as id from events group by 1")
def once_requests(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("request_key"), F.col("event_id").alias("id"), F.col("event_id").alias("seq"))
    return ev.append(e, ["request_key"]).select("request_key", "id")
