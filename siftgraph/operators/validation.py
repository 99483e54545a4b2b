"""Rules that cases, benchmarks, model cases, data policies and graphs must keep, as tables of broken ones.

Each function gives rows of (key, problem); no row means that all rules hold.
Nothing is dropped: callers choose with ``valid`` what goes on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.domains import normalized_domain, normalized_identifier, registrable

LABEL = "struct<domain:string,classification:string,relationship:string,source_refs:array<string>>"
CASE = f"schema_version int, case_id string, root_domain string, labels array<{LABEL}>"
PIVOT = "struct<id_type:string,value:string,acceptable_values:array<string>,source_refs:array<string>>"
MODEL_CASE = f"schema_version int, case_id string, domain string, corpus_class string, evidence string, expected_abstain boolean, expected_pivots array<{PIVOT}>"
#: Run settings that two graphs must share to be compared.
POLICY_FIELDS = (
    "max_depth", "pivot_top_k", "run_mode", "llm_model", "llm_policy_version", "cache_mode", "cloud_approved", "max_model_calls", "max_model_input_tokens",
    "max_model_output_tokens", "max_cloud_tokens", "fast_model", "model_routing_policy", "max_cloud_cost_microusd", "model_price_catalog_version",
)
# What a model case's evidence may hold.
EVIDENCE = ("domain", "whois", "basic_intel", "subdomains", "subdomains_truncated")
WHOIS = ("registrant_name", "registrant_org", "registrant_email", "registrant_phone", "nameservers", "creation_date", "expiration_date")
PAGE = ("title", "description", "aliases", "copyright_org", "tracker_ids", "redirect_domain", "legal_entities")
LISTS = ("nameservers", "aliases", "tracker_ids", "legal_entities")


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _refs_missing(refs: Column) -> Column:
    return F.coalesce(F.size(refs) < 1, F.lit(True)) | F.exists(refs, _blank)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _told(rows: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """A row for each broken rule of each row, from one pass."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules]))
    return rows.select(F.col(key).alias("key"), F.explode(found).alias("problem")).distinct()


def owner(raw: Column) -> Column:
    return registrable(normalized_domain(raw))


def case_problems(cases: DataFrame) -> DataFrame:
    """Of evaluation cases: version 1, an id, a root, labels with domain, class, relationship and references; no domain twice, none the root."""
    root = owner(F.col("root_domain"))
    own = [("version", ~(F.col("schema_version") == 1) | F.col("schema_version").isNull()), ("case_id", _blank(F.col("case_id"))), ("root", root.isNull()), ("no labels", F.coalesce(F.size("labels") < 1, F.lit(True)))]
    x = cases.select("case_id", root.alias("root"), F.explode("labels").alias("l"))
    x = x.select("case_id", "root", owner(F.col("l.domain")).alias("domain"), F.lower(F.trim("l.classification")).alias("kind"), "l.relationship", "l.source_refs")
    kind = ~F.coalesce(F.col("kind").isin("positive", "negative"), F.lit(False))
    each = [("label domain", F.col("domain").isNull()), ("classification", kind), ("relationship", _blank(F.col("relationship"))), ("label references", _refs_missing(F.col("source_refs"))), ("root is labelled", F.col("domain") == F.col("root"))]
    twice = x.where("domain is not null").groupBy("case_id", "domain").agg(F.count("*").alias("n"), F.count_distinct("kind").alias("k")).where("n > 1")
    twice = twice.select(F.col("case_id").alias("key"), F.when(F.col("k") > 1, "conflicting labels").otherwise("repeated label").alias("problem")).distinct()
    return _union([_told(cases, "case_id", own), _told(x, "case_id", each), twice])


def valid(rows: DataFrame, problems: DataFrame, key: str) -> DataFrame:
    return rows.join(problems.select(F.col("key").alias(key)), key, "left_anti")


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases that keep the rules, problems of the others) of JSON files."""
    cases = spark.read.schema(CASE).option("multiLine", True).json(path)
    bad = case_problems(cases)
    return valid(cases, bad, "case_id"), bad


def manifest_problems(manifests: DataFrame) -> DataFrame:
    """Of manifests (schema_version, benchmark_id, comparisons array<struct<case,baseline,candidate>>)."""
    missing = F.exists("comparisons", lambda c: _blank(c["case"]) | _blank(c["baseline"]) | _blank(c["candidate"]))
    rules = [("version", ~F.coalesce(F.col("schema_version") == 1, F.lit(False))), ("benchmark_id", _blank(F.col("benchmark_id"))), ("no comparisons", F.coalesce(F.size("comparisons") < 1, F.lit(True))), ("paths", missing)]
    return _told(manifests, "benchmark_id", rules)


def benchmark_problems(entries: DataFrame, runs: DataFrame) -> DataFrame:
    """Of a benchmark's entries (benchmark_id, ord, case_id, root_domain) and the runs (benchmark_id, ord, side, field, value): cases and roots once, and one value of each setting that both sides of a case state."""
    twice = lambda c, name: entries.groupBy("benchmark_id", c).count().where("count > 1").select(F.col("benchmark_id").alias("key"), F.concat(F.lit(f"duplicate {name}: "), c).alias("problem"))
    own = entries.withColumn("root", owner(F.col("root_domain")))
    roots = own.groupBy("benchmark_id", "root").count().where("count > 1").select(F.col("benchmark_id").alias("key"), F.concat(F.lit("duplicate root_domain: "), "root").alias("problem"))
    both = runs.where("value is not null").groupBy("benchmark_id", "ord", "field").agg(F.count_distinct("side").alias("k"), F.max(F.when(F.col("side") == "baseline", F.col("value"))).alias("v")).where("k = 2")
    mixed = both.groupBy("benchmark_id", "field").agg(F.count_distinct("v").alias("n")).where("n > 1")
    return _union([twice("case_id", "case_id"), roots, mixed.select(F.col("benchmark_id").alias("key"), F.concat(F.lit("inconsistent policy: "), "field").alias("problem"))])


def policy_match(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, state) of runs in long form (keys, side, field, value): ``matched``, ``mismatch``, or ``unverified`` where a side says nothing."""
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("value")))
    x = runs.groupBy(*keys, "field").agg(pick("baseline").alias("b"), pick("candidate").alias("c"))
    state = F.when(F.col("b").isNull() | F.col("c").isNull(), "unverified").when(F.col("b") == F.col("c"), "matched").otherwise("mismatch")
    return x.select(*keys, "field", state.alias("state"))


def run_fields(runs: DataFrame, keep: list[str]) -> DataFrame:
    """A run's settings in long form: (keep, field, value)."""
    fields = [c for c in POLICY_FIELDS if c in runs.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields])
    return runs.select(*keep, F.explode(pairs).alias("x")).select(*keep, "x.*")


def model_case_problems(cases: DataFrame) -> DataFrame:
    """Of model cases: known evidence fields of the right kinds, evidence of the case's own domain, referenced pivots that are valid and unique, and abstention without pivots or pivots without abstention."""
    kind = F.schema_of_variant(F.try_parse_json("evidence"))
    keys = lambda path: F.json_object_keys(F.get_json_object("evidence", path))
    only = lambda found, known: F.size(F.array_except(found, F.array(*map(F.lit, known)))) > 0
    listed = lambda path: F.get_json_object("evidence", path)
    not_list = F.lit(False)
    for section, names in (("whois", WHOIS), ("basic_intel", PAGE)):
        for c in names:
            v = listed(f"$.{section}.{c}")
            wrong = ~v.startswith("[") if c in LISTS else v.startswith("[") | v.startswith("{")
            not_list = not_list | F.coalesce(wrong, F.lit(False))
    not_list = not_list | F.coalesce(~listed("$.subdomains").startswith("["), F.lit(False))
    domain = normalized_domain(F.col("domain"))
    n = F.coalesce(F.size("expected_pivots"), F.lit(-1))
    own = [
        ("version", ~F.coalesce(F.col("schema_version") == 1, F.lit(False))),
        ("domain", domain.isNull()),
        ("corpus_class", ~F.coalesce(F.col("corpus_class").isin("synthetic", "held_out"), F.lit(False))),
        ("evidence", ~F.coalesce(kind.startswith("OBJECT"), F.lit(False))),
        ("unknown evidence", only(keys("$"), EVIDENCE) | F.coalesce(only(keys("$.whois"), WHOIS), F.lit(False)) | F.coalesce(only(keys("$.basic_intel"), PAGE), F.lit(False))),
        ("evidence kinds", not_list),
        ("evidence domain", ~F.coalesce(normalized_domain(listed("$.domain")) == domain, F.lit(False))),
        ("expected_abstain", F.col("expected_abstain").isNull()),
        ("expected_pivots", n < 0),
        ("abstention", (n >= 0) & (F.col("expected_abstain") == (n > 0))),
    ]
    x = cases.select("case_id", F.posexplode("expected_pivots").alias("ord", "p"))
    alternatives = F.coalesce("p.acceptable_values", F.array().cast("array<string>"))
    keyed = F.transform(F.concat(F.array("p.value"), alternatives), lambda v: normalized_identifier(F.col("p.id_type"), v))
    x = x.select("case_id", "ord", "p.id_type", "p.source_refs", keyed.alias("keys"), F.exists(alternatives, _blank).alias("blank"))
    each = [("pivot references", _refs_missing(F.col("source_refs"))), ("acceptable values", F.col("blank")), ("pivot", F.exists("keys", lambda k: k.isNull()))]
    spread = x.select("case_id", "ord", "id_type", F.explode(F.array_distinct("keys")).alias("k")).where("k is not null")
    again = spread.groupBy("case_id", "id_type", "k").agg(F.count_distinct("ord").alias("n")).where("n > 1")
    again = again.select(F.col("case_id").alias("key"), F.lit("pivots repeat").alias("problem")).distinct()
    return _union([_told(cases, "case_id", own), _told(x, "case_id", each), again])


def policy_problems(sources: DataFrame) -> DataFrame:
    """Of sources (name, tier, declared, raw_retention, normalized_retention, cross_run_cache, export_scope, version): known values, caching across runs only with project retention, and a policy of its own for a paid one."""
    known = lambda c, *names: ~F.coalesce(F.col(c).isin(*names), F.lit(False))
    rules = [
        ("raw retention", known("raw_retention", "none", "hash_only")),
        ("normalized retention", known("normalized_retention", "run", "project")),
        ("export scope", known("export_scope", "none", "derived_only", "normalized")),
        ("version", _blank(F.col("version"))),
        ("caching needs project retention", F.col("cross_run_cache") & (F.col("normalized_retention") != "project")),
        ("paid source without a policy", (F.col("tier") == "paid") & ~F.col("declared")),
    ]
    return _told(sources, "name", rules)


def root_problems(graphs: DataFrame, cases: DataFrame) -> DataFrame:
    """Graphs (case_id, root_domain) whose root isn't their case's."""
    c = cases.select("case_id", owner(F.col("root_domain")).alias("__c"))
    x = graphs.join(c, "case_id").where(~F.coalesce(owner(F.col("root_domain")) == F.col("__c"), F.lit(False)))
    return x.select(F.col("case_id").alias("key"), F.lit("another root").alias("problem")).distinct()


def value_problems(rows: DataFrame, key: str, bounded: tuple[str, ...], required: tuple[str, ...], enums: dict[str, tuple[str, ...]]) -> DataFrame:
    """Values outside 0 .. 1, blank required fields and values outside their list."""
    rules = [(f"{c} outside 0 to 1", ~F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False))) for c in bounded]
    rules += [(f"{c} is blank", _blank(F.col(c).cast("string"))) for c in required]
    rules += [(f"{c} is unknown", ~F.coalesce(F.col(c).isin(*names), F.lit(False))) for c, names in enums.items()]
    return _told(rows, key, rules)
