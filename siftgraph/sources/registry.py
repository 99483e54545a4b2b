"""The known sources as a dimension table: what each answers, what it may be asked, what it may keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Capability, name, lineage family, tier, calls at once, calls a minute, requests an attempt, items a result.
SOURCES = (
    ("whois", "rdap-iana", "domain-registration-registry", "free", 4, 60, 30, 100),
    ("whois", "python-whois", "domain-registration-registry", "free", 2, 30, 1, 100),
    ("basic_info", "http-html", "current-origin-web", "free", 8, 60, 12, 50),
    ("reverse_whois", "duckduckgo", "web-search-index", "free", 3, 30, 1, 100),
    ("reverse_whois", "whoxy", "commercial-whois-history", "paid", 2, 20, 1, 2500),
    ("subdomains", "subfinder", "multi-upstream-wrapper", "free", 1, 6, 1, 10000),
    ("subdomains", "crtsh", "certificate-transparency", "free", 2, 10, 6, 10000),
    ("subdomains", "hackertarget", "hackertarget-aggregate", "free", 1, 5, 6, 10000),
    ("dns", "stdlib", "authoritative-dns", "free", 20, 600, 6, 1000),
    ("acquisitions", "wikidata", "wikidata-community-graph", "free", 3, 120, 22, 100),
    ("acquisitions", "gleif", "gleif-lei-register", "free", 2, 60, 5, 100),
    ("acquisitions", "sec-edgar", "sec-regulatory-filings", "free", 1, 30, 7, 20),
    ("historical_web", "wayback", "internet-archive", "free", 1, 10, 8, 4),
)

_COLUMNS = "capability string, name string, family string, tier string, concurrency int, per_minute int, request_limit int, max_items int"


def sources(spark: SparkSession, unavailable: tuple[str, ...] = ()) -> DataFrame:
    """The table, with ``ord`` (order of registration), ``billable`` and ``available``."""
    rows = spark.createDataFrame([(*s, i) for i, s in enumerate(SOURCES)], _COLUMNS + ", ord int")
    return rows.withColumn("billable", F.col("tier") == "paid").withColumn("available", ~F.col("name").isin(*unavailable) if unavailable else F.lit(True))


def usable(table: DataFrame, capability: str, pinned: str | None = None) -> DataFrame:
    """Available sources of a capability, paid before free, then as registered; a pinned one alone."""
    own = table.where((F.col("capability") == capability) & F.col("available"))
    return own.where(F.col("name") == pinned) if pinned else own.orderBy(F.when(F.col("tier") == "paid", 0).otherwise(1), "ord")


def choices(table: DataFrame, pinned: dict[str, str] | None = None) -> DataFrame:
    """``usable`` for every capability at once, with the ``place`` of each source; of a pinned capability its source alone."""
    ok = F.col("available")
    for capability, name in (pinned or {}).items():
        ok = ok & ((F.col("capability") != capability) | (F.col("name") == name))
    place = F.row_number().over(Window.partitionBy("capability").orderBy(F.when(F.col("tier") == "paid", 0).otherwise(1), "ord"))
    return table.where(ok).withColumn("place", place)


def with_policy(observations: DataFrame, policies: DataFrame) -> DataFrame:
    """Observations with the data policy of their source (``source, cache_allowed, export_scope, raw_retention``), a table as small as the registry; others keep the default."""
    p = F.broadcast(policies)
    out = observations.join(p, "source", "left")
    return out.withColumn("cache_allowed", F.coalesce("cache_allowed", F.lit(True))).withColumn("export_scope", F.coalesce("export_scope", F.lit("normalized"))).withColumn("raw_retention", F.coalesce("raw_retention", F.lit("hash_only")))


def over_limits(calls: DataFrame, table: DataFrame) -> DataFrame:
    """Recorded attempts that made more requests than their source may."""
    return calls.join(F.broadcast(table.select(F.col("name").alias("provider"), "request_limit")), "provider").where(F.col("upstream_requests") > F.col("attempts") * F.col("request_limit"))


def diagnostics(table: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """(capability, name, tier, state) of sources with what they lack (missing_environment, invalid_environment, missing_executables: arrays), without asking the network: the first of disabled, dependency_missing, configuration_invalid, configuration_missing that holds, else ready."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    off = F.col("name").isin(*disabled) if disabled else F.lit(False)
    state = (
        F.when(off, "disabled")
        .when(some("missing_executables"), "dependency_missing")
        .when(some("invalid_environment"), "configuration_invalid")
        .when(some("missing_environment"), "configuration_missing")
        .otherwise("ready")
    )
    return table.select("capability", "name", "tier", state.alias("state"))
