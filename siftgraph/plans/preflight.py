"""The plan before a run: which sources may be used, what each step costs at worst, what exceeds a ceiling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOURCES = "name string, capability string, tier string, billable boolean, available boolean, request_limit int, ord int"


@dataclass(frozen=True)
class Settings:
    profile: str = "free"
    paid_approved: bool = False
    subdomains: bool = True
    history: bool = False
    acquisitions: bool = True
    pivot_top_k: int = 5
    domains_per_identifier: int = 10
    max_domains: int = 500
    max_calls: int = 500
    max_units: float = 0.0
    retries: int = 2


def status(sources: DataFrame, s: Settings) -> DataFrame:
    """Each source with its ``state``: unavailable, policy_excluded, approval_gated or selected."""
    paid = F.col("billable") | (F.col("tier") == "paid")
    state = F.when(~F.col("available"), "unavailable").when(paid & F.lit(s.profile == "free"), "policy_excluded").when(paid & F.lit(s.profile == "byok" and not s.paid_approved), "approval_gated").otherwise("selected")
    return sources.withColumn("state", state)


def steps(sources: DataFrame, s: Settings) -> DataFrame:
    """(capability, step, sources, calls, requests, billable) per domain. Cascades use all sources of a capability, other steps the first, paid before free."""
    use = status(sources, s).where("state = 'selected'").withColumn("rank", F.when(F.col("tier") == "paid", 0).otherwise(1))
    item = F.array_sort(F.collect_list(F.struct("rank", "ord", "name", "request_limit", "billable")))
    by = use.groupBy("capability").agg(item.alias("all"))
    n = F.size("all")
    has_reverse = by.where("capability = 'reverse_whois'").select(F.lit(True).alias("reverse"))
    rules = [("whois", "whois", True, n, True), ("basic_info", "basic_info", False, F.lit(1), True), ("dns", "dns", False, F.lit(1), True), ("subdomains", "subdomains", True, n, s.subdomains), ("historical_web", "historical_web", False, F.lit(1), s.history), ("reverse_whois", "reverse_whois", False, F.lit(s.pivot_top_k), True), ("acquisitions", "acquisitions", True, n * s.pivot_top_k, s.acquisitions)]
    out = None
    for cap, step, every, calls, on in rules:
        if on:
            row = by.where(F.col("capability") == cap).select(F.lit(step).alias("step"), F.col("all") if every else F.slice("all", 1, 1).alias("all"), calls.cast("long").alias("calls"))
            out = row if out is None else out.unionByName(row)
    verify = by.where("capability = 'basic_info'").crossJoin(F.broadcast(has_reverse)).select(F.lit("tracker_verification").alias("step"), F.slice("all", 1, 1).alias("all"), F.lit(s.pivot_top_k * s.domains_per_identifier).cast("long").alias("calls"))  # one row by one row
    out = out.unionByName(verify).where("calls > 0")
    return out.select("step", F.transform("all", lambda x: x["name"]).alias("sources"), "calls", F.array_max(F.transform("all", lambda x: x["request_limit"])).cast("long").alias("requests_per_call"), F.exists("all", lambda x: x["billable"]).alias("billable"))


def totals(plan: DataFrame, s: Settings) -> DataFrame:
    """One row: worst-case calls, requests and paid units over all domains, and whether each exceeds its ceiling."""
    m = s.max_domains
    out = plan.agg((F.coalesce(F.sum("calls"), F.lit(0)) * m).alias("calls"), (F.coalesce(F.sum(F.col("calls") * F.col("requests_per_call")), F.lit(0)) * m).alias("requests"), (F.coalesce(F.sum(F.when(F.col("billable"), F.col("calls") * (s.retries + 1))), F.lit(0)) * m).cast("double").alias("units"))
    return out.withColumn("calls_exceed", F.col("calls") > s.max_calls).withColumn("units_exceed", F.col("units") > s.max_units)
