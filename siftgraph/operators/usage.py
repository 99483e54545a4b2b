"""Telemetry: usage, budgets, rate windows, leases, circuits, tasks and retention."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def by_source(calls: DataFrame) -> DataFrame:
    measures = ("attempts", "upstream_requests", "pages", "units", "latency_ms")
    return calls.groupBy("provider", "capability", "status", "billable").agg(F.count("*").alias("calls"), *[F.sum(m).alias(m) for m in measures])


def degraded_runs(calls: DataFrame) -> DataFrame:
    """(run_id, status): a run with a failing call is completed, but degraded."""
    bad = F.bool_or(~F.col("status").isin("success", "empty"))
    return calls.groupBy("run_id").agg(F.when(bad, "completed_degraded").otherwise("completed").alias("status"), F.count("*").alias("calls"))


def rate_windows(calls: DataFrame, width: str = "1 minute", ts: str = "started_at") -> DataFrame:
    w = F.window(ts, width)
    return calls.groupBy("provider", w.alias("w")).agg(F.count("*").alias("calls")).select("provider", F.col("w.start").alias("window_start"), "calls")


def peak_leases(leases: DataFrame, bucket: str = "day") -> DataFrame:
    """The most leases held at once by each provider: a sweep over starts and ends, ends first.

    Changes are summed by instant, then by bucket of time; the buckets' running sums say what is held when one
    begins, so the sweep within a bucket is a task of its own, however long a provider's history is.
    """
    change = lambda c, d: F.struct(F.col(c).alias("at"), F.lit(d).alias("d"))
    ends = leases.select("provider", F.explode(F.array(change("created_at", 1), change("expires_at", -1))).alias("e")).select("provider", "e.*")
    steps = ends.groupBy("provider", "at", "d").agg(F.sum("d").alias("s")).withColumn("b", F.date_trunc(bucket, "at"))
    totals = steps.groupBy("provider", "b").agg(F.sum("s").alias("t"))
    before = Window.partitionBy("provider").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("provider", "b", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("provider", "b").orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0)
    held = steps.withColumn("held", F.sum("s").over(within)).groupBy("provider", "b").agg(F.max("held").alias("held"))
    # A bucket whose first change is an end is held least at its start, so its start is looked at by the bucket before.
    return held.join(totals, ["provider", "b"]).groupBy("provider").agg(F.max(F.col("base") + F.col("held")).alias("peak"))


def fifo_heads(waiters: DataFrame, since: Column | None = None) -> DataFrame:
    """(provider, id, created_at) of each source's first waiter; those who came before ``since`` have given up."""
    waiting = waiters if since is None else waiters.where(F.col("created_at") >= since)
    return waiting.groupBy("provider").agg(F.min(F.struct("created_at", "id")).alias("h")).select("provider", "h.id", "h.created_at")


def leases_granted(asked: DataFrame, limit: int) -> DataFrame:
    """Asked leases (provider, id, created_at, expires_at) in order, each granted if fewer than ``limit`` granted ones of its source still run.

    What is granted depends on all before it; a source's rows stream through one task that holds ``limit`` instants.
    """
    cols = ["provider", "id", "created_at", "expires_at"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for p in frames:
            ok = []
            for who, start, end in zip(p["provider"], p["created_at"], p["expires_at"]):
                if who != now:
                    now, held = who, []
                held = [e for e in held if e > start]
                ok.append(len(held) < limit)
                if ok[-1]:
                    held.append(end)
            yield p[ok]

    rows = asked.select(*cols)
    return in_order(rows, "provider", ["created_at", "id"]).mapInPandas(run, rows.schema)


def latest(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The value of the row that comes last of each key; an aggregation combined before its shuffle."""
    return rows.groupBy(*keys).agg(F.max_by(F.col(value), F.struct(*order)).alias(value))


def task_summary(tasks: DataFrame, statuses: tuple[str, ...] = ("pending", "in_progress", "succeeded", "failed")) -> DataFrame:
    """A row for each status, also where no task has it."""
    names = tasks.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return names.join(tasks.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def runnable(tasks: DataFrame, now: Column) -> DataFrame:
    """Pending tasks whose time has come, and ones whose lease ran out with attempts left."""
    waiting = (F.col("status") == "pending") & (F.col("available_at") <= now)
    lost = (F.col("status") == "in_progress") & (F.col("lease_until") < now) & (F.col("attempts") < F.col("max_attempts"))
    return tasks.where(waiting | lost)


def next_task(tasks: DataFrame, keys: list[str]) -> DataFrame:
    return tasks.groupBy(*keys).agg(F.min_by("id", F.struct((-F.col("priority")).alias("p"), "created_at", "id")).alias("id"))


def in_order(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key's rows in one task, in order, for a fold whose state is a few numbers: rows stream through it and are never held together."""
    return rows.repartition(key).sortWithinPartitions(key, *order)


#: How far a cost may exceed what is left: sums of binary fractions aren't exact.
TOLERANCE = 1e-9


def admitted(
    requests: DataFrame,
    key: str,
    cost: str,
    order: list[str],
    budget: float,
    max_calls: int = -1,
    billable: str | None = None,
) -> DataFrame:
    """Requests in order, each admitted if it fits what is left of its key's ceilings; one that doesn't consumes nothing.

    A ceiling below 0 is none. Only ``billable`` requests (all, if None) cost units. What is admitted depends on all
    before it, so a key's rows are one ordered stream through one task, of which nothing is held.
    """
    paid = F.lit(True) if billable is None else F.coalesce(F.col(billable), F.lit(False))
    rows = requests.select(key, *order, cost, F.when(paid, F.coalesce(F.col(cost), F.lit(0.0))).otherwise(0.0).cast("double").alias("__cost"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, calls = None, 0.0, 0
        for p in frames:
            ok = []
            for k, c in zip(p[key].tolist(), p["__cost"].tolist()):
                if k != now:
                    now, used, calls = k, 0.0, 0
                fits = (max_calls < 0 or calls < max_calls) and (budget < 0 or used + c <= budget + TOLERANCE)
                if fits:
                    used, calls = used + c, calls + 1
                ok.append(fits)
            yield p[ok].drop(columns="__cost")

    return in_order(rows, key, order).mapInPandas(run, requests.select(key, *order, cost).schema)


def circuits(calls: DataFrame, failures: int = 3, cooldown_s: float = 60.0) -> DataFrame:
    """(provider, opened_at, failures): a source opens after so many failures in a row (one for ``auth``), stays open for a while, and calls in that time don't happen."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, streak, until = None, 0, None
        for p in frames:
            out = []
            for who, status, at in zip(p["provider"], p["status"], p["started_at"]):
                if who != now:
                    now, streak, until = who, 0, None
                if (until is not None and at < until) or status in ("budget_exceeded", "capacity"):
                    continue
                streak = 0 if status in ("success", "empty") else streak + 1
                if streak and (streak >= failures or status == "auth"):
                    out.append((who, at, streak))
                    until, streak = at + pd.Timedelta(seconds=cooldown_s), 0
            yield pd.DataFrame(out, columns=["provider", "opened_at", "failures"])

    rows = calls.select("provider", "id", "status", F.col("started_at").cast("timestamp").alias("started_at"))
    return in_order(rows, "provider", ["started_at", "id"]).mapInPandas(run, "provider string, opened_at timestamp, failures int")


def retention(runs: DataFrame, before: Column) -> DataFrame:
    """Runs to delete: finished ones of before the cutoff."""
    return runs.where((F.col("started_at") < before) & (F.col("status") != "running"))


def instant(at: Column) -> Column:
    """A timestamp text as an instant; one without a zone is UTC, whatever the session's zone."""
    zoned = at.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    return F.try_to_timestamp(F.when(zoned, at).otherwise(F.concat(at, F.lit("Z"))))


def fresh(at: Column, now: Column, ttl_hours: float) -> Column:
    """Whether a cache entry may still be used; a bad timestamp may not, and no positive lifetime means never."""
    age = now - instant(at)
    return F.lit(ttl_hours > 0) & F.coalesce(age <= F.make_dt_interval(F.lit(0), F.lit(int(ttl_hours))), F.lit(False))


def run_summary(runs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, root_domain, status, domains, identifiers, edges) of each run; 0 where it has none."""
    n = nodes.groupBy("run_id").agg(F.count_if(F.col("node_type") == "domain").alias("domains"), F.count_if(F.col("node_type") == "identifier").alias("identifiers"))
    e = edges.groupBy("run_id").agg(F.count("*").alias("edges"))
    out = runs.select("run_id", "root_domain", "status").join(n, "run_id", "left").join(e, "run_id", "left")
    return out.select("run_id", "root_domain", "status", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("domains", "identifiers", "edges")])


def progress(nodes: DataFrame, processed: DataFrame, tasks: DataFrame) -> DataFrame:
    """(run_id, nodes, processed, runnable) of each run that has any."""
    n = nodes.groupBy("run_id").agg(F.count("*").alias("nodes"))
    p = processed.groupBy("run_id").agg(F.count("*").alias("processed"))
    left = (F.col("status") == "pending") & (F.col("attempts") < F.col("max_attempts"))
    t = tasks.groupBy("run_id").agg(F.count_if(left).alias("runnable"))
    out = n.join(p, "run_id", "full").join(t, "run_id", "full")
    return out.select("run_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("nodes", "processed", "runnable")])


def observations_by_source(observations: DataFrame) -> DataFrame:
    return observations.groupBy("run_id", "source").agg(F.count("*").alias("observations"))


def next_expiry(leases: DataFrame, now: Column) -> DataFrame:
    """(provider, expires_at): when the next of each source's running leases ends."""
    return leases.where(F.col("expires_at") > now).groupBy("provider").agg(F.min("expires_at").alias("expires_at"))


def resumable(runs: DataFrame) -> DataFrame:
    """(root_domain, run_id): the latest run of each root that stopped on the way."""
    stopped = runs.where(F.col("status").isin("interrupted", "running", "partial"))
    return stopped.groupBy("root_domain").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))


def requeued(tasks: DataFrame) -> DataFrame:
    """The tasks of a resumed run: those in progress wait again, or fail if they have no attempt left."""
    stuck = F.col("status") == "in_progress"
    spent = F.col("attempts") >= F.col("max_attempts")
    error = F.when(stuck & spent, F.coalesce("last_error", F.lit("run stopped after maximum attempts"))).otherwise(F.col("last_error"))
    return tasks.withColumn("last_error", error).withColumn("status", F.when(stuck & spent, "failed").when(stuck, "pending").otherwise(F.col("status")))


# How typed errors end a call, and whether it may be tried again.
ERRORS = {
    "security": ("error", False), "auth": ("auth_error", False), "input": ("error", False), "malformed": ("malformed", False), "capacity": ("rate_limited", False),
    "rate_limit": ("rate_limited", True), "timeout": ("timeout", True),
}


def classified(errors: DataFrame) -> DataFrame:
    """``errors`` (kind, http_status) with the call's ``status`` and whether it is ``retryable``: by kind, else by HTTP status, else an error that may pass."""
    status = again = None
    for kind, (name, retry) in ERRORS.items():
        status = (F.when if status is None else status.when)(F.col("kind") == kind, name)
        again = (F.when if again is None else again.when)(F.col("kind") == kind, retry)
    denied, many = F.col("http_status").isin(401, 403), F.col("http_status") == 429
    status = status.when(denied, "auth_error").when(many, "rate_limited").otherwise("error")
    again = again.when(denied, False).otherwise(True)
    return errors.withColumn("status", status).withColumn("retryable", again)


def backoff_s(attempt: Column) -> Column:
    """Seconds to wait after the n-th attempt: a tenth doubled each time, one at most."""
    return F.least(F.lit(1.0), F.lit(0.1) * F.pow(F.lit(2.0), attempt - 1))


def over_result_limits(results: DataFrame) -> DataFrame:
    """(id, problem) of results (id, payload, max_bytes, max_items): larger than allowed, or with an array or object anywhere that has more items."""
    size = F.octet_length("payload") > F.col("max_bytes")
    items = largest_collection("payload") > F.col("max_items")
    found = F.array_compact(F.array(F.when(items, "items"), F.when(size, "bytes")))
    return results.select("id", F.explode(found).alias("problem"))


@F.pandas_udf(LongType())
def largest_collection(payload: pd.Series) -> pd.Series:
    """Most items of any array or object of a JSON text, at any depth; 0 for other text. Built-in functions don't recur."""
    import json

    def size(x) -> int:
        most, todo = 0, [x]
        while todo:
            y = todo.pop()
            if isinstance(y, dict):
                most, todo = max(most, len(y)), todo + list(y.values())
            elif isinstance(y, list):
                most, todo = max(most, len(y)), todo + y
        return most

    def one(s) -> int:
        try:
            return size(json.loads(s))
        except (TypeError, ValueError):
            return 0

    return payload.map(one, na_action="ignore").fillna(0).astype("int64")
