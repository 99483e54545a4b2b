"""Durable, time-based state on Structured Streaming; each has a batch form in ``operators.usage`` to be tested against."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate_windows(calls: DataFrame, width: str = "1 minute", late: str = "2 hours") -> DataFrame:
    """Calls of each source and window; windows are final and dropped from state after ``late``."""
    w = F.window("started_at", width)
    return calls.withWatermark("started_at", late).groupBy("provider", w.alias("w")).agg(F.count("*").alias("calls")).select("provider", F.col("w.start").alias("window_start"), "calls")


def once(requests: DataFrame, key: str = "request_key", at: str = "started_at", late: str = "2 hours") -> DataFrame:
    """Each request key once within the watermark."""
    return requests.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def circuit_openings(calls: DataFrame, failures: int = 3, cooldown_s: float = 60.0) -> DataFrame:
    """(provider, opened_at, failures) as sources open; the state of a source is its streak and the end of its cooldown."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streak, until = state.get if state.exists else (0, 0.0)
        out, rows = [], pd.concat(list(frames)).sort_values(["started_at", "id"])
        for r in rows.itertuples():
            now = r.started_at.timestamp()
            if now < until or r.status in ("budget_exceeded", "capacity"):
                continue
            streak = 0 if r.status in ("success", "empty") else streak + 1
            if streak and (streak >= failures or r.status == "auth"):
                out.append((key[0], r.started_at, streak))
                streak, until = 0, now + cooldown_s
        state.update((streak, until))
        yield pd.DataFrame(out, columns=["provider", "opened_at", "failures"])

    return calls.select("provider", "id", "status", "started_at").groupBy("provider").applyInPandasWithState(step, "provider string, opened_at timestamp, failures int", "streak int, until double", "append", "NoTimeout")


def task_states(events: DataFrame, max_attempts: int = 3) -> DataFrame:
    """(task_id, status, attempts) after each event of a task: claim, done, error, lease_lost."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, attempts = state.get if state.exists else ("pending", 0)
        for r in pd.concat(list(frames)).sort_values("at").itertuples():
            if r.event == "claim" and status == "pending":
                status, attempts = "in_progress", attempts + 1
            elif r.event == "done" and status == "in_progress":
                status = "succeeded"
            elif r.event in ("error", "lease_lost") and status == "in_progress":
                status = "failed" if attempts >= max_attempts else "pending"
        state.update((status, attempts))
        yield pd.DataFrame([(key[0], status, attempts)], columns=["task_id", "status", "attempts"])

    return events.groupBy("task_id").applyInPandasWithState(step, "task_id long, status string, attempts int", "status string, attempts int", "update", "NoTimeout")
