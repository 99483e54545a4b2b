"""Versions of the stored tables: each adds columns, none changes what is there."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: version -> table -> columns that it adds (name type), in order.
VERSIONS: dict[int, dict[str, tuple[str, ...]]] = {
    1: {
        "observations": ("run_id string", "dedup_key string", "subject_type string", "subject_value_norm string", "predicate string", "object_type string", "object_value_norm string", "source string", "observed_at timestamp", "confidence double"),
        "claims": ("run_id string", "claim_key string", "claim_type string", "confidence_class string", "score double"),
        "calls": ("id string", "run_id string", "provider string", "status string", "started_at timestamp"),
    },
    2: {"calls": ("upstream_requests bigint", "pages bigint")},
    3: {"observations": ("cache_allowed boolean", "export_scope string", "raw_retention string")},
}


def checksum(version: int) -> str:
    return hashlib.sha256(json.dumps(VERSIONS[version], sort_keys=True).encode()).hexdigest()


def columns(table: str, version: int | None = None) -> list[str]:
    """The columns of a table at a version (the last by default)."""
    last = max(VERSIONS) if version is None else version
    return [c for v in sorted(VERSIONS) if v <= last for c in VERSIONS[v].get(table, ())]


def upgraded(rows: DataFrame, table: str, version: int | None = None) -> DataFrame:
    """The rows with the columns of a later version; new ones are null."""
    cols = [c.split(" ", 1) for c in columns(table, version)]
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in cols])


def states(spark: SparkSession, applied: DataFrame) -> DataFrame:
    """(version, state) of the versions known here and of those applied (version, checksum): applied, pending, changed (another checksum) or unknown."""
    known = spark.createDataFrame([(v, checksum(v)) for v in VERSIONS], "version int, own string")
    x = known.join(applied.select(F.col("version").cast("int").alias("version"), "checksum"), "version", "full")
    state = F.when(F.col("own").isNull(), "unknown").when(F.col("checksum").isNull(), "pending")
    return x.select("version", state.when(F.col("own") == F.col("checksum"), "applied").otherwise("changed").alias("state"))
