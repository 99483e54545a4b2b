"""Backups with a manifest: what each table held, which keys are its own, and which rows refer to which.

A table's digest doesn't depend on the order of its rows: it is the number of rows and four sums
over the digests of their canonical JSON, so a row changed, lost, added or repeated
changes it. ``problems`` reads a backup and compares; ``restore`` refuses one that has any,
names them, and else makes all tables visible in a store as one wave. What the store held
before stays readable as its former version.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical_row, raw_hash
from .exports import duplicate_keys, orphans
from .manifest import Store, _created, exists

#: Hexadecimal digits of a digest that make one number (60 bits).
PIECE = 15


def digest(rows: DataFrame) -> DataFrame:
    """One row: rows, digest. One pass, a few numbers from each task."""
    hashes = rows.select(raw_hash(canonical_row(rows)).alias("h"))
    piece = lambda k: F.coalesce(F.sum(F.conv(F.substring("h", 1 + k * PIECE, PIECE), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return hashes.agg(F.count("*").alias("rows"), F.concat_ws("-", *[piece(k) for k in range(4)]).alias("digest"))


def backup(tables: dict[str, DataFrame], folder: str, keys: dict[str, list[str]] | None = None, references: list[tuple[str, str, str, str]] = ()) -> dict:
    """Writes the tables and then their manifest; ``references`` are (child, column, parent, column). A folder that exists is never replaced; without a manifest it is no backup."""
    keys = keys or {}
    spark = next(iter(tables.values())).sparkSession
    if exists(spark, folder):
        raise FileExistsError(folder)
    entries = {}
    for name, rows in tables.items():
        rows.write.mode("error").option("compression", "zstd").parquet(f"{folder}/{name}")
        kept = spark.read.schema(rows.schema).parquet(f"{folder}/{name}")  # what was written counts, not what a second run of the plan gives
        entries[name] = digest(kept).first().asDict() | {"keys": list(keys.get(name, ())), "schema": json.loads(rows.schema.json())}
    manifest = {"format": 1, "tables": entries, "references": [list(r) for r in references]}
    if not _created(spark, f"{folder}/manifest.json", json.dumps(manifest, sort_keys=True)):
        raise FileExistsError(f"{folder}/manifest.json")
    return manifest


def _manifest(spark: SparkSession, folder: str) -> dict:
    if not exists(spark, f"{folder}/manifest.json"):
        raise ValueError(f"{folder} has no manifest")
    return json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first()[0])


def contents(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A backup's tables, unchecked; a missing one is empty."""
    from pyspark.sql.types import StructType

    out = {}
    for name, e in _manifest(spark, folder)["tables"].items():
        schema, path = StructType.fromJson(e["schema"]), f"{folder}/{name}"
        out[name] = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    return out


def problems(spark: SparkSession, folder: str) -> DataFrame:
    """(part, problem, n) of a backup: rows lost or added, other contents, repeated keys, rows whose parent is missing."""
    m, tables = _manifest(spark, folder), contents(spark, folder)
    found = spark.createDataFrame([], "part string, problem string, n long")
    for name, e in m["tables"].items():
        # One pass gives both: two rows at most are made of the digest's one.
        kinds = [(F.col("rows") != e["rows"], "rows", F.col("rows") - e["rows"]), (F.col("digest") != e["digest"], "contents", F.lit(1).cast("long"))]
        told = F.array(*[F.when(odd, F.struct(F.lit(kind).alias("problem"), n.alias("n"))) for odd, kind, n in kinds])
        now = digest(tables[name]).select(F.explode(told).alias("x")).where("x is not null")
        found = found.union(now.select(F.lit(name), "x.problem", "x.n"))
        if e["keys"]:
            found = found.union(duplicate_keys(tables[name], e["keys"]).agg(F.count("*").alias("n")).where("n > 0").select(F.lit(name), F.lit("repeated keys"), "n"))
    for child, column, parent, key in m["references"]:
        known = tables[child].where(F.col(column).isNotNull())
        lost = orphans(known, tables[parent].select(key).distinct(), column, key).agg(F.count("*").alias("n")).where("n > 0")
        found = found.union(lost.select(F.lit(f"{child}.{column}"), F.lit(f"no {parent}.{key}"), "n"))
    return found.select("part", "problem", F.col("n").cast("long").alias("n"))


def restore(store: Store, folder: str, wave: str) -> int:
    """Replaces the store's tables by a backup's, all at once; gives the version. A backup with problems is refused."""
    told = problems(store.spark, folder).collect()  # a few rows
    if told:
        raise ValueError("backup refused: " + "; ".join(f"{x['part']}: {x['problem']} ({x['n']})" for x in sorted(told)))
    return store.commit(contents(store.spark, folder), wave, replace=True)
