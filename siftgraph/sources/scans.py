"""Scans of graph exports and evaluation cases that set bad parts aside instead of failing.

A file (or, with ``lines``, a line) holds one JSON object. What isn't one is refused whole; of
a graph each node and edge is parsed for itself, so a malformed one is refused alone,
with its file, its place in the list, its text and a reason, and the others are read.
Empty files have no row: Spark skips them.
Whole files are rows of one task each, so exports of any number are spread, but one of
many GB should be written as lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validation as va

CORRUPT = "_unreadable"
#: Of each list the fields of an element and those that it must have.
PARTS = {
    "nodes": ("id string, node_type string, value_norm string, metadata_json string", ("id", "node_type", "value_norm")),
    "edges": ("id string, from_node_id string, to_node_id string, relation_type string, depth int, source string, confidence double", ("from_node_id", "to_node_id", "relation_type")),
}
REFUSED = "file string, run_id string, part string, place int, reason string, text string"


def parsed(text: Column, schema: str) -> Column:
    """A JSON object by a schema; what doesn't fit stands whole in the field ``_unreadable``."""
    return F.from_json(text, f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def texts(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """(file, text) of a path's files or lines; empty lines are none."""
    raw = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return raw.where(F.trim("text") != "") if lines else raw


def _object(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"^\s+", "")).startswith("{")


def graphs(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, refused) of the exports at a path."""
    whole = texts(spark, path, lines).withColumn("g", parsed(F.col("text"), "run struct<id:string,root_domain:string,status:string>, nodes array<string>, edges array<string>"))
    reason = F.when(~_object(F.col("text")) | F.col(f"g.{CORRUPT}").isNotNull() | F.col("g").isNull(), "not a graph").when(F.coalesce(F.trim("g.run.id"), F.lit("")) == "", "no run")
    whole = whole.select("file", "text", "g", reason.alias("reason"))
    refused = whole.where("reason is not null").select("file", F.lit(None).cast("string").alias("run_id"), F.lit("graph").alias("part"), F.lit(None).cast("int").alias("place"), "reason", "text")
    out = []
    for part, (schema, needed) in PARTS.items():
        each = whole.where("reason is null").select("file", F.col("g.run.id").alias("run_id"), F.col("g.run.root_domain").alias("root_domain"), F.posexplode(f"g.{part}").alias("place", "text"))
        each = each.withColumn("e", parsed(F.col("text"), schema))
        bad = F.when(F.col("text").isNull() | ~_object(F.col("text")) | F.col(f"e.{CORRUPT}").isNotNull(), "not an object")
        for field in needed:
            bad = bad.when(F.coalesce(F.trim(f"e.{field}"), F.lit("")) == "", f"no {field}")
        each = each.select("file", "run_id", "root_domain", "place", "text", "e", bad.alias("reason"))
        refused = refused.unionByName(each.where("reason is not null").select("file", "run_id", F.lit(part).alias("part"), "place", "reason", "text"))
        fields = [f.split()[0] for f in schema.split(", ")]
        out.append(each.where("reason is null").select("file", "run_id", "root_domain", *[F.col(f"e.{f}").alias("node_id" if (part, f) == ("nodes", "id") else f) for f in fields]))
    return out[0], out[1], refused


def cases(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cases that keep the rules, problems of the others as file, key and problem) of the files at a path. A key is the case's id, or null where the text isn't a case at all."""
    read = texts(spark, path, lines).withColumn("c", parsed(F.col("text"), va.CASE))
    broken = ~_object(F.col("text")) | F.col(f"c.{CORRUPT}").isNotNull() | F.col("c").isNull()
    told = read.where(broken).select("file", F.lit(None).cast("string").alias("key"), F.lit("not a case").alias("problem"))
    whole = read.where(~broken).select("file", "c.*").drop(CORRUPT)
    found = va.case_problems(whole)
    files = whole.select(F.col("case_id").alias("key"), "file")
    problems = found.join(files, F.coalesce(found["key"], F.lit("")) == F.coalesce(files["key"], F.lit("")), "left").select("file", found["key"], "problem").distinct()
    good = whole.join(found.select(F.coalesce("key", F.lit("")).alias("__k")), F.coalesce("case_id", F.lit("")) == F.col("__k"), "left_anti")
    return good, told.unionByName(problems)
