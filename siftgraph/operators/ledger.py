"""Writes and lookups of the ledger: evidence links, nodes with metadata, caches, waves, and what stands behind a claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evidence import append, family, first_of, stable_hash

LINK_KEY = ["claim_id", "observation_id", "polarity"]
NODE_KEY = ["run_id", "node_type", "value_norm"]
#: What makes an edge, a lineage step, a pivot's choice and a processed domain one; their other columns come from the first.
EDGE_KEY = ["run_id", "from_node_id", "to_node_id", "relation_type", "depth", "source"]
LINEAGE_KEY = ["run_id", "child_node_id", "parent_node_id"]
PIVOT_KEY = ["run_id", "domain_node_id", "identifier_value_norm", "identifier_type"]
PROCESSED_KEY = ["run_id", "domain_node_id"]


def link_problem() -> Column:
    """What is wrong with an evidence link: polarity, weight or reason; null where nothing is."""
    blank = F.coalesce(F.trim("reason"), F.lit("")) == ""
    weight = ~F.coalesce(F.col("weight").between(0.0, 1.0) & ~F.isnan("weight"), F.lit(False))
    polarity = ~F.coalesce(F.col("polarity").isin("supports", "contradicts"), F.lit(False))
    return F.when(polarity, "polarity").when(weight, "weight").when(blank, "reason")


def evidence_links(links: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(links to add, links that break a rule with the ``problem``). Of one claim, observation and polarity the first wins."""
    marked = links.withColumn("problem", link_problem())
    good = marked.where("problem is null").drop("problem")
    return append(good, LINK_KEY, stored), marked.where("problem is not null")


def nodes(created: DataFrame) -> DataFrame:
    """(run_id, node_type, value_norm, node_id, value_hash, metadata): the first creator (``seq``) sets the metadata, a map of texts. Maps can't be compared, so entries travel as a sorted array."""
    entries = F.array_sort(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>"))))
    first = first_of(created.select(*NODE_KEY, "seq", entries.alias("entries")), NODE_KEY)
    node_id, value_hash = stable_hash(*NODE_KEY).alias("node_id"), F.sha2("value_norm", 256).alias("value_hash")
    return first.select(*NODE_KEY, node_id, value_hash, F.map_from_entries("entries").alias("metadata"))


def with_metadata(nodes_: DataFrame, updates: DataFrame) -> DataFrame:
    """The nodes with the updates (node_id, seq, metadata) merged into their metadata, key by key the latest; updates of unknown nodes count for nothing."""
    own = nodes_.select("node_id", F.lit(-1).cast("long").alias("seq"), F.explode("metadata").alias("k", "v"))
    new = updates.select("node_id", F.col("seq").cast("long").alias("seq"), F.explode("metadata").alias("k", "v"))
    last = own.unionByName(new).groupBy("node_id", "k").agg(F.max_by("v", "seq").alias("v"))
    merged = last.groupBy("node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("__m"))
    out = nodes_.join(merged, "node_id", "left")
    return out.withColumn("metadata", F.coalesce("__m", "metadata")).drop("__m")


def upserted(table: DataFrame, rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The table with each key's whole row replaced by its latest one (``at``; a tie goes to the new row)."""
    rest = [c for c in table.columns if c not in keys]
    both = table.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, "__new")).alias("__r"))
    return last.select(*keys, "__r.*").select(*table.columns)


def commit_wave(rows: DataFrame, path: str, wave: int) -> DataFrame:
    """Writes one wave's rows as a partition of its own and reads the table. Written again, a wave replaces itself; a failed write leaves what was there."""
    spark = rows.sparkSession
    out = rows.withColumn("wave", F.lit(wave)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("wave").parquet(path)
    return spark.read.parquet(path)


def rows_of(runs: DataFrame, table: DataFrame) -> DataFrame:
    """The rows of a run-scoped table that go with runs to be deleted: a semi join."""
    return table.join(runs.select("run_id").distinct(), "run_id", "left_semi")


def without_runs(runs: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every run-scoped table without the rows of those runs; a table written by run drops their partitions instead."""
    return {name: rows.join(runs.select("run_id").distinct(), "run_id", "left_anti") for name, rows in tables.items()}


def append_calls(calls: DataFrame, stored: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Telemetry rows to append: each call once, none that is stored already."""
    new = calls.dropDuplicates([key])
    return new if stored is None else new.join(stored.select(key), key, "left_anti")


def evidence_of_claims(claims: DataFrame, links: DataFrame, observations: DataFrame) -> DataFrame:
    """A row for each piece of evidence of each claim, with its observation, its source family and its ``place``: by polarity, then creation."""
    o = observations.select("observation_id", "source", "predicate", F.col("subject_value_norm").alias("subject"), F.col("object_value_norm").alias("object"))
    rows = links.join(o, "observation_id").join(claims.select("claim_id"), "claim_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("claim_id").orderBy("polarity", "created_at", "observation_id"))
    return rows.withColumn("source_family", family(F.col("source"))).withColumn("place", place)


def observations_for(asked: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations of each asked (run_id, subject_value_norm, object_value_norm), the object compared without case, with their ``place``: the surest first, then the earliest."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    keys = ["run_id", "subject_value_norm"]
    a = asked.select(*keys, F.col("object_value_norm").alias("asked"), low(F.col("object_value_norm")).alias("__o")).distinct()
    rows = a.join(observations.withColumn("__o", low(F.col("object_value_norm"))), [*keys, "__o"]).drop("__o")
    w = Window.partitionBy(*keys, "asked").orderBy(F.desc("confidence"), "observed_at", "observation_id")
    return rows.withColumn("place", F.row_number().over(w))


_FIELDS = ("subject_type", "subject_value_norm", "predicate", "source", "observed_at", "dedup_key")
_MORE = ("object_type", "object_value_norm", "source_record_id", "valid_from", "valid_to", "raw_hash")
_SCHEMA = ",".join(f"{c}:string" for c in (*_FIELDS, *_MORE)) + ",confidence:double,cache_allowed:boolean,export_scope:string,raw_retention:string"


def to_json(observations: DataFrame) -> Column:
    """An observation as JSON, its keys in the order of the columns, nulls left out."""
    return F.to_json(F.struct(*observations.columns))


def from_json(serialized: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """(observations, texts that aren't one): the required keys must be there; others take their defaults."""
    x = serialized.withColumn("o", F.from_json(column, f"struct<{_SCHEMA}>"))
    whole = F.lit(True)
    for c in _FIELDS:
        whole = whole & F.col(f"o.{c}").isNotNull()
    whole = F.coalesce(whole, F.lit(False))
    o = x.where(whole).select(*[F.col(f"o.{c}") for c in (*_FIELDS, *_MORE)], F.coalesce("o.confidence", F.lit(0.0)).alias("confidence"),
                              F.coalesce("o.cache_allowed", F.lit(True)).alias("cache_allowed"), F.coalesce("o.export_scope", F.lit("normalized")).alias("export_scope"),
                              F.coalesce("o.raw_retention", F.lit("hash_only")).alias("raw_retention"))
    return o, x.where(~whole).select(column)
