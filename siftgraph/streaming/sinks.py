"""A telemetry sink that a replayed or restarted stream can't fill twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType


def stored(spark, path: str, schema) -> DataFrame:
    """The calls in a sink; an absent or empty one has none."""
    from ..sources.manifest import exists

    full = StructType([*schema.fields, StructField("day", DateType()), StructField("run", StringType()), StructField("batch", LongType())])
    return spark.read.schema(full).parquet(path) if exists(spark, path) else spark.createDataFrame([], full)


def append_batch(batch: DataFrame, path: str, run: str, number: int, key: str = "id", at: str = "started_at") -> None:
    """Adds a micro-batch's calls that no other batch holds, the first of each id (by time, then by its columns in order).

    The batch's rows replace what the same run wrote under the same number, so a batch that is done again
    after a crash adds nothing. Ids stored by other runs (a checkpoint was lost and the stream begins anew)
    are left out by a join on day and id, which reads the days of the batch only.
    """
    spark, columns = batch.sparkSession, batch.columns
    others = [F.col(c) for c in columns if c not in (key, at)]
    first = batch.groupBy(key).agg(F.min(F.struct(F.col(at), *others)).alias("r")).select(key, "r.*").select(*columns)
    first = first.withColumn("day", F.to_date(at))
    held = stored(spark, path, batch.schema).where(~((F.col("run") == run) & (F.col("batch") == number))).select("day", key)
    new = first.join(held, ["day", key], "left_anti").withColumn("run", F.lit(run)).withColumn("batch", F.lit(number).cast("long"))
    # Of this batch's own earlier files those that it doesn't write again hold nothing else: the same rows give the same partitions.
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "run", "batch").parquet(path)


def sink(calls: DataFrame, path: str, checkpoint: str, key: str = "id", at: str = "started_at") -> StreamingQuery:
    """Starts a stream of calls into the sink at ``path``, over what there is; the run's name is the one that its checkpoint keeps."""

    def add(batch: DataFrame, number: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        append_batch(batch, path, run, number, key, at)

    return calls.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
