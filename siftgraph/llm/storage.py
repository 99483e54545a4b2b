"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. A local session, as in tests, may do without one and gets a folder of this machine; on a cluster its absence is an error, since executors don't see each other's folders."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        place = "file://" + tempfile.mkdtemp(prefix="siftgraph-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


#: With it Spark deletes a query's shuffle files as soon as it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of rows that go to a Python worker at once, about.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def written(df: DataFrame, what: str, batch: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends there, lost executors cost nothing, and the shuffles that made it are deleted. ``batch``: the size of batches for Python workers, where rows are large."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftgraph/{what}-{uuid.uuid4().hex}"
    given = {CLEANUP: "true"} | ({BATCH: batch} if batch else {})
    old = {k: spark.conf.get(k, None) for k in given}
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Deletes the written tables that these read, when nothing will read them again."""
    for df in tables:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
