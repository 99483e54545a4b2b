"""Queries that replay given tables as streams, in several micro-batches, and read what the sinks hold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import folds, sinks
from .views import ROWS, table, view, with_views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
LATE = "1 hour"


def query(sql: str, *views: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return keep


def place(spark: SparkSession, what: str) -> str:
    """A new folder that the executors share: below the cluster's ``spark.checkpoint.dir``; a local session may do without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        import tempfile

        shared = "file://" + tempfile.mkdtemp(prefix="siftgraph-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/siftgraph/{what}-{uuid.uuid4().hex}"


def replay(events: DataFrame, fold: folds.Fold, key: str, what: str, slices: int = 3, shards: int | None = None) -> DataFrame:
    at = place(events.sparkSession, what)
    size = {} if shards is None else {"rows": 8 * folds.SLICE, "files": 2 * folds.FILES}  # a task holds packed rows, or those of one shard
    stream = folds.replayed(events, at, slices, LATE, key, **size)
    return folds.run_to_end(folds.folded(stream, fold, key, LATE, shards), at)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    leases = view(spark, sf_dir, "leases")
    return leases.select("provider", F.col("created_at").cast("timestamp").alias("at"), "id", F.unix_micros(F.col("expires_at").cast("timestamp")).alias("ends"))


_GRANTED = """select provider, id from (with recursive o as (select provider, id, created_at as a, expires_at as e, row_number() over (partition by provider order by created_at, id) as k from v_leases),
f(provider, k, id, held, granted) as (select provider, k, id, [e], true from o where k = 1 union all
select provider, k, id, case when len(run) < {limit} then list_append(run, e) else run end, len(run) < {limit} from (select o.*, list_filter(f.held, lambda x: x > o.a) as run from f join o on o.provider = f.provider and o.k = f.k + 1))
select * from f) where granted"""


@query(_GRANTED.format(limit=3), "leases")
def streamed_leases(spark, sf_dir):
    """Leases of two hours asked for by the events, three at once for each source, as a stream with timers."""
    return replay(asked(spark, sf_dir), folds.Leases(3), "provider", "leases").select("provider", "id")


@query(_GRANTED.format(limit=2), "leases")
def granted_leases(spark, sf_dir):
    """The same as a batch, two at once."""
    return folds.folded_batch(asked(spark, sf_dir), folds.Leases(2), "provider").select("provider", "id")


TTL = 2 * 3600 * 1_000_000


def waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event asks; a third of them is served after 20 minutes."""
    asks = view(spark, sf_dir, "leases").select("provider", F.col("created_at").cast("timestamp").alias("at"), "id", F.lit(None).cast("long").alias("waiter"))
    return asks.union(asks.where("id % 3 = 0").select("provider", F.expr("at + interval 20 minutes"), "id", "id"))


_HEADS = """with w as (select provider, id, created_at as a, case when id % 3 = 0 then created_at + interval 20 minutes else created_at + interval 2 hours end as e from v_leases),
s as (select provider, id, greatest(a, max(e) over (partition by provider order by a, id rows between unbounded preceding and 1 preceding)) as since, e from w)
select provider, id, epoch_us(since) as since from s where since < e"""


@query(_HEADS.replace("with w as", ", w as", 1), "leases")
def streamed_heads(spark, sf_dir):
    """The head of each source's line and since when; waiters give up after two hours."""
    return replay(waiting(spark, sf_dir), folds.Waiters(TTL), "provider", "heads").select("provider", "id", "since")


def task_events(spark: SparkSession, sf_dir: str, parts: int = 1) -> DataFrame:
    """Each order is a task that is claimed every hour, some more often than it may fail; a claim meets a second one 5 minutes later, and is done, fails, or is reported done too late. Orders are spread over ``parts`` tasks, as each makes many rows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").repartition(parts)
    k = o.select(F.col("o_orderkey").alias("task_id"), F.col("o_orderdate").cast("timestamp").alias("day"), F.explode(F.sequence(F.lit(0), (F.col("o_orderkey") % 5).cast("int"))).alias("i"))
    k = k.withColumn("kind", ((F.floor(F.col("task_id") / 5) + F.col("i")) % 3).cast("int"))
    t = F.col("day") + F.make_dt_interval(F.lit(0), F.col("i"))
    event = lambda minutes, what: F.struct((t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))).alias("at"), F.lit(what).alias("what"))
    end = F.when(F.col("kind") == 0, event(10, "done")).when(F.col("kind") == 1, event(20, "error")).otherwise(event(40, "done"))
    rows = k.select("task_id", "i", F.posexplode(F.array(event(0, "claim"), event(5, "claim"), end)).alias("j", "e"))
    until = F.when(F.col("e.what") == "claim", F.unix_micros("e.at") + 1_800_000_000)
    return rows.select("task_id", F.col("e.at").alias("at"), (F.col("i") * 3 + F.col("j")).cast("long").alias("id"), F.col("e.what").alias("what"), until.alias("lease_until"))


@query("""with k as (select o_orderkey as task_id, o_orderdate as day, unnest(range(0, o_orderkey % 5 + 1)) as i from orders),
c as (select *, (task_id // 5 + i) % 3 as kind, min(case when (task_id // 5 + i) % 3 = 0 then i end) over (partition by task_id) as done from k),
a as (select *, epoch_us(day + i * interval 1 hour) as t, i + 1 as attempts from c where i < 3 and (done is null or i <= done))
select task_id, t as at, 'in_progress' as status, attempts, 'claim' as cause from a union all
select task_id, t + case kind when 0 then 10 when 1 then 20 else 30 end * 60000000, case when kind = 0 then 'succeeded' when attempts >= 3 then 'failed' else 'pending' end, attempts, case kind when 0 then 'done' when 1 then 'error' else 'lease_lost' end from a""")
def streamed_tasks(spark, sf_dir):
    """Every change of the orders' tasks under leases of half an hour and three attempts, as a stream with timers."""
    n = table(spark, sf_dir, "orders").count()
    return replay(task_events(spark, sf_dir, max(min(-(-n // ROWS), 64), n // 500_000, 1)), folds.Tasks(3), "task_id", "tasks", 2, max(64, n // folds.SHARD))


@query("select event_id as id, event_type as status, ts as started_at from events")
def streamed_calls(spark, sf_dir):
    """The events as calls, each twice, through the telemetry sink; then the checkpoint is lost and the stream runs again."""
    at = place(spark, "calls")
    calls = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.col("ts").alias("started_at"))
    calls.union(calls).repartition(3, "status").write.parquet(f"{at}/in")
    for run in ("first", "again"):
        stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
        sinks.sink(stream, f"{at}/sink", f"{at}/checkpoint-{run}").awaitTermination()
    return sinks.stored(spark, f"{at}/sink", calls.schema).select("id", "status", "started_at")
