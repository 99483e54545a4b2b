import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftgraph.plans import streams as plans
from siftgraph.streaming import folds, sinks

START = datetime(2024, 1, 1)
MICRO = 1_000_000


def micros(t):
    return int((t - datetime(1970, 1, 1)).total_seconds() * MICRO)


def lease_rows(n=150, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + timedelta(minutes=r.randint(0, 400))
        rows.append((r.choice("pq"), at, i, micros(at + timedelta(minutes=r.choice([0, 5, 30, 90])))))
    return rows


def granted(rows, limit):
    out, held = set(), {}
    for p, at, i, ends in sorted(rows, key=lambda x: (x[1], x[2])):
        run = [e for e in held.get(p, []) if e > micros(at)]
        if len(run) < limit:
            out.add((p, i))
            run.append(ends)
        held[p] = run
    return out


SCHEMA = "provider string, at timestamp, id long, ends long"


def write(spark, rows, place, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{place}/in")


def run(spark, place, fold=folds.Leases(3), schema=SCHEMA, key="provider"):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    return folds.run_to_end(folds.folded(stream, fold, key, "2 hours"), str(place))


def test_leases_over_micro_batches_and_a_restart(spark, tmp_path):
    rows = sorted(lease_rows(), key=lambda x: x[1])
    first, second = rows[:70], rows[70:]
    shuffled = second[:]
    random.Random(2).shuffle(shuffled)  # within the lateness allowed
    early = [x for x in first if x[1] < START + timedelta(minutes=60)]
    write(spark, early, tmp_path)
    write(spark, [x for x in first if x not in early], tmp_path)
    before = run(spark, tmp_path).count()
    by_time = sorted(shuffled, key=lambda x: x[1] - timedelta(minutes=random.Random(x[2]).randint(0, 100)))
    for part in (by_time[:40], by_time[40:], [(p, START + timedelta(days=9), None, None) for p in "pq"]):
        write(spark, part, tmp_path)
    after = run(spark, tmp_path)  # goes on from the checkpoint
    got = [(x["provider"], x["id"]) for x in after.collect()]
    assert before < len(got) == len(set(got))
    assert set(got) == granted(rows, 3)
    batch = folds.folded_batch(spark.createDataFrame(rows, SCHEMA), folds.Leases(3), "provider")
    assert {(x["provider"], x["id"]) for x in batch.collect()} == set(got)


def test_state_of_a_key_goes_when_its_leases_end():
    f = folds.Leases(2)
    rows = []
    state, left = f.over(f.start(), [(0, 1, 10), (0, 2, 20), (5, 3, 9), (10, 4, 30), (40, None, None), (50, 5, 60)], 45, rows)
    assert [r[0] for r in rows] == [1, 2, 4] and state == ([],) and left == [(50, 5, 60)]


def heads(rows, ttl):
    """By looking at every instant at which something changes."""
    ends = {}
    for p, at, i, w in rows:
        if w is None:
            ends[p, i] = [at, at + timedelta(microseconds=ttl)]
    for p, at, i, w in rows:
        if w is not None and (p, w) in ends:
            ends[p, w][1] = min(ends[p, w][1], at)
    out = set()
    for p in {r[0] for r in rows}:
        mine = sorted((a, i, e) for (q, i), (a, e) in ends.items() if q == p)
        last = None
        for t in sorted({x for a, _, e in mine for x in (a, e)}):
            now = next((i for a, i, e in mine if a <= t < e), None)
            if now is not None and now != last:
                out.add((p, now, micros(t)))
            last = now
    return out


def test_waiters_give_up(spark):
    r = random.Random(3)
    rows = [(r.choice("pq"), START + timedelta(seconds=37 * k + r.randint(0, 30)), k, None) for k in range(120)]
    rows += [(p, at + timedelta(seconds=91 + i), 1000 + i, i) for p, at, i, _ in rows if i % 3 == 0]
    rows += [("p", START, 5000, 4999)]  # someone who never waited
    got = folds.folded_batch(spark.createDataFrame(rows, "provider string, at timestamp, id long, waiter long"), folds.Waiters(200 * MICRO), "provider")
    assert {tuple(x) for x in got.collect()} == heads(rows, 200 * MICRO)


def test_waiters_as_a_stream(spark, tmp_path):
    schema = "provider string, at timestamp, id long, waiter long"
    rows = [("p", START + timedelta(minutes=3 * k), k, None) for k in range(30)] + [("p", START + timedelta(minutes=3 * k, seconds=70), 100 + k, k) for k in range(0, 30, 2)]
    df = spark.createDataFrame(rows, schema)
    stream = folds.replayed(df, str(tmp_path), 3, "1 hour", "provider")
    got = folds.run_to_end(folds.folded(stream, folds.Waiters(400 * MICRO), "provider", "1 hour"), str(tmp_path))
    assert {tuple(x) for x in got.collect()} == heads(rows, 400 * MICRO) != set()


def test_tasks(spark, tmp_path):
    f = folds.Tasks(2)
    run_ = lambda *events: f.over(f.start(), list(events), None, out := []) and out
    assert run_((0, 1, "claim", 10), (5, 2, "claim", 15), (7, 3, "done", None), (8, 4, "error", None)) == [(0, "in_progress", 1, "claim"), (7, "succeeded", 1, "done")]
    lost = run_((0, 1, "claim", 10), (12, 2, "done", None), (13, 3, "claim", 20), (30, 4, "claim", 40))
    assert lost == [(0, "in_progress", 1, "claim"), (10, "pending", 1, "lease_lost"), (13, "in_progress", 2, "claim"), (20, "failed", 2, "lease_lost")]
    df = spark.createDataFrame([(k, START + timedelta(minutes=k), 1, "claim", micros(START + timedelta(minutes=k + 10))) for k in range(6)], "task_id long, at timestamp, id long, what string, lease_until long")
    stream = folds.replayed(df, str(tmp_path), 2, "1 hour", "task_id")
    got = folds.run_to_end(folds.folded(stream, f, "task_id", "1 hour"), str(tmp_path))
    assert sorted((x["task_id"], x["cause"]) for x in got.collect()) == sorted((k, c) for k in range(6) for c in ("claim", "lease_lost"))


def test_no_events(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert folds.folded_batch(df, folds.Leases(1), "provider").count() == 0
    stream = folds.replayed(df, str(tmp_path), 2, "1 hour", "provider")
    assert folds.run_to_end(folds.folded(stream, folds.Leases(1), "provider", "1 hour"), str(tmp_path)).count() == 0


CALLS = "id long, status string, started_at timestamp"


def test_a_batch_done_again_adds_nothing(spark, tmp_path):
    rows = [(k, "s", START + timedelta(hours=k)) for k in range(50)]
    df = spark.createDataFrame(rows, CALLS)
    path = f"file://{tmp_path}/sink"
    sinks.append_batch(df.where("id < 30"), path, "r", 0)
    sinks.append_batch(df.where("id < 30"), path, "r", 0)  # after a crash
    sinks.append_batch(df.where("id >= 20"), path, "r", 1)
    sinks.append_batch(df.unionByName(df.withColumn("status", F.lit("t"))), path, "other", 0)  # a lost checkpoint, with repeated ids
    got = sinks.stored(spark, path, df.schema).select(*df.columns)
    assert sorted(map(tuple, got.collect())) == rows


def test_the_first_of_repeated_calls_stays(spark, tmp_path):
    t = START
    df = spark.createDataFrame([(1, "late", t + timedelta(hours=1)), (1, "b", t), (1, "a", t)], CALLS)
    path = f"file://{tmp_path}/sink"
    sinks.append_batch(df, path, "r", 0)
    assert [x["status"] for x in sinks.stored(spark, path, df.schema).collect()] == ["a"]
    assert sinks.stored(spark, f"file://{tmp_path}/none", df.schema).count() == 0


@pytest.mark.parametrize("name", ["streamed_calls", "granted_leases"])
def test_queries_over_a_table(spark, name):
    assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_many_tasks_share_shards(spark, tmp_path):
    rows = [(k, START + timedelta(minutes=k % 50), 1, "claim", micros(START + timedelta(minutes=k % 50 + 10))) for k in range(300)]
    rows += [(k, START + timedelta(minutes=k % 50 + 5), 2, "done", None) for k in range(0, 300, 3)]
    df = spark.createDataFrame(rows, "task_id long, at timestamp, id long, what string, lease_until long")
    stream = folds.replayed(df, str(tmp_path), 2, "1 hour", "task_id")
    out = folds.folded(stream, folds.Tasks(2), "task_id", "1 hour", shards=4)
    got = folds.run_to_end(out, str(tmp_path))
    want = [(k, c) for k in range(300) for c in ("claim", "lease_lost" if k % 3 else "done")]
    assert sorted((x["task_id"], x["cause"]) for x in got.collect()) == sorted(want)


def test_a_long_line_costs_a_few_steps_an_event():
    n, f, rows = 40_000, folds.Waiters(10**9), []
    events = [(k, k, None) for k in range(n)] + [(n + k, n + k, n - 1 - k) for k in range(n)]  # all wait, then the last leaves first
    began = time.monotonic()
    state, left = f.over(f.start(), events, 3 * n, rows)
    assert time.monotonic() - began < 15  # each event went through the whole line before
    assert rows == [(0, 0)] and not left and state == ([], [], None)


def test_micro_batches_of_bounded_size(spark, tmp_path):
    rows = sorted(lease_rows(400), key=lambda x: x[1])
    stream = folds.replayed(spark.createDataFrame(rows, SCHEMA), str(tmp_path), 2, "1 hour", "provider", rows=50)
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    parts = [spark.read.parquet(str(f)) for f in files]
    spans = [p.agg(F.min("at"), F.max("at"), F.count("*")).first() for p in parts]
    assert len(spans) >= 8 and max(x[2] for x in spans) <= 150 and sum(x[2] for x in spans) == 401
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    got = folds.run_to_end(folds.folded(stream, folds.Leases(3), "provider", "1 hour"), str(tmp_path))
    assert {(x["provider"], x["id"]) for x in got.collect()} == granted(rows, 3)


TASKS = "task_id {}, at timestamp, id long, what string, lease_until long"


def task_rows(r, n, keys):
    rows = []
    for i in range(n):
        at = START + timedelta(minutes=r.randint(0, 300))
        what = r.choice(["claim", "claim", "done", "error", "other", None])
        rows.append((r.choice(keys), at, i, what, micros(at + timedelta(minutes=r.choice([-1, 0, 7, 45]))) if what == "claim" and r.random() < 0.9 else None))
    return rows


@pytest.mark.parametrize("few", [1, 32, 1000])
def test_many_tasks_at_once_as_one_by_one(monkeypatch, few):
    monkeypatch.setattr(folds, "FEW", few)
    r, f = random.Random(few), folds.Tasks(2)
    what = {"claim": 0, "done": 1, "error": 2}
    events = sorted((r.randint(0, 40), r.randint(0, 99), i, r.choice(["claim", "claim", "done", "error", "other", None]), r.randint(0, 140) if r.random() < 0.9 else None, r.random() < 0.9) for i in range(900))
    want, k, at, told = set(), *(np.array([e[i] for e in events]) for i in (0, 1, 5))
    for key in range(41):
        f.over(f.start(), [(e[1], e[2] if e[5] else None, e[3], e[4]) for e in events if e[0] == key], 120, out := [])
        want |= {(key, *x) for x in out}
    fields = [np.array([what.get(e[3], 3) for e in events]), np.array([folds.NEVER if e[4] is None else e[4] for e in events])]
    out = f.over_all(f.starts(41), k, at, told, fields, 120)
    places, *numbers = (np.concatenate(c) for c in zip(*out))
    got = list(zip(places.tolist(), *(c.tolist() for c in f.named(numbers))))
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("kind", ["long", "string"])
def test_shards_of_tasks_over_micro_batches_and_a_restart(spark, tmp_path, kind):
    r, f = random.Random(5), folds.Tasks(3)
    keys = [None, *(k if kind == "long" else f"t{k}" for k in range(2**60, 2**60 + 40))]
    rows = sorted(task_rows(r, 600, keys), key=lambda x: (x[1], x[2]))
    rows.insert(300, (keys[3], rows[300][1], None, "claim", None))  # moves time on only
    schema = TASKS.format(kind)
    end = [(keys[1], START + timedelta(days=9), None, None, None)]
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    go = lambda: folds.run_to_end(folds.folded(read(), f, "task_id", "1 hour", shards=3), str(tmp_path))
    for a in range(0, 300, 75):
        part = rows[a : a + 75]
        r.shuffle(part)
        write(spark, part, tmp_path, schema)
    before = go().count()
    for part in (rows[300:450], rows[450:], end):
        write(spark, part, tmp_path, schema)
    want = []
    for key in keys:
        f.over(f.start(), [x[1:] for x in [(k, micros(t), *e) for k, t, *e in rows] if x[0] == key], 2**62, out := [])
        want += [(key, *x) for x in out]
    got = [tuple(x) for x in go().collect()]
    assert 0 < before < len(got) and sorted(got, key=str) == sorted(want, key=str)


def test_rows_of_many_tasks_reach_the_state_packed(spark, tmp_path):
    n = 20_000
    df = spark.range(n).select(F.col("id").alias("task_id"), (F.lit(START) + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") % 500).cast("int"))).cast("timestamp").alias("at"), F.lit(1).cast("long").alias("id"), F.lit("claim").alias("what"), F.lit(micros(START + timedelta(days=1))).alias("lease_until"))
    stream = folds.replayed(df, str(tmp_path), 2, "1 hour", "task_id")
    out = folds.folded(stream, folds.Tasks(1), "task_id", "1 hour", shards=4)
    run_ = folds.run_to_end(out, str(tmp_path))
    assert run_.groupBy("cause").count().orderBy("cause").collect() == [("claim", n), ("lease_lost", n)]
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan.split("TransformWithState")[1]  # each row went to the state by itself before


def test_a_large_micro_batch_is_a_slice(spark, tmp_path):
    rows = spark.range(0, 40_000, 1, 1).select(F.lit("p").alias("provider"), F.timestamp_seconds("id").alias("at"), "id", F.lit(0).cast("long").alias("ends"))
    folds.replayed(rows, str(tmp_path), 2, "1 hour", "provider", files=2)  # one task writes both slices
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    spans = [spark.read.parquet(*map(str, fs)).agg(F.min("id"), F.max("id"), F.count("id")).first() for fs in (files[:2], files[2:4])]
    assert len(files) == 5 and spans[0][1] < spans[1][0] and spans[0][2] + spans[1][2] == 40_000
    assert 15_000 < spans[0][2] < 25_000
