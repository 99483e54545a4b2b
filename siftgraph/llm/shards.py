"""Sharding by a keyed permutation of global row numbers.

Rows are numbered by (id, size, checksum, hash of the text), null ids first; rows equal in
all of these are interchangeable. A Feistel network over pairs (l, r) with
0 <= l, r < a, where a * a is the least square of at least n, permutes 0 .. a*a-1;
a number that leaves 0 .. n-1 is put through it again until it returns (cycle
walking). Row number i goes to shard p(i) mod shards, slot p(i) div shards, so
shard sizes differ by one row at most, slots have no gap, and either side can
be computed from n, the seed and the row number alone.

All of it is DataFrame expressions. Global numbers come from a range shuffle
and a sort of narrow rows (texts stay behind), a row count for each partition,
and their running sums. Rows equal in every key are spread by their place in
the input, so no range grows with a hot id.

Null texts have no bytes (size 8, checksum 0) and null ids sort first. Empty
tables give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

PRIME = 2147483647
STEPS, WALK = 6, 96


def round_keys(seed: int, rounds: int = STEPS) -> list[tuple[int, int]]:
    """(factor, addend) below the prime for each round, by a linear rule."""
    x, out = seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1, []
    for _ in range(rounds):
        pair = []
        for _ in range(2):
            x = x * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
            pair.append((x >> 33) % (PRIME - 1) + 1)
        out.append((pair[0], pair[1]))
    return out


def side(n: int) -> int:
    """The least a with a * a >= n."""
    return max(1, math.isqrt(max(0, n - 1)) + 1) if n > 1 else 1


def permute(number: Column, n: int, seed: int) -> Column:
    """The place of ``number`` among n. A walk outside 0 .. n-1 has at most a*a - n < 2*a steps, under ``WALK`` for a below 48; for larger a a longer one has probability under (2/a)**WALK, and would raise."""
    a = F.lit(side(n)).cast("long")
    keys = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(c).cast("long").alias("c")) for m, c in round_keys(seed)])

    def turn(s: Column, k: Column) -> Column:
        t = (s["r"] * k["m"] + k["c"]) % PRIME
        u = (t * t + k["c"]) % PRIME
        return F.struct(s["r"].alias("l"), ((s["l"] + u) % a).alias("r"))

    def apply(x: Column) -> Column:
        start = F.struct(F.call_function("div", x, a).alias("l"), (x % a).alias("r"))
        return F.aggregate(keys, start, turn, lambda s: s["l"] * a + s["r"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), apply(number), lambda x, _: F.when(x < n, x).otherwise(apply(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def place(number: int, n: int, seed: int) -> int:
    """``permute`` for one number, without Spark."""
    a, x = side(n), number
    while True:
        l, r = divmod(x, a)
        for m, c in round_keys(seed):
            t = (r * m + c) % PRIME
            l, r = r, (l + (t * t + c) % PRIME) % a
        x = l * a + r
        if x < n:
            return x


def sharded(docs: DataFrame, shards: int = 24, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard (null), row_number."""
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary")))
    narrow = docs.select(F.col(id_col).alias("id"), size.alias("size"), crc.alias("text_crc32"), F.xxhash64(text_col).alias("h"), F.monotonically_increasing_id().alias("at"))
    narrow = written(narrow, "narrow")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = [F.col("id").asc_nulls_first(), *map(F.col, ("size", "text_crc32", "h", "at"))]
    ranged = narrow.repartitionByRange(parts, *key).sortWithinPartitions(*key)
    ranged = written(ranged.select("id", "size", "text_crc32", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("within")), "ranged")
    counts = ranged.groupBy("part").agg(F.count("*").alias("rows"))
    # A row for each shuffle partition, so one window holds them and they can be broadcast.
    before = counts.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    n = ranged.count()
    numbered = ranged.join(F.broadcast(before), "part").withColumn("row_number", F.col("before") + F.col("within").bitwiseAND(F.lit((1 << 33) - 1)))
    out = numbered.withColumn("p", permute(F.col("row_number"), max(1, n), seed))
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("p", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("p") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number")


#: DuckDB: a checksum's table as a list, and the checksum of a text by it (``t``).
CRC_TABLE = "list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"


def crc_sql(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::bigint)"
    return f"xor(list_reduce([4294967295] || {octets}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


def oracle_sql(shards: int = 24, seed: int = 42) -> str:
    """``sharded`` in DuckDB: checksums by a table, the permutation as a recursion over rounds that walks on while a number lies outside."""
    keys = ", ".join(f"({i}, {m}::bigint, {c}::bigint)" for i, (m, c) in enumerate(round_keys(seed), 1))
    return f"""select * from (with recursive tab as (select {CRC_TABLE} as t),
d as (select doc_id, strlen(coalesce(text, '')) + 8 as size, {crc_sql("coalesce(text, '')")} as text_crc32 from documents, tab),
r as (select *, row_number() over (order by doc_id nulls first, size, text_crc32) - 1 as n from d),
z as (select count(*) as n, ceil(sqrt(count(*)))::bigint as a from documents),
k(i, m, c) as (values {keys}),
w as (select r.n, r.n // a as l, r.n % a as r, 0 as step from r, z
union all select w.n, r, (l + (t * t + c) % {PRIME}) % a, i from (select w.*, z.a, k.i, k.c, (w.r * k.m + k.c) % {PRIME} as t from w, z, k where k.i = w.step % {STEPS} + 1 and (w.step < {STEPS} or w.l * z.a + w.r >= z.n)) w),
p as (select w.n, l * a + r as p from w, z where step = {STEPS} and l * a + r < z.n)
select doc_id, size, text_crc32, 'rows' as law, (p % {shards})::int as shard, p // {shards} as slot, null::int as grown_shard, n as row_number from r join p using (n))"""
