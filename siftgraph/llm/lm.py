"""Scoring by a log-bilinear neural language model trained with noise-contrastive estimation.

Tokens are runs of other characters than ASCII white space, A-Z folded, and one
end for each text; they are told apart by 64-bit hashes. Every token type, seen
or not, is an outcome with a vector: the end and the ``plain`` most frequent
types have one each, all others share ``buckets`` vectors, dealt by their hash,
as targets and as contexts. With context vectors r of the two tokens before,
q = C1 r1 + C2 r2, and the score of outcome w is q . r_w + b_w; noise-contrastive
estimation learns it against the unigram noise. Learners, one for about
``LEARN`` tokens of text, train from the same start on all of their tokens, and
their parameters are averaged with their token counts as weights, so scores
depend a little on how the input is split into partitions. The normaliser of
every context is one batched matrix product over the outcomes, made by tasks of
the cluster, so the scores are normalised log-probabilities.

Within a bucket of n training tokens, a type seen c times has (c - D) / n of the
mass, and all unseen ones together, one outcome as in the base score, the rest;
D is n1 / (n1 + 2 n2) of the training counts. A bucket without training tokens
is all unseen. Counts of about the ``head`` most frequent types go to the scorers
(a bounded table); rarer types are joined with the counts by a shuffle.

A null text is empty: one end. Null ids train (crc32 of nothing is 0). Repeated
rows are scored each for itself; other columns are ignored, whatever their
names. Without training texts every token is unseen.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .storage import written
from .text import NONSPACE, U64, Lookup, Texts, slices

END = U64(0x656E64)
PLAIN, BUCKETS, WIDTH, HEAD = 1023, 1024, 32, 1 << 17
NOISE, BATCH, RATE, LEARN = 64, 4096, 0.05, 4 << 20


def _stream(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with an end after each text, bounds of the texts)."""
    s, e, first = t.words(NONSPACE)
    h = t.hashes(s, e)
    n = len(t)
    out = np.empty(len(h) + n, dtype=U64)
    ends = first[1:] + np.arange(n)
    out[ends] = END
    rest = np.ones(len(out), dtype=bool)
    rest[ends] = False
    out[rest] = h
    return out, np.concatenate([[0], ends + 1])


class Lbl:
    """Parameters as one flat vector: R, b, C1, C2."""

    def __init__(self, flat: np.ndarray, v: int, d: int):
        self.flat, self.v, self.d = flat, v, d
        self.r = flat[: v * d].reshape(v, d)
        self.b = flat[v * d : v * d + v]
        self.c = flat[v * d + v :].reshape(2, d, d)

    @staticmethod
    def start(unigram: np.ndarray, d: int, seed: int = 5) -> Lbl:
        rng = np.random.default_rng(seed)
        v = len(unigram)
        c = np.stack([np.eye(d), np.eye(d)]) * 0.5
        return Lbl(np.concatenate([rng.normal(0, 0.1, v * d), np.log(unigram), c.ravel()]).astype(np.float32), v, d)

    def train(self, w: np.ndarray, w1: np.ndarray, w2: np.ndarray, noise: np.ndarray, seen: np.ndarray, rng) -> None:
        """One step of adaptive descent on a batch; the noise words serve the whole batch."""
        v, d, k = self.v, self.d, NOISE
        log_noise = np.log(noise).astype(np.float32)
        j = rng.choice(v, k, p=noise)
        r1, r2, rw, rj = self.r[w1], self.r[w2], self.r[w], self.r[j]
        q = r1 @ self.c[0].T + r2 @ self.c[1].T
        good = np.einsum("ij,ij->i", q, rw) + self.b[w] - log_noise[w] - np.float32(math.log(k))
        bad = q @ rj.T + self.b[j] - log_noise[j] - np.float32(math.log(k))
        e = (-1 / (1 + np.exp(np.clip(good, -30, 30)))) / len(w)
        f = (1 / (1 + np.exp(-np.clip(bad, -30, 30)))) / len(w)
        dq = e[:, None] * rw + f @ rj
        grad = Lbl(np.zeros_like(self.flat), v, d)
        at = np.concatenate([w, w1, w2])
        rows = np.concatenate([e[:, None] * q, dq @ self.c[0], dq @ self.c[1]])
        order = np.argsort(at, kind="stable")
        edge = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1]))
        grad.r[at[order][edge]] = np.add.reduceat(rows[order], edge)
        np.add.at(grad.r, j, f.T @ q)
        grad.b += np.bincount(w, e, v).astype(np.float32)
        np.add.at(grad.b, j, f.sum(axis=0))
        grad.c[0], grad.c[1] = dq.T @ r1, dq.T @ r2
        seen += grad.flat**2
        self.flat -= np.float32(RATE) * grad.flat / np.sqrt(seen + np.float32(1e-8))

    def normaliser(self, rows: np.ndarray | None = None) -> np.ndarray:
        """log Z of the contexts (w1, w2) of each w1 in ``rows`` (all by default), a matrix product for each."""
        rows = np.arange(self.v) if rows is None else rows
        q1, q2 = self.r[rows] @ self.c[0].T, self.r @ self.c[1].T
        out = np.empty((len(rows), self.v), dtype=np.float32)
        for i in range(len(rows)):
            s = (q1[i] + q2) @ self.r.T + self.b
            top = s.max(axis=1, keepdims=True)
            out[i] = (top + np.log(np.exp(s - top).sum(axis=1, keepdims=True)))[:, 0]
        return out


def _contexts(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two outcomes before each token of its own text; ends (0) before its start."""
    w1, w2 = np.zeros(len(ids), dtype=ids.dtype), np.zeros(len(ids), dtype=ids.dtype)
    w1[1:], w2[2:] = ids[:-1], ids[:-2]
    start = bounds[:-1]
    w1[start] = w2[start] = 0
    w2[start[start + 1 < bounds[1:]] + 1] = 0
    return w1, w2


class Types:
    """The frequent types with their counts, and the totals of the training tokens."""

    def __init__(self, tok: np.ndarray, c: np.ndarray, totals: tuple[int, int, int, int], sums: np.ndarray, kinds: np.ndarray, plain: int):
        order = np.lexsort((tok, -c))
        self.tok, self.c = tok[order], c[order]
        self.total, self.types, once, twice = totals
        self.table = Lookup(self.tok)
        own = np.flatnonzero(self.tok != END)[:plain]
        self.first = 1 + len(own)  # the first bucket's outcome; the end's is 0
        self.buckets = len(sums)
        self.outcome = self.first + self.bucket(self.tok)
        self.outcome[own] = 1 + np.arange(len(own))
        self.outcome[self.tok == END] = 0
        alone = np.flatnonzero(self.outcome < self.first)
        self.n = sums - np.bincount(self.bucket(self.tok[alone]), self.c[alone], self.buckets)
        kinds = kinds - np.bincount(self.bucket(self.tok[alone]), minlength=self.buckets)
        mass = np.zeros(self.first + self.buckets)
        mass[self.outcome[alone]] = self.c[alone]
        mass[self.first :] = self.n
        self.unigram = (mass + 0.5) / (mass.sum() + 0.5 * len(mass))
        self.discount = once / (once + 2 * twice) if once and twice else 0.5
        #: log10 shares within each bucket: of its tokens, and of what no training text holds.
        self.log_n = np.log10(np.maximum(self.n, 1.0))
        self.unseen = np.where(self.n > 0, np.log10(np.maximum(self.discount * kinds, 1e-300)) - self.log_n, 0.0)

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return (h & U64(self.buckets - 1)).astype(np.int64)

    def numbers(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, bounds, places in the table or -1, outcomes)."""
        h, bounds = _stream(t)
        at = self.table.find(h)
        out = self.first + self.bucket(h)
        known = at >= 0
        out[known] = self.outcome[at[known]]
        return h, bounds, at, out


def counted(taught: DataFrame, head: int = HEAD, plain: int = PLAIN, buckets: int = BUCKETS) -> tuple[DataFrame, Types]:
    """((tok, c) of all training types, the frequent ones for the scorers). ``buckets`` is a power of two."""

    def count(batches):
        for batch in batches:
            for _, _, t in slices(batch.column(0), 4 << 20):
                tok, n = np.unique(_stream(t)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tok.view(np.int64)), pa.array(n.astype(np.int64))], names=["tok", "n"])

    counts = written(taught.mapInArrow(count, "tok long, n long").groupBy("tok").agg(F.sum("n").alias("c")), "counts")
    of = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    bucket = F.col("tok").bitwiseAND(F.lit(buckets - 1))
    per = counts.groupBy(bucket.alias("b")).agg(F.sum("c").alias("n"), F.count("*").alias("k")).collect()  # a row for each bucket
    sums, kinds = np.zeros(buckets), np.zeros(buckets)
    for r in per:
        sums[r.b], kinds[r.b] = r.n, r.k
    # Whole count classes (eighths of a power of two) from the top, and of the first that
    # doesn't fit a part by hash: nothing is sorted over the cluster for it.
    level = F.floor(F.log2("c") * 8).cast("int")
    sizes = counts.groupBy(level.alias("k")).agg(F.count("*").alias("n")).collect()  # a few hundred classes
    room, edge, share = head, -1, 0.0
    for r in sorted(sizes, key=lambda r: -r.k):
        if r.n > room:
            edge, share = r.k, room / r.n
            break
        room -= r.n
    dice = F.pmod(F.xxhash64("tok"), F.lit(1 << 20)) < int(share * (1 << 20))
    # The end of a text is always there, so that it has its outcome.
    top = counts.where((level > edge) | (level == edge) & dice | (F.col("tok") == int(END))).toArrow()
    return counts, Types(top["tok"].to_numpy().view(U64), top["c"].to_numpy(), tuple(map(int, of)), sums, kinds, plain)


def fitted(taught: DataFrame, types: Types, width: int = WIDTH, learn: int = LEARN) -> tuple[Lbl, np.ndarray]:
    """(model, log Z of every pair of outcomes)."""
    spark = taught.sparkSession
    model, v = Lbl.start(types.unigram, width), len(types.unigram)
    shared, begin = spark.sparkContext.broadcast(types), spark.sparkContext.broadcast(model.flat)

    def teach(batches):
        own, n, seen = Lbl(begin.value.copy(), v, width), 0, np.full(len(begin.value), 1e-6, dtype=np.float32)
        unigram, rng = shared.value.unigram, np.random.default_rng(9)
        for batch in batches:
            for _, _, t in slices(batch.column(0)):
                _, bounds, _, ids = shared.value.numbers(t)
                w1, w2 = _contexts(ids, bounds)
                for i in range(0, len(ids), BATCH):
                    own.train(ids[i : i + BATCH], w1[i : i + BATCH], w2[i : i + BATCH], unigram, seen, rng)
                n += len(ids)
        if n:
            yield _vector(n, own.flat)

    def add(batches):
        n, total = 0, np.zeros(len(begin.value))
        for batch in batches:
            for k, flat in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, total = n + k, total + k * np.frombuffer(flat, dtype=np.float32)
        if n:
            yield _vector(n, total / n)

    if types.total:
        learners = max(1, -(-types.total // learn))
        made = taught.coalesce(learners).mapInArrow(teach, "n long, flat binary").withColumn("k", F.spark_partition_id() % 16)
        # Sums stream through 16 tasks; 16 vectors of a fixed size come to the driver.
        rows = made.repartition(16, "k").select("n", "flat").mapInArrow(add, "n long, flat binary").collect()
        mean = sum(r.n * np.frombuffer(r.flat, dtype=np.float32).astype(np.float64) for r in rows) / sum(r.n for r in rows)
        model = Lbl(mean.astype(np.float32), v, width)
    final = spark.sparkContext.broadcast(model.flat)

    def normal(batches):
        own = Lbl(final.value, v, width)
        for batch in batches:
            at = np.asarray(batch.column(0))
            for i in range(0, len(at), 16):
                z = own.normaliser(at[i : i + 16])
                yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 16]), pa.array([x.tobytes() for x in z], pa.binary())], names=["i", "z"])

    rows = spark.range(0, v, 1, max(1, v // 32)).mapInArrow(normal, "i long, z binary").toArrow()  # v rows of v numbers
    order = np.argsort(rows["i"].to_numpy())
    z = np.frombuffer(b"".join(rows["z"].to_pylist()), dtype=np.float32).reshape(v, v)
    return model, z[order]


def _vector(n: int, flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([flat.astype(np.float32).tobytes()], pa.binary())], names=["n", "flat"])


def scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    plain: int = PLAIN,
    buckets: int = BUCKETS,
    width: int = WIDTH,
    head: int = HEAD,
    modulus: int = 7,
    held: int = 2,
) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    out = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == held
    base = docs.select(F.col(id_col).alias("id"), out.alias("held_out"), F.col(text_col).alias("text"))
    taught = base.where("not held_out").select("text")
    counts, types = counted(taught, head, plain, buckets)
    model, logz = fitted(taught, types, width)
    shared = spark.sparkContext.broadcast(types)
    ready = spark.sparkContext.broadcast((model.flat, logz))

    def score(batches):
        own = shared.value
        flat, logz = ready.value
        m = Lbl(flat, len(own.unigram), width)
        q1, q2 = m.r @ m.c[0].T, m.r @ m.c[1].T
        log_c, log_d = np.log10(own.c + 1.0), np.log10(np.maximum(own.c - own.discount, 1e-300))
        for batch in batches:
            for i, j, t in slices(batch.column(2)):
                h, bounds, at, ids = own.numbers(t)
                w1, w2 = _contexts(ids, bounds)
                p = np.empty(len(ids))
                for a in range(0, len(ids), 1 << 16):
                    s = slice(a, a + (1 << 16))
                    p[s] = np.einsum("ij,ij->i", q1[w1[s]] + q2[w2[s]], m.r[ids[s]]) + m.b[ids[s]] - logz[w1[s], w2[s]]
                p /= math.log(10)
                known = at >= 0
                inside = known & (ids >= own.first)
                p[inside] += log_d[at[inside]] - own.log_n[ids[inside] - own.first]
                b = np.where(known, log_c[at], 0.0) if len(own.c) else np.zeros(len(h))
                size = np.diff(bounds)
                add = lambda x: np.add.reduceat(x, bounds[:-1]) if len(x) else x  # noqa: E731  every text has its end
                miss = np.flatnonzero(~known)
                doc = np.repeat(np.arange(j - i), size)[miss]
                ends = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[miss].view(np.int64)))
                sums = [pa.array(size.astype(np.int64)), pa.array(add(known.astype(np.int64))), pa.array(add(b)), pa.array(add(p))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *sums, lists, batch.column(3).slice(i, j - i)],
                    names=["id", "held_out", "n_tokens", "n_known", "base", "score", "rest", "row"],
                )

    schema = base.select("id", "held_out").schema.add("n_tokens", "long").add("n_known", "long").add("base", "double").add("score", "double")
    schema = schema.add("rest", ArrayType(LongType())).add("row", "long")
    told = written(base.withColumn("row", F.monotonically_increasing_id()).mapInArrow(score, schema), "scored")
    rest = told.select("row", F.explode("rest").alias("tok")).groupBy("row", "tok").agg(F.count("*").alias("m"))
    inner = spark.createDataFrame(list(zip(range(buckets), types.log_n.tolist(), types.unseen.tolist())), "b long, log_n double, unseen double")
    rest = rest.join(counts, "tok", "left").withColumn("b", F.col("tok").bitwiseAND(F.lit(buckets - 1)))
    rest = rest.join(F.broadcast(inner), "b")  # a row for each bucket
    share = F.when(F.col("c").isNull(), F.col("unseen")).otherwise(F.log10(F.col("c") - types.discount) - F.col("log_n"))
    m = F.col("m")
    rest = rest.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), m).otherwise(0)).alias("known"),
        F.sum(m * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("b"),
        F.sum(m * share).alias("s"),
    )
    full = told.join(rest, "row", "left")
    zero = F.lit(0.0)
    return full.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(types.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero) - F.col("n_tokens") * math.log10(types.total + types.types + 1)).alias("base_score"),
        (F.col("score") + F.coalesce("s", zero)).alias("score"),
    )


def base_sql() -> str:
    """The columns of ``scores`` that need no model, in DuckDB; an end is the empty text, which no token is."""
    from .shards import CRC_TABLE, crc_sql

    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""with tab as (select {CRC_TABLE} as t),
d as (select row_number() over () as k, doc_id, {crc_sql("coalesce(doc_id::varchar, '')")} % 7 = 2 as held_out, regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') as w from documents, tab),
x as (select k, held_out, unnest(list_append(w, '')) as tok from d),
c as (select tok, count(*) as c from x where not held_out group by 1),
n as (select coalesce(sum(c), 0)::bigint as n, count(*) as v from c),
s as (select k, count(*) as n_tokens, count(c) as n_known, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) as b from x left join c using (tok), n group by 1)
select doc_id, held_out, n_tokens, n_known, n as train_tokens, round(b, 4) as base_score from d join s using (k), n"""
