"""Benchmark decontamination by winnowing.

Every run of ``k`` words is hashed; of each ``window - k + 1`` consecutive
hashes the smallest (the rightmost of equals) is a fingerprint. Two texts that
share ``window`` words or more share a fingerprint at the same place of the
shared span, so extending each common fingerprint to the left and to the right
finds every shared span of that length. Items of fewer than ``window`` words
are looked up whole by the hash of all their words.

The index of the items is broadcast to the Python workers only if the items
that hold a word measure less than ``broadcast_mb`` together. For a larger
benchmark the documents' fingerprints are joined by a shuffle with the items'
distinct ones; the documents that share one are candidates, and the hashes of
their windows are joined with those of the items' windows. No text is copied to
a pair, and only true hits become (document, item) rows. Both ways give the
same rows.

Nulls, empty texts and texts of separators only have no words: 0 hits, not
contaminated. Repeated documents or items each count for themselves; items of
equal id count once. Columns other than the named ones are ignored, whatever
their names; a kept column named as a result (n_words, n_hit, items) gives way
to the result. Empty tables give empty or all-clean results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import ALNUM, U64, Lookup, Texts, grams, slices

K = 5
RESULTS = ("n_words", "n_hit", "items")


def winnow(g: np.ndarray, w: int, doc_of: np.ndarray | None = None, window: int = 0) -> np.ndarray:
    """Positions of the fingerprints: of each w consecutive hashes the smallest, the rightmost of equals. ``doc_of`` (of each word) keeps to windows of ``window`` words that lie in one text."""
    n = len(g)
    if n < w:
        return np.empty(0, dtype=np.int64)
    best = np.arange(n - w + 1) + w - 1
    low = g[w - 1 :].copy()
    for j in range(w - 2, -1, -1):
        other = g[j : j + n - w + 1]
        less = other < low
        low[less] = other[less]
        best[less] = np.flatnonzero(less) + j
    if doc_of is not None:
        best = best[doc_of[: len(best)] == doc_of[window - 1 : window - 1 + len(best)]]
    return best[np.append(True, best[1:] != best[:-1])] if len(best) else best


class Index:
    """Fingerprints and words of the items, for any number of documents."""

    def __init__(self, ids: list, texts: list[str | None], window: int = 10, k: int = K):
        self.window, self.k, self.w = window, k, window - k + 1
        self.ids = [str(i) for i in ids]
        column = pa.array(["" if t is None else t for t in texts], pa.large_string())
        hs, fp, item, pos, short = [], [], [], [], {}
        for i, j, t in slices(column):
            s, e, first = t.words(ALNUM)
            h = t.hashes(s, e)
            for n in range(i, j):
                own = h[first[n - i] : first[n - i + 1]]
                hs.append(own)
                if 0 < len(own) < window:
                    short.setdefault(len(own), {}).setdefault(int(grams(own, len(own))[0]), []).append(n)
                elif len(own):
                    g = grams(own, k)
                    p = winnow(g, self.w)
                    fp.append(g[p]), item.append(np.full(len(p), n)), pos.append(p)
        self.words = hs
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, dtype=kind)
        fp, item, pos = cat(fp, U64), cat(item, np.int64), cat(pos, np.int64)
        order = np.argsort(fp, kind="stable")
        self.item, self.pos = item[order], pos[order]
        keys, self.first = np.unique(fp[order], return_index=True)
        self.first = np.append(self.first, len(fp))
        self.table = Lookup(keys)
        self.short = {n: (Lookup(np.array(list(x), dtype=U64)), list(x.values())) for n, x in short.items()}

    def scan(self, texts: Texts) -> Iterator[tuple[int, int, set[str]]]:
        """(words, words hit, ids of items found) of each text."""
        s, e, first = texts.words(ALNUM)
        h = texts.hashes(s, e)
        n = len(texts)
        doc_of = np.repeat(np.arange(n), np.diff(first))
        hit = np.zeros(len(h) + 1, dtype=np.int64)  # +1 at a span's start, -1 after its end
        found: list[set[str]] = [set() for _ in range(n)]
        if len(self.table.keys) and len(h) >= self.k:
            p_all = winnow(grams(h, self.k), self.w, doc_of, self.window)
            at = self.table.find(grams(h, self.k)[p_all])
            done: dict[tuple[int, int], int] = {}
            for p, x in zip(p_all[at >= 0].tolist(), at[at >= 0].tolist()):
                d = int(doc_of[p])
                lo, hi = int(first[d]), int(first[d + 1])
                for y in range(int(self.first[x]), int(self.first[x + 1])):
                    i, q = int(self.item[y]), int(self.pos[y])
                    line = (i, p - q)
                    if done.get(line, -1) > p:  # the end of a span is the first word after it
                        continue
                    a, b = _extend(h[lo:hi], self.words[i], p - lo, q, self.k)
                    done[line] = lo + b
                    if b - a >= self.window:
                        hit[lo + a] += 1
                        hit[lo + b] -= 1
                        found[d].add(self.ids[i])
        for length, (table, items) in self.short.items():
            at = table.find(grams(h, length))
            for p in np.flatnonzero(at >= 0).tolist():
                d = int(doc_of[p])
                if d == doc_of[p + length - 1]:
                    hit[p] += 1
                    hit[p + length] -= 1
                    found[d].update(self.ids[i] for i in items[int(at[p])])
        sums = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])
        for d in range(n):
            yield int(first[d + 1] - first[d]), int(sums[first[d + 1]] - sums[first[d]]), found[d]


def _extend(a: np.ndarray, b: np.ndarray, p: int, q: int, k: int) -> tuple[int, int]:
    """The maximal common run of a and b on the diagonal of (p, q), as bounds in a."""
    back = min(p, q)
    left = np.flatnonzero(a[p - back : p] != b[q - back : q])
    start = p - back + (int(left[-1]) + 1 if len(left) else 0)
    on = min(len(a) - p, len(b) - q)
    right = np.flatnonzero(a[p : p + on] != b[q : q + on])
    end = p + (int(right[0]) if len(right) else on)
    return (start, end) if end - p >= k else (p, p)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    broadcast_mb: int = 16,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, the columns in ``keep``, n_words, n_hit, items (sorted ids found)."""
    spark = docs.sparkSession
    items = items.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).alias("t"))
    items = items.where(F.col("t").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"))  # others have no words
    cols = [id_col, *[c for c in keep if c not in (id_col, *RESULTS)]]
    bytes_ = items.agg(F.sum(F.octet_length("t") + F.coalesce(F.octet_length("i"), F.lit(0)) + 64)).first()[0] or 0
    if bytes_ >= broadcast_mb << 20:
        return _by_shuffle(docs, items, cols, text_col, window)
    got = items.collect()
    index = spark.sparkContext.broadcast(Index([r.i for r in got], [r.t for r in got], window))
    schema = docs.select(*cols).schema.add("n_words", "long").add("n_hit", "long").add("items", ArrayType(StringType()))

    def scan(batches):
        for batch in batches:
            rows = [r for _, _, t in slices(batch.column(batch.num_columns - 1)) for r in index.value.scan(t)]
            told = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
            found = pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *told, found], names=schema.names)

    return docs.select(*cols, F.col(text_col).alias("__text")).mapInArrow(scan, schema)


def _by_shuffle(docs: DataFrame, items: DataFrame, cols: list[str], text_col: str, window: int) -> DataFrame:
    """The same rows where the items are too many to broadcast."""
    from .storage import written

    spark = docs.sparkSession

    def lengths_of(batches):
        for batch in batches:
            for _, _, t in slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.diff(t.words(ALNUM)[2])))], names=["n"])

    short = items.select("t").mapInArrow(lengths_of, "n long").where(F.col("n").between(1, window - 1)).distinct()
    lengths = sorted(r.n for r in short.collect())  # window - 1 numbers at most

    def prints(asks: bool):
        """(row, fp): distinct fingerprints of each text, and hashes of the short items' lengths."""

        def emit(batches):
            for batch in batches:
                for i, j, t in slices(batch.column(1)):
                    s, e, first = t.words(ALNUM)
                    h = t.hashes(s, e)
                    rows, fps = [], []
                    for d in range(j - i):
                        own = h[first[d] : first[d + 1]]
                        got = [g[winnow(g, window - K + 1)] for g in [grams(own, K)] if len(own) >= window]
                        got += [grams(own, n) for n in (lengths if asks else [len(own)] * (0 < len(own) < window))]
                        fp = np.unique(np.concatenate(got)) if got else np.empty(0, dtype=U64)
                        rows.append(np.full(len(fp), i + d))
                        fps.append(fp)
                    at, fp = np.concatenate(rows).astype(np.int64), np.concatenate(fps)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(fp.view(np.int64))], names=["row", "fp"])

        return emit

    def windows(asks: bool):
        """(row, at, size, hash) of each window, of an item's own length where that is short."""

        def emit(batches):
            for batch in batches:
                for i, j, t in slices(batch.column(1), 1 << 19):
                    s, e, first = t.words(ALNUM)
                    h = t.hashes(s, e)
                    doc = np.repeat(np.arange(j - i), np.diff(first))
                    count = np.diff(first)[doc]
                    for n in (*lengths, window):
                        g = grams(h, n)
                        on = doc[: len(g)] == doc[n - 1 :] if len(g) else np.empty(0, dtype=bool)
                        if not asks and n < window:
                            on = on & (count[: len(g)] == n)
                        at = np.flatnonzero(on)
                        own = doc[at]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(i + own)), pa.array(at - first[own]), pa.array(np.full(len(at), n)), pa.array(g[at].view(np.int64))],
                            names=["row", "at", "size", "hash"],
                        )

        return emit

    rows = written(docs.select(*cols, F.col(text_col).alias("__text"), F.monotonically_increasing_id().alias("__row")), "decon-docs")
    asked = rows.select("__row", "__text").mapInArrow(prints(True), "row long, fp long")
    named = items.select(F.coalesce("i", F.lit("None")).alias("i"), "t")
    known = named.mapInArrow(prints(False), "row string, fp long").select("fp").distinct()
    candidates = asked.join(known, "fp", "left_semi").select(F.col("row").alias("__row")).distinct()
    texts = rows.select("__row", "__text").join(candidates, "__row", "left_semi")
    own = texts.mapInArrow(windows(True), "row long, at long, size long, hash long")
    theirs = named.mapInArrow(windows(False), "row string, at long, size long, hash long").select("hash", "size", F.col("row").alias("item")).distinct()
    hits = written(own.join(theirs, ["hash", "size"]).select("row", "at", "size", "item"), "decon-hits")
    found = hits.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    before = F.max(F.col("at") + F.col("size")).over(Window.partitionBy("row").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("at") + F.col("size") - F.greatest(F.col("at"), F.coalesce(before, F.lit(0)))
    spans = hits.select("row", "at", "size").distinct().withColumn("new", F.greatest(F.lit(0), new))
    covered = spans.groupBy("row").agg(F.sum("new").alias("n_hit"))

    def words(batches):
        for batch in batches:
            n = [np.diff(t.words(ALNUM)[2]) for _, _, t in slices(batch.column(batch.num_columns - 1))]
            n = np.concatenate(n) if n else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n.astype(np.int64))], names=[*batch.schema.names[:-1], "n_words"])

    schema = rows.select(*cols, "__row").schema.add("n_words", "long")
    counted = rows.select(*cols, "__row", "__text").mapInArrow(words, schema)
    told = covered.join(found, "row").withColumnRenamed("row", "__row")
    none = F.array().cast("array<string>")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit")
    return counted.join(told, "__row", "left").select(*cols, "n_words", hit, F.coalesce("items", none).alias("items"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The registered columns of ``contamination``'s rows."""
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def sha_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def oracle_sql(window: int = 10) -> str:
    """``digest`` of the documents against the benchmark in DuckDB: windows as texts, joined by equality."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""with d as (select row_number() over () as k, doc_id, {words} as w from documents),
b as (select item_id, {words} as w from benchmark),
items as (select distinct item_id, least(len(w), {window}) as n, array_to_string(w[p : p + least(len(w), {window}) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - {window}, 0) + 2)) as p from b where len(w) > 0)),
sizes as (select distinct n from items),
spots as (select k, w, n, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n),
hits as (select k, p, spots.n, item_id from spots join items on items.n = spots.n and s = array_to_string(w[p : p + spots.n - 1], ' ')),
covered as (select k, count(distinct q) as n_hit from (select k, unnest(range(p, p + n)) as q from hits) group by 1),
found as (select k, list_sort(list(distinct cast(item_id as varchar))) as items from hits group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(len(items), 0) as n_items,
sha256(array_to_string(coalesce(items, []), ',')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (k) left join found using (k)"""
