"""Near-duplicate classes by BagMinHash.

A text is a bag of runs of five words (one run of all words where there are
fewer). Each run's weight axis, cut at 0, 1, 2, 4, 8, ..., is a hierarchy of
Poisson processes: one for each piece, of rate its width, whose points come in
order of their time and are dealt by hash bits to a component of the signature
and to a unit of weight within the piece. A run of weight w sees the points of
its first w units; each component keeps its earliest point. Two bags agree in
a component with probability sum of minima / sum of maxima of their weights.
Points are drawn only up to the time by which a bag of that weight has most
likely filled its signature, and further only where it hasn't.

Signatures of 128 components are cut into 32 bands of 4. Texts of equal words
are one node. In each band bucket all nodes are compared with the one of the
highest degree; pairs of nodes that lie in one bucket and in different
components after that are compared too, until none is left unseen. Every link
is a pair whose exact weighted Jaccard similarity is 0.8 or more, and classes
are the connected components of the links.

A null text, an empty one or one without words has no bag: a class of its own.
Repeated rows share a class. Ids may be null; a class takes its least id.
Columns other than the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .components import components
from .storage import written
from .text import ALNUM, U64, Texts, freeing, grams, mix, slices

SHINGLE, COMPONENTS, ROWS, SIMILAR = 5, 128, 4, 0.8
TEXTS = "4m"  # bytes of texts that a Python worker takes at once
_GOLD = U64(0x9E3779B97F4A7C15)


def bags(texts: Texts, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each run, text of each run, 128-bit key of each text's words as two columns)."""
    s, e, first = texts.words(ALNUM)
    h = texts.hashes(s, e)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    keys = np.zeros((len(n), 2), dtype=U64)
    if len(h):
        place = (np.arange(len(h)) - first[:-1][doc]).astype(U64)
        full = np.flatnonzero(n)
        for c, salt in enumerate((U64(0x632BE59BD9B4E019), U64(0xE220A8397B1DCDAF))):
            keys[full, c] = mix(np.add.reduceat(mix(h + salt ^ mix(place * _GOLD + salt)), first[full]) + n[full].astype(U64))
    g = grams(h, k)
    inside = doc[: len(g)] == doc[k - 1 :] if len(g) else np.empty(0, dtype=bool)
    short = np.flatnonzero((n > 0) & (n < k))
    tail = np.array([grams(h[first[d] : first[d + 1]], int(n[d]))[0] for d in short], dtype=U64)
    return np.concatenate([g[inside], tail]), np.concatenate([doc[: len(g)][inside], short]), keys


def weigh(g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, run) with weights. Runs keep 48 bits of their hash here, which only signatures use."""
    x = np.sort(doc.astype(U64) << U64(48) | g >> U64(16))
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, dtype=np.int64)
    return (x[at] >> U64(48)).astype(np.int64), x[at] & U64((1 << 48) - 1), np.diff(np.append(at, len(x)))


def signatures(doc: np.ndarray, run: np.ndarray, weight: np.ndarray, n: int, m: int = COMPONENTS, more: float = 3.0) -> np.ndarray:
    """n signatures of m components; all zero where a text has no runs."""
    sig = np.zeros((n, m), dtype=U64)
    if not len(doc):
        return sig
    total = np.bincount(doc, weights=weight, minlength=n)
    until = (np.log(m) + more) / np.maximum(total, 1)
    seed, who, width, units = [mix(run * _GOLD)], [doc], [np.ones(len(doc))], [np.ones(len(doc), dtype=np.int64)]
    low, layer = 1, 1
    while len(at := np.flatnonzero(weight > low)):
        seed.append(mix(run[at] * _GOLD + U64(layer)))
        who.append(doc[at])
        width.append(np.full(len(at), float(low)))
        units.append(np.minimum(weight[at] - low, low))
        low, layer = 2 * low, layer + 1
    seed, who, width, units = map(np.concatenate, (seed, who, width, units))
    rate, end, wide = width * m, until[who], width.astype(U64)
    time, point = np.zeros(len(seed)), 0
    slots, times, points = [], [], []
    while len(seed):
        point += 1
        bits = mix(seed + U64(point * int(_GOLD) & (1 << 64) - 1))
        time = time - np.log(((bits >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        on = time <= end
        if not on.all():
            seed, who, wide, units, rate, end, time, bits = (x[on] for x in (seed, who, wide, units, rate, end, time, bits))
        deal = mix(bits)
        ok = (deal >> U64(32)) % wide < units.astype(U64)
        slots.append((who * m + (deal % U64(m)).astype(np.int64))[ok])
        times.append(time[ok])
        points.append(deal[ok])
    slots, times, points = map(np.concatenate, (slots, times, points))
    first = np.full(n * m, np.inf)
    np.minimum.at(first, slots, times)
    won = times == first[slots]
    sig.reshape(-1)[slots[won]] = points[won]
    open_ = np.flatnonzero((~np.isfinite(first).reshape(n, m)).any(axis=1) & (total > 0))
    if len(open_):
        again = np.full(n, -1)
        again[open_] = np.arange(len(open_))
        mine = again[doc] >= 0
        sig[open_] = signatures(again[doc[mine]], run[mine], weight[mine], len(open_), m, more + 4)
    return sig


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = sig.reshape(len(sig), -1, rows)
    out = np.zeros(parts.shape[:2], dtype=U64)
    for r in range(rows):
        out = mix(out * _GOLD + parts[:, :, r])
    return mix(out + np.arange(parts.shape[1], dtype=U64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of minima over sum of maxima of the weights of two arrays of run hashes."""
    if not len(a) or not len(b):
        return 0.0
    x, n = np.unique(a, return_counts=True)
    y, k = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], k[j]).sum())
    return both / (len(a) + len(b) - both)


def _packed(keys: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys.byteswap()).tobytes())]).cast(pa.binary())


def _parts(column, rows: int = 1 << 14):
    """Slices of fewer texts than the 16 bits that ``weigh`` has for them."""
    for i in range(0, len(column), rows):
        for a, b, t in slices(column.slice(i, rows)):
            yield i + a, i + b, t


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, node, size, bands) of each document. mark: a hash of its text, node: the key of its words; bands are null where it has none."""

    def run(batches):
        for batch in batches:
            for i, j, t in _parts(batch.column(2)):
                g, doc, keys = bags(t)
                sig = bands(signatures(*weigh(g, doc), j - i))
                size = np.bincount(doc, minlength=j - i)
                full = size > 0
                ends = np.concatenate([[0], np.cumsum(np.where(full, sig.shape[1], 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(sig[full].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), _packed(keys), pa.array(size.astype(np.int64)), lists], names=["id", "mark", "node", "size", "bands"])

    schema = docs.select(F.col(id_col).alias("id")).schema.add("mark", "long").add("node", "binary").add("size", "long").add("bands", ArrayType(LongType()))
    return docs.select(F.col(id_col).alias("id"), mark(text_col).alias("mark"), F.col(text_col).alias("text")).mapInArrow(freeing(run), schema)


def mark(text_col: str = "text"):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _texts(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the nodes, each by the id and the mark of its own document."""
    found = docs.select(F.col(id_col).alias("id"), mark(text_col).alias("mark"), F.col(text_col).alias("text"))
    wanted = nodes.select("node", "own.id", "own.mark").hint("shuffle_hash")
    found = found.join(wanted, found.id.eqNullSafe(wanted.id) & (found.mark == wanted.mark)).select("node", "text")
    return written(found.dropDuplicates(["node"]), "texts")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar enough."""

    def check(batches):
        last: tuple = (None, None)
        for batch in batches:
            good = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if last[0] != b:
                    last = b, next(bags(t)[0] for _, _, t in slices(pa.array([y])))
                good.append(similarity(next(bags(t)[0] for _, _, t in slices(pa.array([x]))), last[1]) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    full = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return written(full.select("a", "b", "x", "y").mapInArrow(freeing(check), "a binary, b binary"), "links", TEXTS)


def _alike(a: str, b: str, least: float):
    """No pair of bags whose sizes differ more can be similar enough."""
    return F.least(a, b) >= F.lit(least) * F.greatest(a, b)


def _runs(nodes: DataFrame) -> DataFrame:
    """(node, run, n): the bags of (node, text), a row for each distinct run."""

    def bag(batches):
        for batch in batches:
            for i, j, t in _parts(batch.column(1)):
                g, doc, _ = bags(t)
                order = np.lexsort((g, doc))
                g, doc = g[order], doc[order]
                at = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1]))) if len(g) else np.empty(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + doc[at])), pa.array(g[at].view(np.int64)), pa.array(np.diff(np.append(at, len(g))))], names=["node", "run", "n"])

    return nodes.select("node", "text").mapInArrow(freeing(bag), "node binary, run long, n long")


def _cross(shared: DataFrame, nodes: DataFrame, parts: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs of nodes that lie in one bucket and in different components, where they can be similar enough.

    A bucket that lies in one component has none. Of a bag, only the weight of
    runs that bags of other components have too can be shared with them; a bag
    with less of it than the least similarity asks for leaves before pairs are
    made. A pair is made in the first bucket that it shares.
    """
    label = shared.join(parts.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = label.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
    label = written(label.join(apart, "h", "left_semi"), "apart")
    roots = label.select("node", "root").distinct()
    runs = written(_runs(texts.join(roots, "node", "left_semi")).join(roots, "node"), "runs", TEXTS)
    often = runs.groupBy("run").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("run")
    common = runs.join(often, "run").groupBy("node").agg(F.sum("n").alias("common"))
    label = written(label.join(common, "node").join(nodes.select("node", "bands"), "node").where(F.col("common") >= F.lit(least) * F.col("size")), "apart")
    x, y = (label.select("h", *[F.col(c).alias(f"{c}{i}") for c in ("node", "root", "size", "common", "bands")]) for i in (1, 2))
    first = F.filter(F.arrays_zip("bands1", "bands2"), lambda z: z["bands1"] == z["bands2"])[0]["bands1"]
    shares = F.least("common1", "common2") * F.lit(1 + least) >= F.lit(least) * (F.col("size1") + F.col("size2"))
    pairs = x.join(y, (x.h == y.h) & F.expr("node1 < node2 and root1 <> root2") & _alike("size1", "size2", least) & shares & (first == x.h))
    return pairs.select(F.col("node1").alias("a"), F.col("node2").alias("b"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """One row per document: id, mark, class_id (the least id of its class), n_runs, keep (in the rows of one id and text of each class), twin (further rows have this id and text)."""
    signed = written(sign(docs, id_col, text_col), "signed", TEXTS)
    own = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    nodes = written(signed.where("size > 0").groupBy("node").agg(F.min(own).alias("own"), F.first("size").alias("size"), F.first("bands").alias("bands")), "nodes")
    rows = nodes.select("node", "size", F.explode("bands").alias("h"))
    counts = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(rows.join(counts, "h"), "buckets")
    involved = shared.select("node").distinct().join(nodes.select("node", "own"), "node")
    texts = _texts(docs, involved, id_col, text_col)
    # First every bucket's nodes against the node that meets the most others.
    degree = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    known = shared.join(degree, "node")
    centre = known.groupBy("h").agg(F.max(F.struct("degree", "node", "size")).alias("c"))
    star = known.join(centre, "h").where(F.col("node") != F.col("c.node")).where(_alike("size", "c.size", least))
    stars = written(star.select(F.col("node").alias("a"), F.col("c.node").alias("b")).distinct(), "stars")
    parts = components(_verified(stars, texts, least))
    # Then what that left apart.
    seen = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = written(_cross(shared, nodes, parts, texts, least).join(seen, ["a", "b"], "left_anti"), "rest")
    more = _verified(rest, texts, least)
    if not more.isEmpty():
        parts = components(parts.union(more))
    root = nodes.select("node", "own").join(parts.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = root.join(root.groupBy("root").agg(F.min("own").alias("own")).withColumnRenamed("own", "first"), "root").select("node", "first")
    out = signed.select("id", "mark", "node", "size").join(named, "node", "left")
    twins = signed.where("size > 0").groupBy("id", "mark").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("id").alias("i"), F.col("mark").alias("m"))
    out = out.join(twins, out.id.eqNullSafe(twins.i) & (out.mark == twins.m), "left")
    alone = F.col("size") == 0
    keep = alone | F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark"))
    return out.select(F.col("id").alias(id_col), "mark", F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("class_id"), F.col("size").alias("n_runs"), keep.alias("keep"), F.col("m").isNotNull().alias("twin"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """The documents without all but one of each class; documents without words stay."""
    found = written(classes(docs, id_col, text_col, least), "classes")
    gone = found.where("not keep").select(F.col(id_col).alias("__id"), F.col("mark").alias("__mark")).distinct()
    kept = docs.join(gone, docs[id_col].eqNullSafe(gone.__id) & (mark(text_col) == gone.__mark), "left_anti")
    twins = found.where("keep and twin").select(F.col(id_col).alias("__id"), F.col("mark").alias("__mark")).distinct()
    if twins.isEmpty():
        return kept
    same = kept[id_col].eqNullSafe(twins.__id) & (mark(text_col) == twins.__mark)
    once = kept.join(twins, same, "left_semi")
    return kept.join(twins, same, "left_anti").unionByName(once.dropDuplicates([id_col, text_col]))
