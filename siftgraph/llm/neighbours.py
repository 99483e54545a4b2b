"""Nearest neighbours by a forest of random-projection trees.

Equal vectors are one point that keeps its ``k`` + 1 smallest ids, all that any
answer can name. The trees are fitted on at most ``sample`` points (those of
the least hashes; a documented bound): a node's plane lies between two random
points of it, at the median of the node, down to leaves of ``leaf`` points.
Every point is put into one leaf of each tree. A query walks all trees through
one priority queue, nearest planes first, until the leaves it has reached hold
a share of all points; these are ranked by exact distance in double precision.
The share is the least that gives the sample's own queries ``recall`` of their
true neighbours within the sample: small for clustered vectors, large for
vectors without structure, for which no index prunes much.

Neighbouring leaves form shelves; a shelf of more than ``block`` points is cut
into blocks, to each of which its queries go, so no task grows with a leaf. Distinct queries are searched once and joined to their rows last.

Vectors that are null, zero, of another dimension than most, or that hold null
or non-finite components take no part, as queries or candidates. Rows of a
null id take none either. Repeated ids count once for each vector. Other
columns are ignored, whatever their names. Without candidates there are no
rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .storage import written
from .text import mix

TREES, LEAF, SAMPLE, BLOCK, SHELF, RECALL = 24, 64, 1 << 14, 1 << 16, 16, 0.96
#: Shares of all points that a walk's leaves may have to hold together, in order of trial.
LADDER = (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0, 1.5, 2.0, 4.0)


class Tree:
    """Nodes in arrays: children of an inner node, or -1 - leaf."""

    def __init__(self, points: np.ndarray, leaf: int, seed: int):
        rng = np.random.default_rng(seed)
        self.normal, self.cut, self.child = [], [], []
        self.leaves = 0
        todo = [(np.arange(len(points)), None)]
        while todo:
            rows, parent = todo.pop()
            me = len(self.normal)
            if parent is not None:
                self.child[parent[0]][parent[1]] = me
            x = points[rows]
            normal, cut, left = np.zeros(points.shape[1]), 0.0, None
            if len(rows) > leaf:
                for _ in range(5):
                    a, b = rng.choice(len(rows), 2, replace=False)
                    normal = x[a] - x[b]
                    size = np.linalg.norm(normal)
                    if size > 0:
                        normal = normal / size
                        side = x @ normal
                        cut = float(np.median(side))
                        left = side < cut
                        if left.any():
                            break
                    left = None
            self.normal.append(normal)
            self.cut.append(cut)
            if left is None:
                self.child.append([-1 - self.leaves] * 2)
                self.leaves += 1
            else:
                self.child.append([0, 0])
                todo += [(rows[left], (me, 0)), (rows[~left], (me, 1))]
        self.normal, self.cut, self.child = np.array(self.normal), np.array(self.cut), np.array(self.child)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at, out = np.zeros(len(x), dtype=np.int64), np.full(len(x), -1)
        todo = np.arange(len(x))
        while len(todo):
            node = at[todo]
            c = self.child[node, 0]
            done = c < 0
            out[todo[done]] = -1 - c[done]
            todo, node = todo[~done], node[~done]
            right = np.einsum("ij,ij->i", x[todo], self.normal[node]) >= self.cut[node]
            at[todo] = self.child[node, right.astype(np.int64)]
        return out


def walk(trees: list[Tree], counts: list[np.ndarray], x: np.ndarray, reach: int) -> list[list[tuple[int, int]]]:
    """The (tree, leaf) pairs of each query, through one queue over all trees, nearest planes first."""
    sides = [x @ t.normal.T - t.cut for t in trees]
    child = [t.child.tolist() for t in trees]
    out = []
    for q in range(len(x)):
        own = [s[q].tolist() for s in sides]
        heap = [(0.0, t, 0) for t in range(len(trees))]
        held, got = 0, []
        while heap and held < reach:
            far, t, node = heapq.heappop(heap)
            while child[t][node][0] >= 0:
                d = own[t][node]
                near, other = child[t][node][d >= 0], child[t][node][d < 0]
                heapq.heappush(heap, (max(far, abs(d)), t, other))
                node = near
            leaf = -1 - child[t][node][0]
            got.append((t, leaf))
            held += int(counts[t][leaf])
        out.append(got)
    return out


def calibrated(trees: list[Tree], x: np.ndarray, k: int, recall: float, queries: int = 96) -> float:
    """The share of the points that a walk has to reach, found on the sample."""
    n = min(queries, len(x))
    if len(x) <= k + 1:
        return float(len(trees))
    near = [np.lexsort((np.arange(len(x)), np.where(np.arange(len(x)) == i, np.inf, ((x - x[i]) ** 2).sum(axis=1))))[:k] for i in range(n)]
    leaf = [t.leaf_of(x) for t in trees]
    counts = [np.bincount(g, minlength=t.leaves) for g, t in zip(leaf, trees)]
    for share in LADDER:
        hits = 0
        for i, got in enumerate(walk(trees, counts, x[:n], int(share * len(x)))):
            pairs = set(got)
            hits += sum(any((t, int(leaf[t][j])) in pairs for t in range(len(trees))) for j in near[i])
        if hits >= recall * n * k:
            return share
    return float(len(trees))


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) that take part; single-precision vectors stay so on their way, which loses nothing."""
    kind = vectors.schema[vec_col].dataType
    narrow = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = F.col(vec_col).cast("array<float>" if narrow else "array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    ok = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & sound
    good = vectors.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    size = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("v") == (size.n if size else 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def neighbours(
    vectors: DataFrame,
    k: int = 10,
    every: int = 100,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    trees: int = TREES,
    leaf: int = LEAF,
    recall: float = RECALL,
    sample: int = SAMPLE,
    block: int = BLOCK,
    seed: int = 11,
) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = written(_usable(vectors, id_col, vec_col), "vectors")
    kind = rows.schema["v"].dataType.simpleString()
    # The smallest ids of each vector: ranks are limited before the shuffle.
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    points = few.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    points = written(points.select(F.col("ids")[0].alias("point"), "ids", "v"), "points")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").distinct()
    asked = written(asked.join(points.select("v", "point"), "v").select("query_id", "point", "v"), "asked")
    fit = points.select("v", "point").orderBy(F.xxhash64("point"), "point").limit(sample).select("v").toArrow()
    if not fit.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = _matrix(fit["v"])
    trees_ = [Tree(x, leaf, seed + i) for i in range(trees)]
    share = calibrated(trees_, x, k, recall)
    forest = spark.sparkContext.broadcast(trees_)

    def tally(batches):
        for p in batches:
            x = _matrix(p.column(0))
            for t, tree in enumerate(forest.value):
                n = np.bincount(tree.leaf_of(x), minlength=tree.leaves)
                at = np.flatnonzero(n)
                yield _batch(tree=np.full(len(at), t, dtype=np.int32), leaf=at, n=n[at])

    # One number for each leaf of the fitted trees: bounded by the sample.
    sizes = points.select("v").mapInArrow(tally, "tree int, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).toArrow()
    counts = [np.zeros(t.leaves, dtype=np.int64) for t in trees_]
    of, at, n = (sizes[c].to_numpy() for c in ("tree", "leaf", "n"))
    for t in range(trees):
        counts[t][at[of == t]] = n[of == t]
    blocks = [-(-np.add.reduceat(c, np.arange(0, len(c), SHELF)) // block) for c in counts]
    known = spark.sparkContext.broadcast((counts, [np.maximum(b, 1) for b in blocks], int(share * counts[0].sum())))

    def place(batches):
        for p in batches:
            x, ids = _matrix(p.column(1)), p.column(0).to_numpy()
            dice = (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(1)).astype(np.int64)
            for t, tree in enumerate(forest.value):
                g = tree.leaf_of(x)
                shelf = g // SHELF
                tree_ = np.full(len(g), t, dtype=np.int32)
                yield _batch(tree=tree_, shelf=shelf, block=dice % known.value[1][t][shelf], leaf=g, point=p.column(0), v=p.column(1))

    def seek(batches):
        counts, blocks, reach = known.value
        for p in batches:
            x, ids = _matrix(p.column(1)), p.column(0)
            for i in range(0, len(x), 64):
                rows = []
                for j, got in enumerate(walk(forest.value, counts, x[i : i + 64], reach), i):
                    shelves: dict[tuple[int, int], list[int]] = {}
                    for t, g in got:
                        shelves.setdefault((t, g // SHELF), []).append(g)
                    rows += [(t, s, b, sorted(g), j) for (t, s), g in shelves.items() for b in range(blocks[t][s])]
                tree, shelf, part, leaves, own = zip(*rows)
                own = pa.array(own, pa.int64())
                yield _batch(tree=pa.array(tree, pa.int32()), shelf=pa.array(shelf, pa.int64()), block=pa.array(part, pa.int64()), leaves=pa.array(leaves, pa.list_(pa.int64())), query=ids.take(own), q=p.column(1).take(own))

    def rank(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if a.num_rows and b.num_rows:
            g = a["leaf"].to_numpy()
            order = np.argsort(g, kind="stable")
            g, ids, x = g[order], a["point"].to_numpy()[order], _matrix(a["v"])[order]
            for query, q, leaves in zip(b["query"].to_pylist(), _matrix(b["q"]), b["leaves"].to_pylist()):
                lo, hi = np.searchsorted(g, leaves, "left"), np.searchsorted(g, leaves, "right")
                at = np.concatenate([np.arange(i, j) for i, j in zip(lo, hi)])
                d = np.sqrt(((x[at] - q) ** 2).sum(axis=1))
                best = np.lexsort((ids[at], d))[: k + 1]
                out.append((np.full(len(best), query), ids[at][best], d[best]))
        return pa.table(dict(zip(("query", "point", "score"), map(np.concatenate, zip(*out)))))

    keys = ["tree", "shelf", "block"]
    stock = points.select("point", "v").mapInArrow(place, f"tree int, shelf long, block long, leaf long, point long, v {kind}")
    asks = asked.select("point", "v").distinct().mapInArrow(seek, f"tree int, shelf long, block long, leaves array<long>, query long, q {kind}")
    found = stock.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(rank, "query long, point long, score double")
    found = found.groupBy("query", "point").agg(F.min("score").alias("score"))
    near = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("score", "point"))).where(F.col("r") <= k + 1)
    near = near.join(points.select("point", "ids"), "point").select(F.col("query").alias("point"), "score", F.explode("ids").alias("vec_id"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("point").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1).drop("r")
    # A query's own row is left out of its list; each list has k + 1 rows at most, gathered once for each distinct vector.
    lists = near.groupBy("point").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("list"))
    own = asked.select("query_id", "point").join(lists, "point")
    best = F.slice(F.filter("list", lambda s: s["vec_id"] != F.col("query_id")), 1, k)
    told = own.select("query_id", F.posexplode(best).alias("rank", "s"))
    return told.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("s.vec_id").alias("vec_id"), F.col("s.score").alias("score"))
