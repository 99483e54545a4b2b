"""Byte-level BPE encoding and decoding with padded numpy matrices.

A text is cut by the vocabulary's pattern. Pieces that are tokens as they
stand map at once; the others are put, by length, into padded matrices of
token ids. In each round every row looks all its neighbour pairs up in a hash
table, merges its leftmost pair of least rank and is compacted; rows without a
pair leave. Pieces of more than ``LONG`` bytes, for which a merge a round would
take quadratic time, go by the same rule through a heap of pairs.

A null text is empty: no tokens, digests of nothing. Repeated rows are encoded
each for itself; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from .text import U64, Lookup

LONG = 192
#: Above all ranks.
NONE = np.int32((1 << 31) - 1)
#: Chunks remembered by a worker, at most.
REMEMBER = 400_000


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs, merged = [], []
        for b, r in ranks.items():
            for i in range(1, len(b)):
                x, y = ranks.get(b[:i]), ranks.get(b[i:])
                if x is not None and y is not None:
                    pairs.append(x << 32 | y)
                    merged.append(r)
        self.table, self.merged = Lookup(np.array(pairs, dtype=np.uint64) + U64(1)), np.array(merged, dtype=np.int32)
        self.pair = dict(zip(pairs, merged))
        self.vocabulary = Arena(self.bytes_of, np.uint8)
        self.known: dict[str, int] = {}
        self.arena = Arena()

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a value above all ranks; ids of -1 are padding."""
        out = np.full(a.shape, NONE, dtype=np.int32)
        both = np.flatnonzero((b.ravel() >= 0) & (a.ravel() >= 0))
        at = self.table.find((a.ravel()[both].astype(U64) << U64(32) | b.ravel()[both].astype(U64)) + U64(1))
        out.ravel()[both[at >= 0]] = self.merged[at[at >= 0]]
        return out

    def _matrix(self, pieces: list[bytes]) -> list[list[int]]:
        """Encodes pieces of like length."""
        width = max(map(len, pieces))
        lens = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), width + 1), -1, dtype=np.int32)
        inside = np.arange(width + 1) < lens[:, None]
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        ranks = self._rank(ids[:, :-1], ids[:, 1:])
        out: list[list[int]] = [[]] * len(pieces)
        row = np.arange(len(pieces))
        while len(row):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(row)), at]
            over = least >= NONE
            if over.any():
                for r, x, n in zip(row[over].tolist(), ids[over].tolist(), lens[over].tolist()):
                    out[r] = x[:n]
                go = ~over
                row, ids, ranks, lens, at, least = row[go], ids[go], ranks[go], lens[go], at[go], least[go]
                if not len(row):
                    break
            n, k = np.arange(len(row)), np.arange(ids.shape[1])
            ids[n, at] = least
            shift = k[None, :-1] > at[:, None]
            ids[:, :-1] = np.where(shift, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ranks[:, :-1] = np.where(shift[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            lens -= 1
            for side in (at - 1, at):
                ok = side >= 0
                ranks[n[ok], side[ok]] = self._rank(ids[n[ok], side[ok]], ids[n[ok], side[ok] + 1])
        return out

    def _heap(self, piece: bytes) -> list[int]:
        """The same rule for one long piece: a heap by (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pair.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (s := self.pair.get(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (s, a, ids[a], ids[b]))
        return [x for x in ids if x >= 0]

    def pieces(self, found: set[str]) -> dict[str, list[int]]:
        """The ids of each piece."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        out: dict[str, list[int]] = {}
        for p in found:
            b = p.encode()
            if (r := self.ranks.get(b)) is not None:
                out[p] = [r]
            elif len(b) > LONG:
                out[p] = self._heap(b)
            else:
                by_size.setdefault(len(b) if len(b) < 16 else 16 + len(b) // 8, []).append((p, b))
        for rows in by_size.values():
            step = max(1, 100_000 // len(rows[0][1]))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                for (p, _), x in zip(part, self._matrix([b for _, b in part])):
                    out[p] = x
        return out

    def learn(self, chunks: set[str]) -> None:
        """Encodes chunks that aren't remembered yet."""
        chunks_ = list(chunks)
        cut = [self.split(c) for c in chunks_]
        ids = self.pieces(set().union(*cut))
        n = len(self.known)
        flat = [[x for p in c for x in ids[p]] for c in cut]
        self.known.update(zip(chunks_, range(n, n + len(flat))))
        self.arena.add(flat)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. A space between two characters that aren't white space always begins a piece, so the chunks that begin there are encoded once each and remembered."""
        if len(self.known) > REMEMBER:
            self.known, self.arena = {}, Arena()
        cut = [[" " + c if i else c for i, c in enumerate(_SINGLE(t))] for t in texts]
        new = set().union(*cut).difference(self.known)
        if new:
            self.learn(new)
        get = self.known.__getitem__
        ends = np.cumsum([len(c) for c in cut])
        at = np.fromiter(map(get, chain.from_iterable(cut)), dtype=np.int64, count=int(ends[-1]))
        ids, bounds = self.arena.take(at)
        bounds = bounds[ends]
        return np.split(ids, bounds[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.vocabulary.take(ids)[0].tobytes()


_SINGLE = re.compile(r" (?=\S)(?<=\S )").split


class Arena:
    """Lists of numbers one after the other in one array."""

    def __init__(self, rows=(), kind="<u4"):
        self.data, self.starts, self.lens = np.empty(1 << 12, dtype=kind), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.used = 0
        self.add(rows)

    def add(self, rows) -> None:
        lens = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        total = int(lens.sum())
        if self.used + total > len(self.data):
            self.data = np.resize(self.data, 2 * (self.used + total))
        self.data[self.used : self.used + total] = np.fromiter(chain.from_iterable(rows), dtype=self.data.dtype, count=total)
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.used += total

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows ``at`` one after the other, and the bounds between them."""
        lens = self.lens[at]
        bounds = np.concatenate([[0], np.cumsum(lens)])
        move = np.repeat(self.starts[at] - bounds[:-1], lens)
        return self.data[move + np.arange(bounds[-1])], bounds


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Bpe:
    """The vocabulary at ``path``, a file on every executor's machine; kept by each Python worker."""
    with open(path, "rb") as f:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def runs(texts: list[str | None], most: int = 1 << 20):
    """Texts in groups of about ``most`` characters."""
    group, size = [], 0
    for t in texts:
        group.append(t or "")
        size += len(group[-1])
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids (token ids), decoded (bytes of the ids)."""

    def encode(batches):
        bpe = load(path, pattern)
        for batch in batches:
            ids, start = batch.column(0), 0
            for group in runs(batch.column(1).to_pylist()):
                x = bpe.encode(group)
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(group)), pa.array(x, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in x], pa.binary())], names=["id", "ids", "decoded"])
                start += len(group)

    schema = docs.select(docs[id_col].alias("id")).schema.add("ids", ArrayType(IntegerType())).add("decoded", "binary")
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(encode, schema).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256."""

    def encode(batches):
        bpe = load(path, pattern)
        for batch in batches:
            start = 0
            for group in runs(batch.column(1).to_pylist()):
                x = bpe.encode(group)
                n = len(group)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), pa.array([len(i) for i in x], pa.int64()), pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in x]), pa.array([hashlib.sha256(bpe.decode(i)).hexdigest() for i in x])], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
                start += n

    schema = docs.select(docs[id_col].alias("id")).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(encode, schema).withColumnRenamed("id", id_col)
