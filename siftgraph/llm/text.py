"""Vectorised text work on Arrow batches: words, word hashes, n-gram hashes.

Texts are handled as UTF-8 bytes in one numpy buffer for a whole slice of a
batch, so no Python object is made for a word. A null text is an empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BLOCK = 1 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_class(test) -> np.ndarray:
    return np.array([bool(test(b)) for b in range(256)])


#: Word bytes of the two tokenisations used here.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
NONSPACE = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))

_FOLD = np.arange(256)
_FOLD[0x41:0x5B] += 32
_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))[_FOLD]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, _BLOCK + 1)
        inverse = pow(_MULT, -1, 1 << 64)
        tables = []
        for base in (_MULT, inverse):
            t = np.full(n, base & _MASK, dtype=U64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        if n > 4 * _BLOCK:  # one word of several MB: not worth keeping
            return tables[0], tables[1]
        _powers = tables[0], tables[1]
    return _powers


class Texts:
    """Some whole texts in one byte buffer. ``offs`` has a bound more than texts."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs

    def __len__(self) -> int:
        return len(self.offs) - 1

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of ``table`` bytes that lie in one text, and for each text the index of its first word (one more at the end)."""
        n = len(self.data)
        on = np.zeros(n + 2, dtype=bool)
        on[1:-1] = table[self.data]
        starts = on[1:-1] & ~on[:-2]
        ends = on[1:-1] & ~on[2:]
        inner = self.offs[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        starts[inner] |= on[1:-1][inner]
        ends[inner - 1] |= on[1:-1][inner - 1]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        return s, e, np.searchsorted(s, self.offs)

    def hashes(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """64-bit hashes of the words with A-Z folded to a-z."""
        out = np.empty(len(s), dtype=U64)
        i = 0
        while i < len(s):
            j = max(i + 1, int(np.searchsorted(e, s[i] + _BLOCK, "right")))
            lo, hi = s[i], e[j - 1]
            up, down = _power_tables(int(hi - lo) + 1)
            sums = np.zeros(hi - lo + 1, dtype=U64)
            np.cumsum(_BYTES[self.data[lo:hi]] * up[: hi - lo], out=sums[1:])
            a, b = s[i:j] - lo, e[i:j] - lo
            out[i:j] = (sums[b] - sums[a]) * down[a] + (b - a).astype(U64) * U64(0xA0761D6478BD642F)
            i = j
        return mix(out)

    def text(self, k: int) -> bytes:
        return self.data[self.offs[k] : self.offs[k + 1]].tobytes()


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order, over the whole array (the caller masks runs that cross texts)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    out = np.zeros(n, dtype=U64)
    for j in range(k):
        out *= U64(0x8CB92BA72F3D8DD7)
        out += h[j : j + n]
    return mix(out + U64(k))


def slices(column: pa.Array | pa.ChunkedArray, most: int = 2 << 20) -> Iterator[tuple[int, int, Texts]]:
    """(first row, row after the last, texts) of slices of about ``most`` bytes; a longer text is a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.empty(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1))
        yield i, j, Texts(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


def freeing(work):
    """``work``, for mapInArrow; when a task is done, freed memory goes back to the system. Python workers outlive their tasks, and numpy and Arrow would keep what the largest of these took."""

    def run(batches):
        for out in work(batches):
            yield out
        out = None
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return run


class Lookup:
    """A hash table from non-zero uint64 keys to positions, built at the first probe, probed with whole arrays. Only the keys are pickled, so a driver that never probes holds no more than these."""

    def __getstate__(self) -> np.ndarray:
        return self.keys

    def __setstate__(self, keys: np.ndarray) -> None:
        self.__init__(keys)

    def __init__(self, keys: np.ndarray):
        self.keys = np.asarray(keys, dtype=U64)
        self.slots: np.ndarray | None = None

    def _build(self) -> None:
        bits = max(4, int(2 * max(1, len(self.keys)) - 1).bit_length())
        self.shift = U64(64 - bits)
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        self.mask = (1 << bits) - 1
        todo = np.arange(len(self.keys), dtype=np.int64)
        at = self._home(self.keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # the last of several wins; the rest go on
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0xC2B2AE3D27D4EB4F)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.keys) or not len(keys):
            return out
        if self.slots is None:
            self._build()
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            got = self.slots[at]
            hit = (got >= 0) & (self.keys[np.maximum(got, 0)] == keys[todo])
            out[todo[hit]] = got[hit]
            on = (got >= 0) & ~hit
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out
