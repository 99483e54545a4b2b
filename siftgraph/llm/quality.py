"""Quality classifier: an interpolated modified Kneser-Ney trigram model.

Tokens are runs of letters and digits (A-Z folded) and single other characters
that aren't white space. The model is fitted on trusted documents, those labelled
good and never toxic: of each language all of one hash-chosen half of them (a
part of about ``fit_mb`` of text, where that is given); the other half sets the
thresholds. Slices of the texts are sent as messages (columns of numbers, a list
of their words) to shards by the middle token of a trigram, where all grams and
contexts with it meet and are counted; counts without context are grouped by
language and word, and these probabilities joined back to the shards.

A model of at most ``local`` trigrams (measured) is broadcast to the scorers.
A larger one stays in shards: the documents' tokens are sent to the shard of the
token before, and those whose last two tokens weren't seen go on to the shard of
the token itself; sums for each document come back to a part named by its slice.
The results are the same. A token that follows one very frequent token goes to
one shard, which grows with that token's count.

A document's value is its perplexity, smoothed by ``prior`` tokens of its
language's average so that a few words decide nothing. Documents above the
``quantile`` of their language's trusted documents outside the sample times
``slack`` (of the log) are rejected; the quantiles cover all of these, of any
length. A language all of whose trusted documents lie in the first half has no
quantile of its own and takes the largest threshold of the others. Averages and
thresholds are tables by language, joined with the documents.

A null language is one of its own. Documents without tokens are rejected: they
hold nothing to keep; where no trusted document has the language, the model of
all languages together decides. Null labels and labels of unknown documents
count for nothing. Repeated rows are scored each for itself, and columns other
than the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import removed, written
from .text import ALNUM, U64, Lookup, Texts, freeing, mix, slices

PRIOR, QUANTILE, SLACK = 30.0, 0.995, 1.1
FIT_MB: float | None = None  # trusted text that a language's model is fitted on; None: all of its half
LOCAL, SHARD = 1 << 21, 8 << 20  # trigrams of a model that is broadcast; documents' tokens of a shard, about
COUNTED = 1 << 20  # trusted tokens that are counted together, about
PASSES = 6  # parts of the documents that are sent to the shards one after the other, so that a part's messages alone are on disk
MESSAGES = "3m"  # bytes of messages or texts that a Python worker takes at once
SLICE, _ROWS = 4 << 20, 20  # most bytes of text whose tokens are sent together, above MESSAGES so that what is taken at once is one slice; bits of a document's place among them
BYTES = 4  # of text for a token, about
_START = U64(0x51)
_TWO = U64(0xA5A3564E27F8862B)
_CLASS = np.where(ALNUM, 1, 2).astype(np.int8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
ALL = "*"


def _tokens(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, index of each text's first token and one more)."""
    kind = _CLASS[t.data]
    before = np.concatenate([np.zeros(1, dtype=np.int8), kind[:-1]]) if len(kind) else kind
    first = (kind == 2) | ((kind == 1) & (before != 1))
    inner = t.offs[1:-1]
    inner = inner[inner < len(kind)]
    first[inner] |= kind[inner] == 1
    s = np.flatnonzero(first)
    stop = np.append(s[1:], len(kind))
    run = np.flatnonzero(kind != 1)
    e = np.where(kind[s] == 2, s + 1, np.minimum(stop, np.append(run, len(kind))[np.searchsorted(run, s)]))
    return t.hashes(s, e), np.searchsorted(s, t.offs)


def _lang_hash(names: list[str | None]) -> np.ndarray:
    from hashlib import blake2b

    known = {n: int.from_bytes(blake2b(repr(n).encode(), digest_size=8).digest(), "little") for n in set(names)}
    return np.array([known[n] for n in names], dtype=U64)


def _hashed(t: Texts, most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """As ``_tokens``, some texts at a time, whose arrays are small."""
    h, first, i = [np.empty(0, dtype=U64)], [np.zeros(1, dtype=np.int64)], 0
    while i < len(t):
        j = min(len(t), max(i + 1, int(np.searchsorted(t.offs, t.offs[i] + most, "right")) - 1))
        mine, at = _tokens(Texts(t.data[t.offs[i] : t.offs[j]], t.offs[i : j + 1] - t.offs[i]))
        h.append(mine), first.append(at[1:] + first[-1][-1])
        i = j
    return np.concatenate(h), np.concatenate(first)


def _folded(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes of the tokens ``h`` as words of the languages ``g``."""
    return mix(h ^ g)


def _coded(g: np.ndarray, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """The words of some texts of the languages ``g`` and their languages; for each token the places of u, v and w among the words: the two tokens before it in its own text and itself."""
    size = np.diff(first)
    langs, of = np.unique(g, return_inverse=True)
    each = np.repeat(of, size)
    found = pc.dictionary_encode(pa.array(np.concatenate([_folded(langs, np.full(len(langs), _START)), _folded(langs[each], h)])))
    words, ids = np.asarray(found.dictionary), np.asarray(found.indices)
    lang = np.empty(len(words), dtype=U64)
    lang[ids[: len(langs)]], start, w = langs, ids[: len(langs)][of], ids[len(langs) :]
    lang[w] = langs[each]
    u, v = np.empty_like(w), np.empty_like(w)
    v[1:], u[2:] = w[:-1], w[:-2]
    v[first[:-1][size > 0]] = u[first[:-1][size > 0]] = start[size > 0]
    u[first[:-1][size > 1] + 1] = start[size > 1]
    return words, lang, u, v, w


def _discounts(counts: DataFrame, by: list[str], times) -> DataFrame:
    """(by, d1, d2, d3) of modified Kneser-Ney; ``times(i)`` aggregates the number of grams counted i times."""
    c = counts.groupBy(*by).agg(*[F.coalesce(times(i), F.lit(0)).cast("double").alias(f"c{i}") for i in (1, 2, 3, 4)])
    y = F.col("c1") / F.greatest(F.col("c1") + 2 * F.col("c2"), F.lit(1.0))
    d = [F.greatest(F.lit(0.1), F.least(F.lit(i - 0.1), F.coalesce(i - (i + 1) * y * F.try_divide(f"c{i + 1}", f"c{i}"), F.lit(0.5)))) for i in (1, 2, 3)]
    return c.select(*by, *[x.alias(f"d{i}") for i, x in enumerate(d, 1)])


def _alone(c1: DataFrame) -> DataFrame:
    """(g, w, p, zero): probability of each word without context, and that of a word unseen in its language."""
    n = F.col("n")
    sums = {"total": F.sum("n"), "words": F.count("*"), "n1": F.count_if(n == 1), "n2": F.count_if(n == 2), "n3": F.count_if(n >= 3)}
    by = c1.groupBy("g").agg(*[x.alias(k) for k, x in sums.items()]).join(_discounts(c1, ["g"], lambda i: F.count_if(n == i)), "g")
    left = (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total").cast("double")
    by = by.select("g", "total", "d1", "d2", "d3", (left / (F.col("words") + 1)).alias("zero"))
    d = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
    return c1.join(F.broadcast(by), "g").select("g", "w", ((n - d) / F.col("total").cast("double") + F.col("zero")).alias("p"), "zero")  # by: a row for each language


class Model:
    """Finished probabilities of the seen grams and weights of the seen contexts of one shard, or of all."""

    def __init__(self, grams: list[np.ndarray] | None, langs: dict[int, tuple], words: np.ndarray | None = None, p: np.ndarray | None = None):
        """``grams``: as of ``_merged``; ``words`` and ``p``: words with their probability without context."""
        if grams is None:
            grams = [np.empty(0, t) for t in (U64, U64, float, int, int, int, int)]
        self.words, lang, lower, u, v, w, n = grams
        known, of = np.unique(lang, return_inverse=True)
        d2, d3 = (np.array([langs[int(x)][i] for x in known]).reshape(-1, 3) for i in (1, 2))
        two, at, n2 = np.unique(v.astype(np.int64) << 32 | w, return_inverse=True, return_counts=True)
        at = at.astype(np.int32)
        v2 = two >> 32
        new = v2[1:] != v2[:-1]
        start, of2 = np.flatnonzero(np.append(len(v2) > 0, new)[: len(v2)]), np.cumsum(np.append(0, new))[: len(v2)]
        d = d2[of[v2], np.minimum(n2, 3) - 1]
        total = np.add.reduceat(n2, start) if len(start) else start
        left = np.add.reduceat(d, start) / total if len(start) else d
        p2 = (n2 - d) / total[of2] + left[of2] * lower[two & 0xFFFFFFFF]
        self.left1 = np.ones(len(self.words) + 1, dtype=np.float32)  # the last is what an unseen context leaves: all
        self.left1[v2[start]] = left
        new = (v[1:] != v[:-1]) | (u[1:] != u[:-1])
        start, of3 = np.flatnonzero(np.append(len(v) > 0, new)[: len(v)]), np.cumsum(np.append(0, new))[: len(v)].astype(np.int32)
        d = d3[of[v], np.minimum(n, 3) - 1]
        total = np.add.reduceat(n, start, dtype=np.int64) if len(start) else start
        left = np.add.reduceat(d, start) / total if len(start) else d
        self.p3 = ((n - d) / total[of3] + left[of3] * p2[at]).astype(np.float32)
        self.left2, self.p2 = np.append(left, 1).astype(np.float32), p2.astype(np.float32)
        self.three, self.two, self.contexts = (Lookup(x.astype(U64)) for x in (of3.astype(np.int64) << 32 | at, two, v[start].astype(np.int64) << 32 | u[start]))
        self.langs, self.one, self.p1 = langs, Lookup(np.empty(0, U64) if words is None else words), p

    def seen(self, words: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each token, positions where the token's own share is still to be multiplied). u, v, w: places in ``words``."""
        at = np.searchsorted(self.words, words)
        at[at == len(self.words)] = 0
        at = np.where(self.words[at] == words, at, -1) if len(self.words) else np.full(len(words), -1)
        u, v, w = at[u], at[v], at[w]
        # No key holds a place of -1. Position -1 is the 1 at the end.
        context, two = self.contexts.find(((v << 32) + u).view(U64)), self.two.find(((v << 32) + w).view(U64))
        p = self.left2[context].astype(np.float64)
        i = np.flatnonzero(two >= 0)
        p[i] *= self.p2[two[i]]
        i = i[context[i] >= 0]
        three = self.three.find((context[i] << 32 | two[i]).view(U64))
        p[i[three >= 0]] = self.p3[three[three >= 0]]
        i = np.flatnonzero(two < 0)
        p[i] *= self.left1[v[i]]
        return p, i

    def alone(self, words: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Share of each word without context."""
        at = self.one.find(words)
        g, back = np.unique(lang, return_inverse=True)
        out = np.array([self.langs[int(x)][0] if int(x) in self.langs else 1e-7 for x in g])[back] if len(g) else np.empty(0)
        out[at >= 0] = self.p1[at[at >= 0]]
        return out

    def coded_logs(self, words: np.ndarray, lang: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 probability of each token."""
        out, i = self.seen(words, u, v, w)
        out[i] *= self.alone(words, lang)[w[i]]
        return np.log10(out)

    def logs(self, lang: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 probability of each token w of a language after u and v, all as hashes."""
        words, ids = np.unique(np.concatenate([_folded(lang, x) for x in (u, v, w)]), return_inverse=True)
        u, v, w = ids.reshape(3, -1)
        g = np.empty(len(words), dtype=U64)
        g[w] = g[v] = g[u] = lang
        return self.coded_logs(words, g, u, v, w)


_MESSAGE = "part int, kind int, size int, blob binary"
_GRAMS, _LOWER, _DOCS, _SIZES, _SUMS = range(5)  # kinds of messages; a part's model comes before its documents


def _part(word: np.ndarray, parts: int) -> np.ndarray:
    part = mix(word + _TWO) % U64(parts)
    return part.astype(np.uint16 if parts <= 1 << 16 else np.int32)  # few bits are sorted by radix


def _dealt(part: np.ndarray, n: int, *ids: np.ndarray):
    """For each part: its number, the positions that it gets, which of ``n`` words their ``ids`` name, and the places of these among them."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, dtype=np.int64)
    place = np.empty(n, dtype=np.int32)
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(part)]):
        at = order[a:b]
        mine = [x[at] for x in ids]
        if n > 8 * len(at):
            met, flat = np.unique(np.concatenate(mine), return_inverse=True)
            mine = list(flat.reshape(len(mine), -1))
        else:
            flag = np.zeros(n, dtype=bool)
            for x in mine:
                flag[x] = True
            met = np.flatnonzero(flag)
            place[met] = np.arange(len(met), dtype=np.int32)
            mine = [place[x] for x in mine]
        yield int(part[a]), at, met, [x.astype(np.min_scalar_type(len(met))) for x in mine]


def _message(part: int, kind: int, *arrays: np.ndarray) -> tuple:
    raw = pickle.dumps(arrays, 5)
    return part, kind, len(raw), pa.compress(raw, "zstd", asbytes=True)


def _opened(size: int, blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(pa.decompress(blob, size, "zstd", asbytes=True))


def _batch(messages: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([m[i] for m in messages], k) for i, k in enumerate(kinds)], names=["part", "kind", "size", "blob"])


def _batches(messages, most: int = 1 << 20):
    """Batches of the messages, of about ``most`` bytes: Spark holds a batch outside its heap."""
    held, size = [], 0
    for m in messages:
        held.append(m)
        size += len(m[3])
        if size >= most:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _told(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            part, kind, size, blob = (c[i].as_py() for c in batch.columns)
            yield part, kind, _opened(size, blob)


def _narrow(n: np.ndarray) -> np.ndarray:
    return n.astype(np.min_scalar_type(int(n.max()))) if len(n) else n


def _gram_messages(grams: list[np.ndarray], parts: int):
    """Messages of grams to the parts of the middle word, which so get all grams and contexts that a token after it needs."""
    words, lang, p, u, v, w, n = grams
    return _batches(_message(to, _GRAMS, words[met], lang[met], p[met], *ids, _narrow(n[at])) for to, at, met, ids in _dealt(_part(words, parts)[v], len(words), u, v, w))


def _merged(held: list[tuple[np.ndarray, ...]], most: int = 64) -> list[np.ndarray]:
    """One list of words, of their languages and their probabilities where these are known, and of the trigrams (u, v, w as places in it, sorted by v, u, w) with their counts, from several. Places of up to ``most`` bits together are sorted as one number."""
    words = np.unique(np.concatenate([m[0] for m in held]))
    lang, p, rows = np.empty(len(words), dtype=U64), np.full(len(words), np.nan), []
    bits = U64(len(words).bit_length())
    packed = 3 * int(bits) <= most
    for k, g, q, u, v, w, n in held:
        at = np.searchsorted(words, k).astype(U64 if packed else np.int32)
        lang[at], p[at] = g, np.fmax(p[at], q)
        rows.append(((at[v] << bits | at[u]) << bits | at[w], n) if packed else (at[v], at[u], at[w], n))
    *keys, n = map(np.concatenate, zip(*rows))
    del rows
    if packed and len(n) and n.max() == 1:
        keys[0].sort()
    else:
        order = np.argsort(keys[0], kind="stable") if packed else np.lexsort(keys[::-1])
        keys, n = [x[order] for x in keys], n[order]
    new = np.zeros(len(n), dtype=bool)
    new[:1] = True
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    start = np.flatnonzero(new)
    keys = [x[start] for x in keys]
    if packed:
        mask = (U64(1) << bits) - U64(1)
        keys = [(keys[0] >> x * bits & mask).astype(np.int32) for x in (U64(2), U64(1), U64(0))]
    v, u, w = keys
    return [words, lang, p, u, v, w, np.add.reduceat(n, start, dtype=np.int64) if len(start) else n.astype(np.int64)]


def _by_part(messages: DataFrame, parts: int, told, schema: str = _MESSAGE) -> DataFrame:
    """``told(part, kinds and arrays)`` for all messages of each part, smaller kinds first."""

    def run(batches):
        at, held = None, []
        for part, kind, arrays in _told(batches):
            if held and at != part:
                yield from told(at, held)
                held = []
            at = part
            held.append((kind, arrays))
        if held:
            yield from told(at, held)

    return messages.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(freeing(run), schema)


def _parts(texts: DataFrame, text_col: str, shard: int) -> int:
    size = texts.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(1, -(-size // (BYTES * shard)))


def fitted(trusted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, dict[int, tuple], int]:
    """Of (lang, text) rows, all of which are counted: messages of the trigrams with their counts, by shard; messages of the probabilities of the words that end a shard's grams; words with their probability p; each language's share of an unseen word, and its discounts of two and three tokens; the number of trigrams."""
    parts = _parts(trusted, "text", COUNTED)

    def cut(batches):
        for batch in batches:
            langs = _lang_hash(batch.column(0).to_pylist())
            for i, j, t in slices(batch.column(1), SLICE):
                words, lang, u, v, w = _coded(langs[i:j], *_hashed(t))
                yield from _gram_messages([words, lang, np.full(len(words), np.nan), u, v, w, np.ones(len(w), dtype=np.uint8)], parts)

    names = ["part", "kind", "size", "blob", "g", "w", "n"]

    def told(part, held):
        grams = _merged([m for _, m in held])
        words, lang, _, u, v, w, n = grams
        one = _batch([_message(part, _GRAMS, *grams[:3], *(_narrow(x) for x in grams[3:]))])
        yield pa.RecordBatch.from_arrays([*one.columns, *[pa.nulls(1, pa.int64())] * 3], names=names)
        two, n2 = np.unique(v.astype(np.int64) << 32 | w, return_counts=True)
        n1 = np.bincount(two & 0xFFFFFFFF, minlength=len(words))
        met = np.flatnonzero(n1)
        rows = [(np.full(len(met), 1), lang[met], words[met].view(np.int64), n1[met])]
        for kind, g, c in ((2, lang[two >> 32], n2), (3, lang[v], n)):  # how many grams have each small count; 0: all of a language
            for i in range(5):
                of, many = np.unique(g if i == 0 else g[c == i], return_counts=True)
                rows.append((np.full(len(of), kind), of, np.full(len(of), i), many))
        kind, g, w, n = map(np.concatenate, zip(*rows))
        k = len(kind)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, part), pa.int32()), pa.array(kind, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), *(pa.array(x.view(np.int64)) for x in (g, w, n))], names=names)

    counts = written(_by_part(trusted.select("lang", "text").mapInArrow(freeing(cut), _MESSAGE), parts, told, _MESSAGE + ", g long, w long, n long"), "counts", MESSAGES)
    few = counts.where("blob is null")
    one = written(_alone(few.where("kind = 1").groupBy("g", "w").agg(F.sum("n").alias("n"))), "words1")

    def pack(batches):
        def message():
            t = pa.Table.from_batches(held)
            return _batch([_message(at, _LOWER, t.column("w").to_numpy().view(U64), t.column("p").to_numpy())])

        at, held = None, []
        for batch in batches:
            part = np.asarray(batch.column(0))
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]).tolist()
            for a, b in zip(cut, [*cut[1:], len(part)]):
                if held and at != int(part[a]):
                    yield message()
                    held = []
                at = int(part[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield message()

    lower = few.where("kind = 1").select("part", "g", "w").join(one.select("g", "w", "p"), ["g", "w"]).select("part", "w", "p")
    lower = written(lower.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(freeing(pack), _MESSAGE), "lower")
    unsigned = lambda x: int(x) & (1 << 64) - 1
    many = few.where("kind in (2, 3)")
    # Some rows for each language:
    d = {(r.kind, unsigned(r.g)): (r.d1, r.d2, r.d3) for r in _discounts(many, ["kind", "g"], lambda i: F.sum(F.when(F.col("w") == i, F.col("n")))).collect()}
    langs = {unsigned(r.g): (float(r.zero), d[2, unsigned(r.g)], d[3, unsigned(r.g)]) for r in one.select("g", "zero").distinct().collect()}
    size = many.where("kind = 3 and w = 0").agg(F.sum("n")).first()[0] or 0
    return counts.where("blob is not null").select("part", "kind", "size", "blob"), lower, one, langs, size


def _lowered(held: list[tuple[int, tuple[np.ndarray, ...]]]) -> list[np.ndarray]:
    """The grams of a shard with the probabilities of the words that end them."""
    grams = _merged([m for kind, m in held if kind == _GRAMS])
    for kind, m in held:
        if kind == _LOWER:
            grams[2][np.searchsorted(grams[0], m[0])] = m[1]
    return grams


def gathered(three: DataFrame, two: DataFrame, one: DataFrame, langs: dict[int, tuple]) -> Model:
    """The whole model, for tables of a measured size."""
    held = {}
    for r in sorted(three.unionByName(two).collect(), key=lambda r: r.kind):
        held.setdefault(r.part, []).append((r.kind, _opened(r.size, bytes(r.blob))))
    t = one.select("w", "p").toArrow()
    return Model(_merged(list(map(_lowered, held.values()))) if held else None, langs, t.column("w").to_numpy().view(U64), t.column("p").to_numpy())


def train(trusted: DataFrame) -> Model:
    """The model of (lang, text) rows, all of which are counted."""
    return gathered(*fitted(trusted)[:4])


def scored(docs: DataFrame, model: Model, known: set[str | None], keep: tuple[str, ...], lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of each document with n_tokens and logp (log10 probability of its text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        for batch in batches:
            k = batch.num_columns - 2
            langs = _lang_hash([x if x in known else ALL for x in batch.column(k).to_pylist()])
            n, logs = [np.empty(0, dtype=np.int64)], [np.empty(0)]
            for i, j, t in slices(batch.column(k + 1), 1 << 19):
                h, first = _tokens(t)
                sums = np.concatenate([[0.0], np.cumsum(shared.value.coded_logs(*_coded(langs[i:j], h, first)))])
                n.append(np.diff(first)), logs.append(sums[first[1:]] - sums[first[:-1]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(np.concatenate(n).astype(np.int64)), pa.array(np.concatenate(logs))], names=[*keep, "n_tokens", "logp"])

    schema = docs.select(*keep).schema.add("n_tokens", "long").add("logp", "double")
    return docs.select(*keep, F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text")).mapInArrow(freeing(scan), schema)


def scored_by_shuffle(docs: DataFrame, three: DataFrame, two: DataFrame, one: DataFrame, langs: dict[int, tuple], known: set[str | None], keep: tuple[str, ...], lang_col: str = "lang", text_col: str = "text", shard: int = SHARD, passes: int = PASSES, last_use: bool = False) -> DataFrame:
    """As ``scored``, with a model that stays in shards. The documents' tokens go there in ``passes``, as messages; sums for each document come back to the part that its slice of documents names. ``last_use``: the model's tables are deleted once the shards are written."""
    parts = _parts(docs, text_col, shard)
    passes = min(passes, parts)

    def deal(part, held):
        yield from _gram_messages(_lowered(held), parts)

    def join(part, held):
        grams = _merged([m for _, m in held])
        yield _batch([_message(part, _GRAMS, *grams[:3], *(_narrow(x) for x in grams[3:]))])

    def spread(batches):
        for batch in batches:
            words, p = (np.asarray(c) for c in batch.columns)
            yield _batch([_message(to, _LOWER, words[at].view(U64), p[at]) for to, at, _, _ in _dealt(_part(words.view(U64), parts), len(words), np.arange(len(words)))])

    grams = written(_by_part(_by_part(three.unionByName(two), parts, deal), parts, join), "shards", MESSAGES)
    words = written(one.select("w", "p").mapInArrow(freeing(spread), _MESSAGE), "words")
    if last_use:
        removed(three, two, one)

    def home(row: np.ndarray) -> np.ndarray:
        return _part(row >> U64(_ROWS), parts)

    def asked(of, row, met, lang, u, v, w):
        for to, at, mine, ids in _dealt(_part(met, parts)[v], len(met), u, v, w):
            start = np.flatnonzero(np.append(True, np.diff(of[at]) > 0))
            yield _message(to, _DOCS, row[of[at[start]]], _narrow(np.diff(np.append(start, len(at)))), met[mine], lang[mine], *ids)

    def ask(batches):
        for whole in batches:
            for batch in (whole.slice(a, 1 << _ROWS) for a in range(0, whole.num_rows, 1 << _ROWS)):
                key = np.asarray(batch.column(0)).view(U64)
                g = _lang_hash([x if x in known else ALL for x in batch.column(1).to_pylist()])
                for i, j, t in slices(batch.column(2), SLICE):
                    h, first = _hashed(t)
                    at = np.arange(j - i, dtype=U64)
                    # A slice is named by its keys: equal slices have equal rows, whose averages are taken in the end.
                    row = np.bitwise_xor.reduce(mix(key[i:j] + mix(at))) << U64(_ROWS) | at
                    yield _batch([_message(int(home(row[:1])[0]), _SIZES, row, key[i:j], np.diff(first))])
                    met, lang, u, v, w = _coded(g[i:j], h, first)
                    yield from _batches(asked(np.repeat(np.arange(j - i), np.diff(first)), row, met, lang, u, v, w))

    def sums(row: np.ndarray, logs: np.ndarray) -> list[tuple]:
        return [_message(to, _SUMS, row[at], logs[at]) for to, at, _, _ in _dealt(home(row), len(row), np.arange(len(row)))]

    def shared(batches):
        part = model = None
        more, n = [], 0

        def rest():
            row, word, g = map(np.concatenate, zip(*more))
            order = np.argsort(row, kind="stable")
            row, word, g = row[order], word[order], g[order]
            found = pc.dictionary_encode(pa.array(word))
            met, w = np.asarray(found.dictionary), np.asarray(found.indices)
            lang = np.empty(len(met), dtype=U64)
            lang[w] = g
            return _batch([_message(to, _DOCS, row[at], met[mine], lang[mine], *ids) for to, at, mine, ids in _dealt(_part(met, parts)[w], len(met), w)])

        for at, kind, arrays in _told(batches):
            if at != part:
                part, model = at, None
            if kind == _GRAMS:
                model = Model(list(arrays), langs)
                continue
            if kind == _SIZES:  # on its way home
                yield _batch([_message(at, kind, *arrays)])
                continue
            row, runs, met, lang, u, v, w = arrays
            model = model or Model(None, langs)
            p, i = model.seen(met, u, v, w)
            yield _batch(sums(row, np.add.reduceat(np.log10(p), np.cumsum(runs, dtype=np.int64) - runs)))
            if len(i):
                more.append((np.repeat(row, runs)[i], met[w[i]], lang[w[i]]))
                n += len(i)
            if n > 1 << 19:
                yield rest()
                more, n = [], 0
        if more:
            yield rest()

    def alone(batches):
        part = model = None
        held, found, n = [], [], 0

        def told():
            row, logs = map(np.concatenate, zip(*found))
            row, at = np.unique(row, return_inverse=True)
            return _batch(sums(row, np.bincount(at, logs, len(row))))

        for at, kind, arrays in _told(batches):
            if at != part:
                part, model, held = at, None, []
            if kind == _LOWER:
                held.append(arrays)
                continue
            if model is None:
                model = Model(None, langs, *(map(np.concatenate, zip(*held)) if held else (np.empty(0, U64), np.empty(0))))
            row, met, lang, w = arrays
            found.append((row, np.log10(model.alone(met, lang))[w]))
            n += len(row)
            if n > 1 << 20:
                yield told()
                found, n = [], 0
        if found:
            yield told()

    def add(batches):
        sizes, found = [], []
        for _, kind, arrays in _told(batches):
            (sizes if kind == _SIZES else found).append(arrays)
        if sizes:
            row, key, n = map(np.concatenate, zip(*sizes))
            row, at = np.unique(row, return_inverse=True)
            to, logs = map(np.concatenate, zip(*found)) if found else (row[:0], np.empty(0))
            total = np.bincount(np.searchsorted(row, to), logs, len(row)) / np.bincount(at)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(total[at])], names=["key", "n", "s"])

    def scan(mine: DataFrame) -> DataFrame:
        sent = mine.select(key, lang_col, text_col).mapInArrow(freeing(ask), _MESSAGE)
        by = lambda x, f: x.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(freeing(f), _MESSAGE)
        tokens = F.col("kind") == _DOCS
        half = written(by(grams.unionByName(sent), shared), "answers", MESSAGES)
        last = by(words.unionByName(half.where(tokens)), alone)
        back = half.where(~tokens).unionByName(last).repartition(parts, "part").mapInArrow(freeing(add), "key long, n long, s double")
        out = written(back.groupBy("key").agg(F.first("n").alias("n"), F.avg("s").alias("s")), "sums", MESSAGES)
        removed(half)
        return out

    cols = [F.col(c) for c in (keep[0], lang_col, text_col)]
    key = F.xxhash64(*cols, *[c.isNull() for c in cols]).alias("__key")
    turn = F.pmod(F.xxhash64(cols[0], F.lit(3)), F.lit(passes))
    found = [scan(docs.where(turn == k)) for k in range(passes)]
    removed(grams, words)
    logs = reduce(DataFrame.unionByName, found).withColumnRenamed("key", "__key")
    out = docs.select(*keep, key).join(logs, "__key", "left").select(*keep, F.coalesce("n", F.lit(0)).alias("n_tokens"), F.coalesce("s", F.lit(0.0)).alias("logp"))
    out = written(out, "scores")
    removed(*found)
    return out


def judged(
    docs: DataFrame,
    labels: DataFrame,
    keep: tuple[str, ...] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    prior: float = PRIOR,
    quantile: float = QUANTILE,
    slack: float = SLACK,
    local: int = LOCAL,
    fit_mb: float | None = FIT_MB,
) -> DataFrame:
    """One row per document: id, lang, n_tokens, log10_perplexity, threshold, accepted, and the columns ``keep``."""
    marks = labels.groupBy(F.col(id_col).alias("__good")).agg(
        F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic")
    )
    good = marks.where("good and not coalesce(toxic, false)").select("__good")
    base = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # Half of each language is chosen by a hash of the id.
    dice = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string"), F.lit(7)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    # Ids and sizes alone are joined with the labels; texts only meet the chosen ids.
    slim = base.select("id", "lang", F.octet_length("text").alias("bytes")).where(dice("id") < 0.5)
    half = slim.join(good, F.col("id") == F.col("__good"), "left_semi")
    part = F.lit(0.5)
    if fit_mb is not None:
        sizes = half.groupBy(F.col("lang").alias("__lang")).agg(F.sum("bytes").alias("all"))
        half = half.join(sizes, F.col("lang").eqNullSafe(F.col("__lang")))
        part = part * F.least(F.lit(1.0), fit_mb * 1e6 / F.greatest(F.coalesce("all", F.lit(0)), F.lit(1)))
    chosen = written(half.where(dice("id") < part).select(F.col("id").alias("__id"), F.col("lang").alias("__of")).distinct(), "chosen")
    mine = (F.col("id") == F.col("__id")) & F.col("lang").eqNullSafe(F.col("__of"))
    sample = base.join(chosen, mine, "left_semi").select("lang", "text")
    known = {r.lang for r in sample.select("lang").distinct().collect()}  # a row for each trusted language
    # A model of all languages together, only where some document's language has no trusted one.
    named = [x for x in known if x is not None]
    strange = ~F.coalesce(F.col("lang").isin(named), F.lit(None in known)) if named else F.lit(not known) | F.col("lang").isNotNull()
    both = sample if base.where(strange).isEmpty() else sample.unionByName(sample.select(F.lit(ALL).alias("lang"), "text"))
    *levels, size = fitted(both)
    names = [c for c in keep if c not in (id_col, lang_col)]
    columns = (id_col, lang_col, *names)
    if size <= local:
        slim = written(scored(docs, gathered(*levels), known, columns, lang_col, text_col), "scores", MESSAGES)
        removed(*levels[:3])
    else:
        slim = scored_by_shuffle(docs, *levels, known, columns, lang_col, text_col, last_use=True)
    lang = F.col(lang_col)
    mean = F.coalesce(F.sum("logp") / F.sum(F.nullif("n_tokens", F.lit(0))), F.lit(-3.0))
    means = slim.groupBy(lang.alias("__lang")).agg(mean.alias("__mean"))
    value = -(F.col("logp") + prior * F.col("__mean")) / (F.col("n_tokens") + prior)
    slim = slim.join(means, lang.eqNullSafe(F.col("__lang"))).withColumn("log10_perplexity", value).drop("__lang", "__mean")
    told = slim.where((F.col("n_tokens") > 0) & (dice(id_col) >= 0.5)).join(good, F.col(id_col) == F.col("__good"), "left_semi")
    least = F.percentile_approx("log10_perplexity", quantile, 100_000) * slack
    limits = told.groupBy(lang.alias("__lang")).agg(least.alias("__limit"))
    most = limits.agg(F.max("__limit")).first()[0]
    out = slim.join(limits, lang.eqNullSafe(F.col("__lang")), "left").withColumn(
        "threshold", F.coalesce("__limit", F.lit(most).cast("double"))
    )
    ok = (F.col("n_tokens") > 0) & (F.col("threshold").isNull() | (F.col("log10_perplexity") <= F.col("threshold")))
    return out.select(id_col, lang.alias("lang"), "n_tokens", "log10_perplexity", "threshold", ok.alias("accepted"), *names)
