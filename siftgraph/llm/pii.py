"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give the base spans. The field's nodes are the tokens (between
white space) that hold a digit or an @; its labels are ``O`` and the four
kinds. Chain edges join neighbouring tokens; skip edges join each token with
the next one of equal form and with the next one of equal shape in the whole
document, however far, so that repeated and similar tokens share potentials.
Loopy sum-product messages run over all documents of a slice at once until none
changes by ``SETTLED``; ``ROUNDS`` only ends messages that swing for ever. Edges
whose incoming messages have settled rest. A token of a kind that no base span touches adds a span.

Weights come from pseudo-likelihood on a sample of at most ``SAMPLE``
documents (a documented bound) and on sentences made by a rule, labelled by the
patterns; tokens that look like a kind but fail its check have no label there.

A null text is empty: no spans. Repeated rows count each for themselves; other
columns are ignored, whatever their names. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
SAMPLE, ROUNDS, SETTLED = 4000, 10_000, 1e-4

# The patterns of the base kinds. Look-behinds and possessive
# repeats only keep failing starts from being tried again.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(spans of the patterns, matches that fail their check), by kind and start."""
    good: list[Span] = [("email", a, b) for a, b in _emails(text)]
    bad: list[Span] = []
    for m in _IP.finditer(text):
        fits = all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))
        (good if fits else bad).append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19:
                (good if luhn(digits) else bad).append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = sum(c in "0123456789" for c in m[0])
            (good if 9 <= n <= 15 else bad).append(("phone", *m.span()))
    return good, bad


_EDGE = "".join(map(chr, range(33, 127))).translate(str.maketrans("", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+()"))
_DIGITS, _LETTERS = re.compile(r"[0-9]+"), re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[tuple[int, int, str]]:
    """(start, end, core) of the tokens that hold a digit or an @, without punctuation at their ends."""
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    space = (code == 32) | ((code >= 9) & (code <= 13)) | ((code >= 28) & (code <= 31)) | (code == 0x85) | (code == 0xA0) | (code == 0x3000) | ((code >= 0x2000) & (code <= 0x200A))
    hot = np.flatnonzero(((code >= 48) & (code <= 57)) | (code == 64))
    gaps = np.flatnonzero(np.concatenate([[True], space, [True]])) - 1
    k = np.unique(np.searchsorted(gaps, hot))
    out = []
    for a, b in zip((gaps[k - 1] + 1).tolist(), gaps[k].tolist()):
        raw = text[a:b]
        left = raw.lstrip(_EDGE)
        core = left.rstrip(_EDGE)
        a += len(raw) - len(left)
        if core.endswith(")") and "(" not in core:
            core = core.rstrip(")" + _EDGE)
        if core:
            out.append((a, a + len(core), core))
    return out


def shape(core: str) -> str:
    """Letters as one ``a``, digits by their number; a long shape as a hash of all of it."""
    s = _DIGITS.sub(lambda m: "9" * len(m[0]) if len(m[0]) <= 4 else "<" + str(len(m[0])) + ">", _LETTERS.sub("a", core))
    return s if len(s) <= 80 else "#" + hashlib.blake2b(s.encode(), digest_size=8).hexdigest()


class Graph:
    """Nodes, features and edges of some documents. Edge kinds: 0 chain, 1 equal form, 2 equal shape."""

    def __init__(self):
        self.doc: list[int] = []
        self.span: list[tuple[int, int, str]] = []
        self.features: list[list[str]] = []
        self.edges: list[tuple[int, int, int]] = []

    def add(self, doc: int, text: str) -> None:
        found, form, alike = tokens(text), {}, {}
        shapes = [shape(c) for _, _, c in found]
        near = [i > 0 and 0 < found[i][0] - found[i - 1][1] <= 2 for i in range(len(found))] + [False]
        for i, (a, b, core) in enumerate(found):
            n, s = len(self.doc), shapes[i]
            digits = sum(c in "0123456789" for c in core)
            dots = core.count(".")
            mixed = bool(_LETTERS.search(core)) and digits > 0
            before = shapes[i - 1] if near[i] else "-"
            after = shapes[i + 1] if near[i + 1] else "-"
            self.features.append(["one", "s" + s, f"n{min(digits, 20)}", f"d{min(dots, 4)}", f"@{'@' in core}", f"m{mixed}", f"l{min(len(core), 40) // 4}", f"x{core.isdigit()}{min(digits, 20)}", "b" + before, "a" + after])
            self.doc.append(doc)
            self.span.append((a, b, core))
            if near[i]:
                self.edges.append((n - 1, n, 0))
            if core in form:
                self.edges.append((form[core], n, 1))
            if s in alike and alike[s] != form.get(core):  # a pair is joined once
                self.edges.append((alike[s], n, 2))
            form[core] = alike[s] = n


class SkipChain:
    def __init__(self, rows: dict[str, np.ndarray], pair: np.ndarray):
        self.rows, self.pair = rows, pair  # feature -> weights of the labels; (edge kind, label, label)

    def beliefs(self, g: Graph) -> np.ndarray:
        n, zero = len(g.doc), np.zeros(len(LABELS))
        unary = np.array([sum((self.rows[f] for f in fs if f in self.rows), zero) for fs in g.features]).reshape(n, len(LABELS))
        unary -= unary.max(axis=1, keepdims=True)
        if not g.edges:
            return unary
        e = np.array(g.edges)
        src, dst = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
        kernel = np.exp(np.concatenate([self.pair[e[:, 2]], self.pair[e[:, 2]].transpose(0, 2, 1)]))  # [edge, from, to]
        back = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
        msg = np.zeros((len(src), len(LABELS)))
        live = np.arange(len(src))
        total = unary.copy()
        for _ in range(ROUNDS):
            inner = total[src[live]] - msg[back[live]]
            inner -= inner.max(axis=1, keepdims=True)
            new = np.log(np.einsum("ei,eij->ej", np.exp(inner), kernel[live]) + 1e-300)
            new -= new.max(axis=1, keepdims=True)
            step = 0.5 * (new - msg[live])
            msg[live] += step
            np.add.at(total, dst[live], step)
            moved = np.abs(step).max(axis=1) > SETTLED
            if not moved.any():
                break
            # A changed message wakes those that leave its target.
            woken = np.zeros(n, dtype=bool)
            woken[dst[live[moved]]] = True
            next_up = woken[src]
            next_up[live[moved]] = True
            live = np.flatnonzero(next_up)
        total = unary.copy()
        np.add.at(total, dst, msg)
        return total

    @staticmethod
    def fit(texts: list[str], steps: int = 150, ridge: float = 1e-3) -> SkipChain:
        """Multinomial regression of each labelled token on its features and on its neighbours' labels."""
        g, label = Graph(), []
        for d, t in enumerate(texts):
            first = len(g.doc)
            g.add(d, t)
            good, bad = base_spans(t)
            for a, b, _ in g.span[first:]:
                y = next((LABELS.index(k) for k, x, z in good if x < b and a < z), None)
                label.append(y if y is not None else -1 if any(x < b and a < z for _, x, z in bad) else 0)
        y = np.array(label, dtype=np.int64)
        names = sorted({f for fs in g.features for f in fs})
        place = {f: i for i, f in enumerate(names)}
        c, m = len(LABELS), len(names)
        cols = np.array([[place[f] for f in fs] for fs in g.features]).reshape(len(y), -1)
        around = np.zeros((len(y), 3 * c))
        for a, b, kind in g.edges:
            for i, j in ((a, b), (b, a)):
                if y[j] >= 0:
                    around[i, kind * c + y[j]] += 1
        keep = np.flatnonzero(y >= 0)
        cols, around, y = cols[keep], around[keep], y[keep]
        w, v, hot = np.zeros((m, c)), np.zeros((3 * c, c)), np.eye(c)[y]
        # Rare kinds weigh as much as frequent ones up to a factor of 50.
        share = np.bincount(y, minlength=c)
        weight = np.minimum(50, len(y) / np.maximum(1, share) / c)[y][:, None] if len(y) else np.zeros((0, 1))
        sw, sv, rate = np.full((m, 1), 1e-8), np.full((3 * c, 1), 1e-8), 0.3
        for _ in range(steps if len(y) else 0):
            z = w[cols].sum(axis=1) + around @ v
            p = np.exp(z - z.max(axis=1, keepdims=True))
            err = (p / p.sum(axis=1, keepdims=True) - hot) * weight / len(y)
            gw = np.stack([np.bincount(cols.ravel(), np.repeat(err[:, k], cols.shape[1]), m) for k in range(c)], axis=1) + ridge * w
            gv = around.T @ err + ridge * v
            sw += (gw**2).sum(axis=1, keepdims=True)
            sv += (gv**2).sum(axis=1, keepdims=True)
            w -= rate * gw / np.sqrt(sw)
            v -= rate * gv / np.sqrt(sv)
        pair = v.reshape(3, c, c)
        pair = np.clip((pair + pair.transpose(0, 2, 1)) / 2, -3, 3)
        pair[0] = np.clip(v.reshape(3, c, c)[0], -3, 3)
        for k in (1, 2):  # skip edges draw labels together, never apart
            pair[k] = np.diag(np.clip(np.diag(pair[k]), 0.2, 3))
        return SkipChain({f: w[i] for f, i in place.items() if np.abs(w[i]).max() > 1e-6}, pair)

    def spans(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """(base spans, all spans) of each text, both by kind as listed, then start."""
        g, base = Graph(), []
        for d, t in enumerate(texts):
            if _ANY.search(t):
                base.append(base_spans(t)[0])
                g.add(d, t)
            else:
                base.append([])
        more: list[list[Span]] = [[] for _ in texts]
        if g.doc:
            best = self.beliefs(g).argmax(axis=1)
            for i in np.flatnonzero(best):
                d, kind, (a, b, core) = g.doc[i], LABELS[best[i]], g.span[i]
                if any(x < b and a < y for _, x, y in base[d]):
                    continue
                own = more[d]
                joins = own and own[-1][0] == kind == "phone" and 0 < a - own[-1][2] <= 2 and core[0] != "+"
                if joins:
                    own[-1] = (kind, own[-1][1], b)
                else:
                    own.append((kind, a, b))
        key = lambda s: (KINDS.index(s[0]), s[1])
        # A lone piece of a phone number says too little.
        fits = lambda s, t: s[0] != "phone" or sum(c in "0123456789" for c in t[s[1] : s[2]]) >= 7
        return [(sorted(b, key=key), sorted([*b, *(s for s in m if fits(s, t))], key=key)) for b, m, t in zip(base, more, texts)]


def made_sentences(n: int = 160, seed: int = 7) -> list[str]:
    """Sentences by a rule, so that every kind is known whatever the sample holds."""
    r, out = random.Random(seed), []
    words = ["alpha", "beta", "the", "of", "call", "at", "from", "and", "number", "host"]
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    for i in range(n):
        card = num(15)
        card += next(c for c in "0123456789" if luhn(card + c))
        thing = [f"{r.choice(words)}.{num(2)}@{r.choice(words)}.example.com", ".".join(str(r.randrange(256)) for _ in range(4)), card, f"+{r.randrange(1, 99)} ({num(3)}) {num(3)}-{num(4)}", f"{r.randrange(1900, 2030)}", f"v{r.randrange(9)}.{r.randrange(9)}", hashlib.sha1(str(i).encode()).hexdigest(), num(r.randrange(1, 7))][i % 8]
        out.append(" ".join([*r.choices(words, k=4), thing, *r.choices(words, k=3)] + ([thing] if i % 3 == 0 else [])))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> SkipChain:
    """Fits on at most ``sample`` documents that hold a digit or an @ (those of the least hashes), of each all lines that do."""
    docs = docs.where(F.col(text_col).rlike("[0-9@]"))
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x: x.rlike("[0-9@]"))
    text = F.concat_ws("\n", lines)
    # Few rows leave the executors: those of low hashes, about twice the sample of the documents that fit.
    h = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30))
    n = docs.count()
    low = h < int(min(1.0, 2 * (sample + 100) / max(1, n)) * (1 << 30))
    least = lambda df: df.select(h.alias("h"), text.alias("t")).orderBy("h", "t").limit(sample).collect()
    rows = least(docs.where(low))
    if len(rows) < min(sample, n):  # ids that repeat, such as nulls, share a hash
        rows = least(docs)
    return SkipChain.fit([*made_sentences(), *(r.t for r in rows)])


def found(docs: DataFrame, model: SkipChain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone (base), base and spans (kind:start:end in code points, comma-joined)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"n_{k}" for k in KINDS]

    def scan(batches):
        from .bpe import runs

        for batch in batches:
            start = 0
            for group in runs(batch.column(1).to_pylist()):
                rows = shared.value.spans(group)
                told = [[",".join(f"{k}:{a}:{b}" for k, a, b in r[i]) for r in rows] for i in (0, 1)]
                counts = [pa.array([sum(s[0] == k for s in r[0]) for r in rows], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(group)), *counts, *map(pa.array, told)], names=["id", *names, "base", "spans"])
                start += len(group)

    schema = docs.select(F.col(id_col).alias("id")).schema
    for n in names:
        schema = schema.add(n, "long")
    schema = schema.add("base", "string").add("spans", "string")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or each group of overlapping ones, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, model: SkipChain, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced in the text; the other columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def scan(batches):
        from .bpe import runs

        for batch in batches:
            start = 0
            for group in runs(batch.column(at).to_pylist()):
                part = batch.slice(start, len(group))
                was = part.column(at).to_pylist()
                new = [None if w is None else redact(w, s[1]) for w, s in zip(was, shared.value.spans(group))]
                cols = part.columns
                cols[at] = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)
                start += len(group)

    return docs.mapInArrow(scan, docs.schema)
