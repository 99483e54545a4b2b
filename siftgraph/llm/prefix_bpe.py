"""BPE encoding by a last token for every prefix, for vocabularies with word ends.

A text is cut at white space, a chunk at the vocabulary's special tokens; what
is left is normalised (NFC, lower case for each code point by itself) and cut
into pieces. A piece's symbols are its bytes, the last one marked as the word's
end. The encoding of every prefix of a piece has one last token: of the tokens
that end there (an automaton over the vocabulary reports them along its suffix
links) the one that is compatible with the last token of the prefix before it.
Two tokens are compatible if encoding their symbols together gives just these
two; that is read off the merges that made them. The ids of the piece follow
from its end by going back token by token.

That a compatible pair of neighbours is all it takes holds for vocabularies in
which each token is made by one merge, of tokens made earlier; others are
refused when they are loaded.

A null text is empty: no tokens, digests of nothing. Texts of white space alone
are the same. Pieces of any length take time in proportion to their length.
Repeated rows are encoded each for itself; other columns are ignored, whatever
their names; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from .bpe import Arena, runs

#: White space of the vocabulary's patterns; Python's ``split`` knows four more characters.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
MORE_SPACE = re.compile("[\x1c-\x1f]")
#: Chunks and pairs remembered by a worker at most, and the longest chunk that is remembered.
REMEMBER, PAIRS, SHORT = 400_000, 2_000_000, 64
NEVER = (1 << 62) - 1


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@lru_cache(maxsize=1)
def later() -> tuple[dict[int, str], dict[int, str]]:
    """Code points newer than Python's Unicode tables: a stand-in of the class that the tokenizers library sees in each (letter, number or other), and the lower case of its capitals. Without that library Python's tables hold for all."""
    try:
        from tokenizers import Regex, normalizers, pre_tokenizers
    except ImportError:
        return {}, {}
    new = regex.findall(r"[\p{L}\p{N}]", "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn"))
    letter, number = (pre_tokenizers.Split(Regex(x), "removed").pre_tokenize_str for x in (r"\p{L}", r"\p{N}"))
    lower = normalizers.Lowercase().normalize_str
    kinds = {ord(c): "ª" if not letter(c) else "²" if not number(c) else "\ue000" for c in new}
    return kinds, {ord(c): x for c in new if (x := lower(c)) != c}


class PrefixBpe:
    def __init__(self, spec: dict):
        model = spec["model"]
        end = model.get("end_of_word_suffix") or ""
        if not end or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("not a BPE vocabulary with word ends alone")
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        # Symbols are characters: a byte's own code, and 256 more for one that ends a word.
        symbols: dict[int, str] = {}
        for b, c in enumerate(letters):
            symbols[vocab[c]], symbols[vocab[c + end]] = chr(b), chr(b + 256)
        #: When each token is made, of which two; the rank of the merge of a pair.
        self.born: dict[int, int] = dict.fromkeys(symbols, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            if made in self.born or x not in self.born or y not in self.born:
                raise ValueError(f"merge {rank} makes a token again or of tokens that aren't made yet")
            self.born[made], self.parts[made], self.merge[x, y] = rank, (x, y), rank
            symbols[made] = symbols[x] + symbols[y]
        #: Tokens that their own symbols are encoded to; others are never met.
        whole: dict[int, bool] = {}
        self.tokens = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for t, s in symbols.items():  # in the order of their making
            x, y = self.parts.get(t, (t, t))
            whole[t] = t not in self.parts or whole[x] and whole[y] and self.meet(x, y, self.born[t])
            if whole[t]:
                self.tokens.add_word(s, (t, len(s)))
        self.tokens.make_automaton()
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        if any(x["normalized"] or x["single_word"] or not x["special"] for x in spec.get("added_tokens", [])):
            raise ValueError("added tokens that aren't matched as they stand")
        self.special = special
        self.marks = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)")
        self.pieces = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
        self.names = Arena([(names[i] + " ").encode() if i in names else b"" for i in range(max(names) + 1)], np.uint8)
        self.cut = self.pieces.findall
        self.known_pieces: dict[str, tuple[int, ...]] = {}
        self.known: dict[str, int] = {}
        self.arena = Arena()
        self.pairs: dict[tuple[int, int], bool] = {}

    def meet(self, x: int, y: int, before: int = NEVER) -> bool:
        """Whether x and y, side by side, stay two tokens while merges of rank below ``before`` are done. Their edges are followed back in time: of two neighbours at the border the younger one is undone, and each pair lives until either is used up. At equal ranks the left pair goes first."""
        x_gone = y_gone = before
        born, merge, parts = self.born, self.merge, self.parts
        while True:
            rank = merge.get((x, y), NEVER)
            if rank < x_gone and rank <= y_gone and rank < before:
                return False
            if born[x] > born[y]:
                x_gone, x = born[x], parts[x][1]
            elif born[y] >= 0:
                y_gone, y = born[y], parts[y][0]
            else:
                return True

    def compatible(self, pair: tuple[int, int]) -> bool:
        ok = self.pairs.get(pair)
        if ok is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            ok = self.pairs[pair] = self.meet(*pair)
        return ok

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of one piece."""
        octets = text.encode()
        n = len(octets)
        symbols = octets[:-1].decode("latin-1") + chr(octets[-1] + 256)
        last: list = [None] * (n + 1)  # of each prefix: its last token and that one's length
        known = self.pairs.get
        for at, found in self.tokens.iter(symbols):
            at += 1
            if last[at] is None:
                t, size = found
                if size == at:
                    last[at] = found
                else:
                    pair = (last[at - size][0], t)
                    ok = known(pair)
                    if self.compatible(pair) if ok is None else ok:
                        last[at] = found
        ids = []
        while n:
            t, size = last[n]
            ids.append(t)
            n -= size
        return tuple(reversed(ids))

    def chunk(self, text: str) -> list[int]:
        """The ids of a chunk without white space."""
        if self.marks.search(text) is None:
            return self.plain(text)
        ids, at = [], 0
        for m in self.marks.finditer(text):
            ids += self.plain(text[at : m.start()])
            ids.append(self.special[m[0]])
            at = m.end()
        return ids + self.plain(text[at:])

    def plain(self, text: str) -> list[int]:
        if text.isascii():
            found = self.cut(text.lower())
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # a sigma's place doesn't count
            kinds, lower = later()
            if kinds and not kinds.keys().isdisjoint(map(ord, text)):
                text = text.translate(lower)
                found = [text[slice(*m.span())] for m in self.pieces.finditer(text.translate(kinds))]
            else:
                found = self.cut(text)
        ids: list[int] = []
        for p in found:
            at = self.known_pieces.get(p)
            if at is None:
                at = self.piece(p)
                if len(p) <= SHORT:
                    self.known_pieces[p] = at
            ids += at
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Chunks of usual length are encoded once and remembered."""
        if len(self.known) > REMEMBER:
            self.known, self.arena = {}, Arena()
        if len(self.known_pieces) > REMEMBER:
            self.known_pieces = {}
        cut = [[c for c in SPACE.split(t) if c] if MORE_SPACE.search(t) else t.split() for t in texts]
        known, new = self.known, list(set().union(*cut).difference(self.known))
        if new:
            n = len(self.arena.starts)
            self.arena.add([self.chunk(c) for c in new])
            known.update(zip(new, range(n, n + len(new))))
        ends = np.cumsum([len(c) for c in cut])
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(ends[-1]))
        ids, bounds = self.arena.take(at)
        for c in new:
            if len(c) > SHORT:
                del known[c]
        return np.split(ids, bounds[ends][:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' names with a space between them, as UTF-8: what a vocabulary file without a decoder gives."""
        return self.names.take(ids)[0].tobytes()[:-1]


@lru_cache(maxsize=2)
def load(path: str) -> PrefixBpe:
    """The vocabulary at ``path``, a file on every executor's machine; kept by each Python worker."""
    with open(path, encoding="utf-8") as f:
        return PrefixBpe(json.load(f))


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids (token ids), decoded (text of the ids)."""

    def encode(batches):
        bpe = load(path)
        for batch in batches:
            start = 0
            for group in runs(batch.column(1).to_pylist()):
                x = bpe.encode(group)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(group)), pa.array(x, pa.list_(pa.int32())), pa.array([bpe.decode(i).decode() for i in x], pa.string())], names=["id", "ids", "decoded"])
                start += len(group)

    schema = docs.select(docs[id_col].alias("id")).schema.add("ids", ArrayType(IntegerType())).add("decoded", "string")
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(encode, schema).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256 (of the text decoded from the ids, UTF-8). A document's ids leave the worker as digests only."""

    def encode(batches):
        bpe = load(path)
        for batch in batches:
            start = 0
            for group in runs(batch.column(1).to_pylist()):
                x = bpe.encode(group)
                n = len(group)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), pa.array([len(i) for i in x], pa.int64()), pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in x]), pa.array([hashlib.sha256(bpe.decode(i)).hexdigest() for i in x])], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
                start += n

    schema = docs.select(docs[id_col].alias("id")).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(encode, schema).withColumnRenamed("id", id_col)
