"""Operators 11 to 13: spelling variants, fill-in-middle and BPE by prefixes."""

import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftgraph.llm import infill, prefix_bpe, spelling

tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def bpe():
    return prefix_bpe.load(PATH)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def same(bpe, library, texts):
    for text, got in zip(texts, bpe.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert got.tolist() == want, text
        assert bpe.decode(got).decode() == library.decode(want, skip_special_tokens=False), text


def test_prefix_bpe_meets_every_code_point(bpe, library):
    texts = [f"a{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(texts), 100_000):
        part = texts[i : i + 100_000]
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert [g.tolist() for g in bpe.encode(part)] == want


def test_prefix_bpe_on_hard_texts(bpe, library):
    same(bpe, library, ["", " ", "\n\t\x1c \x1f", "<|endoftext|>a<|startoftext|> b<|endof", "a<|ENDOFTEXT|>b", "</w> a</w>b", "ΑΣ ΣΑΣ", "İi", "é ́e", "it's I'LL 'Tis ''s", "1234 a1b2", "x" * 5000, "the" * 3000, "aaaa " * 9, "\U00010d50Ᲊ"])
    r = random.Random(7)
    names = [n.replace("</w>", "") for n in library.get_vocab()]
    same(bpe, library, ["".join(r.choice(names) for _ in range(r.randint(1, 30))) for _ in range(2000)])
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    same(bpe, library, ["".join(r.choice(letters[: r.choice([2, 3, 6, 12, 26])]) for _ in range(r.randint(1, 300))) for _ in range(1500)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=20))
def test_prefix_bpe_on_any_text(texts):
    same(prefix_bpe.load(PATH), tokenizers.Tokenizer.from_file(PATH), texts)


def test_prefix_bpe_forgets_without_harm(bpe, library, monkeypatch):
    monkeypatch.setattr(prefix_bpe, "REMEMBER", 3)
    monkeypatch.setattr(prefix_bpe, "PAIRS", 5)
    for k in range(4):
        same(bpe, library, [f"words that come and go {k}", "y" * 100 + f" again {k}"])


def test_prefix_bpe_refuses_other_vocabularies():
    spec = {"model": {"vocab": {}, "merges": [], "end_of_word_suffix": ""}}
    with pytest.raises(ValueError):
        prefix_bpe.PrefixBpe(spec)


def test_prefix_bpe_digests(spark, library):
    rows = [(1, "Hello, world!", "x"), (2, None, "y"), (3, "", "z"), (4, "Hello, world!", "x"), (None, "naïve ÉCOLE " * 4000, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, id string")
    got = {r["doc_id"]: r for r in prefix_bpe.digests(docs, PATH).collect()}
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole = {r["doc_id"]: r for r in prefix_bpe.encoded(docs, PATH).collect()}
    assert whole[1]["decoded"] == "hello</w> ,</w> world</w> !</w>" and whole[2]["ids"] == []
    assert prefix_bpe.digests(docs.limit(0), PATH).count() == 0


def fim(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in infill.MARKERS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b, c = text[:lo], text[lo:hi], text[hi:]
    if h[3] % 100 < 20:
        return n, "spm", lo, hi - lo, f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", lo, hi - lo, f"<P>{a}<S>{c}<M>{b}"


def test_infill_against_slices(spark):
    r = random.Random(3)
    odd = ["a", "\x01", "\x02", "\x02a", "\x02b", "$0", "\\", "\n", "\r\n", "é", "é", "𝔘", "<", "<P", "P>", "S>", "M>", "\x00", " "]
    texts = [None, "", "\x01", "\x02", "<P>", "x<S>y", "<M>", "a" * 50_000, "𝔘" * 301]
    texts += ["".join(r.choice(odd) for _ in range(r.randint(1, 12))) for _ in range(600)]
    rows = [(i, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n int")
    got = {x["doc_id"]: x for x in infill.digests(docs).collect()}
    forms = Counter()
    for i, t, _ in rows:
        n, form, prefix, middle, output = fim(i, t)
        forms[form] += 1
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(got[i])[1:] == (n, form, prefix, middle, sha(output), sha(t or "")), t
    assert min(forms[k] for k in ("plain", "spm", "psm")) > 30


def test_infill_by_words_and_lines(spark):
    docs = spark.createDataFrame([(i, f" one two\nthree {i}\n\nfour  five \n") for i in range(40)], "doc_id int, text string")
    for units, n in (("words", 6), ("lines", 4)):
        rows = infill.transformed(docs, units=units, transform_percent=100).collect()
        assert {r["n"] for r in rows} == {n}
        assert all(r["prefix"] + r["middle"] + r["suffix"] == r["text"] for r in rows)
        ends = {r["prefix"][-1:] for r in rows}
        assert ends <= ({"", "\n", " "} if units == "words" else {"", "\n"})
    with pytest.raises(ValueError):
        infill.transformed(docs, markers=("<A>", "<<B", "<C>"))
    assert infill.digests(docs.limit(0)).count() == 0


def edits(word):
    near, letters = set(), sorted(set("abcdefghijklmnopqrstuvwxyzÀàéß×÷ÿ"))
    for i in range(len(word) + 1):
        near |= {word[:i] + c + word[i:] for c in letters}
        if i < len(word):
            near |= {word[:i] + word[i + 1 :]} | {word[:i] + c + word[i + 1 :] for c in letters}
    return near - {word}


def variants(counts, factor=2):
    out = {}
    for w, n in counts.items():
        near = sorted(((-counts[x], x) for x in edits(w) & counts.keys()))
        form = near[0][1] if near and -near[0][0] >= factor * n else None
        out[w] = (form, n, len(near))
    rows = {}
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w] = (form, root, n, k, counts[form] if form else None)
    return rows


def test_spelling_pairs_against_edits(spark):
    r = random.Random(5)
    counts = {"".join(r.choice("abé") for _ in range(r.randint(1, 9))): r.choice([3, 3, 4, 8, 9, 20, 70]) for _ in range(1500)}
    counts |= {"shared" + "".join(r.choice("abcd") for _ in range(4)): r.choice([3, 6, 12]) for _ in range(300)}
    counts |= {r_ + "ending": 5 for r_ in map("".join, (r.choices("xyz", k=4) for _ in range(60)))}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = spelling.near_pairs(words)
    rows = pairs.collect()
    assert len({(x["a"], x["b"]) for x in rows}) == len(rows)
    want = {tuple(sorted((w, x))) for w in counts for x in edits(w) & counts.keys()}
    assert {tuple(sorted((x["a"], x["b"]))) for x in rows} == want
    got = {x["word"]: tuple(x)[1:] for x in spelling.rooted(spelling.variants(words, pairs)).collect()}
    assert got == variants(counts)


def test_spelling_of_documents(spark):
    r = random.Random(11)
    vocabulary = ["Straße", "strasse", "straßen", "letters", "better", "ABCDEF", "abcdéf", "ÀBCDEF", "àbcdef", "four"]
    rows = [(i, " ".join(r.choices(vocabulary, k=40)) + "-×÷ÿ1") for i in range(120)] + [(500, None), (501, ""), (502, "12 34"), (None, "letters")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id int, text string, n int")
    counts = Counter()
    for i, t in rows:
        run = ""
        for c in (t or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= 5:
                    counts[run] += 1
            run = ""
    want = variants({w: n for w, n in counts.items() if n >= 3})
    assert any(x[0] for x in want.values())
    got = {x["word"]: tuple(x)[1:] for x in spelling.grouped(docs, slip=97).collect()}
    assert got == want
    assert spelling.grouped(docs.where("doc_id > 499"), slip=97).count() == 0
    assert spelling.counted(spelling.occurrences(docs), 1).where("word = 'letters'").count() == 1


def test_spelling_follows_long_chains(spark):
    words = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]
    counts = {w: 3 * 2**k for k, w in enumerate(words)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = {x["word"]: x for x in spelling.rooted(spelling.variants(frame, spelling.near_pairs(frame))).collect()}
    assert {x["root"] for x in rows.values()} == {"bbbbb"} and rows["bbbbb"]["form"] is None
