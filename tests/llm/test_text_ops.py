import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from siftgraph.llm import bpe, decontaminate as dc, licenses, neardup as nd, pii, text

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, items int"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def test_words_and_hashes():
    texts = ["Ab, cD\x00é9", "", None, "x" * 100, "Ab"]
    ((_, _, t),) = text.slices(pa.array(texts))
    s, e, first = t.words(text.ALNUM)
    got = [[t.data[a:b].tobytes().decode().translate(LOW) for a, b in zip(s[i:j], e[i:j])] for i, j in zip(first, first[1:])]
    assert got == [WORD.findall((x or "").translate(LOW)) for x in texts]
    h = t.hashes(s, e)
    assert h[0] == h[-1] and len(set(h.tolist())) == len(set(sum(got, [])))
    assert [j - i for i, j, _ in text.slices(pa.array(["a" * 50] * 10), 120)] == [2] * 5


def test_lookup():
    keys = np.random.default_rng(1).integers(1, 1 << 63, 5000).astype(np.uint64)
    t = text.Lookup(np.unique(keys))
    assert (np.unique(keys)[t.find(keys)] == keys).all() and (t.find(keys + np.uint64(1))[:50] == -1).all() and len(text.Lookup(keys[:0]).find(keys)) == 5000


def brute(doc, items, window=10):
    w = WORD.findall((doc or "").translate(LOW))
    hit, found = [False] * len(w), set()
    for i, t in items:
        x = WORD.findall((t or "").translate(LOW))
        n = min(window, len(x))
        for a in range(len(w) - n + 1):
            if n and any(w[a : a + n] == x[b : b + n] for b in range(len(x) - n + 1)):
                hit[a : a + n] = [True] * n
                found.add(str(i))
    return len(w), sum(hit), dc.sha_of(list(found)), any(hit)


@pytest.mark.parametrize("mb", [16, 0])
def test_decontamination_against_brute_force(spark, mb, monkeypatch):
    r = np.random.default_rng(2)
    vocab = ["a", "b", "c", "Dé", "e1"]
    item_texts = [" ".join(r.choice(vocab, n)) for n in (25, 14, 10, 10, 3, 7)] + ["", None, "Solo", " ".join(["z"] * 15)]
    items = [*enumerate(item_texts), (1, item_texts[1])]
    texts = [" ".join(r.choice(vocab, 60)) + ". " + item_texts[k % 6] + "; " + " ".join(r.choice(vocab, 9)) for k in range(25)] + ["", None, "solo", "z " * 40, item_texts[0], item_texts[0][:-2]]
    d, b = docs(spark, texts), spark.createDataFrame(items, "item_id int, text string")
    found = dc.contamination(d, b, keep=("text", "items") if mb else (), broadcast_mb=mb)
    if mb:
        assert found.columns == ["doc_id", "text", "n_words", "n_hit", "items"]  # a result replaces a kept column of its name
        assert dc.contamination(d, b, keep=("text", "items"), broadcast_mb=0).columns == found.columns
    got = {r.doc_id: (r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in dc.digest(found).collect()}
    want = {i: brute(t, items) for i, t in enumerate(texts)}
    assert got == want and dc.digest(dc.contamination(d.limit(0), b)).count() == 0
    assert not any(r.contaminated for r in dc.digest(dc.contamination(d, b.limit(0))).collect())


def test_decontamination_of_passages_that_go_on_in_the_next_row(spark):
    r = np.random.default_rng(8)
    items = [(f"i{k}", " ".join(f"k{k}w{j}" for j in range(30))) for k in range(12)]
    texts = []
    for _, t in items:
        w, cut = t.split(), int(r.integers(10, 16))
        texts += [" ".join(["x"] * 4 + w[:cut]), " ".join(w[cut : cut + int(r.integers(9, 13))] + ["y"] * 3)]
    long_text = " ".join(f"z{j}" for j in range(60_000)) + " " + items[3][1]
    texts += [long_text, items[5][1]]
    for order in (range(len(texts)), r.permutation(len(texts))):
        own = [texts[i] for i in order]
        d, b = docs(spark, own).coalesce(1), spark.createDataFrame(items, "item_id string, text string")
        want = {i: brute(t, items) for i, t in enumerate(own) if len(t) < 9999} | {
            i: (60_030, 30, dc.sha_of(["i3"]), True) for i, t in enumerate(own) if len(t) > 9999
        }
        for mb in (16, 0):
            rows = dc.digest(dc.contamination(d, b, broadcast_mb=mb)).collect()
            assert {x.doc_id: (x.n_words, x.n_hit, x.items_sha256, x.contaminated) for x in rows} == want


@pytest.fixture(scope="module")
def coder():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(c) for a, c in map(bytes.split, open(path, "rb"))}
    return bpe.load(path, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.lists(st.text(st.sampled_from("aAbe .\n\t!'s1é日😀\x1c\x85_"), max_size=40), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None, database=None)
def test_bpe_equals_tiktoken(coder, texts):
    own, theirs = coder
    for t, x in zip(texts, own.encode(texts)):
        assert x.tolist() == theirs.encode_ordinary(t) and own.decode(x) == t.encode()


def test_bpe_long_pieces_and_query(spark, coder):
    own, theirs = coder
    texts = ["a" * 5000, " " * 900, "ab" * 700, "日本語" * 200, "", None, "The end", "The end", "<|endoftext|>"]
    rows = {r.doc_id: r for r in bpe.digests(docs(spark, texts), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = theirs.encode_ordinary(t or "")
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.encoded(docs(spark, texts), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).where("doc_id = 6").first().decoded == b"The end"


def test_bag_signatures_are_unbiased():
    r = np.random.default_rng(1)
    errors = []
    for _ in range(120):
        run = r.integers(1, 1 << 48, 50).astype(np.uint64)
        a = r.integers(0, 9, 50)
        b = np.where(r.random(50) < 0.7, a, r.integers(0, 9, 50))
        sig = [nd.signatures(np.zeros((w > 0).sum(), dtype=np.int64), run[w > 0], w[w > 0], 1)[0] for w in (a, b)]
        errors.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def shingles(t):
    w = WORD.findall((t or "").translate(LOW))
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])


def classes_by_brute_force(texts):
    from collections import Counter

    bag = [Counter(shingles(t)) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = sum((bag[i] & bag[j]).values())
            if both and both >= 0.8 * sum((bag[i] | bag[j]).values()):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_against_brute_force(spark):
    r = np.random.default_rng(4)
    word = lambda n: list(r.choice([f"w{i}" for i in range(400)], n))
    texts = []
    for _ in range(4):
        base = word(120)
        for k in (0, 0, 1, 2, 3, 6, 10):
            t = list(base)
            for i in r.integers(0, 120, k):
                t[i] = f"x{r.integers(1000)}"
            texts.append(" ".join(t))
    texts += [" ".join(word(80)) for _ in range(10)] + ["", None, "...", "one two", "One, two!", "a", texts[0].upper() + "!", "the " * 300, "the " * 310]
    rows = nd.classes(docs(spark, texts)).collect()
    want = classes_by_brute_force(texts)
    got = {x.doc_id: x.class_id for x in rows}
    assert [got[i] for i in range(len(texts))] == want
    kept = nd.deduplicated(docs(spark, texts))
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want)) and kept.columns == docs(spark, texts).columns
    # Repeated rows, repeated ids with other texts, null ids, no rows.
    t = " ".join(word(30))
    odd = docs(spark, [t, t, "p q r s t u v", t, ""], [1, 1, 1, None, 7])
    assert sorted((x.doc_id or 0, x.text) for x in nd.deduplicated(odd).collect()) == sorted([(1, t), (1, "p q r s t u v"), (7, "")])
    assert nd.classes(odd.limit(0)).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_by_brute_force(t):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            bad = (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits))) or (kind == "phone" and not 9 <= len(digits) <= 15)
            if not bad:
                out.append((kind, *m.span()))
    return out


@given(st.lists(st.sampled_from(["1", "22", "255", "256", ".", "@", "a", "+", " ", "-", "(", ")", "4111111111111111", "x@y.z", "é", "%"]), max_size=16).map("".join))
@settings(max_examples=400, deadline=None, database=None)
def test_base_spans(t):
    assert pii.base_spans(t)[0] == base_by_brute_force(t)


def test_pii_field_adds_and_keeps(spark):
    noisy = "call +1 (843) 555-7672 170.106.47.218 now"  # the pattern takes both as one number of too many digits
    texts = ["mail a.b@c.de and 10.0.0.1", noisy, "pay 4040549990366430 and again 4040549990366430", "year 2024 and version 2.0", "", None, "9" * 20000, "a" * 20000 + "@"]
    d = docs(spark, texts * 2)
    model = pii.train(d)
    rows = {r.doc_id: r for r in pii.found(d, model).collect()}
    assert rows[0].spans == rows[0].base == "email:5:13,ip:18:26"
    assert "phone:5:22" in rows[1].spans and rows[1].base == "ip:23:37"
    assert rows[2].spans.count("card:") == 2 and rows[2].n_card == 0
    assert rows[3].spans == rows[4].spans == rows[5].spans == ""
    assert set(rows[1].base.split(",")) <= set(rows[1].spans.split(","))
    red = {r.doc_id: r for r in pii.redacted(d, model).collect()}
    assert red[0].text == "mail [EMAIL] and [IP]" and red[5].text is None and red[3].text == texts[3] and red[0].items == 1
    assert pii.found(d.limit(0), model).count() == 0


def test_skip_edges_carry_labels():
    r = pii.SkipChain.fit(pii.made_sentences())
    assert (np.diag(r.pair[1])[1:] > 0).all()
    g = pii.Graph()
    g.add(0, "a 12345 b 777 c 12345 d 888")
    assert sorted(k for _, _, k in g.edges) == [1, 2]


def test_licences(spark):
    mit = licenses.KNOWN["MIT"]
    texts = [mit, "Copyright (c) 2020 Someone\n\n" + mit.upper(), mit.replace("sublicense", "sublicence").replace('"', "“"), mit[:-20], "Licensed under the Apache Licence, version 2.0", "", None, "© 1999 x\nplain", mit]
    rows = {r.doc_id: r for r in licenses.scanned(docs(spark, texts)).collect()}
    assert [rows[i].license for i in range(9)] == ["MIT", "MIT", "MIT", None, "Apache-2.0-line", None, None, None, "MIT"]
    assert rows[5].digest == rows[6].digest and licenses.scanned(docs(spark, texts).limit(0)).count() == 0


def test_pii_sample_is_full_where_few_documents_fit(spark, monkeypatch):
    got = []
    monkeypatch.setattr(pii.SkipChain, "fit", staticmethod(lambda texts: got.append(texts)))
    texts = ["no such thing"] * 4000
    for i in range(0, 4000, 100):
        texts[i] = f"plain\nnumber {i} " + "x" * 30_000
    made = len(pii.made_sentences())
    pii.train(docs(spark, texts), sample=20)
    pii.train(docs(spark, texts, [None] * len(texts)), sample=20)
    assert [len(x) - made for x in got] == [20, 20]
    assert pii.SAMPLE == 4000 and all(len(x) > 30_000 and "plain" not in x for x in got[0][made:])


def test_decontamination_of_a_passage_split_over_two_rows():
    for k in range(40):  # the least hash of the second row is sometimes at its first word
        words = [f"w{k}x{i}" for i in range(20)]
        rows = [" ".join(words[:10]), " ".join(words[10:])]
        (_, _, t), = text.slices(pa.array(rows))
        assert list(dc.Index([1], [" ".join(words)]).scan(t)) == [(10, 10, {"1"})] * 2


def test_skip_edges_join_forms_and_shapes_and_reach_far():
    g = pii.Graph()
    g.add(0, "a 12345 b 67890 c 12345")
    assert sorted(g.edges) == [(0, 1, 2), (0, 2, 1), (1, 2, 2)]
    far = pii.Graph()
    far.add(0, " x ".join(["77"] * 40))
    pair = np.stack([np.zeros((5, 5)), np.eye(5) * 9, np.eye(5)])
    field = pii.SkipChain({"b-": np.zeros(5)}, pair)
    far.features = [["up"] if i == 0 else [] for i in range(40)]
    field.rows["up"] = np.array([0, 0, 0, 6.0, 0])
    assert (field.beliefs(far).argmax(axis=1) == 3).all()


def test_messages_give_exact_marginals_on_a_tree():
    from itertools import product

    r = np.random.default_rng(4)
    g = pii.Graph()
    g.doc, g.features = [0] * 5, [[f"f{i}"] for i in range(5)]
    g.edges = [(0, 1, 0), (1, 2, 1), (1, 3, 2), (3, 4, 0)]
    n = len(pii.LABELS)
    pair = r.normal(size=(3, n, n))
    pair[1:] = (pair[1:] + pair[1:].transpose(0, 2, 1)) / 2
    field = pii.SkipChain({f"f{i}": r.normal(size=n) for i in range(5)}, pair)
    want = np.zeros((5, n))
    for y in product(range(n), repeat=5):
        p = np.exp(sum(field.rows[f"f{i}"][y[i]] for i in range(5)) + sum(pair[k, y[a], y[b]] for a, b, k in g.edges))
        want[np.arange(5), y] += p
    got = np.exp(field.beliefs(g) - field.beliefs(g).max(axis=1, keepdims=True))
    assert np.abs(got / got.sum(axis=1, keepdims=True) - want / want.sum(axis=1, keepdims=True)).max() < 1e-3


def test_shapes_of_long_tokens_differ_in_their_ends():
    a, b = "1a" * 60 + "2", "1a" * 60 + "b22"
    assert pii.shape(a) != pii.shape(b) and pii.shape(a) == pii.shape(a.replace("1", "3")) and len(pii.shape(a)) < 20


def test_licenses_as_files_hold_them(spark):
    from pathlib import Path

    rows = dict(licenses.variants())
    n = len(rows)
    place = Path("/usr/share/common-licenses")  # public texts, where the system has them
    long = {"Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    names = [k for k, f in long.items() if (place / f).exists()]
    for k in names:
        text_ = (place / long[k]).read_text()
        rows[len(rows)] = "\n".join(x.strip() for x in text_.splitlines()).replace(" license ", " licence ")
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in rows.items()], "doc_id int, text string, digest string, license string")
    got = {r.doc_id: r.license for r in licenses.scanned(d).collect()}
    mit, bsd = ["MIT"] * 2, ["BSD-2-Clause"] * 3
    assert [got[i] for i in range(n)] == [*mit, *bsd, "ISC", "MIT", "Zlib", "BSD-3-Clause", "Unlicense", None, None]
    assert [got[n + i] for i in range(len(names))] == names
    assert licenses.scanned(spark.createDataFrame([(1, "x " * 400_000)], "doc_id int, text string")).first().license is None
