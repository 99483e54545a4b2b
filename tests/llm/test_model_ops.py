import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftgraph.llm import chat, lm, neighbours as nb, quality as q, shards as sh, text

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def corpus(n=160, seed=3):
    r = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(60)])
    p = 1 / np.arange(1, 61)
    p /= p.sum()
    out = []
    for _ in range(n):
        w = list(r.choice(words, int(r.integers(5, 60)), p=p))
        out.append(" ".join(x for y in w for x in ((y, "next" + y) if y in ("w0", "w1", "w2") else (y,))) + ".")
    return out


@pytest.fixture(scope="module")
def docs(spark):
    t = corpus()
    junk = [" ".join("#" + x + "$$" for x in s.split()) for s in corpus(20, 9)]
    rows = [(i, x, "en" if i % 3 else "de") for i, x in enumerate(t + junk)] + [(900, None, "en"), (901, "", None), (902, "Rare é words w0", "xx"), (903, t[0], "en"), (903, t[0], "en"), (None, t[1], "en")]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, n_tokens int").cache()


@pytest.fixture(scope="module")
def scored(docs):
    return lm.scores(docs).collect()


def test_lm_base_score_and_shape(docs, scored):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW)) + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i or -1, held(i), len(tokens(t)), sum(w in c for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    got = sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored)
    assert got == want


def test_lm_learns_and_is_normalised(scored):
    held = [r for r in scored if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    m = lm.Lbl.start(np.full(9, 1 / 9), 4)
    z = m.normaliser()
    s = ((m.r @ m.c[0].T)[2] + (m.r @ m.c[1].T)[5]) @ m.r.T + m.b - z[2, 5]
    assert abs(np.exp(s).sum() - 1) < 1e-5


def test_lm_rare_words_by_shuffle(docs, scored):
    few = lm.scores(docs, head=40, plain=20, buckets=8)
    base = {(r.doc_id, r.n_tokens): round(r.base_score, 6) for r in scored}
    for r in few.collect():
        assert base[r.doc_id, r.n_tokens] == round(r.base_score, 6)
    assert lm.scores(docs, head=0, plain=5, buckets=2).count() == docs.count()


def test_lm_score_against_brute_force(docs, monkeypatch):
    """The trained model, token by token from its definition; in each context all outcomes sum to one."""
    kept = []
    monkeypatch.setattr(lm, "fitted", lambda taught, types, width, fit=lm.fitted: kept.append((taught, types, fit(taught, types, width))) or kept[-1][2])
    got = {(r.doc_id, r.n_tokens): r.score for r in lm.scores(docs, head=40, plain=20, buckets=8).collect()}
    taught, types, (m, _) = kept[0]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))

    def hashed(w):
        ((_, _, t),) = text.slices(pa.array([w]))
        return int(t.hashes(*t.words(text.NONSPACE)[:2])[0])

    end = int(lm.END)
    c = Counter(h for r in taught.collect() for h in [*map(hashed, words(r.text)), end])
    singles = [end, *[int(x) for x in types.tok[(types.outcome > 0) & (types.outcome < types.first)]]]
    assert types.first == 21 and sorted(c[x] for x in singles[1:])[0] >= sorted(c.values())[-21]
    place = {x: i for i, x in enumerate(singles)}
    out = lambda h: place.get(h, 21 + h % 8)
    ones, twos = (sum(v == i for v in c.values()) for i in (1, 2))
    d = ones / (ones + 2 * twos) if ones and twos else 0.5

    def logp(w1, w2):
        s = (m.c[0] @ m.r[w1] + m.c[1] @ m.r[w2]) @ m.r.T.astype(np.float64) + m.b
        return s - np.log(np.exp(s).sum())

    def share(h):
        own = {k: n for k, n in c.items() if k not in place and k % 8 == h % 8}
        if h in place:
            return 1.0
        return ((c[h] - d) if h in own else d * len(own)) / sum(own.values()) if own else 1.0

    for r in docs.where("doc_id in (3, 12, 902) or doc_id is null").collect():
        h, w1, w2, want = [*map(hashed, words(r.text)), end], 0, 0, 0.0
        for x in h:
            want += logp(w1, w2)[out(x)] / math.log(10) + math.log10(share(x))
            w1, w2 = out(x), w1
        assert abs(got[r.doc_id, len(h)] - want) < 1e-3 * len(h)
    total = sum(np.exp(logp(3, 22)[out(h)]) * share(h) for h in c)
    total += sum(np.exp(logp(3, 22)[21 + b]) * share(-8 + b) for b in range(8))  # what no text holds, of each bucket
    assert abs(total - 1) < 1e-6
    assert lm.scores(docs.limit(0)).count() == 0


def test_quality_keeps_clean_and_rejects_junk(spark, docs):
    labels = spark.createDataFrame([(i, int(i < 160), 0) for i in range(0, 180, 2)] + [(None, 1, 0), (5, None, None), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in q.judged(docs, labels).collect()}
    assert np.mean([rows[i].accepted for i in range(160)]) > 0.97
    assert not any(rows[i].accepted for i in range(160, 180))
    assert not rows[900].accepted and not rows[901].accepted
    assert q.judged(docs, labels).count() == docs.count() and q.judged(docs.limit(0), labels).count() == 0
    assert q.judged(docs, labels.limit(0)).where("n_tokens > 0 and not accepted").count() == 0


def test_kneser_ney_sums_to_one(spark):
    text = "a b c a b d a b c b a c d d a b"
    train = spark.createDataFrame([("en", text), ("en", "b a b c")], "lang string, text string")
    model = q.train(train)
    g = q._lang_hash(["en"])
    (_, _, t), = q.slices(__import__("pyarrow").array(["a b c d zzz"]))
    h, _ = q._tokens(t)
    for u, v in ((h[0], h[1]), (h[3], h[3]), (h[4], h[4]), (h[1], h[4])):
        known = sum(10 ** model.logs(g, np.array([u]), np.array([v]), np.array([w]))[0] for w in h[:4])
        unknown = 10 ** model.logs(g, np.array([u]), np.array([v]), np.array([h[4]]))[0]
        assert abs(known + unknown - 1) < 1e-5


def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(1500, 12)).round(3)
    x[700:800] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5000, None, 0), (5100, [0.0] * 12, 0), (5200, [float("nan")] * 12, 0), (5300, [1.0, None] + [0.0] * 10, 0), (5400, [1.0], 0), (None, x[0].tolist(), 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {}
    for row in nb.neighbours(v, block=500).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    assert sorted(got) == list(range(0, 1500, 100))
    hits = 0
    for i, rows in got.items():
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        rows.sort()
        assert [k for k, _, _ in rows] == list(range(1, 11)) and all(abs(s - d[j]) < 1e-12 for _, j, s in rows)
        hits += len(set(best.tolist()) & {j for _, j, _ in rows})
    assert hits >= 0.9 * 10 * len(got)
    assert [j for _, j, _ in sorted(got[100])] == list(range(700, 710)) and [j for _, j, _ in sorted(got[700])] == [100, *range(701, 710)]
    few = nb.neighbours(v.where("vec_id in (0, 1, 2)")).collect()
    assert [(r["rank"], r.query_id) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 0), (2, 0)]
    assert nb.neighbours(v.limit(0)).count() == 0


def test_sharding_laws(spark):
    rows = [(i // 2 if i % 5 else None, None if i % 7 == 0 else "é" * (i % 11)) for i in range(501)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string")
    got = sh.sharded(d, 24).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r.slot)
        assert sh.place(r.row_number, 501, 42) == r.slot * 24 + r["shard"]
    assert len(got) == 501 and all(sorted(x) == list(range(len(x))) for x in slots.values()) and {len(x) for x in slots.values()} == {20, 21}
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    again = sh.sharded(d.repartition(7), 24).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got)) or Counter((r.doc_id, r.size, r.text_crc32, r["shard"]) for r in again) == Counter((r.doc_id, r.size, r.text_crc32, r["shard"]) for r in got)
    assert sh.sharded(d.limit(0)).count() == 0
    for n in (1, 2, 3, 7, 24, 100, 1000):
        assert sorted(sh.place(i, n, 1) for i in range(n)) == list(range(n))


def test_permutation_of_large_numbers(spark):
    n = 10**13 + 7
    x = spark.createDataFrame([(0,), (12345678901,), (n - 1,)], "x long").select("x", sh.permute(F.col("x"), n, 3).alias("y")).collect()
    assert all(sh.place(r.x, n, 3) == r.y < n for r in x)


def test_transcripts(spark):
    r = np.random.default_rng(2)
    talk = lambda k: " ".join(r.choice(["So", "what", "is", "this", "thing", "about"], k)).capitalize()
    rows = []
    for c in range(60):
        for t in range(4):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", talk(4) + "?" if t % 2 == 0 else talk(40) + ".\n" + talk(30) + ".", 1))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    model = chat.train(table.where("conv_id < 40"))
    got = chat.parsed_pieces(chat.transcripts(table.where("conv_id >= 40")), model).collect()
    right = np.mean([a == b for x in got for a, b in zip(x.roles.split(","), x.truth.split(","))])
    assert right > 0.95 and len(got) == 20
    long = talk(40) + ".\n" + talk(30) + "."
    assert model.parse(f"### Human\nSo what is this?\n### Assistant\n{long}") == [("user", "So what is this?"), ("assistant", long)]
    assert chat.rendered([("user", "hi")]) == "<|user|>\nhi\n<|end|>\n"
    empty = spark.createDataFrame([(1, None), (2, "")], "id int, transcript string")
    assert [(x.n_lines, x.n_turns) for x in chat.parsed(empty, model).collect()] == [(0, 0), (0, 0)]
    odd = spark.createDataFrame([(None, None, None, None, 1), (1, 0, "user", None, 1), (1, 0, "user", None, 1)], table.schema)
    assert chat.parsed_pieces(chat.transcripts(odd), model).count() == 2
    assert chat.parsed_pieces(chat.transcripts(table.limit(0)), model).count() == 0 and chat.train(table.limit(0)) is not None


def test_pieces_are_parsed_as_one_transcript(spark):
    r = np.random.default_rng(5)
    talk = lambda k: " ".join(r.choice(["So", "what", "is", "this", "thing", "about"], k)).capitalize()
    rows = [(c, t, ("user", "assistant", "system", "odd")[int(r.integers(0, 2 if c else 4))], "\n".join(talk(int(r.integers(0, 9))) for _ in range(int(r.integers(1, 4)))), 1) for c in range(6) for t in range(50)]
    rows += [(7, None, "user", "x " * 100_000, 1), (None, 3, "user", "Who?", 1), (None, 4, "assistant", "Nobody.", 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered int")
    model = chat.train(table)
    pieces = chat.transcripts(table, piece=4).cache()
    texts, told = {}, {}
    for x in sorted(pieces.collect(), key=lambda x: (x.part, x.seq)):
        texts.setdefault(x.conv_id, []).append(x.transcript)
    assert min(len(texts[c]) for c in range(6)) >= 9
    for x in sorted(chat.parsed_pieces(pieces, model).collect(), key=lambda x: (x.part, x.seq)):
        told.setdefault(x.conv_id, []).append(x)
    for c, parts in texts.items():
        whole = model.parse("\n".join(parts))
        assert [y for x in told[c] if x.roles for y in x.roles.split(",")] == [r for r, _ in whole]
        tidy = lambda s: re.sub(r"\s+", " ", s)  # noqa: E731  blank lines at a cut may differ
        assert tidy("".join(x.rendered for x in told[c])) == tidy(chat.rendered(whole))


def viterbi_by_brute_force(model, lines):
    from itertools import product

    seen = chat.observed(lines)
    best = None
    for path in product(range(len(chat.STATES)), repeat=len(lines)):
        score = model.start[path[0]] + sum(model.move[a, b] for a, b in zip(path, path[1:])) + sum(t.get(x, d)[s] for s, o in zip(path, seen) for t, x, d in zip(model.tables, o, model.default))
        best = max(best, (score, path)) if best else (score, path)
    return best


def test_viterbi_is_exact():
    model = chat.Hmm.fit([[("user", "Hello there?"), ("assistant", "Long answer.\nMore of it.")]] * 6)
    lines = ["User: hi", "", "A> ok", "more"]
    score, path = viterbi_by_brute_force(model, lines)
    seen, own = chat.observed(lines), model.states(lines)
    mine = model.start[own[0]] + sum(model.move[a, b] for a, b in zip(own, own[1:])) + sum(t.get(x, d)[s] for s, o in zip(own, seen) for t, x, d in zip(model.tables, o, model.default))
    assert abs(mine - score) < 1e-9 and len(path) == len(own)


def test_quality_fits_on_a_stated_part_of_the_trusted_text(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    big = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.substring(F.sha2(F.concat(F.col("id"), F.lit(" "), i), 256), 1, 9))).alias("text"))
    size = big.count() * 200 * 10
    seen = []
    monkeypatch.setattr(q, "fitted", lambda t, fit=q.fitted: seen.append(t.agg(F.sum(F.length("text"))).first()[0]) or fit(t.limit(5)))
    labels = big.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    q.judged(big, labels, fit_mb=None)
    assert 0.45 * size < seen[0] < 0.55 * size  # 3 of 6 MB: half of all
    q.judged(big, labels, fit_mb=1.5)
    assert 1.3e6 < seen[1] < 1.7e6


def test_quality_by_shards_gives_the_same(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 160, 2)], "doc_id long, quality int, toxic int")
    key = lambda r: (str(r.doc_id), r.n_tokens, round(r.log10_perplexity, 5), round(r.threshold, 4), r.accepted)
    whole = sorted(map(key, q.judged(docs, labels).collect()))
    assert sorted(map(key, q.judged(docs, labels, local=0).collect())) == whole
    trusted = docs.where("doc_id < 80").select("lang", "text")
    *levels, _ = q.fitted(trusted)
    langs = {r.lang for r in trusted.select("lang").distinct().collect()}
    told = [{(str(r.doc_id), r.n_tokens, round(r.logp, 3)) for r in x.collect()} for x in (q.scored(docs, q.gathered(*levels), langs, ("doc_id", "lang")), q.scored_by_shuffle(docs, *levels, langs, ("doc_id", "lang"), shard=500))]
    assert told[0] == told[1]


def kneser_ney_by_brute_force(texts):
    """log10 probability of a text's tokens under interpolated modified Kneser-Ney trigrams of the given texts."""
    cut = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+|[^\x09-\x0d\x20]", (t or "").translate(LOW))
    three = Counter(g for t in texts for w in [["<s>", "<s>", *cut(t)]] for g in zip(w, w[1:], w[2:]))
    two = Counter(g[1:] for g in three)
    one = Counter(g[1:] for g in two)

    def level(counts):
        n = [sum(c == i for c in counts.values()) for i in range(5)]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        d = [min(i - 0.1, max(0.1, i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5)) for i in (1, 2, 3)]
        total, left = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3) - 1]
        return {g: (c - d[min(c, 3) - 1]) / total[g[:-1]] for g, c in counts.items()}, {h: x / total[h] for h, x in left.items()}

    (s3, l3), (s2, l2), (s1, l1) = map(level, (three, two, one))

    def p(g):
        low = s1.get(g[2:], 0) + l1[()] / (len(one) + 1)
        mid = s2.get(g[1:], 0) + l2.get(g[1:2], 1) * low
        return s3.get(g, 0) + l3.get(g[:2], 1) * mid

    def score(t):
        w = ["<s>", "<s>", *cut(t)]
        return len(w) - 2, sum(math.log10(p(g)) for g in zip(w, w[1:], w[2:]))

    return score


def test_quality_perplexity_and_thresholds_by_brute_force(spark, docs):
    rows = [r for r in docs.collect() if r.doc_id is not None]
    of = {}
    for lang in ("en", "de"):
        of[lang] = kneser_ney_by_brute_force([r.text for r in rows if r.doc_id < 120 and r.lang == lang])
    trusted = docs.where("doc_id < 120").select("lang", "text")
    got = q.scored(docs.where("lang in ('en', 'de') and doc_id is not null"), q.train(trusted), {"en", "de"}, ("doc_id", "lang"))
    want = Counter((r.doc_id, *(round(x, 2) for x in of[r.lang](r.text))) for r in rows if r.lang in of)
    assert Counter((r.doc_id, r.n_tokens, round(r.logp, 2)) for r in got.collect()) == want
    labels = spark.createDataFrame([(i, 1, 0) for i in range(160)], "doc_id long, quality int, toxic int")
    out = q.judged(docs, labels, quantile=0.5, slack=1.0).collect()
    dice = {r.doc_id: r.d for r in docs.selectExpr("doc_id", f"pmod(xxhash64(string(doc_id), 7), {1 << 20}) / {float(1 << 20)} as d").collect()}
    for lang in ("en", "de"):
        other = sorted(r.log10_perplexity for r in out if r.lang == lang and r.n_tokens and r.doc_id is not None and r.doc_id < 160 and dice[r.doc_id] >= 0.5)
        assert {r.threshold for r in out if r.lang == lang} == {other[math.ceil(len(other) / 2) - 1]}
        assert all(r.accepted == (r.n_tokens > 0 and r.log10_perplexity <= r.threshold) for r in out if r.lang == lang)


def test_quality_trusts_no_toxic_text(spark, monkeypatch):
    rows = [(i, "vile words here" if i % 2 else "fair words here", "en") for i in range(80)]
    seen = []
    monkeypatch.setattr(q, "fitted", lambda t, fit=q.fitted: seen.extend(r.text for r in t.collect()) or fit(t))
    labels = [(i, 1, i % 2) for i in range(80)] + [(0, 1, None), (2, 0, 1), (2, 1, 0)]
    q.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert seen and set(seen) == {"fair words here"}


def test_quality_fits_on_all_of_its_half_unless_told_otherwise(spark, monkeypatch):
    class Seen(Exception):
        pass

    def stop(trusted):
        raise Seen(trusted.count())

    big = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string")), 20_000).alias("text"))  # 7 MB
    labels = big.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    monkeypatch.setattr(q, "fitted", stop)
    counts = []
    for given in ({}, {"fit_mb": None}):
        with pytest.raises(Seen) as e:
            q.judged(big, labels, **given)
        counts.append(e.value.args[0])
    assert counts[0] == counts[1] > 20  # two MB hold about 17 of them


def test_quality_leaves_no_model_tables(spark, docs, tmp_path, monkeypatch):
    from siftgraph.llm import storage

    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 160, 2)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(storage, "shared_dir", lambda session: f"file://{tmp_path}")
    for local in (0, q.LOCAL):
        assert q.judged(docs, labels, local=local).count() == docs.count()
    assert {x.name.split("-")[0] for x in (tmp_path / "siftgraph").iterdir()} == {"chosen", "scores"}


def test_quality_in_passes_gives_the_same(spark, docs):
    trusted = docs.where("doc_id < 80").select("lang", "text")
    *levels, _ = q.fitted(trusted)
    langs = {r.lang for r in trusted.select("lang").distinct().collect()}
    told = [sorted((str(r.doc_id), r.n_tokens, round(r.logp, 9)) for r in q.scored_by_shuffle(docs, *levels, langs, ("doc_id", "lang"), shard=500, passes=n).collect()) for n in (1, 4)]
    assert told[0] == told[1] and len(told[0]) == docs.count()


def test_quality_sends_slices_not_documents(spark, docs, monkeypatch):
    """Rows between the stages are messages: fewer than documents, whatever the number of shards."""
    made = []

    def written(df, what, *more, keep=q.written):
        out = keep(df, what, *more)
        if what == "answers":
            made.append(out.count())
        return out

    monkeypatch.setattr(q, "written", written)
    many = docs.where("doc_id < 80").crossJoin(spark.range(30).select(F.col("id").alias("copy"))).withColumn("doc_id", F.col("doc_id") + 1000 * F.col("copy")).coalesce(1)
    trusted = docs.where("doc_id < 80").select("lang", "text")
    *levels, _ = q.fitted(trusted)
    langs = {r.lang for r in trusted.select("lang").distinct().collect()}
    got = q.scored_by_shuffle(many, *levels, langs, ("doc_id", "lang"), shard=1500, passes=1).collect()
    assert len(made) == 1 and made[0] < many.count() == len(got)
    want = {r.doc_id: round(r.logp, 6) for r in q.scored(many, q.gathered(*levels), langs, ("doc_id", "lang")).collect()}
    assert {r.doc_id: round(r.logp, 6) for r in got} == want


def test_quality_equal_rows_and_slices_count_once(spark, docs):
    one = docs.where("doc_id in (3, 12) or doc_id is null").coalesce(1)
    twice = one.unionByName(one).unionByName(one)
    *levels, _ = q.fitted(docs.where("doc_id < 80").select("lang", "text"))
    told = [sorted((str(r.doc_id), r.n_tokens, round(r.logp, 9)) for r in q.scored_by_shuffle(x, *levels, {"en", "de"}, ("doc_id", "lang"), shard=20).collect()) for x in (one, twice)]
    assert told[1] == sorted(told[0] * 3)


def test_quality_merges_grams_of_many_words_alike():
    r = np.random.default_rng(1)
    held = []
    for _ in range(3):
        words = np.unique(r.integers(1, 60, 40)).astype(np.uint64)
        held.append((words, words % np.uint64(2), np.full(len(words), np.nan), *(r.integers(0, len(words), 500) for _ in range(3)), r.integers(1, 3, 500)))
    for x, y in zip(q._merged(held), q._merged(held, most=0)):
        assert np.array_equal(x, y, equal_nan=x.dtype == float)
    count = Counter()
    for k, _, _, u, v, w, n in held:
        for a, b, c, m in zip(k[u], k[v], k[w], n):
            count[a, b, c] += m
    k, _, _, u, v, w, n = q._merged(held)
    assert {(k[a], k[b], k[c]): m for a, b, c, m in zip(u, v, w, n)} == count


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    import glob
    import os
    import time

    from siftgraph.llm.storage import written

    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    held = lambda: {f for d in local for f in glob.glob(os.path.join(d, "*", "shuffle_*.data"))}
    before = held()
    written(spark.range(1000).groupBy("id").count(), "counted")
    end = time.time() + 10
    while held() - before and time.time() < end:
        time.sleep(0.2)
    assert not held() - before


def test_quality_messages_come_in_small_batches():
    rng = np.random.default_rng(5)
    words, n = np.unique(rng.integers(1, 2**63, 400_000).astype(text.U64)), 400_000
    u, v, w = rng.integers(0, len(words), (3, n)).astype(np.int32)
    sent = list(q._gram_messages([words, words, np.full(len(words), np.nan), u, v, w, np.ones(n, dtype=np.uint8)], 40))
    assert sum(b.nbytes for b in sent) > 4 << 20
    assert max(b.nbytes for b in sent) < 2 << 20
    got = [q._opened(b["size"][i].as_py(), b["blob"][i].as_py()) for b in sent for i in range(b.num_rows)]
    assert sum(len(m[-1]) for m in got) == n


def test_a_worker_keeps_no_memory_of_a_done_task():
    def resident():
        with open("/proc/self/status") as f:
            return next(int(x.split()[1]) / 1024 for x in f if x.startswith("RssAnon"))

    kept = []

    def work(batches):
        held = [np.ones(8_000) for _ in range(4_000)]  # 256 MB
        kept.append(np.ones(100))
        yield from batches
        del held

    before = resident()
    assert list(text.freeing(work)([1, 2])) == [1, 2]
    assert resident() < before + 60
