import corpus_pipeline as cp

from siftgraph.llm.storage import written


def test_stages_on_a_small_table(spark, tmp_path):
    import random

    r = random.Random(4)
    words = [f"w{i}" for i in range(80)]
    make = lambda n: " ".join(r.choices(words, weights=[1 / (i + 1) for i in range(80)], k=n))
    texts = [make(60) for _ in range(60)]
    bench = " ".join(f"q{i}" for i in range(20))
    texts += [texts[0], texts[1] + " w5", make(40) + " " + " ".join(bench.split()[3:16]), make(30) + " mail a.b@c.org", " ".join("%" + w + "##" for w in make(60).split()), "", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        left[name] = {x.doc_id: x for x in docs.collect()}
        if name != cp.STAGES[-1][0]:
            assert docs.columns == list(cp.COLUMNS)
    assert [n for n, _ in cp.STAGES] == list(left) and len(left) == 5
    assert 64 not in left["quality"] and 65 not in left["quality"] and len(left["quality"]) >= 60
    assert 60 in left["quality"] and 60 not in left["near_duplicates"] and 61 not in left["near_duplicates"] and 0 in left["near_duplicates"]
    assert 62 in left["near_duplicates"] and 62 not in left["decontamination"]
    assert left["personal_data"][63].text.endswith(" mail [EMAIL]") and left["personal_data"][63].n_chars == len(left["personal_data"][63].text)
    assert set(left["byte_bpe"]) == set(left["personal_data"])
    assert {x.doc_id for x in cp.run(spark, str(tmp_path)).collect()} == set(left["byte_bpe"])


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    """No rows; null ids, languages and texts; repeated rows; further columns named like results."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words int, class_id string, spans string, accepted int"
    rows = [(None, "one two three four five six", None, None, None), (None, None, None, None, None), (1, "x " * 60_000, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "seven eight nine", "en", "s", 0), (3, "seven eight nine", "en", "s", 0)]
    labels = "doc_id long, quality int, toxic int, lang string, text int"
    for name, own in (("empty", []), ("odd", rows)):
        place = tmp_path / name
        spark.createDataFrame([(*r, 1, "c", "s", 0) for r in own], schema).write.parquet(str(place / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0, "x", 1), (None, 1, None, "x", 1), (3, None, None, "x", 1)] if own else [], labels).write.parquet(str(place / "labels.parquet"))
        spark.createDataFrame([(None, None), (1, "")] if own else [], "item_id long, text string").write.parquet(str(place / "benchmark.parquet"))
        got = cp.run(spark, str(place)).collect()
        assert len(got) == (0 if not own else len({r.doc_id for r in got})) and {r.doc_id for r in got} <= {None, 1, 3}
