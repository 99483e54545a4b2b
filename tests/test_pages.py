from pyspark.sql import functions as F

from siftgraph.functions import pages as pg
from siftgraph.plans import driver, hashes, payloads


def page_dir(spark, tmp_path):
    rows = [(1, "https://a.com/", "<title>x &amp; y &eacute;&#39;s &lt b &amp</title>"), (2, "https://b.com/", "<title>&amp;lt; &nosuch; &notit;</title>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    return f"{tmp_path}"


WANT = {1: "x & y é's &lt b &amp", 2: "&lt; &nosuch; &notit;"}


def test_page_titles_keep_open_references(spark, tmp_path):
    got = driver.QUERIES["page_titles"](spark, page_dir(spark, tmp_path)).collect()
    assert {r.page_id: r.title for r in got} == WANT
    first = spark.createDataFrame([("<title>a &lt b &amp</title>",)], "h string").select(pg.title(F.col("h"))).first()[0]
    assert first == "a < b &"  # the operator resolves what a browser does


def test_page_observations_keep_open_references(spark, tmp_path):
    got = driver.QUERIES["page_observations"](spark, page_dir(spark, tmp_path)).collect()
    assert {r.object_value_norm for r in got} == set(WANT.values())


def test_hashed_observations_keep_open_references(spark, tmp_path):
    got = hashes.QUERIES["hashed_observations"](spark, page_dir(spark, tmp_path)).collect()
    assert [r.normalized for r in got if r.page_id == 1] == ['{"capability":"page","value":"x & y \\u00e9\'s &lt b &amp"}']


def part_dir(spark, tmp_path):
    rows = [(1234567, "blue anvil", "Brand#1")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return f"{tmp_path}"


def test_page_records_of_large_keys(spark, tmp_path):
    got = payloads.QUERIES["page_records"](spark, part_dir(spark, tmp_path)).first()
    assert got.tracker_ids == ["GTM-ABCD1234567", "UA-1244567-1"]
    cut = spark.createDataFrame([("GTM-ABCD1234567",)], "h string").select(pg.trackers(F.col("h"))).first()[0]
    assert cut == ["GTM-ABCD123456"]  # the operator's own bound


def test_page_pivots_of_large_keys(spark, tmp_path):
    got = payloads.QUERIES["page_pivots"](spark, part_dir(spark, tmp_path)).collect()
    assert {r.value for r in got if r.id_type == "tracker"} == {"GTM-ABCD1234567", "UA-1244567-1"}
