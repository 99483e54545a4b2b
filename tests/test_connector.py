import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from siftgraph.sources import captures
from siftgraph.sources import connector as c


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("captured")
    rows = [(["rdap", "crt sh"][k % 2], date(2024, 1, 1 + k % 4), f"d{k}.com", datetime(2024, 1, 1 + k % 4, 1, 2, 3, k), json.dumps({"events": [], "n": k, "t": 'é"\n'})) for k in range(40)]
    c.write(spark.createDataFrame(rows, "source string, day date, domain string, captured_at timestamp, payload string"), f"file://{place}")
    return place, rows


def test_reads_what_was_written(spark, folder):
    place, rows = folder
    got = c.read(spark, f"file://{place}").where("problem is null").select("source", "day", "domain", "captured_at", "payload").collect()
    assert sorted(map(tuple, got)) == sorted(rows)
    records = captures.registration_records(c.read(spark, f"file://{place}").where("source = 'rdap'"))
    assert records.count() == 20 and set(records.columns) >= {"domain", "nameservers"}


def test_filters_prune_folders(spark, folder):
    place, rows = folder
    df = c.read(spark, f"file://{place}")
    got = df.where((F.col("source") == "crt sh") & (F.col("day") > F.lit(date(2024, 1, 2))) & (F.col("domain") != "d3.com")).select("domain").collect()
    assert {x[0] for x in got} == {r[2] for r in rows if r[0] == "crt sh" and r[1] > date(2024, 1, 2)} - {"d3.com"}
    reader = c.CaptureReader({"path": f"file://{place}", "splitbytes": "1"})
    all_files = len(reader.partitions())
    left = list(reader.pushFilters([EqualTo(("source",), "rdap"), GreaterThan(("day",), date(2024, 1, 3)), EqualTo(("domain",), "d0.com"), In(("day",), (date(2024, 1, 4), None)), EqualTo(("day",), None)]))
    assert [f.attribute for f in left] == [("domain",), ("day",)]
    kept = [f for p in reader.partitions() for f in p.files]
    assert {(f.source, f.day) for f in kept} <= {("rdap", date(2024, 1, 4))} and len(kept) < all_files
    assert c.read(spark, f"file://{place}").where("source in ('none', 'nor this')").count() == 0
    assert c.CaptureReader({"path": f"file://{place}/absent"}).partitions() == []


def test_bad_lines_are_told(spark, tmp_path):
    at = tmp_path / "source=x" / "day=2024-05-06"
    at.mkdir(parents=True)
    lines = ["not json", "[1]", '{"payload": "a"}', '{"domain": "a.com", "payload": "' + "y" * 200 + '"}', '{"domain": "b.com", "captured_at": "soon"}', '{"domain": "c.com", "payload": {"k": [1, "é"]}}', "", '{"domain": "d.com", "payload": null}', '{"domain": "e.com", "payload": "' + "z" * 1_200_000 + '"}', '{"domain": "f.com"}']
    (at / "part-0.json").write_text("\n".join(lines))
    (at / "_SUCCESS").write_text("")
    got = {r["line"]: (r["domain"], r["payload"], r["problem"]) for r in c.read(spark, f"file://{tmp_path}", maxBytes=100).collect()}
    assert got == {
        0: (None, None, "not JSON"), 1: (None, None, "not an object"), 2: (None, None, "no domain"), 3: ("a.com", None, "payload too large"), 4: ("b.com", None, "captured_at isn't a time"),
        5: ("c.com", '{"k": [1, "é"]}', None), 7: ("d.com", None, None), 8: (None, None, "line too long"), 9: ("f.com", None, None),
    }


def test_long_lines_across_blocks():
    class Raw:
        def __init__(self, blocks):
            self.blocks = list(blocks)

        def read(self, _):
            return self.blocks.pop(0) if self.blocks else b""

    assert list(c._lines(Raw([b"ab\ncd", b"ef\n", b"g"]), 10)) == [b"ab", b"cdef", b"g"]
    assert list(c._lines(Raw([b"a" * 15, b"b" * 15, b"bb\nnext\n" + b"c" * 15]), 10)) == [b"a" * 11, b"next", b"c" * 11]


def test_stream_goes_on_from_its_offsets(spark, folder, tmp_path):
    _, rows = folder
    schema = "source string, day date, domain string, captured_at timestamp, payload string"
    place, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"

    def run():
        q = c.stream(spark, place).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/check").option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(x[0] for x in spark.read.schema(c.SCHEMA).parquet(out).select("domain").collect())

    c.write(spark.createDataFrame(rows[:25], schema), place)
    assert run() == sorted(r[2] for r in rows[:25])
    assert run() == sorted(r[2] for r in rows[:25])
    c.write(spark.createDataFrame(rows[25:], schema), place)
    assert run() == sorted(r[2] for r in rows)
