import json

import pytest
from pyspark.sql import functions as F

from siftgraph.sources import backups, scans
from siftgraph.sources.manifest import Conflict, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def nodes(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def test_tables_of_a_wave_appear_together(spark, store):
    assert store.versions() == [] and store.tables() == []
    assert store.commit({"nodes": nodes(spark, 1, 2), "edges": nodes(spark, 7)}, "a") == 1
    assert store.commit({"nodes": nodes(spark, 3)}, "b") == 2
    assert ids(store.read("nodes")) == [1, 2, 3] and ids(store.read("edges")) == [7]
    assert ids(store.read("nodes", 1)) == [1, 2]
    assert store.commit({"nodes": nodes(spark, 4)}, "a") == 3  # the wave again, otherwise
    assert ids(store.read("nodes")) == [3, 4] and ids(store.read("edges")) == [] and ids(store.read("nodes", 2)) == [1, 2, 3]
    with pytest.raises(KeyError):
        store.read("none")


def test_a_failed_wave_leaves_no_trace(spark, store, tmp_path):
    store.commit({"nodes": nodes(spark, 1), "edges": nodes(spark, 5)}, "a")
    before = {p.relative_to(tmp_path) for p in tmp_path.rglob("*.parquet")}
    broken = nodes(spark, 6).select(F.when(F.col("id") > 0, F.raise_error(F.lit("lost"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"nodes": nodes(spark, 2), "edges": broken}, "b")
    assert store.versions() == [1] and ids(store.read("nodes")) == [1]
    assert {p.relative_to(tmp_path) for p in tmp_path.rglob("*.parquet")} == before
    with pytest.raises(ValueError):
        store.commit({"nodes": spark.createDataFrame([("x",)], "id string")}, "c")
    assert store.versions() == [1]


def test_two_writers_take_two_versions(spark, store):
    other = Store(spark, store.path)
    store.commit({"nodes": nodes(spark, 1)}, "a")
    publish = store._publish

    def late(manifest):
        if len(store.versions()) == 1:
            other.commit({"nodes": nodes(spark, 2)}, "b")  # between this one's look and its writing
        return publish(manifest)

    store._publish = late
    assert store.commit({"nodes": nodes(spark, 3)}, "c") == 3
    assert ids(store.read("nodes")) == [1, 2, 3]
    store._publish = lambda m: False
    with pytest.raises(Conflict):
        store.commit({"nodes": nodes(spark, 4)}, "d", tries=2)


def test_compact_and_sweep(spark, store):
    for k in range(3):
        store.commit({"nodes": nodes(spark, k), "edges": nodes(spark, 10 + k)}, f"w{k}")
    v = store.compact("nodes")
    folders = [f for w in store.manifest()["waves"] for f in w["tables"].get("nodes", ())]
    assert len(folders) == 1 and ids(store.read("nodes")) == [0, 1, 2] and ids(store.read("nodes", 2)) == [0, 1]
    assert len(store.sweep()) == 3 and store.versions() == [v]
    assert ids(store.read("nodes")) == [0, 1, 2] and ids(store.read("edges")) == [10, 11, 12]


def family(spark):
    parents = spark.createDataFrame([(k, f"p é{k}", 0.1 * k) for k in range(5)], "id long, name string, score double")
    children = spark.createDataFrame([(k, k % 5, None) for k in range(20)], "id long, parent long, note string")
    return {"parents": parents, "children": children}


KEYS, REFERENCES = {"parents": ["id"], "children": ["id"]}, [("children", "parent", "parents", "id")]


def test_a_whole_backup_is_restored_at_once(spark, store, tmp_path):
    at = f"file://{tmp_path}/backup"
    store.commit({"parents": family(spark)["parents"].limit(1), "other": nodes(spark, 1)}, "old")
    backups.backup(family(spark), at, KEYS, REFERENCES)
    assert backups.problems(spark, at).count() == 0
    v = backups.restore(store, at, "back")
    assert sorted(map(tuple, store.read("parents", v).collect())) == sorted(map(tuple, family(spark)["parents"].collect()))
    assert store.read("children").count() == 20 and ids(store.read("other")) == [1] and store.read("parents", 1).count() == 1
    with pytest.raises(FileExistsError):
        backups.backup(family(spark), at)
    with pytest.raises(ValueError):
        backups.problems(spark, f"file://{tmp_path}/none")


@pytest.mark.parametrize(
    ("change", "told"),
    [
        (lambda t: {"parents": t["parents"].withColumn("score", F.when(F.col("id") == 3, 0.30000000000000004 + 1e-16).otherwise(F.col("score")))}, None),
        (lambda t: {"parents": t["parents"].withColumn("name", F.when(F.col("id") == 3, "p").otherwise(F.col("name")))}, {("parents", "contents")}),
        (lambda t: {"children": t["children"].withColumn("parent", F.when(F.col("id") == 3, 99).otherwise(F.col("parent")))}, {("children", "contents"), ("children.parent", "no parents.id")}),
        (lambda t: {"children": t["children"].union(t["children"].where("id = 3"))}, {("children", "rows"), ("children", "contents"), ("children", "repeated keys")}),
        (lambda t: {"parents": t["parents"].where("id <> 3")}, {("parents", "rows"), ("parents", "contents"), ("children.parent", "no parents.id")}),
        (lambda t: {"children": t["children"].orderBy(F.desc("id"))}, set()),
    ],
)
def test_an_altered_backup_is_refused(spark, store, tmp_path, change, told):
    at = f"file://{tmp_path}/backup"
    backups.backup(family(spark), at, KEYS, REFERENCES)
    for name, rows in change(family(spark)).items():
        rows.write.mode("overwrite").parquet(f"{at}/{name}")
    if told is None:
        told = set() if 0.1 * 3 == 0.30000000000000004 + 1e-16 else {("parents", "contents")}
    assert {(x["part"], x["problem"]) for x in backups.problems(spark, at).collect()} == told
    if told:
        with pytest.raises(ValueError, match="refused.*contents"):
            backups.restore(store, at, "back")
        assert store.versions() == []


def test_bad_graphs_are_set_aside(spark, tmp_path):
    good = {"run": {"id": "r1", "root_domain": "a.com"}, "nodes": [{"id": "n1", "node_type": "domain", "value_norm": "a.com", "metadata_json": "{}"}, "text", None, {"id": "n2", "node_type": " "}, {"id": ["n3"], "node_type": "x", "value_norm": "y"}], "edges": [{"from_node_id": "n1", "to_node_id": "n2", "relation_type": "r", "confidence": 0.5}, 7, {"from_node_id": "n1", "to_node_id": "n2", "relation_type": "r", "depth": "deep"}]}
    for name, text in {"a": json.dumps(good, indent=1), "b": "[1]", "c": json.dumps(good)[:-3], "d": json.dumps({"nodes": []}), "e": "", "f": json.dumps({"run": {"id": "r2"}})}.items():
        (tmp_path / f"{name}.json").write_text(text)
    n, e, bad = scans.graphs(spark, f"file://{tmp_path}")
    assert [(x["run_id"], x["node_id"], x["value_norm"], x["file"][-6:]) for x in n.collect()][0] == ("r1", "n1", "a.com", "a.json")
    assert [(x["from_node_id"], x["confidence"]) for x in e.collect()] == [("n1", 0.5)]
    told = {(x["file"][-6:], x["part"], x["place"]): x["reason"] for x in bad.collect()}
    assert {k: v for k, v in told.items() if k[0] != "a.json"} == {("b.json", "graph", None): "not a graph", ("c.json", "graph", None): "not a graph", ("d.json", "graph", None): "no run"}
    assert {k[1:]: v for k, v in told.items() if k[0] == "a.json"}.items() >= {("nodes", 1): "not an object", ("nodes", 2): "not an object", ("nodes", 3): "no node_type", ("edges", 1): "not an object", ("edges", 2): "not an object"}.items()
    assert n.count() + bad.where("part = 'nodes'").count() == 5


def test_bad_cases_are_set_aside(spark, tmp_path):
    label = {"domain": "b.com", "classification": "positive", "relationship": "owner", "source_refs": ["s"]}
    case = {"schema_version": 1, "case_id": "c1", "root_domain": "a.com", "labels": [label]}
    lines = [json.dumps(case), json.dumps(case | {"case_id": "c2", "schema_version": 2}), "nothing", json.dumps(case | {"case_id": "c3", "labels": "none"}), "", json.dumps(case | {"case_id": None})]
    (tmp_path / "cases.json").write_text("\n".join(lines))
    good, bad = scans.cases(spark, f"file://{tmp_path}", lines=True)
    assert [x["case_id"] for x in good.collect()] == ["c1"]
    assert sorted((x["key"] or "", x["problem"]) for x in bad.collect()) == [("", "case_id"), ("", "not a case"), ("", "not a case"), ("c2", "version")]
    assert all(x["file"].endswith("cases.json") for x in bad.collect())


def test_problems_read_a_table_once_for_rows_and_contents(spark, tmp_path, capsys):
    at = f"file://{tmp_path}/backup"
    backups.backup({"nodes": nodes(spark, 3)}, at)
    backups.problems(spark, at).explain()
    assert capsys.readouterr().out.count("FileScan parquet") == 1
