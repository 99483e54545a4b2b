import json
from datetime import datetime

from pyspark.sql import functions as F

from siftgraph.plans import preflight as pf
from siftgraph.sources import captures as c
from siftgraph.sources import exports as x
from siftgraph.streaming import state


def test_registration(spark):
    card = [["version", {}, "text", "4.0"], ["fn", {}, "text", "Ann  Owner"], ["org", {}, "text", "REDACTED FOR PRIVACY"], ["email", {}, "uri", "a@a.com"]]
    payload = json.dumps({"entities": [{"roles": ["registrar"], "vcardArray": ["vcard", []]}, {"roles": ["registrant"], "vcardArray": ["vcard", card]}], "events": [{"eventAction": "registration", "eventDate": "2001"}, {"eventAction": "registration", "eventDate": "2002"}], "nameservers": [{"ldhName": "NS1.A.com."}]})
    got = c.registration_records(spark.createDataFrame([("a.com", payload), ("b.com", "broken")], "domain string, payload string")).orderBy("domain").collect()
    assert (got[0].registrant_name, got[0].registrant_org, got[0].registrant_email, got[0].creation_date, got[0].nameservers) == ("Ann Owner", "", "a@a.com", "2001", ["ns1.a.com"])
    assert got[1].registrant_name == "" and got[1].nameservers == []


def test_cascade_and_merge(spark):
    s = "domain string, priority int, registrant_name string, registrant_org string, registrant_email string, registrant_phone string, nameservers array<string>"
    a = spark.createDataFrame([("a", 1, "", "", "", "", ["n1"]), ("a", 2, "", "Org", None, "", ["n2"]), ("a", 3, "Late", "Late", "", "", ["n3"])], s)
    r = c.registration_cascade(a).first()
    assert (r.registrant_name, r.registrant_org, r.nameservers) == ("", "Org", ["n1", "n2"])
    m = c.merged_registration(a.where("priority = 1").drop("priority"), a.where("priority = 3").drop("priority")).first()
    assert m.registrant_org == "Late" and m.nameservers == ["n1", "n3"]


def test_listings(spark):
    t = spark.createDataFrame([("a.com", "*.a.com\nWWW.a.com\nmail.a.com\nx.b.com\nwww.a.com")], "domain string, payload string")
    assert [r.host for r in c.listed_hosts(t, 5).orderBy("place").collect()] == ["www.a.com", "mail.a.com"]
    j = "\n".join(json.dumps(d) for d in [{"host": "x.a.com", "source": "s2"}, {"host": "X.a.com", "source": "s1"}, {"host": "a.com"}, {"host": "nota.com"}])
    assert [(r.host, r.sources) for r in c.found_hosts(spark.createDataFrame([("a.com", j)], t.schema), 5).collect()] == [("x.a.com", ["s1", "s2"])]
    hits = spark.createDataFrame([("i", 1, "see www.google.com and b.org"), ("i", 0, "a.net index.html B.org")], "identifier string, ord int, text string")
    assert [r.domain for r in c.search_hits(hits, 5).orderBy("place").collect()] == ["a.net", "b.org"]
    svc = c.service_for(spark.createDataFrame([("x.co.uk",)], "domain string"), spark.createDataFrame([("uk", "1"), ("co.uk", "2")], "suffix string, base string"))
    assert svc.first().base == "2"


def test_archive_filings_names(spark):
    head = ["timestamp", "original", "statuscode", "mimetype", "digest"]
    rows = [[f"2020010{i}000000", "u", "200" if i != 3 else "404", "text/html", f"d{i}"] for i in range(1, 8)]
    a = c.archive_rows(spark.createDataFrame([("a.com", json.dumps([head, *rows]))], "domain string, payload string"))
    assert a.count() == 6 and sorted(r.digest for r in c.snapshots(a, 3).collect()) == ["d1", "d2", "d7"]
    f = {"filings": {"recent": {"form": ["8-K", "10-K", "8-K/A"], "items": ["2.01,9.01", "2.01", "1.01"], "filingDate": ["a", "b", "c"], "accessionNumber": ["1", "2", "3"], "primaryDocument": ["a.htm", "b.htm", "c.htm"]}}}
    assert [r.accessionNumber for r in c.filings(spark.createDataFrame([("7", json.dumps(f))], "cik string, payload string")).collect()] == ["1"]
    reg = spark.createDataFrame([("1", True, ["Acme, Inc."]), ("2", True, ["Twin"]), ("3", True, ["TWIN"]), ("4", False, ["Gone"])], "id string, active boolean, names array<string>")
    assert [tuple(r) for r in c.exact_names(spark.createDataFrame([("acme inc",), ("twin",), ("gone",)], "name string"), reg).collect()] == [("acme inc", "1")]


def test_filings_are_cut_before_they_are_filtered(spark):
    """Only the first 25 filings are looked at: a purchase told in the 26th isn't found."""
    n = 30
    cols = {"form": ["8-K" if i in (24, 25) else "10-Q" for i in range(n)], "items": ["2.01"] * n, "filingDate": ["d"] * n, "accessionNumber": [str(i) for i in range(n)], "primaryDocument": ["p"] * n}
    t = spark.createDataFrame([("7", json.dumps({"filings": {"recent": cols}})), ("8", None)], "cik string, payload string")
    assert [r.accessionNumber for r in c.filings(t).collect()] == ["24"]


def test_backup(spark, tmp_path):
    import pytest

    t = spark.range(5).toDF("id")
    x.backup({"t": t, "twice": t.union(t)}, str(tmp_path / "b"))
    assert x.restored(spark, str(tmp_path / "b"), {"t": ["id"]})["t"].count() == 5
    with pytest.raises(ValueError):
        x.restored(spark, str(tmp_path / "b"), {"twice": ["id"]})
    with pytest.raises(Exception):
        x.backup({"t": t}, str(tmp_path / "b"))


def test_exports(spark, tmp_path):
    o = spark.createDataFrame([("none", "v"), ("derived_only", "v"), ("normalized", "v")], "export_scope string, object_value_norm string")
    kept, counts = x.exportable(o)
    assert [(r[0], r[1]) for r in kept.collect()] == [("normalized", "v")] and tuple(counts.first()) == (1, 1)
    e = spark.createDataFrame([(1, "s", "none", "v"), (1, "s", "derived_only", "v"), (1, "s", None, "v")], "claim_id int, source string, export_scope string, object string")
    assert sorted(map(str, (tuple(r) for r in x.exportable_evidence(e).collect()))) == ["(1, 's', 'derived_only', None)", "(1, 's', None, 'v')"]
    t = spark.createDataFrame([(" mail a\x00b \n", ["x"] * 300 + ["y"]), ("\x01", ["", "z"])], "t string, l array<string>")
    assert [tuple(r) for r in t.select(x.egress_text(F.col("t")), F.size(x.egress_list(F.col("l")))).collect()] == [("mail ab", 250), (None, 1)]
    (tmp_path / "g.json").write_text(json.dumps({"run": {"id": "r", "root_domain": "a"}, "nodes": [{"id": "1", "node_type": "identifier", "value_norm": "v", "metadata_json": '{"identifier_type": "org"}'}], "edges": []}))
    assert x.graphs(spark, str(tmp_path / "g.json"))[0].first().identifier_type == "org"
    assert x.ascii_tree([("a", "r", "b"), ("b", "r", "a")], "a") == "a\n  r: b\n    r: a (seen)"


def test_preflight(spark):
    s = spark.createDataFrame([("w1", "whois", "free", False, True, 3, 0), ("w2", "whois", "free", False, True, 2, 1), ("b", "basic_info", "free", False, True, 2, 2), ("r", "reverse_whois", "free", False, True, 1, 3), ("x", "reverse_whois", "paid", True, True, 1, 4), ("d", "dns", "free", False, False, 1, 5)], pf.SOURCES)
    k = pf.Settings()
    assert {r.name: r.state for r in pf.status(s, k).collect()} == {"w1": "selected", "w2": "selected", "b": "selected", "r": "selected", "x": "policy_excluded", "d": "unavailable"}
    plan = {r.step: (r.sources, r.calls) for r in pf.steps(s, k).collect()}
    assert plan == {"whois": (["w1", "w2"], 2), "basic_info": (["b"], 1), "reverse_whois": (["r"], 5), "tracker_verification": (["b"], 50)}
    assert pf.totals(pf.steps(s, k), k).first().calls == 58 * 500
    assert {r.name: r.state for r in pf.status(s, pf.Settings(profile="byok")).collect()}["x"] == "approval_gated"
    assert {r.step: r.sources for r in pf.steps(s, pf.Settings(profile="byok", paid_approved=True)).collect()}["reverse_whois"] == ["x"]


def test_streams_equal_batch(spark, tmp_path):
    from siftgraph.operators import usage as us

    rows = [("p", i, "error" if i % 4 else "success", datetime(2024, 1, 1, 0, i // 2, i % 60)) for i in range(40)]
    df = spark.createDataFrame(rows, "provider string, id int, status string, started_at timestamp").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, got, want in (("rates", state.rate_windows(stream), us.rate_windows(df)), ("circuits", state.circuit_openings(stream), us.circuits(df))):
        q = got.writeStream.outputMode("complete" if name == "rates" else "append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c{name}")).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, want.collect())) != []


def test_registry_settings_and_reports(spark, tmp_path):
    import pytest

    from siftgraph.plans.settings import resolve
    from siftgraph.sources import registry as rg

    t = rg.sources(spark, ("crtsh",))
    assert [r.name for r in rg.usable(t, "subdomains").collect()] == ["subfinder", "hackertarget"]
    assert [r.name for r in rg.usable(t, "reverse_whois").collect()] == ["whoxy", "duckduckgo"] and rg.usable(t, "dns", "none").count() == 0
    o = rg.with_policy(spark.createDataFrame([("whoxy",), ("crtsh",)], "source string"), spark.createDataFrame([("whoxy", False, "none", "none")], "source string, cache_allowed boolean, export_scope string, raw_retention string"))
    assert sorted(tuple(r) for r in o.collect()) == [("crtsh", True, "normalized", "hash_only"), ("whoxy", False, "none", "none")]
    calls = spark.createDataFrame([("crtsh", 1, 7), ("crtsh", 2, 7)], "provider string, attempts int, upstream_requests int")
    assert rg.over_limits(calls, t).count() == 1
    s = resolve("max", env={"SIFTGRAPH_NODE_CAP": "7", "SIFTGRAPH_PAID_APPROVED": "true"}, pivot_top_k=1)
    assert (s.node_cap, s.pivot_top_k, s.paid_approved, s.queue_cap) == (7, 1, True, 300)
    with pytest.raises(ValueError):
        resolve("odd", env={})
    nodes = spark.createDataFrame([("r", "1", "domain", "a"), ("r", "2", "domain", "b"), ("r", "3", "ip", "c")], "run_id string, node_id string, node_type string, value_norm string")
    lineage = spark.createDataFrame([("r", "2", 3), ("r", "2", 1)], "run_id string, child_node_id string, depth int")
    assert sorted(tuple(r)[1:] for r in x.discovered_domains(nodes, lineage).collect()) == [("a", 0), ("b", 1)]
    edges = spark.createDataFrame([("r", "1", "links", "2")], "run_id string, from_node_id string, relation_type string, to_node_id string")
    report = x.markdown_report({"id": "r", "root_domain": "a", "status": "completed"}, {"Domains": 2}, [], [], [])
    x.write_bundle(spark, str(tmp_path / "b"), report, x.ascii_tree([("a", "links", "b")], "a"), x.graph_json(nodes, edges))
    assert json.loads(spark.read.text(str(tmp_path / "b/graph")).first()[0])["run_id"] == "r"
    assert x.duplicate_keys(nodes, ["run_id"]).count() == 1 and x.orphans(edges, nodes, "to_node_id", "node_id").count() == 0
