import json

from pyspark.sql import functions as F

from siftgraph.operators import extract as ex
from siftgraph.operators import models as mo


def test_registration_pivots(spark):
    raw = json.dumps({"a": "Registrant Organization: Acme  Inc\nName Server: ns1.acme.com\nName Server: x.cloudflare.com\nCreated: 2020-01-01", "b": ["mail a@acme.com", None, "abuse@acme.com"]})
    r = spark.createDataFrame([("acme.com", raw, "", "", "Boss@acme.com", "+1.2025550100", ["ns9.acme.com"])], "domain string, raw string, registrant_name string, registrant_org string, registrant_email string, registrant_phone string, nameservers array<string>")
    got = [(x.id_type, x.value, x.score) for x in ex.registration_pivots(r).orderBy("ord").collect()]
    assert got[:4] == [("email", "boss@acme.com", 0.80), ("email", "a@acme.com", 0.80), ("phone", "+12025550100", 0.60), ("ns", "ns1.acme.com", 0.65)]
    assert ("org", "acme inc", 0.75) in got and ("name", "ns1.acme.com", 0.65) in got
    assert not any(k == "ns" and "cloudflare" in v for k, v, _ in got)


def test_page_pivots(spark):
    p = spark.createDataFrame([("a.com", ["Acme"], "Acme  LLC", ["Acme Holdings, Inc"], ["ua-123456-1"])], "domain string, aliases array<string>, copyright_org string, legal_entities array<string>, tracker_ids array<string>")
    assert [(x.id_type, x.value, x.score) for x in ex.page_pivots(p).orderBy("ord").collect()] == [("org", "Acme", 0.45), ("org", "acme llc", 0.70), ("org", "acme holdings, inc", 0.85), ("tracker", "UA-123456-1", 0.92)]


def test_purchases(spark):
    t = "Intro. On May 1 the Company completed the acquisition of Foo Bar, Inc. for cash. The company agreed to acquire all of Baz LLC. Later it completed the Acquisition described in Item 1.01. End."
    rows = spark.createDataFrame([(t,), ("The company may acquire Foo Inc. soon.",), (None,)], "t string").select(ex.completed_purchases("t").alias("p")).collect()
    assert [x.target for x in rows[0].p] == ["Foo Bar, Inc", "Baz LLC"] and rows[1].p == rows[2].p == []
    assert rows[0].p[0].support.startswith("On May 1") and rows[0].p[1].support.startswith("The company agreed to acquire all of Baz LLC.")


def test_support_is_a_window_of_the_sentence():
    pad = "x" * 300
    (name, support), = ex.purchases(f"Intro. {pad} the Company completed the acquisition of Foo Bar, Inc. for cash and notes. More.")
    assert name == "Foo Bar, Inc" and support == f"{'x' * 167} the Company completed the acquisition of Foo Bar, Inc. for cash and notes."
    (_, support), = ex.purchases(f"The Company acquired Foo LLC for {pad}")
    assert support == f"The Company acquired Foo LLC for {'x' * 175}"
    text = f"{pad} We agreed to acquire Baz LLC for shares. Then it completed the Acquisition described in Item 1.01 in May. End."
    (_, support), = ex.purchases(text)
    assert support == f"{'x' * 119} We agreed to acquire Baz LLC for shares. completed the Acquisition described in Item 1.01 in May."


def test_model_outputs(spark):
    good = {"abstain": False, "abstention_reason": None, "pivots": [{"id_type": "org", "value": "x", "score": 0.8, "reason": "r"}]}
    bad = [good | {"extra": 1}, good | {"abstain": True}, good | {"pivots": []}, good | {"pivots": [good["pivots"][0] | {"score": 2}]}, good | {"pivots": [good["pivots"][0] | {"id_type": "zip"}]}, good | {"abstain": "false"}, "no json"]
    abstain = {"abstain": True, "abstention_reason": "none", "pivots": []}
    rows = [("good", json.dumps(good)), ("abstain", json.dumps(abstain)), *[(f"bad{i}", x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(bad)]]
    out = mo.validated(spark.createDataFrame(rows, "domain string, content string"))
    got = {r.domain: r.disposition for r in out.collect()}
    assert got == {"good": "accepted", "abstain": "abstained"} | {f"bad{i}": "invalid" for i in range(len(bad))}
    assert {r.domain: r.route for r in mo.routed(out.where("domain <> 'x'"), out).collect()} == {"good": "fast"}


def test_cost_and_context(spark):
    x = spark.createDataFrame([("gpt-5-mini", 3, 1), ("none", 1, 1)], "m string, i int, o int").select(mo.micro_dollars(F.col("m"), F.col("i"), F.col("o"))).collect()
    assert [r[0] for r in x] == [3, None]
    c = {"domain": "a", "subdomains": [f"h{i}.example.com" for i in range(100)]}
    cut = json.loads(spark.createDataFrame([(json.dumps(c),)], "c string").select(mo.trimmed(F.col("c"), 800)).first()[0])
    assert len(cut["subdomains"]) == 40 and cut["subdomains_truncated"] == 60
