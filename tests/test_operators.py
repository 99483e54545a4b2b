import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from siftgraph.operators import evidence as ev
from siftgraph.operators import graph as gr
from siftgraph.operators import pivots as pv
from siftgraph.operators import quality as qu
from siftgraph.operators import usage as us


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_first_write_wins_and_replay_adds_nothing(spark):
    r = spark.createDataFrame([("domain_redirects_to", "domain", "a", "domain", "b", 0.9, "x", 2), ("domain_redirects_to", "domain", "a", "domain", "b", 0.3, "x", 1), ("domain_has_ip", "domain", "a", "ip", "1", 7.0, "x", 3)], "relation_type string, subject_type string, subject_value_norm string, object_type string, object_value_norm string, score double, source string, seq long")
    made = ev.claims(r)
    first = ev.append(made, ["claim_key"])
    assert rows(first, "claim_type", "score", "confidence_class", "status") == [("domain_has_ip", 1.0, "verified", "observed"), ("domain_redirects_to", 0.3, "candidate", "candidate")]
    assert ev.append(made, ["claim_key"], first).count() == 0


def test_observations_of_records_and_rules(spark):
    w = spark.createDataFrame([("a.com", "python-whois", "t1", "Ann", "", "a@a.com", None, None, "", ["ns1.a.com"]), ("b.com", "fallback", "t1", "", "Org", "", "", "", "", None)], "domain string, source string, observed_at string, registrant_name string, registrant_org string, registrant_email string, registrant_phone string, creation_date string, expiration_date string, nameservers array<string>")
    facts = ev.observations_from(w, "whois").withColumn("raw_hash", F.lit("h"))
    good, bad = ev.observations(facts)
    assert rows(good, "subject_value_norm", "predicate", "confidence") == [("a.com", "has_nameserver", 0.7), ("a.com", "has_registrant_email", 0.7), ("a.com", "registered_by_name", 0.7), ("b.com", "registered_by_org", 0.1)]
    assert bad.count() == 0 and ev.observations(facts.withColumn("confidence", F.lit(2.0)))[1].count() == 4


def test_families_and_value(spark):
    c = spark.createDataFrame([(1, "verified", "domain", "asset.example"), (2, "probable", "domain", "acquired.example"), (3, "verified", "domain", "unknown.example"), (4, "verified", "ip", "x")], "claim_id int, confidence_class string, object_type string, object_value_norm string")
    e = spark.createDataFrame([(1, "rdap-iana", "supports"), (1, "python-whois", "supports"), (2, "http-html", "supports"), (2, "sec-edgar", "supports"), (3, "mystery", "supports"), (4, "gleif", "contradicts")], "claim_id int, source string, polarity string")
    got = {r.source_family: r for r in ev.source_value(c, e).collect()}
    assert got["domain-registration-registry"].sole_family_verified_claims == 1 and got["domain-registration-registry"].sources == ["python-whois", "rdap-iana"]
    assert got["current-origin-web"].corroborated_claims == got["sec-regulatory-filings"].corroborated_claims == 1
    assert got["unclassified"].sole_family_claims == 0 and "gleif-lei-register" not in got
    fam = spark.createDataFrame([("subfinder/crt",), ("subfinder:crt",), (" CRTSH ",), ("subfinder:",)], "s string")
    assert [r[0] for r in fam.select(ev.family(F.col("s"))).collect()] == ["subfinder-upstream:crt", "subfinder-upstream:crt", "certificate-transparency", "unclassified"]
    assert [r[0] for r in fam.select(ev.family(F.col("s"), compat=True)).collect()][0] == "unclassified"


def test_clusters(spark):
    n = spark.createDataFrame([("a", "domain", "a.com", None), ("b", "domain", "b.com", None), ("c", "domain", "c.com", None), ("t", "identifier", "UA-1", "tracker"), ("o", "identifier", "acme org", "org"), ("e", "identifier", "x@x.com", "email")], "node_id string, node_type string, value_norm string, identifier_type string")
    links = [("a", "t"), ("t", "b"), ("a", "o"), ("o", "c"), ("a", "e")]
    e = spark.createDataFrame(links, "from_node_id string, to_node_id string")
    assert [(r.identifier, r.domains) for r in gr.shared_clusters(n, e).orderBy("rank").collect()] == [("UA-1", ["a.com", "b.com"]), ("acme org", ["a.com", "c.com"])]
    assert gr.shared_clusters(n, spark.createDataFrame([(b, a) for a, b in links], e.schema)).count() == 2
    assert gr.shared_clusters(n, e, 3).count() == 0


def test_expansion_equals_plain_search(spark):
    r = random.Random(3)
    links = [(str(r.randrange(40)), str(r.randrange(40))) for _ in range(70)]
    depth, front = {"0": 0}, ["0"]
    for k in range(1, 5):
        front = [b for a, b in links if a in front and b not in depth]
        depth |= {b: k for b in front}
    got = gr.expand(spark.createDataFrame(links, "from_domain string, to_domain string"), spark.createDataFrame([("0",)], "domain string"), 4)
    assert dict(rows(got, "domain", "depth")) == depth
    assert gr.expand(spark.createDataFrame(links, "from_domain string, to_domain string"), spark.createDataFrame([("0",)], "domain string"), 4, 3).count() == 3


def test_allocation(spark):
    p = spark.createDataFrame([("d", "email", "first@example.com", 0.95, 0), ("d", "email", "second@example.com", 0.90, 1), ("d", "org", "example holdings", 0.75, 2), ("d", "org", "example holdings", 0.99, 3)], "domain string, id_type string, value string, score double, ord int")
    assert [r.value for r in pv.allocate(pv.first_occurrences(p), 2).orderBy("slot").collect()] == ["first@example.com", "example holdings"]
    u = spark.createDataFrame([("tracker", 0.8), ("email", 0.8)], "k string, s double").select(pv.utility(F.col("k"), F.col("s"), 4).alias("u"), pv.calls(F.col("k"), 4).alias("c")).collect()
    assert u[0].c == 5 and u[0].u < u[1].u
    x = spark.createDataFrame([(0.0738125,), (0.3264375,)], "x double").select(pv.half_even(F.col("x"), 6)).collect()
    assert [r[0] for r in x] == [0.073813, 0.326437]


def test_admission_and_circuits_against_plain_python(spark):
    r = random.Random(5)
    t0 = datetime(2024, 1, 1)
    reqs = [(k, i, float(r.randrange(1, 9))) for k in "ab" for i in range(30)]
    want = []
    for k in "ab":
        left = 40.0
        for _, i, c in (x for x in reqs if x[0] == k):
            if c <= left:
                left -= c
                want.append((k, i))
    assert rows(us.admitted(spark.createDataFrame(reqs, "k string, i int, c double"), "k", "c", ["i"], 40.0), "k", "i") == sorted(want)
    calls = [("p", i, r.choice(["success", "error", "error", "capacity"]), t0 + timedelta(seconds=17 * i)) for i in range(80)]
    streak, until, opened = 0, None, 0
    for _, _, s, at in calls:
        if until and at < until or s == "capacity":
            continue
        streak = 0 if s == "success" else streak + 1
        if streak >= 3:
            opened, streak, until = opened + 1, 0, at + timedelta(seconds=60)
    assert us.circuits(spark.createDataFrame(calls, "provider string, id int, status string, started_at timestamp")).count() == opened > 0


def test_quality_example_and_pool(spark):
    def run(org, tps, extra):
        return [(org, f"p{i}.{org}") for i in range(tps)] + [(org, x) for x in extra]

    labels = [(o, f"p{i}.{o}", True) for o in "xy" for i in range(5)] + [(o, f"n{i}.{o}", False) for o in "xy" for i in range(5)]
    lab = spark.createDataFrame(labels, "case_id string, domain string, positive boolean")
    s = "case_id string, domain string"
    one = qu.evaluated(spark.createDataFrame(run("x", 1, ["n0.x", "u.x"]), s), lab.where("case_id = 'x'"), ["case_id"]).first()
    assert (one.tp, one.fp, one.fn, one.unlabeled, one.precision, one.recall) == (1, 1, 4, 1, 0.5, 0.2)
    c = qu.compared(spark.createDataFrame([], s), spark.createDataFrame(run("x", 5, []) + run("y", 5, []), s), lab, ["case_id"])
    assert {r.verdict for r in c.collect()} == {"improved_on_labeled_case"}
    p = qu.pooled(c).first()
    assert (p.labels, p.positives, p.candidate_tp, p.candidate_precision, p.candidate_recall, p.verdict, p.eligible) == (20, 10, 10, 1.0, 1.0, "improved_on_labeled_corpus", True)
    odd = qu.compared(spark.createDataFrame([], s), spark.createDataFrame([("x", "u.x")], s), lab.where("case_id = 'x'"), ["case_id"]).first()
    assert odd.verdict == "inconclusive_unlabeled_change" and not odd.eligible
    assert qu.evaluated(spark.createDataFrame([], s), lab.where("case_id = 'x'"), ["case_id"]).first().precision is None


def test_fresh_and_leases(spark):
    now = F.lit("2024-01-02T00:00:00Z").cast("timestamp")
    x = spark.createDataFrame([("2024-01-01T12:00:00Z",), ("2023-01-01",), ("bad",), (None,)], "t string")
    assert [r[0] for r in x.select(us.fresh(F.col("t"), now, 24)).collect()] == [True, False, False, False]
    assert not any(r[0] for r in x.select(us.fresh(F.col("t"), now, 0)).collect())
    t = lambda s: datetime(2024, 1, 1, 0, 0, s)
    held = spark.createDataFrame([("p", t(0), t(10)), ("p", t(10), t(20)), ("p", t(5), t(12))], "provider string, created_at timestamp, expires_at timestamp")
    assert us.peak_leases(held).first().peak == 2
