import html
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftgraph.functions import domains as d
from siftgraph.functions import pages as p


def values(spark, xs, f):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").select("i", f(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def test_domains(spark):
    raw = ["https://Example.COM/path", "Blog.Example.COM.", " a.b ", "http://h:8080/", "", None, "-x.com", "x" * 64 + ".com", "no_dot"]
    assert values(spark, raw, d.normalized_domain) == ["example.com", "blog.example.com", "a.b", None, None, None, None, None, None]
    assert values(spark, ["a.b.c.example.com", "shop.foo.co.uk", "co.uk", "example.com.", "x"], d.registrable) == ["example.com", "foo.co.uk", "co.uk", "example.com", "x"]


def test_domain_rule_against_plain_python(spark):
    label = st.text("ab-0", min_size=1, max_size=4)
    found = []

    @given(st.lists(label, min_size=1, max_size=4), st.sampled_from(["", "http://", "HTTPS://"]), st.sampled_from(["", "/", "/x.y", "."]))
    @settings(max_examples=150, deadline=None, database=None)
    def collect(labels, head, tail):
        found.append(head + ".".join(labels) + tail)

    collect()

    def plain(raw):
        v = raw.lower()
        host = re.match("[^/]*", v.split("://", 1)[-1])[0].rstrip(".")
        parts = host.split(".")
        return host if len(parts) > 1 and all(x and x[0] != "-" != x[-1] for x in parts) else None

    assert values(spark, found, d.normalized_domain) == [plain(x) for x in found]


def test_identifiers_and_trackers(spark):
    rows = spark.createDataFrame([("email", " A@B.C "), ("phone", "+1.2025550100"), ("tracker", "ua-123456-1"), ("org", " Acme   Inc "), ("ns", "NS1.Example.com."), ("phone", "x")], "k string, v string")
    assert [r.y for r in rows.select(d.normalized_identifier(F.col("k"), F.col("v")).alias("y")).collect()] == ["a@b.c", "+12025550100", "UA-123456-1", "acme inc", "ns1.example.com", None]
    assert values(spark, ["UA-123456-1", "G-XXXXXXXXXX", "UA-0000-0", "GTM-AAAB", "G-ABC1234XYZ", "GTM-TEST1"], d.plausible_tracker) == [True, False, False, False, True, False]
    assert values(spark, ["ca-pub-1", "UA-1", "GTM-1", "G-1", "x"], d.tracker_confidence) == [0.95, 0.92, 0.90, 0.85, 0.70]


def test_hosts(spark):
    assert values(spark, ["www.google.com", "notgoogle.com", "index.html", "localhost", "foo.bar", "a.markmonitor.com"], d.noise_domain) == [True, False, True, True, False, True]
    assert values(spark, ["10.0.0.1", "8.8.8.8", "172.20.1.1", "a.internal", "example.com", "localhost", "300.1.1.1"], d.scan_target) == [False, True, False, False, True, False, True]  # 300.1.1.1 is no address
    rows = spark.createDataFrame([("email", "abuse@x.com", 0.5), ("email", "a@x.com", 0.5), ("ns", "ns.cloudflare.com", 0.5), ("org", " ", 0.5), ("odd", "x", 0.5), ("org", "x", 1.5)], "k string, v string, s double")
    assert [r.y for r in rows.select(d.valid_pivot(F.col("k"), F.col("v"), F.col("s")).alias("y")).collect()] == [False, True, False, False, False, False]


PAGE = """<title>A &amp;
 B</title><meta name="description" content="Some  words"><script>gtag('G-ABC1234XYZ'); UA-123456-1 GTM-AB12CD ca-pub-1234567890123456 G-XXXXXXXXXX GTM-XXXXXXX</script>
<p>© 2020–2026 Example Legal LLC. All rights reserved</p><a href="/privacy#x">p</a><a href="https://other.com/terms">t</a><a href="terms?x=1">t</a><a href="/about">a</a>
<p>This site is operated by Example Holdings, Inc. and operated by EXAMPLE HOLDINGS, INC.</p>"""


def test_pages(spark):
    r = spark.createDataFrame([(PAGE, "https://www.example.com/a/")], "h string, u string").select(p.title(F.col("h")).alias("t"), p.description(F.col("h")).alias("d"), p.trackers(F.col("h")).alias("k"), p.copyright_owner(F.col("h")).alias("c"), p.legal_entities(F.col("h")).alias("e"), p.legal_links(F.col("h"), F.col("u")).alias("l"), p.unescaped(F.col("h")).alias("x"), p.plain_text(F.col("h")).alias("p")).first()
    assert r.t == "A & B" and r.d == "Some words"
    assert r.k == ["G-ABC1234XYZ", "GTM-AB12CD", "UA-123456-1", "ca-pub-1234567890123456"]
    assert r.c == "Example Legal LLC" and r.e == ["Example Holdings, Inc"]
    assert r.l == ["https://www.example.com/privacy", "https://www.example.com/a/terms?x=1"]
    assert r.x == html.unescape(PAGE) and "gtag" not in r.p
