import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from siftgraph.functions import addresses as ad
from siftgraph.functions import domains as dom


def literal(text):
    try:
        return ipaddress.ip_address(text)
    except ValueError:
        return None


def unsafe(a):
    return a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved


def allowed(host):
    h = host.strip().lower().rstrip(".")
    if not h or h in dom.INNER_HOSTS or h.endswith(dom.INNER_ENDINGS):
        return False
    a = literal(h)
    return a is None or not unsafe(a)


HARD = [
    "0:0:0:0:0:0:0:1", "0000::1", "0:0:0:0:0:ffff:a00:1", "fe80::1%eth0", "64:ff9b::1", "2002:7f00:1::", "100.64.0.1", "2001:1::1", "2001:20::1", "::", ":::", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::",
    "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8::", "1:2:3:4::5:6:7:8", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "::1.2.3.4", "::ffff:8.8.8.8", "::FFFF:10.0.0.1", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4",
    "1.2.3.4::", "1.2.3.4:5::", "::1.2.3.256", "::1.2.3", "::01.2.3.4", "fe80::1%", "fe80::1%a%b", "%1", "1::%", "::g", "::12345", "1.2.3.4.", "1.2.3", "1.2.3.4.5", "01.2.3.4", "1.2.3.04", "256.1.1.1", "1.1.1.1 ", "\t8.8.8.8\n",
    "8.8.8.8\x1c", "٣.1.1.1", "8.8.8.8/32", "::1/128", "", " ", ".", "a.com", "a.internal.", "LOCALHOST", "192.0.0.9", "192.0.0.10", "192.0.0.11", "fec0::1", "ff02::1", "2001:4:112::5", "3fff::1", "5f00::1", "2606:4700::1111", "169.254.169.254",
]


def spellings(n):
    six, r = ipaddress.IPv6Address(n), random.Random(n)
    yield from (str(six), six.exploded, six.exploded.upper(), f"{six}%{r.randint(0, 9)}")
    g = [n >> 16 * k & 0xFFFF for k in range(7, -1, -1)]
    yield ":".join(f"{x:x}" for x in g)
    yield ":".join(f"{x:x}" for x in g[:6]) + f":{ipaddress.IPv4Address(n & 0xFFFFFFFF)}"
    yield str(ipaddress.IPv4Address(n & 0xFFFFFFFF))
    yield f"::ffff:{ipaddress.IPv4Address(n & 0xFFFFFFFF)}"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    numbers = {x + d for t in ad.INNER_IPV4 + ad.OUTER_IPV4 + ad.INNER_IPV6 + ad.OUTER_IPV6 for n in [ipaddress.ip_network(t)] for x in (int(n[0]), int(n[-1])) for d in (-1, 0, 1)}
    numbers |= {r.getrandbits(128) for _ in range(200)} | {0x2000 << 112 | r.getrandbits(125) for _ in range(200)} | {r.getrandbits(32) for _ in range(300)} | {0x2001 << 112 | r.getrandbits(8) << 104 | r.getrandbits(104) for _ in range(200)}
    out = dict.fromkeys(HARD)
    for n in sorted(x for x in numbers if 0 <= x < 1 << 128):
        out.update(dict.fromkeys(spellings(n)))
    pieces = ["::", ":", "0", "1", "ffff", "00", "fe80", "10.0.0.1", "1.1.1.1", ".", "%x", "g"]
    out.update(dict.fromkeys("".join(r.choices(pieces, k=r.randint(1, 9))) for _ in range(3000)))
    return list(out)


def test_guard_is_python_s_rule(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ad.public_address(F.col("t")).alias("public"), dom.scan_target(F.col("t")).alias("ok")).collect()
    for t, public, ok in rows:
        a = literal(t)
        assert public == (None if a is None else not unsafe(a)), t
        assert ok == allowed(t), t


def test_addresses_are_128_bits_in_order(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ad.address(F.col("t")).alias("a")).collect()
    for t, a in rows:
        x = literal(t)
        if x is None:
            assert a is None, t
        else:
            assert (a["version"], a["hi"], a["lo"]) == (x.version, *ad.halves(int(x))), t


def test_own_ranges_and_nulls(spark):
    table = {4: ad.ranges(("100.64.0.0/10",), ("100.64.0.1/32",)), 6: ad.ranges((), ())}
    rows = spark.createDataFrame([("100.64.0.0",), ("100.64.0.1",), ("100.64.0.2",), ("10.0.0.1",), (None,), ("host",)], "t string")
    assert [r[0] for r in rows.select(ad.inner(ad.address(F.col("t")), table)).collect()] == [True, False, True, False, None, None]
    assert [r[0] for r in rows.select(dom.scan_target(F.col("t"))).collect()] == [True, True, True, False, False, True]
    assert rows.limit(0).select(ad.public_address(F.col("t"))).count() == 0


def test_brackets_come_off(spark):
    rows = spark.createDataFrame([("[::1]",), ("[2606:4700::1111]",), ("[10.0.0.1].",)], "t string")
    assert [r[0] for r in rows.select(dom.scan_target(F.col("t"))).collect()] == [False, True, False]
