import hashlib
import json
import random
import struct
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import CalendarIntervalType

from siftgraph.functions import canonical as ca


def dump(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def test_numbers_are_the_shortest(spark):
    r = random.Random(1)
    xs = [0.0, -0.0, 1.0, 10.0, 123456.0, 1e15, 1e16, 1e17, 123456789012345678.0, 9007199254740993.0, 1e-4, 1e-5, 0.00012, 1.5e300, 5e-324, 1.7976931348623157e308, 2.2250738585072014e-308, 2e-3, 1e23, 9.999999999999999e22, 2**-44, 0.1, 0.2 + 0.1, -1.25, 100.0, 2.0**63, float("nan"), float("inf"), float("-inf")]
    xs += [r.random() * 10 ** r.randint(-30, 30) for _ in range(4000)] + [2.0**k for k in range(-1074, 1024)] + [10.0**k for k in range(-300, 300)]
    xs += [x for x in (struct.unpack("d", r.randbytes(8))[0] for _ in range(6000)) if x == x]
    xs += [round(r.random() * 1000, r.randint(0, 6)) for _ in range(2000)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", ca.canonical(F.col("x"), ca.DoubleType()).alias("t")).collect()
    wrong = [(x, t, dump(x)) for x, t in rows if t != dump(x)]
    assert not [w for w in wrong if 1e-5 < abs(w[0]) < 9e18], wrong[:5]
    # Elsewhere the text still reads back and is as short, and all but a few are the same.
    assert len(wrong) < len(xs) / 1000 and all(float(t) == x and len(t) == len(want) for x, t, want in wrong), wrong[:5]


def test_texts(spark):
    texts = ["", "plain", 'q"\\/', "\n\r\t\b\f", "\x00\x01\x1f\x7f\x80", "é ü ß", "漢字", "𝔘🎉", " ﻿￿", "mix é\n\"𝔘", "$1 \\u0041", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ca.canonical(F.col("t"), ca.StringType()).alias("c")).collect()
    assert [c for _, c in rows] == [dump(t) for t, _ in rows]


SCHEMA = "id int, z struct<b: string, `a é`: array<double>, `A`: map<string, struct<y: int, x: boolean>>>, f float, d date, t timestamp, n decimal(10,2), m map<string, string>, e array<array<string>>, bad string"


def test_nested_values(spark):
    rows = [
        (1, ("ü", [1.0, None, 2.5e-7], {"b": (1, True), "a": (None, False), "é": None, "𝔘": (2, None), "￿": (3, True)}), 0.5, date(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5, 60), Decimal("1.50"), {}, [["x", None], [], None], None),
        (2, None, None, None, datetime(2024, 1, 2, 3, 4, 5), None, {"k": None}, [], ""),
        (3, (None, [], {}), 3.0, None, None, None, None, None, "\\"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r[0]: r[1:] for r in df.select("id", ca.canonical_row(df).alias("c"), ca.raw_hash(ca.canonical_row(df)).alias("h"), ca.canonical_row(df, ["id", "m"]).alias("k")).collect()}
    for r in rows:
        z = r[1] and {"b": r[1][0], "a é": r[1][1], "A": {k: v and {"y": v[0], "x": v[1]} for k, v in r[1][2].items()}}
        value = dict(zip(("id", "z", "f", "d", "t", "n", "m", "e", "bad"), (r[0], z, *r[2:])))
        assert got[r[0]] == (dump(value), hashlib.sha256(dump(value).encode()).hexdigest(), dump({"id": r[0], "m": r[6]}))


def test_other_types_are_refused():
    with pytest.raises(TypeError):
        ca.canonical(F.lit(1), CalendarIntervalType())
    with pytest.raises(TypeError):
        ca.canonical(F.lit(1), ca.MapType(ca.DoubleType(), ca.StringType()))
