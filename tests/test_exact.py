import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from siftgraph.functions import exact


def test_half_even_is_python_s_round(spark):
    r = random.Random(1)
    xs = [k / 128 for k in range(-300, 300)] + [k / 2**7 + 1e-16 * k for k in range(200)] + [0.0, -0.0, 2.5, 1e300, -1e300, 5e-324, 1e15 + 0.5, 4503599627.3704955, math.inf, -math.inf, None]
    xs += [r.uniform(-1, 1) for _ in range(2000)] + [r.randint(0, 10**7) / 10**7 for _ in range(3000)] + [round(r.random(), 6) * w / 4 for w in (2.5, 0.85) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = df.select("x", exact.half_even(F.col("x"), 6).alias("a"), exact.half_even(F.col("x"), 2).alias("b")).collect()
    for x, a, b in rows:
        for got, places in ((a, 6), (b, 2)):
            want = x if x is None or math.isinf(x) else round(x, places)
            assert got == want and (got is None or math.copysign(1, got) == math.copysign(1, want)), (x, places, got, want)
    assert math.isnan(spark.range(1).select(exact.half_even(F.lit(float("nan")), 6)).first()[0])


def test_products_have_no_error(spark):
    r = random.Random(2)
    xs = [r.uniform(0, 10 ** r.randint(-20, 20)) for _ in range(2000)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", exact.product(F.col("x"), 1e6).alias("m")).collect()
    assert all(Fraction(m["p"]) + Fraction(m["e"]) == Fraction(x) * 10**6 for x, m in rows)
