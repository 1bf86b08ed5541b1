"""Exact sums against whole-number arithmetic, and enclosures against exact sums."""

import math
import random
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.functions import exact
from tallyspark.operators import robustness

HARD = {
    "cancels": [1e16, 1.0, -1e16, 2.0**-40] * 7,
    "tenths": [0.1] * 1000,
    "extremes": [5e-324, 1.7e308, -1.7e308, 2.2250738585072014e-308, -5e-324, 3.0],
    "powers": [s * 2.0**k for k in range(-1074, 1023, 13) for s in (1, -1, 1.0000000000000002)],
    "one": [0.3],
    "zeros": [0.0, -0.0],
}


def truth(xs, ddof=1):
    f = [Fraction(x) for x in xs]
    n, s = len(f), sum(f)
    return exact.moments(n, s, sum(x * x for x in f), ddof)


def collected(df):
    return {(r.g, r.metric): (r.value, r.lo, r.hi) for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 7])
def test_sums_do_not_depend_on_partitions(spark, parts):
    rng = random.Random(parts)
    rows = [(g, x) for g, xs in HARD.items() for x in xs] + [("random", rng.uniform(-1, 1) * 10.0 ** rng.randint(-200, 150)) for _ in range(3000)] + [("bad", math.nan), ("bad", 1.0), ("skipped", None), ("tenths", None)]
    rng.shuffle(rows)
    got = collected(exact.exact_moments(spark.createDataFrame(rows, "g string, x double").repartition(parts)))
    for g in [*HARD, "random"]:
        for metric, want in truth([x for k, x in rows if k == g and x is not None]).items():
            assert got[g, metric] == want, (g, metric)
    assert not [k for k in got if k[0] in ("bad", "skipped")]
    assert got["tenths", "sum"][0] == math.fsum([0.1] * 1000) and got["cancels", "sum"][0] == math.fsum(HARD["cancels"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, min_value=-1e150, max_value=1e150), min_size=2, max_size=20))
def test_nearest_doubles_and_neighbours(xs):
    found = truth(xs)
    n, s = len(xs), sum(map(Fraction, xs))
    assert found["sum"][0] == math.fsum(xs)
    for metric, value in (("sum", s), ("mean", s / n)):
        near, lo, hi = found[metric]
        assert Fraction(lo) <= value <= Fraction(hi) and (lo == hi or math.nextafter(lo, math.inf) == hi) and near in (lo, hi)
    near, lo, hi = found["stdev"]
    var = sum((Fraction(x) - s / n) ** 2 for x in xs) / (n - 1)
    assert Fraction(lo) ** 2 <= var <= Fraction(hi) ** 2 and near in (lo, hi)


def test_enclosures_hold_the_true_values(spark):
    rng = random.Random(5)
    keys = {k: v for k, v in HARD.items() if k not in ("extremes", "powers")} | {f"r{k}": [rng.gauss(10.0**k, 1) for _ in range(500)] for k in range(0, 9, 2)}
    t = spark.createDataFrame([(g, x) for g, xs in keys.items() for x in xs], "g string, x double")
    exactly = {k: v for k, v in collected(exact.exact_moments(t)).items()}
    rough = {(r.g, r.metric): (r.lo, r.hi) for r in robustness.enclosures(t).collect()}
    assert rough.keys() == exactly.keys()
    for k, (_, lo, hi) in exactly.items():
        assert rough[k][0] <= lo and hi <= rough[k][1], k


def test_no_rows(spark):
    assert exact.exact_moments(spark.range(0).select(F.lit("a").alias("g"), F.lit(1.0).alias("x"))).count() == 0
