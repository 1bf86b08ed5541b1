"""Exact quantiles against sorting."""

import random

import numpy as np
import pytest

from tallyspark.plans import quantiles
from tallyspark.plans.evaluate import evaluate


@pytest.mark.parametrize("few", [1, 50, 100_000])
def test_quantiles_against_sorting(spark, few):
    rng = random.Random(few)
    groups = {
        "uniform": [rng.random() for _ in range(3000)],
        "ties": [float(rng.randrange(3)) for _ in range(2000)],
        "one": [2.5],
        "same": [7.0] * 500,
        "outliers": [10.0 ** rng.randint(-300, 300) * rng.choice([-1, 1]) for _ in range(1500)],
        "heap": [0.0] * 1000 + [rng.gauss(0, 1e-9) for _ in range(1000)] + [1e300, -1e300],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("uniform", None)]
    rng.shuffle(rows)
    qs = [0, 0.05, 0.25, 0.5, 0.871, 1]
    got = {(r.g, r.q): r.value for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), qs, few=few).collect()}
    assert len(got) == len(groups) * len(qs)
    for g, xs in groups.items():
        for q in qs:
            assert got[g, q] == pytest.approx(float(np.quantile(xs, q)), rel=1e-12, abs=1e-300), (g, q)


def test_recipes_of_long_groups(spark):
    rng = random.Random(2)
    t = spark.createDataFrame([("a", k, rng.gauss(0, 0.02)) for k in range(2000)], "g string, pos int, r double")
    ids = ["value_at_risk", "tail_ratio", "common_sense_ratio", "reward_to_var_ratio", "drawdown_at_risk"]
    plain = {r.recipe: r.value for r in evaluate(t, ids).collect()}
    long = {r.recipe: r.value for r in evaluate(t, ids, long=100, block=300).collect()}
    assert plain.keys() == long.keys()
    assert all(long[k] == pytest.approx(v, rel=1e-9) for k, v in plain.items())
