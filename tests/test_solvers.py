"""Solvers against the lists of pairs that they stand for."""

import math
import random

import pytest

from tallyspark.functions import catalogue
from tallyspark.functions.recipes import RECIPES
from tallyspark.plans import solvers
from tallyspark.plans.evaluate import evaluate


def by_sql(spark, t, i):
    catalogue.load()
    return {r.g: r.v for r in spark.sql(f"SELECT g, CAST({RECIPES[i].exprs[0]} AS DOUBLE) AS v FROM {RECIPES[i].source} s GROUP BY g", t=t).collect()}


def same(got, want):
    for g, v in got.items():
        w = want.get(g)
        assert (v is None) == (w is None), (g, v, w)
        assert v is None or math.isclose(v, w, rel_tol=1e-10, abs_tol=1e-10), (g, v, w)


def test_slopes_against_all_pairs(spark):
    rng = random.Random(3)
    keys = {f"{n}-{spread}": [(float(rng.randrange(spread)), float(rng.randrange(spread))) for _ in range(n)] for n in (1, 2, 3, 17, 64, 150) for spread in (1, 3, 60, 10**6)}
    keys["line"] = [(float(k), 3.0 * k + 1) for k in range(90)]
    keys["cents"] = [(rng.randrange(10**4) / 100, rng.randrange(10**4) / 100 + k * 37 % 101) for k in range(200)]
    t = spark.createDataFrame([(g, k, x, y) for g, v in keys.items() for k, (x, y) in enumerate(v)], "g string, pos int, x double, y double")
    for i in ("theil_sen_slope", "siegel_slope"):
        got = {r.g: r.value for r in evaluate(t, [i]).collect()}
        assert got.keys() == keys.keys()
        same(got, by_sql(spark, t, i))


@pytest.mark.parametrize("n", [20_000])
def test_slopes_of_a_long_key_are_not_listed(n):
    # 200 million pairs: their list alone would take 1.6 GB
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=n)
    y = 2 * x + rng.normal(size=n)
    assert solvers.theil_sen(x, y) == pytest.approx(2, abs=0.05)
    assert solvers.repeated_median(x, y) == pytest.approx(2, abs=0.05)


@pytest.mark.parametrize("stretch", [0, 16, 64])
def test_hurst_against_windows(spark, stretch, monkeypatch):
    rng = random.Random(11)
    keys = {f"{n}": [rng.gauss(0, 1) for _ in range(n)] for n in (1, 15, 16, 40, 333, 1024)} | {"flat": [0.1] * 300, "steps": [k // 40 / 7 for k in range(400)]}
    rows = [(g, k, x) for g, v in keys.items() for k, x in enumerate(v)]
    rng.shuffle(rows)
    t = spark.createDataFrame(rows, "g string, pos int, x double")
    if stretch:
        monkeypatch.setattr(solvers, "STRETCH", stretch)
    got = {r.g: r.value for r in evaluate(t, ["hurst_rs"], long=10 if stretch else 1000_000, block=50).collect()}
    assert got.keys() == keys.keys()
    same(got, by_sql(spark, t, "hurst_rs"))


def test_only_what_is_read_in_order_is_written(spark, monkeypatch):
    from tallyspark.plans import series

    seen = []
    monkeypatch.setattr(series, "blocked", lambda t, rows, f=series.blocked: seen.append(t.columns) or f(t, rows))
    t = spark.createDataFrame([("a", k, 1.0 + k % 7, 2.0 + k % 5, 3.0) for k in range(50)], "g string, pos int, revenue double, x double, assets double")
    got = {r.recipe: r.value for r in evaluate(t, ["cagr", "asset_turnover"], long=10, block=8).collect()}
    assert seen == [] and got["cagr"] is not None and got["asset_turnover"] is not None


def test_columns_of_long_keys(spark, sf_dir):
    from tests.test_series import bound, values

    shape, t = bound(spark, sf_dir, "columns")
    ids = [i for i in shape.recipes if RECIPES[i].in_blocks and RECIPES[i].in_blocks != RECIPES[i].source]
    assert {"jitter", "growth_rate", "gini_coefficient", "winsorized_mean", "rosenbluth_index"} <= set(ids)
    t = t.where("g in (0, 202, 203)")
    plain, blocks = values(evaluate(t, ids, shape.params)), values(evaluate(t, ids, shape.params, long=10, block=57))
    assert plain.keys() == blocks.keys()
    same(blocks, plain)


def test_neutral_corr_takes_an_era_at_a_time(spark, monkeypatch):
    from tallyspark.functions.finishers import FINISHERS

    rng = random.Random(4)
    keys = {g: [(e, *(rng.gauss(0, 1) for _ in range(4))) for e, n in (("1", 40), ("2", 25), ("3", 1)) for _ in range(n)] for g in "ab"} | {"c": [("1", 1.0, 2.0, 0.5, 0.1)]}
    want = {g: FINISHERS["neutral_corr"](*zip(*v, strict=True)) for g, v in keys.items()}
    t = spark.createDataFrame([(g, k, *r) for g, v in keys.items() for k, r in enumerate(v)], "g string, pos int, era string, p double, target double, f1 double, f2 double")
    found = evaluate(t, ["feature_neutral_corr"])
    same({r.g: r.value for r in found.collect()}, want)
    assert "collect_list" not in found._jdf.queryExecution().toString()
