"""Long series in blocks, and pairs by orders, against plain windows and all pairs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import catalogue
from tallyspark.functions.recipes import RECIPES
from tallyspark.operators import metrics
from tallyspark.plans import series
from tallyspark.plans.evaluate import evaluate


def values(df):
    return {(r.g, r.recipe): r.value for r in df.collect()}


def bound(spark, sf_dir, name):
    catalogue.load()
    shape = next(s for s in metrics._shapes() if s.name == name)
    t = spark.read.parquet(f"{sf_dir}/{shape.table}.parquet")
    with metrics.lenient(spark):
        return shape, spark.sql(shape.relation.replace(f"FROM {shape.table}", "FROM {source}"), source=t)


@pytest.mark.parametrize("name, block", [("returns", 97), ("trades", 250), ("pairs", 31)])
def test_blocks_give_what_windows_give(spark, sf_dir, name, block):
    shape, t = bound(spark, sf_dir, name)
    ids = [i for i in shape.recipes if RECIPES[i].in_blocks and RECIPES[i].in_blocks != RECIPES[i].source]
    assert ids
    t = t.where("g in (0, 1, 100, 101, 103, 203)")
    plain, blocks = values(evaluate(t, ids, shape.params)), values(evaluate(t, ids, shape.params, long=10, block=block))
    assert plain.keys() == blocks.keys()
    for k, v in plain.items():
        assert (v is None) == (blocks[k] is None), k
        assert v is None or math.isclose(v, blocks[k], rel_tol=1e-8, abs_tol=1e-9), (k, v, blocks[k])


def test_one_key_is_the_work_of_many_tasks(spark, sf_dir):
    _, t = bound(spark, sf_dir, "returns")
    one = series.blocked(t.where("g = 1").select("g", "pos", "r"), 50)
    rows = sorted((r.nth, r.blk, r.pos) for r in one.collect())
    assert [r[0] for r in rows] == list(range(len(rows))) and [r[2] for r in rows] == sorted(r[2] for r in rows)
    assert all(b == n // 50 for n, b, _ in rows)
    # every window of the plan is partitioned by the block, or runs over a row a block
    frame = evaluate(t.where("g = 1"), ["max_drawdown"], long=10, block=50)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "blk" in plan


def test_a_flat_stretch_over_blocks_is_no_loss(spark):
    rng = random.Random(1)
    r = [rng.choice([0.013, -0.007, 0.1]) for _ in range(40)] + [5.0] + [0.0] * 200
    t = spark.createDataFrame([("a", k, x) for k, x in enumerate(r)], "g string, pos int, r double")
    got = values(evaluate(t, ["time_underwater", "max_drawdown_duration"], long=10, block=16))
    assert got == values(evaluate(t, ["time_underwater", "max_drawdown_duration"]))


def test_losses_of_everything_and_more(spark):
    series_of = {"all": [0.1, 0.2, -1.0, 0.5, 0.1], "more": [0.1, 0.2, -1.2, 0.5, 0.1], "twice": [0.1, -1.5, -3.0, 0.2], "one": [0.5], "never": [0.01, 0.02]}
    t = spark.createDataFrame([(g, k, r) for g, rs in series_of.items() for k, r in enumerate(rs)], "g string, pos int, r double")
    ids = ["total_return", "max_drawdown", "ulcer_index", "pain_index", "max_drawdown_duration", "recovery_factor", "calmar", "catalog_calmar", "sterling_ratio"]
    got = values(evaluate(t, ids))
    for g, rs in series_of.items():
        eq = np.cumprod(1 + np.array(rs))
        dd = eq / np.maximum.accumulate(np.maximum(eq, 1)) - 1
        assert math.isclose(got[g, "total_return"], eq[-1] - 1, abs_tol=1e-12)
        assert math.isclose(got[g, "max_drawdown"], min(dd.min(), 0), abs_tol=1e-12)
        assert math.isclose(got[g, "ulcer_index"], math.sqrt((dd**2).mean()), abs_tol=1e-12)
        assert math.isclose(got[g, "pain_index"], abs(dd).mean(), abs_tol=1e-12)
        under = max((len(list(k)) for below, k in itertools.groupby(dd < -1e-15) if below), default=0)
        assert got[g, "max_drawdown_duration"] == under
        if eq[-1] <= 0:
            assert got[g, "calmar"] is got[g, "catalog_calmar"] is got[g, "sterling_ratio"] is None
    assert got["all", "recovery_factor"] == -1


@pytest.mark.parametrize("column", ["o", "h", "l", "c"])
def test_prices_of_nothing_have_no_volatility(spark, column):
    rows = [("a", k, 10.0 + k, 12.0 + k, 9.0 + k, 11.0 + k) for k in range(4)] + [("two", k, 10.0, 12.0, 9.0, 11.0 + k) for k in range(2)]
    t = spark.createDataFrame(rows, "g string, pos int, o double, h double, l double, c double")
    ids = ["parkinson_volatility", "garman_klass_volatility", "rogers_satchell_volatility", "yang_zhang_volatility"]
    good = values(evaluate(t, ids))
    assert all(good["a", i] is not None for i in ids) and good["two", "yang_zhang_volatility"] is None
    bad = values(evaluate(t.withColumn(column, F.when(t.pos == 0, 0.0).otherwise(t[column])), ids))
    assert all(bad["a", i] is None for i in ids if column in ("h", "l") or i != "parkinson_volatility")


def all_pairs(x, y):
    pairs = [(np.sign(a - c), np.sign(b - d)) for (a, b), (c, d) in itertools.combinations(zip(x, y, strict=True), 2)]
    con, dis = sum(a * b > 0 for a, b in pairs), sum(a * b < 0 for a, b in pairs)
    ax, ay = sum(a != 0 for a, _ in pairs), sum(b != 0 for _, b in pairs)
    only_y = sum(a != 0 and b == 0 for a, b in pairs)
    u, v = np.abs(np.subtract.outer(x, x)), np.abs(np.subtract.outer(y, y))
    u, v = (m - m.mean(0) - m.mean(1)[:, None] + m.mean() for m in (u, v))
    spread = math.sqrt((u * u).mean() * (v * v).mean())
    return {
        "kendall_tau": (con - dis) / math.sqrt(ax * ay) if ax * ay else None,
        "somers_d": (con - dis) / (con + dis + only_y) if con + dis + only_y else None,
        "goodman_kruskal_gamma": (con - dis) / (con + dis) if con + dis else None,
        "distance_correlation": math.sqrt(max((u * v).mean(), 0) / spread) if spread > 1e-12 else None,
    }


def concordance(d, s, e):
    held = [(s[i], s[j]) for i in range(len(d)) for j in range(len(d)) if e[i] == 1 and d[i] < d[j]]
    return sum(1 if a < b else 0.5 if a == b else 0 for a, b in held) / len(held) if held else None


@pytest.mark.parametrize("blocks", [False, True])
def test_pairs_by_orders_against_all_pairs(spark, blocks, monkeypatch):
    rng = random.Random(7)
    keys = {f"k{n}-{spread}": [(rng.randrange(spread), rng.randrange(spread), rng.randrange(spread), rng.randrange(2)) for _ in range(n)] for n in (1, 2, 3, 17, 64, 65, 130) for spread in (1, 3, 1000)}
    rows = [(g, k, float(x), float(y), float(d), e) for g, v in keys.items() for k, (x, y, d, e) in enumerate(v)]
    t = spark.createDataFrame([(*r, r[3]) for r in rows], "g string, pos int, x double, y double, d double, ev int, sc double")
    ids = ["kendall_tau", "somers_d", "goodman_kruskal_gamma", "distance_correlation", "concordance_index"]
    if blocks:  # stretches of 8 places
        for i in ids:
            recipe = RECIPES[i]
            small = recipe.in_blocks.replace("b < 18", "b < 3").replace("b >= 18", "b >= 3").replace("nx, 18", "nx, 3")
            assert small != recipe.in_blocks
            monkeypatch.setitem(RECIPES, i, type(recipe)(**{**recipe.__dict__, "in_blocks": small}))
    got = values(evaluate(t, ids, long=0 if blocks else series.LONG, block=8))
    for g, v in keys.items():
        x, y, d, e = (np.array(c, float) for c in zip(*v, strict=True))
        want = all_pairs(x, y) | {"concordance_index": concordance(d, y, e)}
        for i, w in want.items():
            assert (got[g, i] is None) == (w is None), (g, i, got[g, i], w)
            assert w is None or math.isclose(got[g, i], w, rel_tol=1e-9, abs_tol=1e-7), (g, i, got[g, i], w)
