"""Recipes on literal inputs, poisoned cells, parameters, finishers."""

import math

import pytest

from tallyspark.functions import catalogue, special
from tallyspark.functions.recipes import RECIPES
from tallyspark.plans.evaluate import ansi_sql, evaluate


def values(spark, rows, schema, ids, params=None):
    out = evaluate(spark.createDataFrame(rows, schema), ids, params).collect()
    return {(r.g, r.recipe): (r.value, r.degenerate) for r in out}


def test_returns(spark):
    r = [0.1, -0.2, 0.3, -0.05]
    got = values(spark, [(1, k, x) for k, x in enumerate(r)], "g int, pos int, r double", ["total_return", "max_drawdown", "win_rate", "max_consecutive_losses", "sharpe", "cvar"], {"sharpe": {"P": 1}})
    equity, peak, worst = 1.0, 1.0, 0.0
    for x in r:
        equity *= 1 + x
        peak = max(peak, equity)
        worst = min(worst, equity / peak - 1)
    mean = sum(r) / 4
    sd = math.sqrt(sum((x - mean) ** 2 for x in r) / 3)
    assert got[1, "total_return"][0] == pytest.approx(equity - 1)
    assert got[1, "max_drawdown"][0] == pytest.approx(worst)
    assert got[1, "win_rate"][0] == 0.5
    assert got[1, "max_consecutive_losses"][0] == 1
    assert got[1, "sharpe"][0] == pytest.approx(mean / sd)
    assert got[1, "cvar"][0] == pytest.approx(0.2)


def test_bad_cells_poison_their_key_only(spark):
    rows = [(1, 0, 1.0), (1, 1, None), (2, 0, 1.0), (2, 1, float("nan")), (3, 0, 1.0), (3, 1, 3.0)]
    got = values(spark, rows, "g int, pos int, x double", ["column_mean", "column_max"])
    assert got[1, "column_mean"] == (None, True)
    assert got[2, "column_max"] == (None, True)
    assert got[3, "column_mean"] == (2.0, False)


def test_degenerate_instead_of_errors(spark):
    got = values(spark, [(1, 0, 5.0, 5.0), (1, 1, 5.0, 5.0)], "g int, pos int, x double, y double", ["correlation", "ols_slope", "index_of_dispersion", "covariance"])
    assert got[1, "correlation"] == (None, True)
    assert got[1, "ols_slope"] == (None, True)
    assert got[1, "covariance"] == (0.0, False)


def test_parameters_are_checked():
    catalogue.load()
    with pytest.raises(ValueError, match="no parameter"):
        RECIPES["percentile"].text(k=3)
    with pytest.raises(ValueError, match="plain parameter"):
        RECIPES["percentile"].text(q="0) --")
    assert "quantile_cont(x, 0.25e0)" in ansi_sql("SELECT 1 AS g, x FROM t", ["percentile"], {"percentile": {"q": 0.25}})


def test_an_ordered_recipe_needs_an_order(spark):
    with pytest.raises(ValueError, match="pos"):
        evaluate(spark.createDataFrame([(1, 0.1)], "g int, r double"), ["max_drawdown"])


def test_empty(spark):
    assert values(spark, [], "g int, pos int, x double", ["column_mean", "gini_coefficient"]) == {}


def test_tails():
    # textbook values
    assert special.norm_cdf(1.96) == pytest.approx(0.9750021048517795, rel=1e-12)
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert special.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-9)
    assert special.t_sf2(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-9)
    assert special.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05, rel=1e-9)
    assert special.t_ppf(0.975, 10) == pytest.approx(2.2281388519649385, rel=1e-9)
    assert special.kolmogorov_sf(1.3580986393225505) == pytest.approx(0.05, rel=1e-6)


def test_two_samples(spark):
    a, b = [5.1, 4.9, 6.2, 5.8, 6.0], [4.1, 4.8, 5.0, 4.4]
    rows = [(1, k, "a", x) for k, x in enumerate(a)] + [(1, k, "b", x) for k, x in enumerate(b)]
    got = values(spark, rows, "g int, pos int, side string, v double", ["p_value", "cliffs_delta", "mann_whitney", "wasserstein_1d", "ks_2samp"])
    wins = sum((x > y) - (x < y) for x in a for y in b)
    assert got[1, "cliffs_delta"][0] == pytest.approx(wins / 20)
    assert 0 < got[1, "p_value"][0] < 0.05
    points = sorted(a + b)
    area = sum(abs(sum(v <= x for v in a) / 5 - sum(v <= x for v in b) / 4) * (y - x) for x, y in zip(points, points[1:], strict=False))
    assert got[1, "wasserstein_1d"][0] == pytest.approx(area)


def test_solvers(spark):
    flows = [-100.0, 30.0, 40.0, 50.0]
    got = values(spark, [(1, k, f) for k, f in enumerate(flows)], "g int, pos int, cf double", ["irr", "npv"], {"npv": {"rate": 0.1}})
    rate = got[1, "irr"][0]
    assert sum(f / (1 + rate) ** k for k, f in enumerate(flows)) == pytest.approx(0, abs=1e-9)
    assert got[1, "npv"][0] == pytest.approx(sum(f / 1.1**k for k, f in enumerate(flows)))


def test_option_prices_and_implied_volatility(spark):
    book = values(spark, [(1, 100.0, 95.0, 0.5, 0.25, 0.03, 1.0)], "g int, spot double, strike double, tm double, vol double, rate double, quantity double", ["bs_value", "bs_delta"])
    price = book[1, "bs_value"][0]
    back = values(spark, [(1, 100.0, 95.0, 0.5, 0.03, price)], "g int, spot double, strike double, tm double, rate double, price double", ["bs_implied_vol"])
    assert back[1, "bs_implied_vol"][0] == pytest.approx(0.25, abs=1e-8)
    assert 0.5 < book[1, "bs_delta"][0] < 1


def test_text_similarity(spark):
    rows = [(1, "the cat sat", "the cat sat down"), (1, "martha", "marhta")]
    got = values(spark, rows[1:], "g int, tp string, tr string", ["jaro_similarity", "jaro_winkler_similarity", "longest_common_subsequence", "levenshtein_similarity"])
    assert got[1, "jaro_similarity"][0] == pytest.approx(0.944444, abs=1e-6)
    assert got[1, "jaro_winkler_similarity"][0] == pytest.approx(0.961111, abs=1e-6)
    assert got[1, "longest_common_subsequence"][0] == 5
    got = values(spark, rows[:1], "g int, tp string, tr string", ["wer", "token_jaccard", "token_f1"])
    assert got[1, "wer"][0] == pytest.approx(0.25)
    assert got[1, "token_jaccard"][0] == pytest.approx(0.75)
    assert got[1, "token_f1"][0] == pytest.approx(2 * 2 / 5)


@pytest.mark.parametrize(
    ("recipe", "params", "expected"),
    [
        ("growth_rate", {}, 0.5),
        ("growth_rate", {"mode": "total"}, 2.0),
        ("column_std", {"ddof": 0}, math.sqrt(2 / 3)),
        ("percentile", {"q": 0.25}, 1.5),
        ("trimmed_mean", {"proportion": 0.4}, 2.0),
    ],
)
def test_conventions_change_the_value(spark, recipe, params, expected):
    got = values(spark, [(1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0)], "g int, pos int, x double", [recipe], {recipe: params})
    assert got[1, recipe][0] == pytest.approx(expected)


def test_modes(spark):
    rows = [(1, 0, 1.0, 2.0), (1, 1, 3.0, 1.0)]
    schema = "g int, pos int, p double, a double"
    assert values(spark, rows, schema, ["mape"], {"mape": {"mode": "smape"}})[1, "mape"][0] == pytest.approx((2 * 1 / 3 + 2 * 2 / 4) / 2)
    assert values(spark, rows, schema, ["nrmse"], {"nrmse": {"mode": "range"}})[1, "nrmse"][0] == pytest.approx(math.sqrt(2.5))
    flags = [(1, 0, 404), (1, 1, 503), (1, 2, 200), (1, 3, 200)]
    for mode, share in (("flag", 1.0), ("http4xx", 0.5), ("http5xx", 0.25)):
        assert values(spark, flags, "g int, pos int, flag int", ["error_rate"], {"error_rate": {"mode": mode}})[1, "error_rate"][0] == share
    assert values(spark, [(1, 0, 1), (1, 1, 0)], "g int, pos int, flag int", ["churn_rate"], {"churn_rate": {"mode": "retention"}})[1, "churn_rate"][0] == 0.5
    texts = [(1, "The Cat!", "a cat")]
    assert values(spark, texts, "g int, tp string, tr string", ["exact_match", "exact_match_normalized"])[1, "exact_match_normalized"][0] == 1.0


def test_pair_means(spark):
    xs = [1.0, 2.0, 2.0, 5.0, 9.0]
    pairs = sorted((a + b) / 2 for k, a in enumerate(xs) for b in xs[k:])
    middle = (pairs[(len(pairs) - 1) // 2] + pairs[len(pairs) // 2]) / 2
    got = values(spark, [(1, k, x) for k, x in enumerate(xs)], "g int, pos int, x double", ["hodges_lehmann_estimator"])
    assert got[1, "hodges_lehmann_estimator"][0] == middle
