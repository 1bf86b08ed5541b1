"""The formula store's versions and lookup, and formulas on trial."""

import pytest
from pyspark.errors import AnalysisException

from tallyspark.operators import resolve
from tallyspark.sources import stores

RECORD = "metric string, aliases array<string>, text string, expression string"


def held(spark, path, version=None):
    return {r.metric: (r.expression, r.version) for r in stores.formulas(spark, path, version).collect()}


def test_versions_and_snapshots(spark, tmp_path):
    path = str(tmp_path / "store")
    assert stores.add_formulas(spark.createDataFrame([("a", ["first"], "one", "sum(x)"), ("b", None, "two", "avg(x)")], RECORD), path) == 0
    assert stores.add_formulas(spark.createDataFrame([("a", ["first"], "one", "max(x)"), ("c", [], None, "min(x)")], RECORD), path) == 1
    assert held(spark, path, 0) == {"a": ("sum(x)", 0), "b": ("avg(x)", 0)}
    assert held(spark, path) == {"a": ("max(x)", 1), "b": ("avg(x)", 0), "c": ("min(x)", 1)}
    # a second writer of the same version gets an error and what is there stays
    with pytest.raises(AnalysisException):
        spark.createDataFrame([("z", [], "", "0")], RECORD).write.mode("errorifexists").parquet(f"{path}/version=1")
    assert "z" not in held(spark, path)


def test_lookup_takes_names_first_then_the_most_similar_text(spark):
    store = spark.createDataFrame([("gross margin ratio", ["gmr"], "", "1"), ("gross margin rate", [], "", "2"), ("net margin", [], "", "3")], RECORD)
    names = ["GMR ", "gross margin ratios", "ratio of gross margin", "something else", "", "net margin"]
    got = {r.name: (r.metric, round(r.score, 3)) for r in resolve.lookup(spark.createDataFrame([(n,) for n in names], "name string"), store).collect()}
    assert got["gmr"] == ("gross margin ratio", 1.0) and got["net margin"] == ("net margin", 1.0)
    assert got["gross margin ratios"][0] == "gross margin ratio" and got["gross margin ratios"][1] < 1
    assert "something else" not in got and "" not in got


def test_lookup_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    words = ["gross", "net", "margin", "ratio", "rate", "share", "profit", "loss", "of", "the"]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(1, 5)))
    store = spark.createDataFrame([(f"{text()} {k}", [], text(), str(k)) for k in range(60)], RECORD)
    asked = spark.createDataFrame([(f"{r.metric} {r.text}"[: -rng.randint(1, 4)],) for r in store.collect()], "name string")
    vectors = lambda df, c: [(r[0], r[1]) for r in df.select(df.columns[0], resolve.embed(c)).collect()]
    from pyspark.sql import functions as F

    q = vectors(asked.select("name"), F.lower(F.trim("name")))
    f = vectors(store, F.concat_ws(" ", "metric", F.concat_ws(" ", "aliases"), "text"))
    best = {n.strip().lower(): max(sum(a * b for a, b in zip(v, w, strict=True)) for _, w in f) for n, v in q}
    got = {r.name: r.score for r in resolve.lookup(asked, store).collect()}
    assert got.keys() == {n for n, s in best.items() if s >= resolve.SIMILAR}
    assert all(s in (1.0, pytest.approx(best[n], abs=1e-9)) for n, s in got.items()) and len(got) > 10


def test_formulas_on_trial(spark):
    rows = [(t, k % 3, (k * t) % 3, float(k + t)) for t in range(40) for k in range(8)] + [(99, 1, 1, 2.0)]
    cases = spark.createDataFrame(rows, "trial int, y int, p int, x double")
    formulas = {"right": ("avg(CASE WHEN y = p THEN 1 ELSE 0 END)", "catalog_accuracy"), "wrong": ("avg(y)", "catalog_accuracy"), "without value": ("sum(x) / 0", "catalog_stdev"), "spread": ("stddev_samp(x)", "catalog_stdev")}
    got = {r.metric: r for r in resolve.validated(cases, formulas).collect()}
    assert got["right"].trusted and got["right"].trials == 41
    assert not got["wrong"].trusted and got["wrong"].max_error > 0 and not got["without value"].trusted
    assert got["spread"].trusted and got["spread"].trials == 40  # one row has no spread: that trial says nothing
    with pytest.raises(ValueError):
        resolve.validated(cases, {"bad": ("java_method('x')", "catalog_accuracy")})
