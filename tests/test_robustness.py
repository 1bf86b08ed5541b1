"""Enclosures, perturbations, invariances, resolution."""

import math

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import resolve
from tallyspark.operators import robustness as rb
from tallyspark.operators import verdict as vd


def test_enclosures_hold_the_exact_value(spark):
    data = {1: [0.1 * k for k in range(50)], 2: [1e9 + 0.1 * k for k in range(50)], 3: [1e16, 1.0, -1e16]}
    df = spark.createDataFrame([(g, x) for g, xs in data.items() for x in xs], "g int, x double")
    got = {(r.g, r.metric): (r.lo, r.hi) for r in rb.enclosures(df).collect()}
    for g, xs in data.items():
        n, mean = len(xs), math.fsum(xs) / len(xs)
        var = math.fsum((x - mean) ** 2 for x in xs) / (n - 1)
        for metric, value in (("sum", math.fsum(xs)), ("mean", mean), ("variance", var), ("stdev", math.sqrt(var))):
            lo, hi = got[g, metric]
            assert lo <= value <= hi
    b = spark.createDataFrame([(1.0, 1.0 + 1e-12, 1.0, 1.0), (0.9, 1.1, 1.0, 1.0), (2.0, 3.0, 1.0, 1.0)], "lo double, hi double, p double, r double")
    assert [r.x for r in b.select(rb.band(F.col("lo"), F.col("hi"), F.col("p"), F.col("r")).alias("x")).collect()] == ["inside", "straddle", "outside"]


def test_perturbations_move_a_genuine_metric(spark):
    rows = [(1, k, k % 2, (k % 2) if k % 5 else 1 - k % 2, k / 40, float(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "g int, pos int, y int, p int, s double, x double")
    got = {r.kind: r.moved for r in rb.sensitivity(df, "accuracy", ["flip_pred", "shuffle_pred", "drop_tail"]).collect()}
    assert got["flip_pred"] > rb.MATERIAL and got["shuffle_pred"] > rb.MATERIAL
    assert rb.perturbed(df, "shuffle_pred").count() == 40
    assert rb.perturbed(df, "drop_tail").count() == 32
    with pytest.raises(ValueError, match="apply"):
        rb.perturbed(df.drop("s"), "negate_score")
    oracle = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.4), (2, "a", 0.5), (2, "b", 0.4)], "g int, kind string, moved double")
    produced = spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.0), (2, "a", 0.3), (2, "b", 0.0)], "g int, kind string, moved double")
    assert [r.g for r in rb.constant_under(oracle, produced).collect()] == [1]


def test_invariances_and_fabrication(spark):
    rows = [("good", "mean", c, "base", c * 1.0) for c in range(4)] + [("good", "mean", c, "scale_pos", c * 1.5) for c in range(4)]
    rows += [("bad", "mean", c, "base", c * 1.0) for c in range(4)] + [("bad", "mean", c, "scale_pos", c + 9.0) for c in range(4)]
    rows += [("fixed", "accuracy", c, t, 0.9) for c in range(5) for t in ("base", "perm_samples")]
    df = spark.createDataFrame(rows, "target string, metric string, case int, tag string, value double")
    broken = {r.target for r in rb.metamorphic(df).where("broken").collect()}
    assert broken == {"bad"}
    assert [r.target for r in rb.fabricated(df).collect()] == ["fixed"]


def test_differential(spark):
    rows = [("ok", k, 1.0 * k, 1.0 * k, [9.0]) for k in range(4)] + [("conv", k, 2.0 * k + 1, 1.0 * k, [2.0 * k + 1]) for k in range(4)] + [("off", k, 5.0 * k + 3, 1.0 * k, [2.0 * k]) for k in range(4)]
    got = rb.differential(spark.createDataFrame(rows, "target string, case int, produced double, default double, conventions array<double>")).collect()
    assert {r.target for r in got if r.is_diverged} == {"off"}


@pytest.mark.parametrize(
    ("source", "level"),
    [
        ("import numpy as np\nnp.random.seed(0)\nnp.random.rand(3)", "deterministic"),
        ("np.random.rand(3)", "at_risk"),
        ("rng = default_rng()", "at_risk"),
        ("train_test_split(x, y, random_state=42)", "deterministic"),
        ("train_test_split(x, y, random_state=None)", "at_risk"),
        ("print(sum(range(3)))", "deterministic"),
        ("import time\ntime.time()", "at_risk"),
        ("  ", "unknown"),
    ],
)
def test_static_determinism(spark, source, level):
    assert rb.static_determinism(spark.createDataFrame([("r", source)], "repo string, source string")).first().level == level


def test_resolution():
    assert resolve.resolve("Accuracy Score", ["y_true", "y_pred"])[:2] == ("catalog", "catalog_accuracy")
    assert resolve.resolve("logloss", ["y_true", "y_prob"]) == ("recipe", "log_loss", {"q": "y_prob", "y": "y_true"})
    assert resolve.resolve("BERTScore", ["candidate"])[0] == "learned"
    assert resolve.resolve("nonsense", ["x"])[0] == "none"
    assert resolve.resolve("accuracy", ["x"])[0] == "none"


def test_recompute_by_name(spark):
    df = spark.createDataFrame([("c", 1, 1), ("c", 0, 1), ("c", 1, 1), ("c", 0, 0)], "call_id string, y_true int, y_pred int")
    row = resolve.recompute(df, "acc").first()
    assert (row.value, row.provenance) == (0.75, "catalog")
    assert resolve.recompute(df, "youden_j").first().value == pytest.approx(0.5)
    assert resolve.recompute(df, "comet") is None


def test_formulas(spark):
    df = spark.createDataFrame([("c", 1.0, 3.0), ("c", 2.0, 5.0)], "call_id string, a double, b double")
    assert resolve.formula(df, "sum(a * b) / nullif(sum(b), 0) + 1e0").first().value == pytest.approx(13 / 8 + 1)
    assert resolve.formula(df, "sum(a) / (sum(b) - 8)").first().value is None
    for bad in ("java_method(a)", "sum(secret)", "(SELECT 1)", "sum(a); DROP", "'x'", "reflect(a, b)", "current_user()"):
        with pytest.raises(ValueError, match="allowed"):
            resolve.check_formula(bad, df.columns)


def test_store_lookup(spark):
    store = spark.createDataFrame([("hit ratio", ["hr"], "share of cache hits", "avg(h)"), ("lag", None, "delay of replicas in seconds", "max(l)")], "metric string, aliases array<string>, text string, expression string")
    q = spark.createDataFrame([("HR",), ("lag",), ("lag delay of replicas in seconds",), ("zebra",)], "name string")
    got = {r.name: r.expression for r in resolve.lookup(q, store).collect()}
    assert got == {"hr": "avg(h)", "lag": "max(l)", "lag delay of replicas in seconds": "max(l)"}


def test_failures(spark):
    log = "Traceback\n  File x\nModuleNotFoundError: No module named y\n\n"
    row = spark.createDataFrame([(log,), ("",), ("CUDA error\nlast",)], "s string").select(resolve.failure(F.col("s")).alias("k"), resolve.error_line(F.col("s")).alias("l")).collect()
    assert [(r.k, r.l) for r in row] == [("missing-dep", "ModuleNotFoundError: No module named y"), ("errored", ""), ("needs-gpu", "last")]


def test_artifacts_and_caps(spark):
    claims = spark.createDataFrame([("a", "acc", "0.81"), ("b", "acc", "0.99"), ("c", "roc auc", "0.4")], "id string, metric string, value string")
    values = spark.createDataFrame([("accuracy", 0.81, 2, 0.6), ("roc_auc", 0.4, 2, 0.6)], "metric string, recomputed double, classes int, majority double")
    judged = resolve.artifact_verify(claims.withColumn("metric", F.replace("metric", F.lit("roc auc"), F.lit("auc"))), values)
    assert {r.id: r.verdict for r in judged.collect()} == {"a": vd.CONFIRMED, "b": vd.REFUTED, "c": vd.INVALIDATED}
    before = spark.createDataFrame([("a", vd.DISCOVERED), ("b", vd.CONFIRMED), ("z", vd.DISCOVERED)], "id string, verdict string")
    merged = resolve.merge_artifacts(before, judged)
    assert {r.id: r.verdict for r in merged.collect()} == {"a": vd.CONFIRMED, "b": vd.CONFIRMED, "z": vd.DISCOVERED}
    assert {r.verdict for r in resolve.cap_modified(merged, F.lit(True)).collect()} == {vd.REPRODUCED, vd.DISCOVERED}


def test_heads_and_strides(spark):
    claims = spark.createDataFrame([(str(k), "m", str(k), k / 10) for k in range(5)], "id string, metric string, value string, salience double")
    assert {r.id for r in resolve.verify_head(claims, 2).where("deep").collect()} == {"3", "4"}
    rows = spark.createDataFrame([("d", k) for k in range(10)], "dataset string, pos int")
    assert sorted(r.pos for r in resolve.strided(rows, 3).collect()) == [0, 3, 6]
    assert resolve.strided(rows, 20).count() == 10
