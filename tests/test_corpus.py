"""Corpora, meta-evaluation, generated cases, listings, experience."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import corpus, robustness
from tallyspark.operators import verdict as vd
from tallyspark.plans.evaluate import evaluate
from tallyspark.sources import files, stores

YAML = """
repos:
  - name: a
    meta: {domain: ml, tier: T1, split: dev, license: MIT, commit_date: 2026-01-01}
    claims: [{id: acc, metric: accuracy, value: "0.80", expect: CONFIRMED}, {id: x, metric: f1, value: "0.5"}]
  - name: a
    meta: {domain: cooking, tier: T2, split: dev, commit_date: unknown}
"""


def test_corpus(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "repos.yaml").write_text(YAML)
    specs = corpus.load(spark, str(tmp_path / "repos.yaml"))
    assert {(r.name, r.what) for r in corpus.violations(specs).collect()} == {("a", "domain"), ("a", "license"), ("a", "duplicate name")}
    assert [(r.id, r.value) for r in corpus.graded(specs).collect()] == [("acc", "0.80")]
    assert {(r.domain, r.tier): r.n for r in corpus.distribution(specs).collect()}[None, None] == 2


def test_rates(spark):
    rows = [("a", True, 2.0, True, vd.CONFIRMED, vd.CONFIRMED), ("a", True, 2.0, True, vd.CONFIRMED, vd.REFUTED), ("b", False, 1.0, None, None, None), ("c", True, 1.0, False, vd.INCONCLUSIVE, None)]
    got = corpus.rates(spark.createDataFrame(rows, "name string, ran boolean, seconds double, bound boolean, verdict string, expect string")).first()
    assert (got.repos, got.reproduction_rate, got.claims, got.graded, got.verdict_accuracy, got.false_confirms) == (3, 0.667, 3, 2, 0.5, 1)


def test_injections_are_caught(spark):
    truth = spark.createDataFrame([(f"c{k}", "accuracy", 0.5 + k / 40) for k in range(10)], "id string, metric string, true double")
    claims = corpus.injections(truth)
    facts = claims.select(
        "id", "metric", "value", "kind", "rel", F.lit("bound").alias("status"), F.col("true").alias("produced"), F.col("true").alias("recomputed"), F.lit("s").alias("sink"), F.lit(2).alias("k"), F.lit(True).alias("stable"),
        *(F.col("true").alias(c) for c in ("obs_lo", "obs_hi", "center", "lo", "hi")), F.lit(False).alias("enough"), F.expr("named_struct('invalid', CAST(NULL AS STRING), 'thin', CAST(NULL AS STRING))").alias("validity"),
    )
    got = {(r.kind, r.rel): r for r in corpus.score(vd.decide(facts)).collect()}
    assert got["honest", 0.0].confirmed == 1 and got["misreport", 0.15].refuted == 1
    assert got["misreport", 0.15].confirmed == 0 and got["sweep", 1e-3].refuted == 1


FAMILY = {"labels": ("accuracy", "catalog_accuracy"), "ranking": ("roc_auc", "catalog_roc_auc"), "regression": ("rmse", "catalog_rmse"), "finance": ("sharpe", "catalog_sharpe"), "values": ("variance", "catalog_variance"), "pairs": ("correlation", "catalog_correlation")}


@pytest.mark.parametrize("family", sorted(FAMILY))
def test_trusted_metrics_keep_their_invariances(spark, family):
    metric, recipe = FAMILY[family]
    base = corpus.cases(spark, family, 4)
    parts = []
    for tag in ["base", *robustness.RELATIONS[metric]]:
        out = evaluate(corpus.variant(base, tag), [recipe], key="case")
        parts.append(out.select(F.lit("t").alias("target"), F.lit(metric).alias("metric"), F.col("g").alias("case"), F.lit(tag).alias("tag"), "value"))
    got = robustness.metamorphic(reduce(DataFrame.unionByName, parts)).collect()
    assert got and all(r.n == 4 and r.violated == 0 for r in got)


def test_seed_effect(spark):
    rows = [("a", False, 1.0), ("a", False, 2.0), ("a", True, 1.5), ("a", True, 1.5), ("b", False, 1.0), ("b", False, 1.0), ("c", False, 1.0), ("c", False, 2.0), ("c", True, 3.0), ("c", True, 4.0)]
    got = {r.target: r.effect for r in corpus.seed_effect(spark.createDataFrame(rows, "target string, seeded boolean, value double")).collect()}
    assert got == {"a": "seed-controlled", "b": "deterministic", "c": "irreducibly random"}


def test_listings(spark, tmp_path):
    root = tmp_path / "repo"
    for name in ("m.csv", "results/r.csv", "preds/p.csv", "deep/er/x.csv", "notes.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("y_true,y_pred\n1,1\n" if "p.csv" in name else "a,b\n1,2\n")
    found = files.listing(spark, str(root))
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.candidate_csvs(found, str(root)).collect()) == ["m.csv", "r.csv"]
    predictions = files.prediction_files(spark, found, str(root))
    assert [p.rsplit("/", 1)[1] for p, _ in predictions] == ["p.csv"] and predictions[0][1].count() == 1
    assert files.sequence_column(["id", "DNA", "label"]) == "DNA" and files.sequence_column(["label", "v"]) == "v"
    (root / "t.csv").write_text("id,seq\n1,ACGT\n2,GG\n")
    assert [r.row for r in files.split_rows(spark, str(root / "t.csv")).orderBy("pos").collect()] == ["ACGT", "GG"]


def test_calls_round_trip(spark, tmp_path):
    calls = spark.createDataFrame([("c", "acc", 0.5, {"y_true": [1.0]}, True, 1, 0)], "call_id string, metric string, result double, inputs map<string,array<double>>, user_site boolean, n long, seq long")
    files.write_calls(calls, str(tmp_path / "log"))
    files.write_calls(calls, str(tmp_path / "log"))
    back = files.captured_calls(spark, str(tmp_path / "log"), run_index=3)
    assert back.count() == 2 and back.first().inputs == {"y_true": [1.0]} and back.first().run_index == 3


def test_experience(spark, tmp_path):
    schema = "key string, kind string, payload string, success boolean, seq long"
    path = str(tmp_path / "bank")
    stores.bank(spark.createDataFrame([("k", "plan", "good", True, 1), ("k", "plan", "good", True, 2), ("k", "plan", "new", True, 3), ("k", "plan", "bad", False, 4)], schema), path)
    assert stores.experience(spark, path).first().payload == "good"
    with pytest.raises(ValueError, match="known_value"):
        stores.bank(spark.createDataFrame([("k", "known_value", "0.9", True, 1)], schema), path)
