"""Claims, binding, verdicts, leakage, stores, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import naming, tolerance
from tallyspark.operators import conventions, discover, leakage, verdict
from tallyspark.sources import files, stores
from tallyspark.streaming import reducers

BIND = "struct<occurrence:int,sink:string,site:string,label:string>"
CALLS = "run_index int, call_id string, seq long, metric string, sink string, site string, label string, user_site boolean, n long, result double"


@pytest.mark.parametrize(
    ("raw", "value", "decimals", "kind"),
    [("0.987", 0.987, 3, "plain"), ("98.7%", 0.987, 3, "percent"), ("2.3x", 2.3, 1, "factor"), ("1,234", 1234.0, 0, "plain"), ("1e-3", 0.001, None, "plain"), ("n/a", None, None, "plain"), ("", None, None, "plain")],
)
def test_parse_claim(spark, raw, value, decimals, kind):
    got = spark.createDataFrame([(raw,)], "raw string").select(tolerance.parse_claim(F.col("raw")).alias("c")).first().c
    assert (got.value, got.decimals, got.kind) == (pytest.approx(value) if value is not None else None, decimals, kind)


@pytest.mark.parametrize(("raw", "produced", "ok"), [("0.83", 0.8349, True), ("0.83", 0.8351, False), ("1", 0.9667, False), ("1000", 1000.4, True), ("83.1%", 0.83149, True), ("bad", 1.0, False), ("0.5", None, False), ("0.5", float("nan"), False)])
def test_claim_close(spark, raw, produced, ok):
    row = spark.createDataFrame([(raw, produced)], "raw string, p double")
    assert row.select(tolerance.claim_close(tolerance.parse_claim(F.col("raw")), F.col("p")).alias("ok")).first().ok is ok


def test_names(spark):
    names = [("Accuracy Score", "accuracy", None), ("val_f1", "f1", "val"), ("testing AUC", "roc_auc", "test"), ("nDCG@5 (linear)", "ndcg", None), ("auroc_mean", "roc_auc", None), ("peak_ram_mb", None, None), ("", None, None)]
    got = spark.createDataFrame([(n,) for n, *_ in names], "n string").select("n", naming.map_metric(F.col("n")).alias("m")).collect()
    assert [(r.n, r.m.metric, r.m.split) for r in got] == names


def claims(spark, rows):
    return spark.createDataFrame(rows, f"id string, metric string, split string, bind {BIND}")


def test_binding_never_looks_at_values(spark):
    calls = spark.createDataFrame(
        [
            (0, "a", 0, "accuracy_score", "s", "x", None, True, 100, 0.9),
            (0, "b", 1, "accuracy_score", "s", "x", None, True, 400, 0.8),
            (0, "c", 2, "f1", "t", "y", None, False, 100, 0.1),
            (0, "d", 3, "f1", "t", "y", None, True, 100, 0.2),
            (0, "e", 4, "mae", "u", "z", None, True, 10, 1.0),
            (0, "f", 5, "mae", "w", "z", None, True, 20, 2.0),
            (0, "g", 6, "mae", "w", "z", None, True, 30, 3.0),
        ],
        CALLS,
    )
    got = verdict.bind(
        claims(
            spark,
            [
                ("held", "acc", "test", None),
                ("train", "acc", "train", None),
                ("guess", "accuracy", None, None),
                ("own", "F1", None, None),
                ("open", "mae", None, None),
                ("second", "mae", None, (1, None, None, None)),
                ("beyond", "mae", None, (9, None, None, None)),
                ("none", "r2", None, None),
            ],
        ),
        calls,
    ).collect()
    found = {r.id: (r.status, r.call_id) for r in got}
    assert found == {
        "held": ("bound", "a"),
        "train": ("bound", "b"),
        "guess": ("bound_heuristic", "a"),
        "own": ("bound", "d"),
        "open": ("ambiguous", None),
        "second": ("bound", "f"),
        "beyond": ("unbound", None),
        "none": ("unbound", None),
    }


FACTS = "id string, metric string, value string, status string, produced double, recomputed double, sink string, k long, stable boolean, obs_lo double, obs_hi double, center double, lo double, hi double, enough boolean, validity struct<invalid:string,thin:string>"


@pytest.mark.parametrize(
    ("facts", "expected"),
    [
        (("0.83", "bound", 0.83, 0.83, 2, True), verdict.CONFIRMED),
        (("0.93", "bound", 0.83, 0.83, 2, True), verdict.REFUTED),
        (("0.83", "bound", 0.83, 0.70, 2, True), verdict.INVALIDATED),
        (("0.83", "bound", 0.83, None, 2, True), verdict.REPRODUCED),
        (("0.83", "bound", 0.83, 0.83, 1, True), verdict.REPRODUCED),
        (("0.83", "bound", 0.83, 0.83, 2, False), verdict.UNSTABLE),
        (("0.83", "unbound", None, None, None, None), verdict.INCONCLUSIVE),
        (("0.83", "ambiguous", None, None, None, None), verdict.INCONCLUSIVE),
        (("0.83", "bound", float("nan"), 0.83, 2, True), verdict.INCONCLUSIVE),
        (("0.83", "bound_heuristic", 0.83, 0.83, None, None), verdict.INCONCLUSIVE),
        (("0.93", "bound_heuristic", 0.83, 0.83, None, None), verdict.REFUTED),
    ],
)
def test_decide(spark, facts, expected):
    value, status, produced, recomputed, k, stable = facts
    row = ("c", "accuracy", value, status, produced, recomputed, "s", k, stable, 0.8, 0.9, 0.85, 0.7, 0.95, False, (None, None))
    assert verdict.decide(spark.createDataFrame([row], FACTS)).first().verdict == expected


def test_stochastic_claims(spark):
    rows = [(v, "accuracy", v, "bound", 0.83, 0.83, "s", 6, False, 0.80, 0.86, 0.83, 0.76, 0.90, True, (None, None)) for v in ("0.82", "0.99", "0.91")]
    got = {r.id: r.verdict for r in verdict.decide(spark.createDataFrame(rows, FACTS)).collect()}
    assert got == {"0.82": verdict.STOCHASTIC, "0.99": verdict.REFUTED, "0.91": verdict.INCONCLUSIVE}


def test_overlays_only_weaken(spark):
    levels = sorted(verdict.STRENGTH)
    rows = [(a, b) for a in levels for b in [*levels, None]]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", verdict.weaker(F.col("a"), F.col("b")).alias("w")).collect()
    assert all(verdict.STRENGTH[r.w] <= verdict.STRENGTH[r.a] for r in got)
    assert all(r.w == r.a for r in got if r.b is None)


def test_conventions_are_well_formed():
    assert conventions.violations() == []


def test_convention_is_found_and_nothing_else(spark):
    r = [0.01, -0.02, 0.03, 0.015, -0.01]
    df = spark.createDataFrame([("c", k, x) for k, x in enumerate(r)], "call_id string, pos int, r double")
    cells = conventions.cells(df, "sharpe")
    mean, sd = sum(r) / 5, (sum((x - sum(r) / 5) ** 2 for x in r) / 5) ** 0.5
    for value, hit in ((mean / sd * 252**0.5, True), (1.2345, False)):
        found = conventions.search(spark.createDataFrame([("c", value)], "g string, produced double"), cells).collect()
        assert bool(found) is hit
    assert "252" in conventions.search(spark.createDataFrame([("c", mean / sd * 252**0.5)], "g string, produced double"), cells).first().convention


def test_discovery(spark, tmp_path):
    text = "| Accuracy | 0.831 |\nF1: 72.5%\nWe reach 96.67% accuracy; the AUC was 0.91.\npeak_ram: 512\n"
    got = {(r.metric, r.value, r.source) for r in discover.claims_of_session(spark, text).collect()}
    assert got == {("accuracy", "0.831", "table"), ("f1", "72.5%", "text"), ("accuracy", "96.67%", "prose"), ("roc_auc", "0.91", "prose")}
    (tmp_path / "results.json").write_text(json.dumps({"test": {"accuracy": 0.81, "loss": 2}, "f1": 0.5}))
    numbers = files.results_json(spark, str(tmp_path / "results.json"))
    found = discover.from_json(numbers)
    assert {(r.metric, r.value, r.location) for r in found.collect()} == {("accuracy", "0.81", "results.json::test.accuracy"), ("f1", "0.5", "results.json::f1")}
    (tmp_path / "results.csv").write_text("dataset,model,accuracy,auroc,note\niris,a,0.9,0.95,x\nwine,b,,0.7,y\n")
    table = discover.from_csv(files.results_csv(spark, str(tmp_path / "results.csv")), "results.csv")
    assert {(r.metric, r.value, r.context) for r in table.collect()} == {("accuracy", "0.9", "dataset=iris model=a"), ("roc_auc", "0.95", "dataset=iris model=a"), ("roc_auc", "0.7", "dataset=wine model=b")}
    ranked = discover.salience(discover.discover([found, table]))
    best = discover.head(ranked, 1).first()
    assert best.source == "results-json" and ranked.select("id").distinct().count() == ranked.count()


def test_predictions(spark, tmp_path):
    (tmp_path / "p.csv").write_text("label,probability\n1,0.9\n0,0.2\n")
    got = files.predictions_csv(spark, str(tmp_path / "p.csv")).collect()
    assert [(r.y_true, r.y_pred, r.y_score) for r in got] == [(1.0, 0.9, 0.9), (0.0, 0.2, 0.2)]
    (tmp_path / "q.csv").write_text("a,b\n1,2\n")
    assert files.predictions_csv(spark, str(tmp_path / "q.csv")) is None


def test_captured_calls(spark, tmp_path):
    line = {"call_id": "c", "metric": "acc", "result": 0.5, "inputs": {"y_true": [1, 0], "y_pred": [1, 1]}, "user_site": True, "n": 2, "seq": 0}
    (tmp_path / "calls.jsonl").write_text(json.dumps(line) + "\n{broken\n")
    calls = files.captured_calls(spark, str(tmp_path / "calls.jsonl"))
    assert calls.count() == 1
    wide = files.wide_inputs(calls, ["y_true", "y_pred"]).orderBy("pos").collect()
    assert [(r.y_true, r.y_pred) for r in wide] == [(1.0, 1.0), (0.0, 1.0)]


def test_split_pairs(spark):
    paths = [("/r/iris_train.csv",), ("/r/iris_test.csv",), ("/r/wine/train.csv",), ("/r/wine/test.csv",), ("/r/odd_train.csv",)]
    got = files.split_pairs(spark.createDataFrame(paths, "path string")).collect()
    assert {r.dataset for r in got} == {"iris", "wine"}


def test_near_leakage_of_whole_texts(spark):
    head, *tails = (" ".join(str(k * k * 7919 + 31) for k in range(a, b)) for a, b in ((0, 500), (900, 2400), (3000, 4500)))
    train = spark.createDataFrame([(f"{head} {tails[0]}",), ("ab",), (None,)], "row string")
    test = spark.createDataFrame([(f"{head} {tails[1]}",), (f"other {tails[0]} {head}",), ("ab",), ("",)], "row string")
    assert len(head) > 4000
    assert {r.r[:5]: r.best for r in leakage.near_pairs(train, test).collect()}.keys() == {"other", "ab"}


def test_leakage(spark):
    train = spark.createDataFrame([("ACGTACGTACGTACGTACGTACGA",), (" exact row ",)], "row string")
    test = spark.createDataFrame([("ACGTACGTACGTACGTACGTACGAT",), ("exact row",), ("GGGGCCCCTTTTAAAA",), (None,)], "row string")
    assert leakage.exact_overlap(train, test).first().n_overlap == 1
    assert leakage.homology_overlap(train, test).first().n_overlap == 2
    assert {r.kind for r in leakage.findings(train, test, sequences=True).collect()} == {"duplicate rows", "near-duplicate sequences"}


def test_anomaly(spark):
    history = spark.createDataFrame([("k", float(x)) for x in range(20)] + [("few", 1.0)], "key string, value double")
    got = {r.key + str(r.value): r.is_outlier for r in verdict.anomalies(spark.createDataFrame([("k", 10.0), ("k", 100.0), ("few", 9.0)], "key string, value double"), history).collect()}
    assert got == {"k10.0": False, "k100.0": True, "few9.0": False}


def test_stores(spark, tmp_path):
    path = str(tmp_path / "refs")
    for seq in range(3):
        stores.append_references(spark.createDataFrame([("My Data!", "acc", seq / 10, seq)], "dataset string, metric string, value double, seq long"), path)
    assert sorted(r.value for r in stores.references(spark, path, kept=2).collect()) == [0.1, 0.2]
    chain = stores.chained(spark.createDataFrame([("s", k, f"r{k}") for k in range(4)], "series string, seq long, receipt string"))
    assert chain.count() == 4 and stores.broken(chain).count() == 0
    assert stores.broken(chain.withColumn("receipt", F.when(F.col("seq") == 2, "forged").otherwise(F.col("receipt")))).count() >= 1


def test_streaming_drawdown(spark, tmp_path):
    for k, part in enumerate([[(1, 0, 0.1), (2, 0, -0.5)], [(1, 1, -0.2), (1, 2, 0.05)]]):
        spark.createDataFrame(part, "g int, pos long, r double").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema("g int, pos long, r double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    run = reducers.max_drawdown(stream).writeStream.outputMode("update").format("memory").queryName("drawdowns").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    worst = spark.table("drawdowns").groupBy("g").agg(F.min("max_drawdown").alias("m")).collect()
    assert {r.g: round(r.m, 9) for r in worst} == {1: -0.2, 2: -0.5}


def test_streaming_exact(spark, tmp_path):
    spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0)], "g int, x double").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("g int, x double").parquet(str(tmp_path / "in"))
    writer = reducers.exact_on_batches(stream, str(tmp_path / "store"), ["column_median"], lambda df, epoch: seen.extend(df.collect()))
    writer.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert {r.g: r.value for r in seen} == {1: 1.5, 2: 5.0}
