import duckdb
import pytest
from tests.conftest import same_rows

from tallyspark.llm import mixing as m


def filled(sizes, weights, cap):
    """Targets by giving shares again and again."""
    total, open_ = sum(sizes.values()), dict(zip(sizes, weights, strict=True))
    out = {}
    while open_:
        left = total - sum(out.values())
        shares = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if shares[s] > cap * sizes[s]]
        if not over:
            return out | shares
        for s in over:
            out[s] = cap * sizes[s]
            del open_[s]
    return out


def test_targets(spark):
    rows = [(k, "w " * n, s) for k, (n, s) in enumerate([(10, "a"), (400, "b"), (30, "c"), (1, "d"), (200, "e"), (90, None)])]
    got = {r.source_size: r.target for r in m.allotment(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    want = filled({10: 10, 400: 400, 30: 30, 1: 1, 200: 200, 90: 90}, [5, 2, 1, 5, 2, 1], 3)
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(731)


def test_against_sql(spark, docs):
    con = duckdb.connect()
    documents = docs.select("doc_id", "text", "source").dropDuplicates().toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con.register("documents", documents)
    got = m.allotment(docs.dropDuplicates()).toPandas()
    assert same_rows(got, con.sql(m.ORACLE_SQL).df())


def test_words_come_near_the_target(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = m.allotment(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    for _, part in got.groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= part["size"].max() / 2 + 1e-6
    assert (got["taken"] <= 3 * got["size"]).all()
    again = m.allotment(docs.repartition(7)).toPandas()
    assert same_rows(got.drop(columns="source"), again)


def test_all_bins_agree_with_one(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = m.allotment(docs).toPandas()
    monkeypatch.setattr(m, "BUCKETS", 1)
    assert same_rows(m.allotment(docs).toPandas(), want)


def test_edge_rows(docs, no_docs):
    assert m.allotment(no_docs).count() == 0
    got = m.mix(docs)
    assert got.columns[: len(docs.columns)] == docs.columns
    assert got.count() == docs.count()
    out = got.select("doc_id", "__mix_out.*").collect()
    assert all(r.taken == 0 for r in out if r["size"] == 0)
    assert {r.doc_id for r in out if r["size"] == 0} == {2, 3, 4}


def test_without_broadcast(docs, monkeypatch):
    want = m.allotment(docs).toPandas()
    monkeypatch.setattr(m, "BROADCAST_SOURCES", 0)
    assert same_rows(m.allotment(docs).toPandas(), want)
