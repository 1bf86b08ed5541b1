"""Each stage on its own input, against plain Python versions of its decision."""

from zlib import crc32

import corpus_pipeline as p
from pyspark.sql import functions as F

from tallyspark.llm import language_id, mixing
from tests.llm.test_decontaminate import brute
from tests.llm.test_simhash import similar_classes
from tests.llm.test_texts import PlainLanguages, kept_lines


def test_stages(spark, sf_dir):
    docs = p.table(spark, sf_dir, "documents")
    columns = docs.columns
    plants = spark.createDataFrame([(900001, "12345 !!! 999", None, "src0", 13)], docs.schema)
    docs = docs.unionByName(plants)
    names = [n for n, _ in p.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "source_mixing"]
    bench = [tuple(r) for r in p.table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    for name, stage in p.STAGES:
        before = docs.orderBy("doc_id").collect()
        docs = p.stored(stage(spark, docs, sf_dir), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count()
        if name != "source_mixing":
            assert docs.columns == columns
        if name == "language_id":
            assert {r.doc_id for r in before} - after.keys() == {900001}
            plain = PlainLanguages([(r.lang, r.text) for r in before if r.lang is not None and r.text is not None and crc32(str(r.doc_id).encode()) % 4 != 2])
            found = {r.doc_id: plain.predict(r.text) for r in before}
            assert after.keys() == {i for i, (lang, score) in found.items() if lang != "und" and score >= 0.3}
        if name == "line_dedup":
            want = kept_lines({r.doc_id: r.text for r in before})
            assert {i: r.text for i, r in after.items()} == {i: t for i, t in want.items() if t.strip()}
            assert all(r.n_chars == len(r.text) for r in after.values())
        if name == "simhash_near_dedup":
            rows = [(r.doc_id, r.text) for r in before]
            assert after.keys() == {rows[k][0] for k in similar_classes(rows)}
        if name == "decontamination":
            assert after.keys() == {i for i, *_, bad in brute([(r.doc_id, r.text) for r in before], bench) if not bad}
        if name == "source_mixing":
            want = {r.doc_id: r.taken for r in mixing.allotment(spark.createDataFrame(before)).collect() if r.taken}
            assert {i: r.taken for i, r in after.items()} == want
    assert p.run(spark, sf_dir).select(F.count("doc_id")).first()[0] == len(after)


def test_a_stage_on_nothing(spark, docs, sf_dir):
    none = docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    for name, stage in p.STAGES:
        none = p.stored(stage(spark, none, sf_dir), name)
        assert none.count() == 0


def test_edge_rows_pass_through(spark, docs, sf_dir):
    df = docs
    for name, stage in p.STAGES[:-1]:
        df = p.stored(stage(spark, df, sf_dir), name)
        assert df.columns == docs.columns
    assert {r.doc_id for r in df.collect()} >= {0, 5}
    assert language_id.UNKNOWN not in {r.lang for r in df.collect()}
