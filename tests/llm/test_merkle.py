"""The manifest against a plain tree, and the monoid's laws."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import merkle_manifest as mm


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(fields):
    return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_tree(leaves):
    """Root, and for each leaf its siblings as (left, right) from below."""
    paths, level, of = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, at in enumerate(of):
            run = at // 3 * 3
            paths[i].append((level[run:at], level[at + 1 : run + 3]))
            of[i] = at // 3
        level = [h(*level[k : k + 3]) for k in range(0, len(level), 3)]
    return level[0], paths


def plain_manifest(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {}
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        leaves[s] = [plain_leaf(r) for r in sources[s]]
    trees = {s: plain_tree(leaves[s]) for s in order}
    root, top = plain_tree([trees[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for row, leaf, path in zip(sources[s], leaves[s], trees[s][1], strict=True):
            way = path + top[k]
            value = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                value = plain_leaf((*row[:4], row[4].replace("\n", "")))
            for left, right in way:
                value = h(*left, value, *right)
            proof = h(*(x for left, right in way for x in left + right))
            out.append((row[0], leaf, trees[s][0], root, proof, value, value == root))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def fields(docs):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]


def test_table_against_plain_tree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = rows_of(mm.report(docs))
    assert got == plain_manifest(fields(docs))
    assert {r[-1] for r in got} == {True, False}


def test_edge_rows(docs, no_docs):
    assert rows_of(mm.report(docs)) == plain_manifest(fields(docs))
    assert rows_of(mm.report(docs.where("doc_id = 5"))) == plain_manifest(fields(docs.where("doc_id = 5")))
    assert mm.report(no_docs).count() == 0


@pytest.mark.parametrize("parts", [1, 5, 40])
@pytest.mark.parametrize("sources", [["one"], ["a", "b", None], [f"s{k}" for k in range(70)]])
def test_ranges_do_not_change_the_tree(spark, parts, sources):
    rng = random.Random(parts)
    rows = [(k // 2, rng.choice(sources), "en", k, f"text {k % 90}\n") for k in range(300)]
    rows += [(5, sources[0], "en", 1, "copy")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = rows_of(mm.report(docs))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain_manifest(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=6), st.integers(0, 10**6))
def test_fragments_merge_in_any_order(sizes, seed):
    rng = random.Random(seed)
    leaves = {(t, 0, i): h(str(t), str(i)) for t, n in enumerate(sizes) for i in range(n)}
    of = dict(enumerate(sizes)) | {mm.TOP: len(sizes)}
    pieces = [{} for _ in range(rng.randint(1, 8))]
    for k, v in leaves.items():
        rng.choice(pieces)[k] = v
    while len(pieces) > 1:
        rng.shuffle(pieces)
        pieces.append(mm.merge(pieces.pop(), pieces.pop(), of))
    (root,) = mm.merge(pieces[0], {}, of).values()
    assert root == plain_tree([plain_tree([leaves[(t, 0, i)] for i in range(n)])[0] for t, n in enumerate(sizes)])[0]
