"""Periodic runs against all periods at all places."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import period_runs


def plain_runs(words, exponent=4, least=6):
    """Maximal stretches of each period, shortest period first; a stretch with a shorter period isn't one of the longer."""
    found = set()
    n = len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q):
                stretch = words[i : i + length]
                if not any(all(stretch[k] == stretch[k + p] for k in range(length - p)) for p in range(1, q)):
                    found.add((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    """What the contract says of one document."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else None
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    dropped = {k for s, length, q in found for k in range(s + q, s + length)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    runs_sha = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest()
    collapsed = hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in dropped).encode()).hexdigest()
    best = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *best, runs_sha, collapsed)


words = st.lists(st.integers(0, 2), max_size=40)
periodic = st.builds(lambda a, p, k, b: a + p * k + b, words, st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(3, 9), words)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(words, periodic), min_size=1, max_size=5))
def test_refinement_finds_all_runs(docs):
    got = period_runs.runs([np.array(d, np.int64) for d in docs])
    assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(d) for d in docs]


@settings(max_examples=150, deadline=None)
@given(st.lists(periodic, min_size=1, max_size=3))
def test_refinement_finds_squares_too(docs):
    got = period_runs.runs([np.array(d, np.int64) for d in docs], 2, 2)
    assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(d, 2, 2) for d in docs]


def test_long_documents_use_few_steps():
    """A long text of one word, Fibonacci words and a text of random words: n log n steps, not n squared."""
    a, b = [0], [0, 1]
    while len(b) < 40_000:
        a, b = b, b + a
    random = np.random.default_rng(0).integers(0, 1000, 200_000)
    one, fibonacci, noise = period_runs.runs([np.zeros(50_000, np.int64), np.array(b), random])
    assert one.tolist() == [[0, 50_000, 1]]
    assert len(fibonacci) == 0 and len(noise) == 0  # Fibonacci words have no fourth powers


def test_packed_and_plain_order_agree():
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(0, 50, 1000) for _ in range(3))
    small, large = period_runs._sorted_groups(a, b, c, 50), period_runs._sorted_groups(a, b, c, 1 << 40)
    assert all((x == y).all() for x, y in zip(small, large, strict=True))


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=repr)


def test_report_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    short = docs.where("length(text) < 4000")
    want = [plain_row(r.doc_id, r.text) for r in short.collect()]
    assert any(w[1] for w in want)
    assert rows_of(period_runs.report(short)) == sorted(want, key=repr)


def test_edge_rows(docs, no_docs):
    want = [plain_row(r.doc_id, r.text) for r in docs.where("doc_id is null or doc_id <> 7").collect()]
    got = [r for r in rows_of(period_runs.report(docs)) if r[0] != 7]
    assert got == sorted(want, key=repr)
    assert period_runs.report(no_docs).count() == 0


def test_spans_and_collapsed_text(spark):
    text = "intro " + "\n".join(["buy now"] * 5) + " end end end end end end end"
    rows = [("a", text), ("b", None), ("c", "  \u0085x"), ("d", "")]
    got = {r.key: r for r in period_runs.detect(spark.createDataFrame(rows, "key string, body string"), "key", "body").collect()}
    assert [tuple(r) for r in got["a"].runs] == [(1, 10, 2), (11, 7, 1)]
    assert got["a"].collapsed == "intro buy now end"
    assert got["b"].runs == [] and got["b"].collapsed == "" and got["d"].collapsed == ""
    assert got["c"].collapsed == "  \u0085x"  # only blanks of ASCII part words


@pytest.mark.parametrize("words", [1, 50])
def test_batches_do_not_change_results(spark, monkeypatch, words):
    monkeypatch.setattr(period_runs, "BATCH_WORDS", words)
    texts = [" ".join("xy"[k % (2 + d % 2) % 2] for k in range(d * 7)) for d in range(12)]
    batches = list(period_runs._batches(texts))
    assert [b" ".join(d).decode() for b in batches for d in b] == texts
