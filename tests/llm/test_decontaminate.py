import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import decontaminate as d

BENCH = "item_id long, text string"


def words(text):
    low = "".join(c.lower() if c < "\x80" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, bench, window=13):
    pats = {}
    for ident, text in bench:
        w = words(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            pats.setdefault(tuple(w[k : k + size]), set()).add("null" if ident is None else str(ident))
    out = []
    for ident, text, *_ in rows:
        w = words(text)
        hit, items = set(), set()
        for size in {len(p) for p in pats}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in pats:
                    items |= pats[tuple(w[k : k + size])]
                    hit |= set(range(k, k + size))
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((ident, len(w), len(hit), len(items), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


ITEMS = [
    (1, "brown fox jumps over the lazy dog and runs away from here"),
    (2, "THE quick, brown fox jumps over the lazy dog and runs away"),
    (10, "Hund"),
    (10, "漢字 \U0001f600"),
    (None, "two words"),
    (3, None),
    (4, " - "),
    (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi"),
]


@pytest.mark.parametrize("part_words", [d.PART_WORDS, 12])
def test_against_brute_force(spark, docs, rows, part_words):
    bench = spark.createDataFrame(ITEMS, BENCH)
    got = d.report(docs, bench, part_words=part_words).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, ITEMS)


def test_kept_documents_are_untouched(spark, docs, rows):
    bench = spark.createDataFrame(ITEMS[:1], BENCH)
    kept = d.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    bad = {r[0] for r in brute(rows, ITEMS[:1]) if r[5]}
    assert bad == {0, 1}
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs.collect() if r.doc_id not in bad)


def test_empty_tables(spark, docs, no_docs):
    bench = spark.createDataFrame([], BENCH)
    assert d.report(no_docs, bench).count() == 0
    assert d.report(docs, bench).where("contaminated OR n_hit > 0 OR n_items > 0").count() == 0


def test_long_items_are_cut_into_segments(spark, monkeypatch):
    rng = random.Random(0)
    item = [f"w{rng.randrange(500)}" for _ in range(9000)]
    docs = spark.createDataFrame([(k, " ".join(item[at : at + 13])) for k, at in enumerate(range(0, 8987, 7))], BENCH.replace("item_id", "doc_id"))
    got = d.report(docs, spark.createDataFrame([(1, " ".join(item))], BENCH))
    assert got.where("n_items = 1 AND n_hit = 13").count() == docs.count()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=16), min_size=1, max_size=4), st.lists(st.sampled_from("abc"), max_size=60), st.integers(1, 13))
def test_wu_manber_finds_all(items, text, window):
    found, names = d.Matcher([(str(k), [w.encode() for w in i]) for k, i in enumerate(items)], window).search([w.encode() for w in text])
    want, hit = set(), set()
    for k, i in enumerate(items):
        size = min(window, len(i))
        for p in range(len(i) - size + 1):
            for q in range(len(text) - size + 1):
                if text[q : q + size] == i[p : p + size]:
                    want.add(str(k))
                    hit |= set(range(q, q + size))
    assert (set(found), names) == (hit, want)


def test_equal_windows_and_items_cost_no_more(spark):
    """A megabyte of one word, against items of that word alone, and many equal items."""
    begin = time.process_time()
    hit, names = d.Matcher([("long", [b"a"] * 4000), *((str(k), [b"a"] * 20) for k in range(2000))]).search([b"a"] * 500_000)
    assert len(hit) == 500_000 and len(names) == 2001
    assert time.process_time() - begin < 10
    docs = spark.createDataFrame([(1, "a " * 50)] * 3, BENCH.replace("item_id", "doc_id"))
    bench = spark.createDataFrame([(1, "a " * 20)] * 500, BENCH)
    assert {(r.n_hit, r.n_items) for r in d.report(docs, bench, part_words=40).collect()} == {(50, 1)}


def test_names_of_columns_and_parts_change_nothing(spark):
    df = spark.createDataFrame([(1, "x brown fox jumps over the lazy dog and runs away from here", {"a": 1}, "t", 2.0)], "doc_id long, text string, m map<string,int>, __text string, `a.b` double")
    bench = spark.createDataFrame([(k, f"item {k} of words that none has {k}") for k in range(30)], BENCH)
    for part_words in (10, d.PART_WORDS):
        kept = d.drop_contaminated(df, bench, part_words=part_words)
        assert kept.columns == df.columns and kept.collect() == df.collect()
