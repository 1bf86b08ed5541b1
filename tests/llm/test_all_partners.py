"""Texts whose only similar partner has many nearer ones of its own."""

import random

import numpy as np
import pytest

from tallyspark.llm import simhash_dedup as s


def with_edits(rng, words, spots):
    out = list(words)
    for at in spots:
        out[at] = f"x{rng.randrange(10**9)}"
    return out


@pytest.mark.parametrize("crowd", [s.CROWD, 4])
def test_a_partner_of_one_among_near_copies(spark, crowd):
    """Twelve near copies of a text (0.98), and one text that is similar to that only (0.807; 0.792 to the copies)."""
    rng = random.Random(5)
    texts = []
    for _ in range(30):
        base = [f"w{rng.randrange(10**6)}" for _ in range(520)]
        spots = rng.sample(range(2, 518, 5), 23)
        texts += [base, with_edits(rng, base, spots[:11]), *(with_edits(rng, base, [at]) for at in spots[11:])]
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)]
    got = {r.doc_id for r in s.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd).collect()}
    assert got >= set(range(0, len(texts), 14))
    # bands catch 0.993 of such pairs
    assert len(got) <= 31


def test_overlaps_against_sets():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(common, rng.integers(0, 900)), rng.choice(common[:40], 20), rng.integers(0, 1 << 62, 5).astype(np.uint64)])) for _ in range(120)] + [common[:0]]
    left, right = np.arange(0, 80), np.arange(40, 121)
    want = [[len(set(sets[i].tolist()) & set(sets[j].tolist())) for j in right] for i in left]
    assert s.overlaps(sets, left, right).tolist() == want
