"""Near-duplicates in families whose texts are all close to the similarity asked for."""

import random

import numpy as np
import pytest

from tallyspark.llm import simhash_dedup as s

from .test_simhash import shingles


def dense_family(rng, n, planted, words=520, edits=8):
    """Texts of one template, each with its own edits: 0.73 to 0.79 all round; some once more with few further edits (0.8 to 0.9)."""
    base = [f"t{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for at in rng.sample(range(2, words - 2, 5), edits):
            text[at] = f"x{rng.randrange(10**7)}"
        out.append(text)
    for text in rng.sample(out, planted):
        near = list(text)
        for at in rng.sample(range(2, words - 2, 5), rng.choice([6, 8, 10])):
            near[at] = f"y{rng.randrange(10**7)}"
        out.append(near)
    return [" ".join(w) for w in out]


def brute_force(texts, limit=0.8):
    """Smallest text that each reaches over all pairs, by one product of incidence matrices."""
    sets = [shingles(t) for t in texts]
    column = {x: k for k, x in enumerate(set().union(*sets))}
    held = np.zeros((len(sets), len(column)), np.float32)
    for row, own in zip(held, sets, strict=True):
        row[[column[x] for x in own]] = 1
    both, size = held @ held.T, held.sum(1)
    similar = both / (size[:, None] + size - both)
    root = np.arange(len(sets))
    for _ in range(len(sets)):
        then = np.where(similar >= limit, root, len(sets)).min(1)
        if (then == root).all():
            break
        root = then
    return root, similar


@pytest.mark.parametrize("crowd", [s.CROWD, 12])
def test_recall_in_dense_families(spark, crowd):
    rng = random.Random(11)
    texts = dense_family(rng, 900, 100) + dense_family(rng, 150, 20)
    rng.shuffle(texts)
    root, similar = brute_force(texts)
    inside = similar[similar > 0.5]
    assert np.quantile(inside, 0.05) > 0.6 and np.median(inside) > 0.72
    want = {int(k) for k in np.flatnonzero(root == np.arange(len(texts)))}
    got = {r.doc_id for r in s.keep_representatives(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), crowd=crowd).collect()}
    assert want <= got
    removed, found = len(texts) - len(want), len(texts) - len(got)
    print("crowd", crowd, "removed by brute force", removed, "of", len(texts), "found", found)
    assert 100 < removed < 300
    assert found >= 0.9 * removed


def test_no_candidates(spark):
    rows = [(k, " ".join(f"w{k}-{i}" for i in range(30))) for k in range(5)]
    assert s.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).count() == 5
