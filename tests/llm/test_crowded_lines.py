"""Lines of one leaf and run that are unlike otherwise."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import line_dedup

from .test_texts import alike


def lines_of(rng, n, tokens, vocabulary):
    out = []
    for _ in range(n):
        if out and rng.random() < 0.3:  # one or more tokens from an earlier line changed
            line = list(rng.choice(out))
            for at in rng.sample(range(2, tokens), rng.randint(1, tokens // 4)):
                line[at] = f"n{rng.randrange(vocabulary)}".replace("0", "o").translate(str.maketrans("123456789", "abcdefghi"))
        else:
            line = ["same", "lead", *(f"w{rng.randrange(vocabulary)}".translate(str.maketrans("0123456789", "oabcdefghi")) for _ in range(tokens - 2))]
        out.append(line)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("tokens, vocabulary", [(6, 3), (12, 2), (12, 4), (20, 3)])
def test_longer_keys_lose_no_pair(spark, monkeypatch, tokens, vocabulary):
    monkeypatch.setattr(line_dedup, "WIDE", 3)
    lines = lines_of(random.Random(tokens * vocabulary), 120, tokens, vocabulary)
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    first = {}
    for k, x in enumerate(lines):
        first.setdefault(x, k)
    want = [any(first[o] < first[x] and alike(o.split(), x.split()) for o in first) or first[x] != k for k, x in enumerate(lines)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.report(docs).collect()}
    assert [bool(got[k]) for k in range(len(lines))] == want and 0 < sum(want) < len(lines)


def test_many_unlike_lines_of_one_run(spark):
    """Time grows with the lines, not with their square: 20,000 of them would make 200 million pairs."""
    base = spark.range(20_000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("same lead first run of words "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.translate(F.substring(F.sha2(F.concat("id", F.lit("-"), i).cast("string"), 256), 1, 12), "0123456789", "ghijklmnop")), " ")).alias("text"),
    )
    begin = time.time()
    assert line_dedup.report(base).where("n_dropped > 0").count() == 0
    assert time.time() - begin < 120
