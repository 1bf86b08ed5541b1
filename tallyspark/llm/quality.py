"""Quality classifier on supervised subword embeddings.

Every word, word n-gram and run of three or four bytes hashes to a learned vector; a
document is the mean of its features' vectors, and a softmax over the classes reads
that mean. Word pairs are hashed by their words; word n-grams of the ``ALIKE`` lengths
by which of their words are the same, whatever they are, so that repetition in words
never seen is a feature like any other. Vectors and output weights are trained together
by stochastic gradient descent in numpy on at most ``SAMPLE_DOCS`` labelled
documents (the first by a hash of the id), whose whole texts are turned into
feature counts on the executors. For scoring, vectors and output weights multiply
out to one number per feature and class, which is exact, as both are linear.

Only texts are read by a score: letter case and punctuation are kept, as they
tell good from bad; labels, language, source and id are not inputs.

Edge cases: null and blank texts have no features and score by the bias, which is
trained with them; rows without a label aren't learned from; several labels of
one document count as the least of them; without any label every score is 0.5;
texts of any length are read whole, ``_PIECE`` bytes at a time; repeated rows are all
scored; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 3_000
BUCKETS = 1 << 15
WIDTH = 16
ALIKE = (2, 4, 8)
EPOCHS = 12
RATE = 4.0
SEED = 42
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
_PIECE = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x.astype(np.uint32) + np.uint32(salt)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    return ((x * np.uint32(0x85EBCA77)) >> np.uint32(17)).astype(np.int64)


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in pieces that end at a blank."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + _PIECE)
        end = blank.start() if blank else len(text)
        yield text[at:end].split()
        at = end


def features(text: bytes | None) -> Iterator[np.ndarray]:
    """Buckets of the text's features, in pieces of bounded size."""
    text, last = text or b"", None
    if not text.strip():
        return
    for piece in _words(text):
        words = np.array([crc32(w) for w in piece], np.uint32)
        yield _hash(words, 1)
        # n-grams over the end of a piece belong to the next one
        row = words if last is None else np.concatenate([last, words])
        begun = 0 if last is None else len(last)
        pairs = row[max(0, begun - 1) :]
        yield _hash(pairs[:-1] * np.uint32(31) + pairs[1:], 2)
        # how far back the same word is, 0 if not within the longest n-gram
        back = np.zeros(len(row), np.int64)
        for lag in range(min(ALIKE[-1], len(row)) - 1, 0, -1):
            back[lag:][row[lag:] == row[:-lag]] = lag
        for n in ALIKE:
            # one bit for each place whose word stands earlier in the n-gram
            end = np.arange(max(n - 1, begun), len(row))
            same = sum(((back[end - j] > 0) & (back[end - j] < n - j)).astype(np.uint32) << np.uint32(j) for j in range(n - 1))
            yield _hash(same + np.uint32(n << 16), 5)
        last = row[-ALIKE[-1] + 1 :]
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(data), _PIECE):
        # the next piece's first bytes belong to the runs that begin in this one
        d = data[at : at + _PIECE + 3].astype(np.uint32)
        three = d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16)
        yield _hash(three[:_PIECE], 3)
        yield _hash(three[:-1] | d[3:] << np.uint32(24), 4)


def counts(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for f in features(text):
        total += np.bincount(f, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int], classes: int = 2, width: int = WIDTH, epochs: int = EPOCHS, rate: float = RATE) -> np.ndarray:
    """Weight of each feature for each class; the last row is the bias."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / width, 1 / width, (BUCKETS, width))
    out, bias = np.zeros((classes, width)), np.zeros(classes)
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            at, n = docs[k]
            share = n / n.sum() if len(n) else n
            mean = share @ vectors[at] if len(n) else np.zeros(width)
            power = out @ mean + bias
            power = np.exp(power - power.max())
            error = power / power.sum()
            error[labels[k]] -= 1
            step = rate * (1 - done / steps)
            if len(n):
                back = error @ out
                vectors[at] -= step * share[:, None] * back * len(at) ** 0.5
            out -= step * 0.1 * np.outer(error, mean)
            bias -= step * 0.01 * error
            done += 1
    return np.vstack([vectors @ out.T, bias])


def score(text: bytes | None, weights: np.ndarray) -> np.ndarray:
    """Probability of each class."""
    power, n = np.zeros(weights.shape[1]), 0
    for f in features(text):
        power += weights[f].sum(axis=0)
        n += len(f)
    power = (power / n if n else power) + weights[-1]
    power = np.exp(power - power.max())
    return power / power.sum()


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [counts(x) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([a.astype(np.int16).tobytes() for a, _ in found], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in found], pa.binary()), b.column(2)],
            names=["label", "at", "n", "turn"],
        )


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn_from: Column | None = None, sample_docs: int = SAMPLE_DOCS) -> np.ndarray | None:
    """Weights from a bounded sample of labelled documents; None without any."""
    turn = F.xxhash64(F.lit("quality"), F.col("id"))
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    marked = marked if learn_from is None else marked.where(learn_from)
    chosen = marked.groupBy("id").agg(F.min("label").alias("label")).withColumn("turn", turn).orderBy("turn", "id").limit(sample_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body"))
    # at most sample_docs rows
    sample = texts.join(F.broadcast(chosen), "id").select("label", "body", "turn")
    rows = sample.mapInArrow(_sparse, "label int, at binary, n binary, turn long").orderBy("turn", "at", "n").limit(sample_docs).collect()
    if not rows:
        return None
    given = [(np.frombuffer(r["at"], np.int16).astype(np.int64), np.frombuffer(r["n"], np.int32).astype(float)) for r in rows]
    return train(given, [r["label"] for r in rows])


def fold(id_col: Column, folds: int = FOLDS) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row per document: held_out, score (probability of label 1), predicted."""
    weights = learn(docs, labels, id_col, text_col, learn_from=fold(F.col("id")) != HELD_OUT, **options)
    shared = docs.sparkSession.sparkContext.broadcast(None if weights is None else weights.astype(np.float32))
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(F.col(id_col)) == HELD_OUT, F.lit(False)).alias("held_out"), F.col(text_col).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        w = None if w is None else w.astype(np.float64)
        for b in batches:
            found = [0.5 if w is None else float(score(x.as_py(), w)[1]) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.float64())], names=["doc_id", "held_out", "score"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
