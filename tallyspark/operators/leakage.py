"""Test rows that also stand in the training split: exactly, or nearly by k-mers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 6
SIMILARITY = 0.8
EXACT_LIMIT, NEAR_LIMIT = 0.01, 0.05
PIECE = 1_000


def row_text(*columns: str) -> Column:
    """Cells as one text: trimmed and joined by a bar."""
    return F.concat_ws("|", *(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns))


def exact_overlap(train: DataFrame, test: DataFrame, column: str = "row") -> DataFrame:
    """One row: n_test, n_overlap, overlap_frac."""
    seen = train.select(F.trim(F.col(column)).alias("r")).distinct().withColumn("hit", F.lit(1))
    joined = test.select(F.trim(F.col(column)).alias("r")).join(seen, "r", "left")
    return joined.agg(F.count(F.lit(1)).alias("n_test"), F.count("hit").alias("n_overlap")).withColumn("overlap_frac", F.coalesce(F.try_divide("n_overlap", "n_test"), F.lit(0.0)))


def kmers(texts: DataFrame, k: int = K) -> DataFrame:
    """Rows (id, m): distinct substrings of length k of whole texts ``r``; a shorter text stands for itself."""
    starts = lambda c, step: F.explode(F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1)), F.lit(step)))
    # by overlapping pieces, as finding a place takes time in proportion to the text before it
    pieces = texts.select("id", "r", starts("r", PIECE).alias("i")).select("id", F.substr("r", "i", F.lit(PIECE + k - 1)).alias("piece"))
    return pieces.select("id", "piece", starts("piece", 1).alias("i")).select("id", F.substr("piece", "i", F.lit(k)).alias("m")).distinct()


def near_pairs(train: DataFrame, test: DataFrame, column: str = "row", k: int = K, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct test texts with a training text of Jaccard similarity over k-mers: (r, best).

    Prefix filter: sets that are similar share one of their first n - ceil(s n) + 1
    k-mers in a common order, rarest first, so that only those are joined; the
    similarity is then computed on whole sets. No candidate and no text is cut off.
    """
    rows = lambda df, side: df.select(F.trim(F.col(column)).alias("r"), F.lit(side).alias("side"))
    both = rows(train, 0).unionByName(rows(test, 1)).where("r IS NOT NULL").distinct().withColumn("id", F.sha2("r", 256))
    grams = kmers(both.select("id", "r").distinct(), k)
    sizes = grams.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("id").orderBy("count", "m")
    ranked = grams.join(grams.groupBy("m").count(), "m").withColumn("place", F.row_number().over(order)).join(sizes, "id")
    prefix = ranked.where(F.col("place") <= F.col("n") - F.ceil(similarity * F.col("n")) + 1).join(both.select("id", "side"), "id")
    left = prefix.where("side = 0").select("m", F.col("id").alias("a"), F.col("n").alias("na"))
    right = prefix.where("side = 1").select("m", F.col("id").alias("b"), F.col("n").alias("nb"))
    sized = (F.col("na") >= similarity * F.col("nb")) & (F.col("nb") >= similarity * F.col("na"))
    pairs = left.join(right, "m").where(sized).select("a", "b", "na", "nb").distinct()
    common = pairs.join(grams.select(F.col("id").alias("a"), "m"), "a").join(grams.select(F.col("id").alias("b"), "m"), ["b", "m"])
    shared = common.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    scored = shared.withColumn("s", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).where(F.col("s") >= similarity)
    best = scored.groupBy(F.col("b").alias("id")).agg(F.max("s").alias("best"))
    return both.where("side = 1").join(best, "id").select("r", "best")


def homology_overlap(train: DataFrame, test: DataFrame, column: str = "row", k: int = K, similarity: float = SIMILARITY) -> DataFrame:
    """One row: n_test, n_overlap, overlap_frac, over all test rows."""
    near = near_pairs(train, test, column, k, similarity).withColumn("hit", F.lit(1))
    joined = test.select(F.trim(F.col(column)).alias("r")).join(near, "r", "left")
    return joined.agg(F.count(F.lit(1)).alias("n_test"), F.count("hit").alias("n_overlap")).withColumn("overlap_frac", F.coalesce(F.try_divide("n_overlap", "n_test"), F.lit(0.0)))


def findings(train: DataFrame, test: DataFrame, sequences: bool = False, column: str = "row") -> DataFrame:
    """Rows (kind, magnitude): leaks over their limits, each invalidating a held-out claim."""
    out = exact_overlap(train, test, column).where(F.col("overlap_frac") >= EXACT_LIMIT).select(F.lit("duplicate rows").alias("kind"), F.col("overlap_frac").alias("magnitude"))
    if sequences:
        near = homology_overlap(train, test, column).where(F.col("overlap_frac") >= NEAR_LIMIT)
        out = out.unionByName(near.select(F.lit("near-duplicate sequences").alias("kind"), F.col("overlap_frac").alias("magnitude")))
    return out
