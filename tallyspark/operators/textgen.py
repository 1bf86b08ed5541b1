"""BLEU and ROUGE by exploding n-grams: counts, clipped counts, one closed form.

Pairs of candidate and reference carry an id; the n-grams of both sides are
counted in one aggregation by (key, pair, order, gram), so nothing is joined.
"""

from __future__ import annotations

import re
import string

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.row_functions import _lcs


def tokens(text: Column, mode: str = "none", lowercase: bool = False) -> Column:
    """Tokens of a text: by white space, with punctuation apart (13a), or characters."""
    text = F.lower(text) if lowercase else text
    if mode == "char":
        return F.filter(F.split(F.replace(text, F.lit(" "), F.lit("")), ""), lambda c: c != "")
    if mode in ("13a", "intl"):
        text = F.regexp_replace(text, f"([{re.escape(string.punctuation)}])", " $1 ")
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def ngrams(words: Column, n: Column) -> Column:
    """All runs of n words; none if there are fewer."""
    count = F.size(words) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def clipped(df: DataFrame, orders: int, mode: str = "none", lowercase: bool = False, key: str = "g") -> DataFrame:
    """Per key, pair and order: n-grams of the candidate, of the reference, and shared ones.

    df: ``key``, pair, candidate, reference.
    """
    sides = df.select(F.col(key).alias("g"), "pair", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), tokens(F.col(c), mode, lowercase).alias("w")) for s, c in ((0, "candidate"), (1, "reference"))])).alias("x"))
    grams = sides.select("g", "pair", "x.side", F.explode(F.sequence(F.lit(1), F.lit(orders))).alias("n"), "x.w").select("g", "pair", "side", "n", F.explode(ngrams(F.col("w"), F.col("n"))).alias("gram"))
    by_gram = grams.groupBy("g", "pair", "n", "gram").agg(F.count_if(F.col("side") == 0).alias("c"), F.count_if(F.col("side") == 1).alias("r"))
    return by_gram.groupBy("g", "pair", "n").agg(F.sum("c").alias("cand"), F.sum("r").alias("ref"), F.sum(F.least("c", "r")).alias("shared"))


def bleu(df: DataFrame, max_order: int = 4, tokenize: str = "none", smooth: str = "none", scale: str = "unit", lowercase: bool = False, key: str = "g") -> DataFrame:
    """Corpus BLEU with one reference per candidate: rows (g, value)."""
    n = F.col("n")
    by_order = clipped(df, max_order, tokenize, lowercase, key).groupBy("g", "n").agg(F.sum("cand").alias("t"), F.sum("ref").alias("r"), F.sum("shared").alias("m"))
    wide = by_order.groupBy("g").agg(
        F.max(F.when(n == 1, F.col("t"))).alias("cand"),
        F.max(F.when(n == 1, F.col("r"))).alias("ref"),
        *(F.coalesce(F.max(F.when(n == k, F.col(c))), F.lit(0)).cast("double").alias(f"{c}{k}") for k in range(1, max_order + 1) for c in ("m", "t")),
    )
    precisions, misses = [], F.lit(0)
    for k in range(1, max_order + 1):
        m, t = F.col(f"m{k}"), F.col(f"t{k}")
        plain = F.when(t > 0, m / F.nullif(t, F.lit(0.0))).otherwise(0.0)
        if smooth in ("add1", "add-k"):
            plain = (m + 1) / (t + 1)
        elif smooth == "exp":
            gone = (m == 0) & (t > 0)
            misses = misses + gone.cast("int")
            plain = F.when(gone, 1 / (F.pow(F.lit(2.0), misses) * F.nullif(t, F.lit(0.0)))).otherwise(plain)
        elif smooth == "floor":
            plain = F.when(m == 0, 1e-9).otherwise(plain)
        precisions.append(plain)
    least = F.least(*precisions) if max_order > 1 else precisions[0]
    logs = sum((F.ln(F.greatest(p, F.lit(1e-300))) for p in precisions[1:]), F.ln(F.greatest(precisions[0], F.lit(1e-300))))
    brevity = F.when(F.col("cand") > F.col("ref"), 1.0).otherwise(F.exp(1 - F.col("ref") / F.nullif(F.col("cand"), F.lit(0))))
    value = F.when(least > 0, F.exp(logs / max_order)).otherwise(0.0) * brevity * (100 if scale == "percent" else 1)
    return wide.select("g", value.alias("value"))


def rouge_n(df: DataFrame, n: int, lowercase: bool = True, key: str = "g") -> DataFrame:
    """Mean ROUGE-n F over pairs, 0 for those without a shared n-gram: rows (g, value)."""
    per = clipped(df, n, "none", lowercase, key).where((F.col("n") == n) & (F.col("shared") > 0))
    f = per.groupBy("g").agg(F.sum(2 * F.col("shared") / (F.col("cand") + F.col("ref"))).alias("f"))
    pairs = df.select(F.col(key).alias("g"), "pair").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(f, "g", "left").select("g", (F.coalesce("f", F.lit(0.0)) / F.col("n")).alias("value"))


@F.pandas_udf(T.DoubleType())
def _lcs_f(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    def one(c: str, r: str) -> float:
        a, b = c.lower().split(), r.lower().split()
        return 2 * _lcs(a, b) / (len(a) + len(b)) if a and b else 0.0

    return pd.Series([one(c, r) for c, r in zip(candidate, reference, strict=True)], dtype="float64")


def rouge_l(df: DataFrame, key: str = "g") -> DataFrame:
    """Mean ROUGE-L F over pairs: rows (g, value)."""
    return df.groupBy(F.col(key).alias("g")).agg(F.avg(_lcs_f("candidate", "reference")).alias("value"))
