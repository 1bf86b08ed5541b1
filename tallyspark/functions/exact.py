"""Sums of doubles without rounding error, whatever the partitioning.

A double is an integer of 53 bits times a power of two. ``parts`` adds those integers up
as decimals, for each key and bucket of sixteen exponents, and the partial sums of
their squares likewise; that is an ordinary aggregation, partial and final, whose result
does not depend on order. A key has at most 132 buckets. ``exact_moments`` puts them together in
whole numbers: sum, mean, variance and standard deviation are the doubles nearest to the true
values, with the neighbouring doubles that enclose these.

Decimals of 38 digits hold the buckets of 2^40 rows. Nulls are skipped; a key with a
value that is no finite number has no moments.
"""

from __future__ import annotations

from fractions import Fraction
from math import inf, isqrt, nextafter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Exponents of a bucket, and bits of the lower half of an integer that is squared.
SPAN, HALF = 16, 28
#: Every finite double is a multiple of 2 ** LEAST.
LEAST = -1200


def _power(k: Column) -> Column:
    return F.power(F.lit(2.0), k.cast("double"))


def _decimal(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def parts(t: DataFrame, key: str = "g", value: str = "x") -> DataFrame:
    """Rows (g, bucket, n, bad, s, hh, hl, ll): of each bucket the sums of integers, and of the products of their halves."""
    x = F.col("x__")
    t = t.select(F.col(key).alias("g"), F.col(value).cast("double").alias("x__")).where(x.isNotNull())
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    # a bit to spare on each side: the logarithm may be off at a power of two
    e = F.when(bad | (x == 0), 0).otherwise(F.floor(F.log2(F.abs(x)))).cast("int")
    t = t.select("g", bad.alias("bad"), F.when(bad, 0.0).otherwise(x).alias("x__"), e.alias("e"))
    up = F.lit(53) - F.col("e")
    half = F.floor(up / 2)
    whole = (F.col("x__") * _power(half) * _power(up - half)).cast("long")
    t = t.select("g", "bad", whole.alias("m"), (F.col("e") - 53 - LEAST).alias("q"))
    size = F.abs("m")
    t = t.select("g", "bad", "m", F.expr(f"q DIV {SPAN}").alias("bucket"), (F.col("q") % SPAN).alias("s"), F.shiftright(size, HALF).alias("hi"), size.bitwiseAND(F.lit((1 << HALF) - 1)).alias("lo"))
    once, twice = (_decimal(F.expr(f"shiftleft(1L, CAST({c} AS INT))")) for c in ("s", "2 * s"))
    add = lambda a, by: F.sum((_decimal(a) * by).cast("decimal(38,0)"))
    hi, lo = F.col("hi"), F.col("lo")
    return t.groupBy("g", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.max("bad").alias("bad"), add(F.col("m"), once).alias("s"), add(hi * hi, twice).alias("hh"), add(hi * lo, twice).alias("hl"), add(lo * lo, twice).alias("ll")
    )


def _enclosed(value: Fraction) -> tuple[float, float, float]:
    """The nearest double, and the doubles next to each other that have the value between them."""
    try:
        near = value.numerator / value.denominator
    except OverflowError:
        return (inf, 1.7976931348623157e308, inf) if value > 0 else (-inf, -inf, -1.7976931348623157e308)
    exact = Fraction(near)
    return near, near if exact <= value else nextafter(near, -inf), near if exact >= value else nextafter(near, inf)


def _root(value: Fraction) -> tuple[float, float, float]:
    """The same of a square root, from a whole root with at least 70 bits."""
    shift = max(0, 140 - value.numerator.bit_length() + value.denominator.bit_length()) // 2 + 1
    scaled = (value.numerator << (2 * shift)) // value.denominator
    root = isqrt(scaled)
    whole = root * root == scaled and scaled * value.denominator == value.numerator << (2 * shift)
    # between root and root + 1: half a unit more stands for all of them
    near, lo, hi = _enclosed(Fraction(2 * root + (0 if whole else 1), 2 << shift))
    return near, lo, hi


def moments(n: int, total: Fraction, squares: Fraction, ddof: int = 1) -> dict[str, tuple[float, float, float]]:
    """Nearest doubles and enclosures from the true sums."""
    out = {"sum": _enclosed(total)}
    if n:
        out["mean"] = _enclosed(total / n)
    if n > ddof:
        variance = (squares - total * total / n) / (n - ddof)
        out |= {"variance": _enclosed(variance), "stdev": _root(variance)}
    return out


def exact_moments(t: DataFrame, key: str = "g", value: str = "x", ddof: int = 1) -> DataFrame:
    """Rows (g, metric, n, value, lo, hi) of sum, mean, variance and stdev."""
    held = parts(t, key, value).groupBy("g").agg(F.sum("n").alias("n"), F.max("bad").alias("bad"), F.collect_list(F.struct("bucket", "s", "hh", "hl", "ll")).alias("held"))

    @F.pandas_udf("array<struct<metric: string, value: double, lo: double, hi: double>>")
    def finished(counts: pd.Series, buckets: pd.Series) -> pd.Series:
        def one(n: int, rows) -> list[dict]:
            total = squares = 0
            for r in rows:
                at = SPAN * r["bucket"]
                total += int(r["s"]) << at
                squares += ((int(r["hh"]) << 2 * HALF) + (int(r["hl"]) << HALF + 1) + int(r["ll"])) << 2 * at
            found = moments(int(n), Fraction(total) * Fraction(2) ** LEAST, Fraction(squares) * Fraction(2) ** (2 * LEAST), ddof)
            return [{"metric": k, "value": v, "lo": lo, "hi": hi} for k, (v, lo, hi) in found.items()]

        return pd.Series([one(n, rows) for n, rows in zip(counts, buckets, strict=True)])

    rows = held.where(~F.col("bad")).select("g", "n", F.explode(finished("n", "held")).alias("r"))
    return rows.select("g", "r.metric", "n", "r.value", "r.lo", "r.hi")
