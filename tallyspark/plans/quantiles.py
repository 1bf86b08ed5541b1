"""Exact quantiles of groups of any size, by narrowing brackets.

An exact percentile aggregate keeps every distinct value of a group in one buffer. Here
each wanted place of a group's order has a bracket of values. In every round one
aggregation sketches the values inside the brackets (a summary of bounded size, partial
and final), the cuts next to the place become the new bracket, and a second one counts what
is below and inside. Brackets shrink a few hundredfold a round; once a bracket holds ``FEW``
rows, or copies of one value only, those are sorted. The result is exact whatever the
sketch says: a bracket that misses its place by the counts is not taken.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: Rows of a bracket that are sorted at once.
FEW = 4_096
CUTS, ACCURACY = 500, 20_000


def _counted(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """Brackets with the rows below and inside them."""
    x = F.col("x")
    counts = rows.join(brackets, "g").groupBy("g", "place").agg(F.count_if(x < F.col("lo")).alias("below"), F.count_if((x >= F.col("lo")) & (x <= F.col("hi"))).alias("inside"))
    return brackets.join(counts, ["g", "place"])


def order_statistics(rows: DataFrame, places: DataFrame, few: int = FEW) -> DataFrame:
    """Rows (g, place, value): the value at each ``place`` (from 0) of the ascending values of ``rows`` (g, x), for ``places`` (g, place)."""
    ends = rows.groupBy("g").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("inside"))
    open_ = written(places.join(ends, "g").withColumn("below", F.lit(0).cast("long")), "brackets")
    done = []
    while True:
        flat = F.col("lo") == F.col("hi")
        done.append(open_.where(flat).select("g", "place", F.col("lo").alias("value")))
        small = rows.join(open_.where(~flat & (F.col("inside") <= few)), "g").where("x >= lo AND x <= hi")
        turn = F.row_number().over(Window.partitionBy("g", "place").orderBy("x")) - 1
        done.append(small.withColumn("turn", turn).where("turn = place - below").select("g", "place", F.col("x").alias("value")))
        open_ = open_.where(~flat & (F.col("inside") > few))
        if open_.isEmpty():
            break
        shares = F.array(*[F.lit(k / CUTS) for k in range(CUTS + 1)])
        cuts = rows.join(open_, "g").where("x >= lo AND x <= hi").groupBy("g", "place").agg(F.percentile_approx("x", shares, ACCURACY).alias("cuts"))
        at = F.floor((F.col("place") - F.col("below")) / F.col("inside") * CUTS).cast("int")
        near = open_.join(cuts, ["g", "place"]).withColumn("at", at)
        lo = F.when(F.col("at") > 1, F.get("cuts", F.col("at") - 1)).otherwise(F.col("lo"))
        hi = F.when(F.col("at") < CUTS - 2, F.get("cuts", F.col("at") + 2)).otherwise(F.col("hi"))
        tried = _counted(rows, written(near.select("g", "place", lo.alias("lo"), hi.alias("hi")), "brackets"))
        held = (F.col("t.below") <= F.col("o.place")) & (F.col("o.place") < F.col("t.below") + F.col("t.inside")) & (F.col("t.inside") < F.col("o.inside"))
        both = open_.alias("o").join(tried.alias("t"), ["g", "place"])
        halves = [F.when(held, F.col(f"t.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("lo", "hi", "inside", "below")]
        then = written(both.select("g", "place", *halves, held.alias("held")), "brackets")
        stuck = then.where("NOT held").drop("held")
        # a bracket that a sketch can't narrow is split by value: exact, only slower
        split = _split(rows, stuck)
        open_ = written(then.where("held").drop("held").unionByName(split), "brackets")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _split(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """Brackets cut at the middle of their values; ends move to values that occur."""
    if brackets.isEmpty():
        return brackets
    x, middle = F.col("x"), F.col("lo") / 2 + F.col("hi") / 2
    inside = rows.join(brackets, "g").where("x >= lo AND x <= hi").withColumn("low", x <= middle)
    parts = inside.groupBy("g", "place", "below", "low").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("inside"))
    parts = parts.withColumn("skipped", F.when(F.col("low"), 0).otherwise(F.coalesce(F.sum(F.when(F.col("low"), F.col("inside"))).over(Window.partitionBy("g", "place")), F.lit(0))))
    parts = parts.withColumn("below", F.col("below") + F.col("skipped"))
    return parts.where("place >= below AND place < below + inside").select("g", "place", "lo", "hi", "inside", "below")


def exact_quantiles(t: DataFrame, qs: Iterable[float], key: str = "g", value: str = "x", few: int = FEW) -> DataFrame:
    """Rows (g, q, value): linear interpolation between the neighbours of place q * (n - 1). Nulls are skipped."""
    rows = written(t.select(F.col(key).alias("g"), F.col(value).cast("double").alias("x")).where("x IS NOT NULL"), "values")
    keyed = rows.where("g IS NOT NULL")
    asked = keyed.groupBy("g").agg(F.count("x").alias("n")).select("g", "n", F.explode(F.array(*[F.lit(float(q)) for q in sorted(set(qs))])).alias("q"))
    asked = asked.withColumn("at", F.col("q") * (F.col("n") - 1)).withColumn("low", F.floor("at")).withColumn("high", F.least(F.col("low") + 1, F.col("n") - 1))
    asked = written(asked, "quantiles")
    places = asked.select("g", F.explode(F.array("low", "high")).alias("place")).distinct()
    found = written(order_statistics(keyed, places, few), "order-statistics")
    of = lambda c: found.select("g", F.col("place").alias(c), F.col("value").alias(f"at_{c}"))
    part = F.col("at") - F.col("low")
    both = asked.join(of("low"), ["g", "low"]).join(of("high"), ["g", "high"])
    return both.select("g", "q", F.when(part == 0, F.col("at_low")).otherwise(F.col("at_low") + part * (F.col("at_high") - F.col("at_low"))).alias("value"))
