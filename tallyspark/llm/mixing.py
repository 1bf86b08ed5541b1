"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words: its share by weight, at most ``CAP`` times
what it has, the excess shared again by weight. A source that must give r times
its words gives floor(r) whole copies of each document with certainty. The rest
is a Pareto sample: document i has inclusion odds f / (1 - f) * sqrt(size_i /
mean size), f being the fraction of the source that is still wanted, so longer
documents are likelier; its rank is its random odds u / (1 - u) divided by those.
The documents of lowest rank are the sample.

The sample's fixed size is in words, so the cut is where the cumulative words in
rank order come nearest to the rest: the words taken from a source miss its target
by half of the document at the cut at most, over or under. No document is left out
or brought in for its size. No source is sorted as a whole: ranks fall into
``BUCKETS`` bins and the bin of the cut into as many again, words are summed by source
and bin, and only the last bin with the cut, about a millionth of a source, is
ordered. A cut is one (rank, doc_id) for each source.

Sources are numbered over a range partitioning, and their shares settle in rounds
of two sums, so no task has them all. Documents meet their source's row by
broadcast if there are at most ``BROADCAST_SOURCES`` sources; otherwise sources with
many documents do, and the rest are shuffled.

Random numbers are an MD5 of seed and doc_id: reruns agree.

Edge cases: a null text has size 0; size-0 documents take 0, and a source of such
documents only has target 0; a very long text counts like any other; a null source is a
source of its own, last in order; a null doc_id draws as the text "null"; rows
with the same doc_id and size fall on the same side of the cut; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own, partitions, spread_join, stored

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 42
BUCKETS = 1024
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"
OUT = "__mix_out"


def uniform(id_col: Column, seed: int = SEED) -> Column:
    """A number above 0 and below 1 that depends on the id and the seed only."""
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> list[Column]:
    """What the mix needs of a document: id, source (and a key of it that isn't null), size, random odds."""
    u, source = uniform(F.col(id_col)), F.col(source_col)
    return [
        F.col(id_col).alias("id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit("-")).alias("key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
        (u / (1 - u)).alias("drawn"),
    ]


def _numbered(per: DataFrame) -> DataFrame:
    """``per`` with the place ``turn`` of each source by code point, null last."""
    ranged = per.repartitionByRange(partitions(per.sparkSession), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "sources-by-range")
    # a row for each partition
    before, offsets = 0, [(0, 0)]
    for part, n in sorted(tuple(r) for r in ranged.groupBy("part").count().collect()):
        offsets.append((part, before))
        before += n
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for p in dict(offsets).items() for x in p]), F.col("part").cast("long"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ranged.withColumn("turn", offset + within - 1).drop("part")


def targets(drawn: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: its words, its target, whole copies, the rest wanted."""
    per = drawn.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n_docs"), F.count(F.lit(1)).alias("n"))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    ranked = stored(_numbered(per).withColumn("weight", weight).withColumn("limit", F.col("source_size") * cap), "weights")
    total, rate, left, open_ = ranked.agg(F.sum("source_size")).first()[0] or 0, F.col("limit") / F.col("weight"), None, None
    level = -1.0
    # sources below the level of the last round are at their limit; what they leave raises the level for the rest
    while True:
        full = rate < level
        given, weight_left = ranked.agg(F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight")))).first()
        left, open_ = total - (given or 0), weight_left
        if not open_ or left / open_ <= level:
            break
        level = left / open_
    target = F.when(rate < level, F.col("limit").cast("double"))
    target = target.otherwise(F.lit(float(left)) * F.col("weight") / F.lit(float(open_))) if open_ else F.col("limit").cast("double")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    share = F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        ranked.withColumn("target", target)
        .withColumn("whole", whole)
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .select("key", "n", "source_size", "target", "whole", "rest", (share / (1 - share)).alias("odds"), F.try_divide("source_size", "n_docs").alias("mean"))
    )


def _rank(size: Column, drawn: Column, odds: Column, mean: Column) -> Column:
    return drawn / (odds * F.sqrt(size / mean))


def _bin(rank: Column, bins: int) -> Column:
    # bins is a power of two, so the bins of the bins nest
    return F.floor(rank / (1 + rank) * bins).cast("long")


def _with_sources(rows: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    return rows.join(F.broadcast(sources.drop("n")), "key") if small else spread_join(rows, sources, "key").drop("n")


def cuts(drawn: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """``sources`` with the small bin of the cut and the last (rank, id) there that is taken."""
    wanted = sources.select("key", "n", "rest", "odds", "mean").where("odds > 0")
    rank = _rank(F.col("size"), F.col("drawn"), F.col("odds"), F.col("mean"))
    ranked = _with_sources(drawn.where("size > 0").select("key", "id", "size", "drawn"), wanted, small).select("key", "id", "size", "rest", rank.alias("q"))
    ranked = ranked.withColumn("below", F.lit(0).cast("long"))
    for bins in (BUCKETS, BUCKETS * BUCKETS):
        ranked = ranked.withColumn("bin", _bin(F.col("q"), bins))
        in_order = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        sums = ranked.groupBy("key", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("below").alias("below"))
        upto = sums.withColumn("upto", F.col("below") + F.sum("words").over(in_order))
        cut = upto.where("upto >= rest").groupBy("key").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("words")).alias("below")), "bin").alias("cut"))
        cut = stored(cut.select("key", F.col("cut.bin").alias("bin"), F.col("cut.below").alias("cut_below")), "bins")
        ranked = ranked.join(F.broadcast(cut) if small else cut, ["key", "bin"]).withColumn("below", F.col("cut_below")).drop("cut_below")
    # equal (rank, id) are taken or left together
    edge = ranked.groupBy("key", "q", "id").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"), F.first("below").alias("below"))
    middle = F.col("below") + F.sum("size").over(Window.partitionBy("key").orderBy("q", "id")) - F.col("size") / 2
    last = edge.withColumn("middle", middle).where("middle < rest").groupBy("key").agg(F.max(F.struct("q", "id")).alias("last"))
    return sources.join(cut.select("key", F.col("bin").alias("cut_bin")), "key", "left").join(last, "key", "left")


def _copies(f, small: Column, drawn: Column, ident: Column) -> Column:
    """Copies of a document; ``f`` gives the columns of its source's plan."""
    q = _rank(small, drawn, f("odds"), f("mean"))
    at = _bin(q, BUCKETS * BUCKETS)
    edge = (at == f("cut_bin")) & (F.struct(q.alias("q"), ident.alias("id")) <= f("last"))
    extra = F.when((small > 0) & (f("odds") > 0), (at < f("cut_bin")) | edge)
    return F.when(small > 0, f("whole") + F.coalesce(extra, F.lit(False)).cast("long")).otherwise(F.lit(0)).cast("long")


def _marked(rows: DataFrame, facts: str, drawn: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """``rows`` (key, facts and more) with the plan of their source."""
    sources = stored(targets(drawn, weights, cap), "plan")
    small = sources.count() <= BROADCAST_SOURCES
    plan = stored(cuts(drawn, sources, small), "cuts")
    joined = _with_sources(rows, plan.select("key", "n", F.struct(*(c for c in plan.columns if c not in ("key", "n"))).alias("plan")), small)
    copies = _copies(lambda c: F.col(f"plan.{c}"), F.col(f"{facts}.size"), F.col(f"{facts}.drawn"), F.col(f"{facts}.id"))
    out = F.struct(F.col(f"{facts}.size").alias("size"), F.col("plan.source_size").alias("source_size"), F.col("plan.target").alias("target"), copies.alias("copies"))
    return joined.withColumn("out", out).withColumn("out", F.col("out").withField("taken", F.col("out.size") * F.col("out.copies")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, out: str = OUT, **columns: str) -> DataFrame:
    """``docs`` with the struct ``out``: size, source_size, target, copies, taken."""
    facts = sized(docs, **columns)
    drawn = stored(docs.select(*facts), "sizes")
    rows = docs.select(F.struct(*own(docs)).alias("row"), F.struct(*facts).alias("facts")).withColumn("key", F.col("facts.key"))
    marked = _marked(rows, "facts", drawn, weights, cap)
    return marked.select("row.*", F.col("out").alias(out))


def allotment(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, **columns: str) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    drawn = stored(docs.select(*sized(docs, **columns)), "sizes")
    rows = drawn.select("key", F.struct("id", "size", "drawn").alias("facts"))
    return _marked(rows, "facts", drawn, weights, cap).select(F.col("facts.id").alias("doc_id"), *(F.col(f"out.{c}").alias(c) for c in ("size", "source_size", "target", "taken")))


#: The same mix, with one ordered sum over each source instead of bins.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) FILTER (size > 0) AS n_docs FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 3 * source_size AS lim,
             (sum(source_size) OVER ())::BIGINT AS total FROM s),
f AS (SELECT *, lim::DOUBLE / weight < (total - coalesce(sum(lim) OVER (ORDER BY lim::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / (sum(weight) OVER (ORDER BY lim::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS is_full FROM r),
l AS (SELECT *, (total - coalesce(sum(lim) FILTER (is_full) OVER (), 0))::DOUBLE AS rest_words, (sum(weight) FILTER (NOT is_full) OVER ())::DOUBLE AS open FROM f),
t AS (SELECT *, CASE WHEN is_full THEN lim::DOUBLE ELSE rest_words * weight / open END AS target FROM l),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT *, target - whole * source_size AS rest, CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0 END AS share FROM w),
j AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target, g.whole, g.rest, g.share,
             CASE WHEN d.size > 0 AND g.share > 0 THEN (d.u / (1 - d.u)) / ((g.share / (1 - g.share)) * sqrt(d.size::DOUBLE / (g.source_size::DOUBLE / g.n_docs))) END AS q
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, CASE WHEN q IS NOT NULL THEN sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id) END AS through,
             sum(size) OVER (PARTITION BY source, q, doc_id) AS own FROM j)
SELECT doc_id, size, source_size, target,
       size * CASE WHEN size > 0 THEN whole + CASE WHEN coalesce(through - own / 2.0::DOUBLE < rest, false) THEN 1 ELSE 0 END ELSE 0 END AS taken
FROM c
"""
