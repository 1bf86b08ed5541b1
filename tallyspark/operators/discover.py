"""Claims out of result files and text, deduplicated and ranked.

A claims relation has: metric, value (as written), context, location, source,
confidence, split; ``ranked`` adds id and salience.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.naming import map_metric
from ..plans.numbering import numbering

# Patterns of reported numbers, context columns, ranks of sources.
_NAME, _NUMBER = r"[A-Za-z][A-Za-z0-9 _\-/@()]{1,40}?", r"[-+]?\d*\.?\d+%?"
TABLE_ROW = rf"\|\s*({_NAME})\s*\|\s*({_NUMBER})\s*\|"
KEY_VALUE = rf"({_NAME})\s*[:=]\s*({_NUMBER})"
_METRIC = r"(balanced[\s_-]*accuracy|accuracy|acc|auroc|roc[\s_-]*auc|auc|f1[\s_-]*score|f1|f-score|matthews|mcc|kappa|rmse|mae|mse|r\^?2|r[\s_-]?squared|precision|recall|sharpe)"
_SPLIT = r"(?:test|testing|val|valid|validation|holdout|held[\s-]*out|train|training|overall|final|mean|average|macro|micro|weighted)"
METRIC_VALUE = rf"(?i){_METRIC}[\w\s,'\-]{{0,25}}?(?:\bof\b|\bwas\b|\bis\b|\bto\b|[:=])\s*([-+]?\d*\.?\d+\s*%?)"
VALUE_METRIC = rf"(?i)([-+]?\d*\.?\d+\s*%?)[\s-]+(?:{_SPLIT}[\s-]+){{0,2}}{_METRIC}"
CONTEXT = ("dataset", "data", "model", "method", "task", "name", "config", "split", "split_source", "group", "fold", "seed", "k", "encoder", "approach", "system", "run")
SOURCE_RANK = {"results-json": 1.0, "results-csv": 0.9, "table": 0.8, "text": 0.6, "prose": 0.45, "stdout": 0.4}
HEADLINE, TRAINING = ("test", "val", "holdout", "eval", "oos", "dev"), ("train", "training")
RESULT_FILES = ("results.json", "metrics.json", "result.json", "scores.json", "eval.json")
#: Weight of a source in the confidence of its claims, in the order in which they win.
_TEXT_SOURCES = (("table", TABLE_ROW, 1, 2, 1.0), ("text", KEY_VALUE, 1, 2, 0.85), ("prose", METRIC_VALUE, 1, 2, 0.7), ("prose", VALUE_METRIC, 2, 1, 0.7))


def _claim(df: DataFrame, name: Column, value: Column, source: Column, weight: Column, context: Column, *keep: str) -> DataFrame:
    mapped = df.withColumn("__m", map_metric(name)).where("__m.metric IS NOT NULL")
    return mapped.select(
        *keep,
        F.col("__m.metric").alias("metric"),
        F.trim(value).alias("value"),
        context.alias("context"),
        "location",
        source.alias("source"),
        (F.col("__m.confidence") * weight).alias("confidence"),
        F.col("__m.split").alias("split"),
    )


def from_text(texts: DataFrame) -> DataFrame:
    """Claims of texts (location, text): table rows, key and value, prose either way round."""
    found = []
    for order, (source, pattern, name, value, weight) in enumerate(_TEXT_SOURCES):
        get = lambda g: F.regexp_extract_all("text", F.lit(pattern), F.lit(g))  # noqa: B023, E731
        pairs = texts.select("location", F.posexplode(F.arrays_zip(get(name).alias("name"), get(value).alias("value"))).alias("pos", "m"))
        found.append(pairs.select("location", F.lit(order).alias("order"), "pos", "m.name", F.regexp_replace("m.value", r"\s+", "").alias("v"), F.lit(source).alias("src"), F.lit(weight).alias("weight")))
    both = reduce(DataFrame.unionByName, found)
    claims = _claim(both, F.col("name"), F.col("v"), F.col("src"), F.col("weight"), F.lit(""), "order", "pos")
    # the first mention of a value stands, structured ones before prose
    first = Window.partitionBy("location", "metric", "value").orderBy("order", "pos")
    return claims.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn", "order", "pos")


def from_csv(table: DataFrame, location: str) -> DataFrame:
    """Claims of a wide results table: columns named like metrics, rows labelled by id columns."""
    spark = table.sparkSession
    known = spark.createDataFrame([(c,) for c in table.columns], "name string").select("name", map_metric(F.col("name"))["metric"].alias("m")).where("m IS NOT NULL").collect()
    metrics = [r.name for r in known]
    labels = [c for c in table.columns if c.lower() in CONTEXT]
    if not metrics:
        return table.limit(0).select(*(F.lit(None).cast(t).alias(c) for c, t in (("metric", "string"), ("value", "string"), ("context", "string"), ("location", "string"), ("source", "string"), ("confidence", "double"), ("split", "string"))))
    context = F.concat_ws(" ", *(F.when(F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`").cast("string") != ""), F.concat(F.lit(f"{c}="), F.col(f"`{c}`").cast("string"))) for c in labels))
    cells = table.select(context.alias("ctx"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.trim(F.col(f"`{c}`").cast("string")).alias("v")) for c in metrics])).alias("x")).where("x.v IS NOT NULL AND x.v != ''")
    numeric = cells.where(F.col("x.v").try_cast("double").isNotNull())
    placed = numeric.withColumn("location", F.concat(F.lit(f"{location}::"), F.col("x.name"), F.when(F.col("ctx") != "", F.concat(F.lit(" ["), "ctx", F.lit("]"))).otherwise("")))
    return _claim(placed, F.col("x.name"), F.col("x.v"), F.lit("results-csv"), F.lit(1.0), F.col("ctx")).withColumn("confidence", F.lit(0.85)).withColumn("split", F.lit(None).cast("string"))


def from_json(numbers: DataFrame) -> DataFrame:
    """Claims of flattened JSON numbers (location, path, value as written)."""
    leaf = F.element_at(F.split("path", r"\."), -1)
    placed = numbers.withColumn("location", F.concat_ws("::", "location", "path"))
    return _claim(placed, leaf, F.col("value"), F.lit("results-json"), F.lit(1.0), F.lit(""))


def discover(parts: list[DataFrame]) -> DataFrame:
    """Union of claims: the most confident of each (metric, value, context), ordered, with ids."""
    both = reduce(DataFrame.unionByName, parts)
    best = Window.partitionBy("metric", "value", "context").orderBy(F.desc("confidence"), "source", "location")
    kept = both.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")
    order = [F.desc("confidence"), F.asc("metric"), F.asc("value"), F.asc("context"), F.asc("location")]
    numbered = numbering(kept, order, "place").withColumn("id", F.concat(F.lit("d"), F.col("place"), F.lit("_"), F.col("metric"))).drop("place")
    return numbered.withColumn("confidence", F.when(F.col("split").isin(*TRAINING), F.bround(F.col("confidence") * 0.5, 3)).otherwise(F.col("confidence")))


def salience(claims: DataFrame) -> DataFrame:
    """``claims`` with a score from 0 to 1 of how much a claim is the headline."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCE_RANK.items() for x in kv]), F.lower("source")), F.lit(0.5))
    split = F.lower(F.coalesce("split", F.lit("")))
    place = F.lower(F.coalesce("location", F.lit("")))
    score = (
        0.55 * rank
        + 0.30 * F.coalesce("confidence", F.lit(0.5))
        + F.when(split.isin(*HEADLINE), 0.12).when(split.isin(*TRAINING), -0.30).otherwise(0.0)
        + F.when(place.contains("readme") | place.contains("results.json") | place.contains("metrics.json"), 0.05).otherwise(0.0)
    )
    return claims.withColumn("salience", F.bround(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4))


def head(claims: DataFrame, n: int) -> DataFrame:
    """The n most salient claims."""
    return claims.orderBy(F.desc("salience"), "metric", "value").limit(n)


def claims_of_session(spark: SparkSession, text: str, location: str = "stdout") -> DataFrame:
    return from_text(spark.createDataFrame([(location, text)], "location string, text string"))
