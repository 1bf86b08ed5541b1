"""Tables that grow: reference values, receipts in a hash chain, the graph of claims."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEPT = 5_000  # latest reference values of each key


def dataset_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def append_references(values: DataFrame, path: str) -> None:
    """Append (dataset, metric, value, seq) to the store."""
    values.select(dataset_key(F.col("dataset")).alias("dataset"), "metric", "value", "seq").write.mode("append").parquet(path)


def references(spark: SparkSession, path: str, kept: int = KEPT) -> DataFrame:
    """The latest values of each (dataset, metric)."""
    latest = Window.partitionBy("dataset", "metric").orderBy(F.desc("seq"))
    return spark.read.parquet(path).withColumn("rn", F.row_number().over(latest)).where(F.col("rn") <= kept).drop("rn")


_FORMULA = "metric string, aliases array<string>, text string, expression string"


def add_formulas(records: DataFrame, path: str) -> int:
    """Append formulas (metric, aliases, text, expression) as a new version of the store; returns its number.

    A version is a folder that is written once: of two writers at the same time one gets an
    error and starts again. Readers of earlier versions don't see it.
    """
    spark = records.sparkSession
    version = (spark.read.parquet(path).agg(F.max("version")).first()[0] if _exists(spark, path) else -1) + 1
    records.select("metric", F.col("aliases").cast("array<string>").alias("aliases"), "text", "expression").write.mode("errorifexists").parquet(f"{path}/version={version}")
    return version


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def formulas(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The formulas as of a version, or the latest: the last record of each metric, with its version."""
    every = spark.read.option("basePath", path).schema(f"{_FORMULA}, version int").parquet(path)
    seen = every if version is None else every.where(F.col("version") <= version)
    record = F.struct("aliases", "text", "expression", "version")
    return seen.groupBy("metric").agg(F.max_by(record, F.struct("version", "expression")).alias("x")).select("metric", "x.*")


def digest(*columns: str) -> Column:
    """SHA-256 of a canonical JSON object of the columns, keys in order."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def receipts(verdicts: DataFrame, *columns: str) -> DataFrame:
    """Verdict rows with their receipt."""
    return verdicts.withColumn("receipt", digest(*columns))


def chained(entries: DataFrame, series: str = "series") -> DataFrame:
    """Hash chain over receipts (series, seq, receipt): each entry covers all before it.

    One chain is sequential, so it is folded in one pass over its receipts.
    """
    kinds = dict(entries.dtypes)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["seq", "receipt"])
        out, h = [], ""
        for receipt in rows["receipt"]:
            h = hashlib.sha256((h + receipt).encode()).hexdigest()
            out.append(h)
        return rows.assign(entry=out)

    return entries.select(series, F.col("seq").cast("long").alias("seq"), "receipt").groupBy(series).applyInPandas(fold, f"{series} {kinds[series]}, seq long, receipt string, entry string")


def broken(chain: DataFrame, series: str = "series") -> DataFrame:
    """Entries whose hash doesn't follow from the one before."""
    before = F.coalesce(F.lag("entry").over(Window.partitionBy(series).orderBy("seq")), F.lit(""))
    return chain.withColumn("expected", F.sha2(F.concat(before, "receipt"), 256)).where("expected != entry")


def graph(claims: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind) and edges (src, dst, kind) of claims, metrics and their other names.

    claims: id, metric, verdict; aliases: alias, metric.
    """
    node = lambda df, c, kind: df.select(F.concat(F.lit(f"{kind}:"), F.col(c)).alias("id"), F.lit(kind).alias("kind")).distinct()
    nodes = node(claims, "id", "claim").unionByName(node(claims, "metric", "metric")).unionByName(node(claims, "verdict", "verdict")).unionByName(node(aliases, "alias", "alias")).unionByName(node(aliases, "metric", "metric")).distinct()
    edge = lambda df, a, ka, b, kb, kind: df.select(F.concat(F.lit(f"{ka}:"), F.col(a)).alias("src"), F.concat(F.lit(f"{kb}:"), F.col(b)).alias("dst"), F.lit(kind).alias("kind"))
    edges = edge(claims, "id", "claim", "metric", "metric", "measures").unionByName(edge(claims, "id", "claim", "verdict", "verdict", "has")).unionByName(edge(aliases, "alias", "alias", "metric", "metric", "names"))
    return nodes, edges


# What may be used again; known values are kept apart.
REUSABLE = ("plan", "targets", "conventions")


def bank(records: DataFrame, path: str) -> None:
    """Append reusable experience (key, kind, payload, success, seq); known values are refused."""
    bad = records.where(~F.col("kind").isin(*REUSABLE)).select("kind").first()
    if bad:
        raise ValueError(f"{bad.kind} isn't reusable experience")
    records.select("key", "kind", "payload", "success", "seq").write.mode("append").parquet(path)


def experience(spark: SparkSession, path: str) -> DataFrame:
    """The payload of each key and kind that did best: successes minus failures, then the latest."""
    per = spark.read.parquet(path).groupBy("key", "kind", "payload").agg(F.sum(F.when(F.col("success"), 1).otherwise(-1)).alias("balance"), F.max("seq").alias("seq"))
    return per.groupBy("key", "kind").agg(F.max_by("payload", F.struct("balance", "seq")).alias("payload"))
