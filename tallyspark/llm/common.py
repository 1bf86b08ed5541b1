"""Shared helpers: tables in the shared folder, row keys, graph components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_DIR = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and the master is local does a temporary folder of this machine serve.
    """
    found = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tallyspark-")
    spark.conf.set(CHECKPOINT_DIR, made)
    return made


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs only the tasks that read the file.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` wrote and nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(conf).delete(at, True)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def own(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` as they are, whatever their names."""
    return [F.col(quoted(c)) for c in docs.columns]


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def plain_name(docs: DataFrame, column: str) -> str:
    """The name of a column in what ``mapped`` hands on."""
    return f"c{docs.columns.index(column)}"


def mapped(docs: DataFrame, run, *added: T.StructField) -> DataFrame:
    """``docs`` through ``mapInArrow``, with columns added; Spark's own can't take names with dots, so they are numbered for it."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    kinds = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)), *added])
    return docs.toDF(*names).mapInArrow(run, kinds).toDF(*docs.columns, *(f.name for f in added))


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once: inside a lambda it would be for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def row_hash(docs: DataFrame, seed: int) -> Column:
    """Hash of all columns of a row; maps, which have no hash, go by their JSON."""
    plain = [F.to_json(F.col(quoted(f.name))) if "map<" in f.dataType.simpleString() else F.col(quoted(f.name)) for f in docs.schema.fields]
    return F.xxhash64(F.lit(seed), *plain)


HOT_KEYS = 1_000


def size_marks(n: str = "n") -> list[Column]:
    """Aggregates that ``spread_join`` takes of ``sizes``: how many keys there are, the sum and the largest of their numbers of rows."""
    return [F.count(F.lit(1)), F.sum(n), F.max(n)]


def spread_join(rows: DataFrame, sizes: DataFrame, key: str, n: str = "n", marks: tuple[int, int | None, int | None] | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``sizes``, which has each key once and the number ``n`` of its rows.

    A key with more than one in ``HOT_KEYS`` of the rows goes by broadcast: there are
    fewer than ``HOT_KEYS`` of them, whatever the data. No key that is shuffled has
    more rows than that. Both sides should be stored tables, as they are read twice.
    marks: ``size_marks`` of ``sizes``, if that has numbers only; then one join serves
    where there are few keys or no large one.
    """
    if marks:
        keys, total, most = marks
        if keys <= HOT_KEYS:
            return rows.join(F.broadcast(sizes), key)
        if most * HOT_KEYS <= total:
            return rows.join(sizes, key)
    else:
        total = sizes.agg(F.sum(n)).first()[0]
    limit = (total or 0) / HOT_KEYS
    hot, rest = F.broadcast(sizes.where(F.col(n) > limit)), sizes.where(F.col(n) <= limit)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges ``(u, v)``: rows ``(u, root)``.

    Alternating large-star and small-star rounds: every round is a grouped
    minimum and an equi-join that deals nodes of very many edges out, so no component
    is ever gathered in one task, and the number of rounds grows with the logarithm of
    the component's size. Edges that already are stars around their smallest nodes take
    no round: one grouped pass tells.
    ``root`` is the smallest node of the component; roots themselves are not
    listed. Rounds are written to the shared folder, older ones deleted.
    """
    now = stored(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(),
        "edges",
    )
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")), "edges")
        # in a star the centre is below all its neighbours and any other node has one
        *marks, between = low.agg(*size_marks(), F.count_if((F.col("m") < F.col("u")) & (F.col("n") > 1))).first()
        if not between:
            discard(low)
            return now.select("u", F.col("v").alias("root"))
        large = stored(spread_join(both, low, "u", marks=marks).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        # small star: u's smaller neighbours and u itself all point at the least of them
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "edges")
        small = (
            spread_join(large, least, "u", marks=least.agg(*size_marks()).first())
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        then = stored(small, "edges")
        for done in (now, low, large, least):
            discard(done)
        now = then
