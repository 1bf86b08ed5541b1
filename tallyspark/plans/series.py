"""Long ordered series in blocks, so that one series is the work of many tasks.

``blocked`` numbers the rows of every key in order of ``pos`` and cuts each key into
blocks of a fixed number of rows. Windows then run inside blocks: running sums and
maxima take on the state that the blocks before leave (one row a block), neighbours
come from copies of the rows next to a block's ends. Sources declare both forms, see
``functions.recipes.running`` and ``nearby``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: A key with more rows than this is cut into blocks.
LONG = 1_000_000
#: Rows of a block.
BLOCK = 250_000


def is_long(t: DataFrame, limit: int = LONG) -> bool:
    """Whether some key of ``t`` has more rows than ``limit``."""
    return bool(t.groupBy("g").count().where(F.col("count") > limit).limit(1).count())


def numbered(t: DataFrame, keys: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """``t`` with the place of each row among those of equal ``keys``, from 0 in ascending ``order``.

    Rows are sorted in ranges and the ranges written, so that every use sees the same;
    a range counts on from the rows of its key in the ranges before it. Equal rows may
    change places.
    """
    parts = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    by = [*keys, *order]
    ranged = written(t.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("at__", F.monotonically_increasing_id()), "ranges")
    ranged = ranged.withColumn("part__", F.shiftright("at__", 33))
    # a row for each range and key in it
    pieces = ranged.groupBy("part__", *(F.col(k).alias(f"{k}__") for k in keys)).agg(F.min("at__").alias("first__"), F.count(F.lit(1)).alias("n__"))
    earlier = Window.partitionBy(*(f"{k}__" for k in keys)).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before__", F.coalesce(F.sum("n__").over(earlier), F.lit(0))).withColumnRenamed("part__", "of__")
    same = F.col("part__") == F.col("of__")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}__"))
    return ranged.join(pieces, same).withColumn(name, F.col("before__") + F.col("at__") - F.col("first__")).select(*t.columns, name)


def blocked(t: DataFrame, rows: int = BLOCK) -> DataFrame:
    """``t`` with ``nth``, a row's place in its key from 0, and ``blk``, its block."""
    return written(numbered(t, ["g"], ["pos"]).withColumn("blk", F.expr(f"nth DIV {rows}")), "series")
