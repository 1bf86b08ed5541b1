"""Numbers of rows in a global order, without one task that has them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbering(df: DataFrame, order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """``df`` with the place of each row from 0: ranges are sorted apart, and each counts on from the rows before it.

    The ranges' number is fixed, so that both uses of them are one exchange. One row
    for each range is broadcast.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + within).drop("__part", "__before")
