"""Running sums over long histories, in blocks of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, key: str, value: Column, name: str, block: str = "hour") -> DataFrame:
    """rows with the sum of `value` over the key's rows up to each, in order of (ts, seq).

    Each block of time is summed, the blocks' sums are carried forward, and within a block rows are summed in order. So a window holds the rows of one
    block, or one row for each block of a key, and a key with all rows fills as many tasks as it has blocks.
    """
    placed = rows.withColumns({"__time": F.date_trunc(block, "ts"), "__value": value})
    sums = placed.groupBy(F.col(key).alias("__key"), F.col("__time").alias("__t")).agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy("__key").orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("__key", "__t", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__carried"))
    met = placed.join(carried, F.col(key).eqNullSafe(F.col("__key")) & F.col("__time").eqNullSafe(F.col("__t")))
    inside = Window.partitionBy(key, "__time").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return met.select(*rows.columns, (F.col("__carried") + F.sum("__value").over(inside)).alias(name))
