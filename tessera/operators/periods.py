"""Periods that begin at the first use after the last one ran out, for keys of any size.

Where a period begins depends on where the one before did, so a key's periods are a chain. But each call has one successor, the first call a period
later, whoever asks; and of a path along successors 2 ** k steps are known after k joins of the successors with themselves. So a hot key's
periods are found in as many rounds as the length of its chain has binary digits, each of them a few joins that all tasks share.

Times are whole microseconds. Time is cut into blocks shorter than a period: a call's successor lies in the block exactly a period on, or is the first call of
the next block that has any; and a block has at most one period's begin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import stored

#: Rows of a key from which it counts as hot.
HOT_ROWS = 1_000_000
#: Blocks of a period.
BLOCKS = 16


def split_hot(rows: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """rows of keys of up to `most` rows, and the others, None if there are none."""
    hot = stored(rows.groupBy(F.col(key).alias("__hot")).count().filter(F.col("count") > most).select("__hot"), "hot")
    if hot.isEmpty():
        return rows, None
    hot = F.broadcast(hot)  # at most one in `most` rows
    same = F.col(key).eqNullSafe(F.col("__hot"))
    return rows.join(hot, same, "left_anti"), rows.join(hot, same, "left_semi")


def successors(times: DataFrame, step: int) -> DataFrame:
    """(key, at, next) of distinct times (key, at): the first time of the key at or after at + step, where there is one."""
    width = max(1, step // BLOCKS)
    block = lambda c: F.floor(c / width)
    target = F.col("at") + step
    events = times.select("key", block(F.col("at")).alias("block"), F.col("at").alias("t"), F.col("at").alias("event"), F.lit(None).cast("long").alias("asks"))
    asks = times.select("key", block(target).alias("block"), target.alias("t"), F.lit(None).cast("long"), F.col("at"))
    inside = Window.partitionBy("key", "block").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = stored(events.union(asks).withColumn("next", F.min("event").over(inside)).filter("asks is not null").select("key", "block", F.col("asks").alias("at"), "next"), "successors")
    # what finds nothing in its block goes on to the first call of a later one; there is a row for each block
    firsts = times.groupBy("key", block(F.col("at")).alias("block")).agg(F.min("at").alias("first"))
    wanted = met.filter("next is null").select("key", "block").distinct().withColumn("first", F.lit(None).cast("long"))
    later = Window.partitionBy("key").orderBy(F.desc("block")).rangeBetween(Window.unboundedPreceding, -1)
    every = firsts.union(wanted).withColumn("later", F.min("first").over(later)).filter("first is null").select(F.col("key").alias("k"), F.col("block").alias("b"), "later")
    found = met.join(every, F.col("key").eqNullSafe(F.col("k")) & (F.col("block") == F.col("b")) & F.col("next").isNull(), "left")
    return found.select("key", "at", F.coalesce("next", "later").alias("next")).filter("next is not null")


def period_begins(times: DataFrame, step: int) -> DataFrame:
    """(key, since) of each period's begin, of distinct times (key, at)."""
    times = stored(times, "times")
    jump = stored(successors(times, step), "jump")
    reached = stored(times.groupBy("key").agg(F.min("at").alias("at")), "reached")
    while not jump.isEmpty():
        on = jump.select(F.col("key").alias("k"), F.col("at").alias("a"), "next")
        there = lambda df, c: df.join(on, F.col("key").eqNullSafe(F.col("k")) & (F.col(c) == F.col("a")))  # noqa: B023, E731
        reached = stored(reached.union(there(reached, "at").select("key", F.col("next").alias("at"))), "reached")
        jump = stored(there(jump.withColumnRenamed("next", "via"), "via").select("key", "at", "next"), "jump")
    return reached.select("key", F.col("at").alias("since"))


def with_periods(rows: DataFrame, key: str, seconds: float) -> DataFrame:
    """rows with since, in microseconds: when the row's period began. rows: key, ts."""
    step = round(seconds * 1e6)
    width = max(1, step // BLOCKS)
    placed = rows.withColumns({"__at": F.unix_micros("ts")}).withColumn("__block", F.floor(F.col("__at") / width))
    times = placed.select(F.col(key).alias("key"), F.col("__at").alias("at")).distinct()
    begins = period_begins(times, step).withColumn("b", F.floor(F.col("since") / width))
    blocks = placed.select(F.col(key).alias("key"), F.col("__block").alias("b")).distinct().join(begins.select(F.col("key").alias("k"), F.col("b").alias("kb"), "since"), F.col("key").eqNullSafe(F.col("k")) & (F.col("b") == F.col("kb")), "left")
    before = F.last("since", ignorenulls=True).over(Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    known = blocks.select(F.col("key").alias("__key"), F.col("b").alias("__b"), F.col("since").alias("__own"), before.alias("__before"))
    met = placed.join(known, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__b")))
    since = F.when(F.col("__at") >= F.col("__own"), F.col("__own")).otherwise(F.col("__before"))
    return met.select(*rows.columns, since.alias("since"))
