"""Order of the blocks that a body quotes, by the clocks they state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import LEAST, MOST


def window(wall: Column, offset: Column) -> Column:
    """struct<lo, hi>: the instants that a stated clock can mean.

    Without an offset any zone is possible; an exact midnight may be a date without a
    clock, which takes a day more.
    """
    minutes = lambda n: F.make_interval(mins=n)
    lo = wall - minutes(F.coalesce(offset, F.lit(MOST)))
    hi = wall - minutes(F.coalesce(offset, F.lit(LEAST)))
    midnight = (F.hour(wall) == 0) & (F.minute(wall) == 0) & (F.second(wall) == 0)
    return F.when(wall.isNotNull(), F.struct(lo.alias("lo"), F.when(midnight, hi + F.expr("INTERVAL 24 HOURS")).otherwise(hi).alias("hi")))


def order(blocks: DataFrame, presumed: int = 0) -> DataFrame:
    """Blocks (entry_id, block, sent, offset) with `nested` and `dated`, their places among the dated ones from 1.

    `nested` goes by block, `dated` by instant, newest first, equal ones by block; clocks
    without an offset are read at the presumed one.  A block without a clock has neither.
    """
    at = F.col("sent") - F.make_interval(mins=F.coalesce("offset", F.lit(presumed)))
    place = lambda *by: F.when(F.col("sent").isNotNull(), F.row_number().over(Window.partitionBy("entry_id", F.col("sent").isNull()).orderBy(*by)))
    rows = blocks.withColumn("at", at)
    return rows.withColumn("nested", place(F.col("block"))).withColumn("dated", place(F.col("at").desc(), F.col("block"))).drop("at")


def moved(ordered: DataFrame) -> DataFrame:
    """(entry_id, blocks, moved): how many dated blocks each body has, and how many stand elsewhere by date."""
    return ordered.where("nested IS NOT NULL").groupBy("entry_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("nested") != F.col("dated")).alias("moved"))


def impossible(blocks: DataFrame) -> DataFrame:
    """(entry_id, block, outer, excess): blocks that no reading of the clocks lets be quoted by an earlier block, and the one that they contradict most.

    A block contradicts an earlier one if its earliest instant is behind the latest of
    that; the worst is the one whose latest instant is least.  `excess` is in seconds.
    """
    rows = blocks.where("sent IS NOT NULL").withColumn("w", window(F.col("sent"), F.col("offset")))
    before = Window.partitionBy("entry_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    worst = F.min(F.struct(F.col("w.hi").alias("hi"), F.col("block").alias("outer"))).over(before)
    found = rows.withColumn("worst", worst).withColumn("excess", F.unix_timestamp(F.col("w.lo").cast("timestamp")) - F.unix_timestamp(F.col("worst.hi").cast("timestamp")))
    return found.where("excess > 0").select("entry_id", "block", F.col("worst.outer").alias("outer"), "excess")
