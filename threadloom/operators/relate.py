"""Joins by nearness, universal quantification and change between two states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written


def band_join(rows: DataFrame, key: str, at: str, entry: str, width: int) -> DataFrame:
    """(key, a, b, gap): pairs of rows of a key at most `width` apart in `at` (a number), a before b.

    Each row is dealt to the bucket of its place and, as the later partner, to the next
    one, so a key is spread over its buckets and no key is gathered whole.
    """
    x = rows.select(F.col(key).alias("key"), F.col(entry).alias("a"), F.col(at).alias("pa"), F.floor(F.col(at) / width).alias("bucket"))
    y = rows.select(F.col(key).alias("key"), F.col(entry).alias("b"), F.col(at).alias("pb"), F.explode(F.array(F.floor(F.col(at) / width), F.floor(F.col(at) / width) - 1)).alias("bucket"))
    near = (F.col("pb") - F.col("pa")).between(0, width) & ((F.col("pa") < F.col("pb")) | (F.col("a") < F.col("b")))
    return x.join(y, ["key", "bucket"]).where(near).select("key", "a", "b", (F.col("pb") - F.col("pa")).alias("gap"))


def runs(rows: DataFrame, key: list[str], at: str, width: int) -> DataFrame:
    """Every row with `run`, the first place of its connected run: neighbours at most `width` apart."""
    w = Window.partitionBy(*key).orderBy(at)
    starts = F.when(F.coalesce(F.col(at) - F.lag(at).over(w) > width, F.lit(True)), F.col(at))
    return rows.withColumn("run", F.last(starts, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def every(rows: DataFrame, key: str, condition: str) -> DataFrame:
    """Keys all of whose rows meet the condition; unknown counts as not met."""
    return rows.groupBy(key).agg(F.count("*").alias("rows"), F.count_if(F.coalesce(F.expr(condition), F.lit(False))).alias("met")).where("rows = met").select(key, "rows")


def growth(before: DataFrame, after: DataFrame, key: str, size: str) -> DataFrame:
    """(key, before, after, change): added, gone, grown, shrunk or same."""
    out = before.select(key, F.col(size).alias("before")).join(after.select(key, F.col(size).alias("after")), key, "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "gone").when(F.col("after") > F.col("before"), "grown").when(F.col("after") < F.col("before"), "shrunk").otherwise("same")
    return out.withColumn("change", change)


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`, all columns; partial maxima keep hot keys cheap."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def nearest_rank(rows: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """(key, share, value): the value at place int(share * (n - 1)) of each key, without interpolation.

    Equal values are counted before they are ordered, so the ordered rows are the distinct ones.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    # ranges of (key, value): a key is spread over many, and only their sums are put in order
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(counts.repartitionByRange(parts, key, value).withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy(key, "part").agg(F.sum("c").alias("held"))
    w = Window.partitionBy(key).orderBy("part")
    sums = sums.select(F.col(key).alias("of"), "part", (F.sum("held").over(w) - F.col("held")).alias("before"), F.sum("held").over(Window.partitionBy(key)).alias("n"))
    upto = dealt.join(sums, F.col(key).eqNullSafe(F.col("of")) & (dealt["part"] == sums["part"])).drop(sums["part"])
    upto = upto.withColumn("hi", F.col("before") + F.sum("c").over(Window.partitionBy(key, "part").orderBy(value)))
    at = upto.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("place", F.floor(F.col("share") * (F.col("n") - 1)))
    return at.where("place < hi AND place >= hi - c").select(key, "share", F.col(value).alias("value"))
