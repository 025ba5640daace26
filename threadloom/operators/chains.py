"""Reply chains: roots, depths and what is known of each chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written

DEPTH = 64


def roots(entries: DataFrame, entry: str = "entry_id", parent: str = "parent_id", depth: int = DEPTH) -> DataFrame:
    """(entry_id, root_id, depth) by pointer jumping: log2(depth) self-joins at most.

    A parent that is no entry ends the walk.  At `depth` steps the node reached is the
    root, so members of a cycle get a node of the cycle.  The pointers are written each
    round, so no plan holds more than one self-join, and rounds end when none moves.
    """
    known = entries.select(F.col(entry).alias("entry_id"), F.col(parent).alias("p"))
    met = known.alias("x").join(known.select(F.col("entry_id").alias("q")), F.col("x.p") == F.col("q"), "left")
    top = F.col("q").isNull() | (F.col("q") == F.col("x.entry_id"))
    up = written(met.select("x.entry_id", F.coalesce("q", "x.entry_id").alias("root_id"), F.when(top, 0).otherwise(1).cast("long").alias("depth")))
    for _ in range(max(1, (depth - 1).bit_length())):
        # only what does not point to a root yet can move, and only to what points further
        step = up.where("depth > 0").select(F.col("entry_id").alias("via"), F.col("root_id").alias("to"), F.col("depth").alias("more"))
        if step.join(up.select("root_id").distinct(), step["via"] == F.col("root_id"), "left_semi").isEmpty():
            break
        moved = up.join(step, up["root_id"] == step["via"], "left")
        up = written(moved.select("entry_id", F.coalesce("to", "root_id").alias("root_id"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    return up


def chain_meta(entries: DataFrame, found: DataFrame, ts: str = "ts", label: str = "person") -> DataFrame:
    """A row for each chain: entries, first and last time, distinct labels in order."""
    return (
        entries.join(found, "entry_id")
        .groupBy("root_id")
        .agg(F.countDistinct("entry_id").alias("entries"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.array_join(F.sort_array(F.collect_set(label)), ",").alias("labels"))
    )
