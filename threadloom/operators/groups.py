"""Connected components of a table of links, without gathering any component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written


def groups(links: DataFrame, a: str = "a", b: str = "b", node: str = "node", group: str = "group") -> DataFrame:
    """(node, group) of every node that has a link to another; the group is its smallest node.

    Each round, every node points to the smallest of its neighbours and itself, pointers
    are followed twice, and links are drawn anew between what they point to, until no
    link is left.  So chains of any length halve at least, and cycles end.  Null ends
    are no links; no links give no rows.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.select(F.col("a").alias(node)).distinct().withColumn(group, F.col(node)))
    while not both.isEmpty():
        least = written(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")))
        far = written(least.alias("x").join(least.alias("y"), F.col("x.to") == F.col("y.a"), "left").select("x.a", F.coalesce("y.to", "x.to").alias("to")))
        labels = written(labels.join(far, labels[group] == far["a"], "left").select(node, F.coalesce("to", group).alias(group)))
        ends = both.alias("e").join(far.alias("x"), F.col("e.a") == F.col("x.a")).join(far.alias("y"), F.col("e.b") == F.col("y.a"))
        both = written(ends.select(F.col("x.to").alias("a"), F.col("y.to").alias("b")).where("a <> b").distinct())
    return labels
