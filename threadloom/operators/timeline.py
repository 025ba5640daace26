"""Selected messages as one ordered document with threads, and what changed between two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse
from .groups import groups


def closure(entries: DataFrame, seeds: DataFrame) -> DataFrame:
    """Entries of every chain that holds a seed (entry_id), once each, however long the chain.

    A chain is what parents connect, so entries without a parent or an answer among the
    entries are taken for themselves.
    """
    known = entries.select(F.col("entry_id").alias("parent_id"))
    of = groups(entries.select("entry_id", "parent_id").join(known, "parent_id"), "entry_id", "parent_id", "entry_id")
    asked = seeds.select("entry_id").distinct()
    whole = of.join(of.join(asked, "entry_id").select("group").distinct(), "group").select("entry_id")
    return entries.join(whole.unionByName(asked), "entry_id", "left_semi")


def messages(selected: DataFrame, chain: DataFrame) -> DataFrame:
    """The selection (entry_id, parent_id, container, person, ts, subject, text) with chain root, place, shown parent and subject.

    `place` counts from 0 in the order of (ts, entry_id) inside a chain.  A parent counts
    only if it stands earlier, else the message is an orphan.  A subject shows where there
    is no parent or the parent's differs.
    """
    place = (F.row_number().over(Window.partitionBy("root_id").orderBy("ts", "entry_id")) - 1).cast("long")
    rows = selected.join(chain.select("entry_id", "root_id"), "entry_id").withColumn("place", place)
    up = rows.select(F.col("entry_id").alias("pid"), F.col("ts").alias("pts"), F.col("subject").alias("psubject"))
    met = rows.join(up, (F.col("parent_id") == F.col("pid")) & ((F.col("pts") < F.col("ts")) | ((F.col("pts") == F.col("ts")) & (F.col("pid") < F.col("entry_id")))), "left")
    shown = F.when(F.col("pid").isNull() | ~F.col("psubject").eqNullSafe(F.col("subject")), F.col("subject"))
    orphan = F.col("parent_id").isNotNull() & F.col("pid").isNull()
    return met.select("root_id", "place", "entry_id", F.col("pid").alias("parent_id"), "container", "person", "ts", shown.alias("subject"), collapse(F.col("text")).alias("text"), orphan.alias("orphan"))


def documents(placed: DataFrame) -> DataFrame:
    """What heads each document (root_id): count, first and last time, subject, cast in order, orphans.

    The messages themselves stay the rows of `messages`, by root_id and place, so no
    chain is ever one row.
    """
    at = F.struct("place", "entry_id")
    return placed.groupBy("root_id").agg(
        F.count("*").alias("messages"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("subject", at).alias("subject"),
        F.array_join(F.sort_array(F.collect_set("person")), ",").alias("cast"), F.count_if("orphan").alias("orphans"),
    )


def threads(selected: DataFrame) -> DataFrame:
    """(container, subject, count, first_ts, last_ts): the subject is that of the first message."""
    return selected.where("container IS NOT NULL").groupBy("container").agg(F.min_by("subject", F.struct("ts", "entry_id")).alias("subject"), F.count("*").alias("count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def lanes(spans: DataFrame, key: str, start: str, end: str, lane_of: str) -> DataFrame:
    """Rows with `lane`: by start, each interval takes the first lane that is free before it.

    Each key is cut where no span is open; there all lanes are free, so only spans that
    overlap one another are gathered.
    """
    each = F.struct(F.col(start).alias("s"), F.col(lane_of).alias("i"), F.col(end).alias("e"))
    w = Window.partitionBy(key).orderBy(start, lane_of)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce(before < F.col(start), F.lit(True)).cast("int")
    runs = spans.withColumn("cut", cut).withColumn("run", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    packed = runs.groupBy(key, "run").agg(F.array_sort(F.collect_list(each)).alias("spans"))
    none = F.struct(F.array().cast("array<bigint>").alias("ends"), F.array().cast("array<int>").alias("at"))

    def put(state, span):
        free = F.array_position(F.transform(state["ends"], lambda x: x < span["s"]), True).cast("int")
        lane = F.when(free > 0, free).otherwise(F.size(state["ends"]) + 1)
        end = span["e"].cast("bigint")
        ends = F.when(free > 0, F.transform(state["ends"], lambda x, i: F.when(i == lane - 1, end).otherwise(x))).otherwise(F.concat(state["ends"], F.array(end)))
        return F.struct(ends.alias("ends"), F.concat(state["at"], F.array(lane - 1)).alias("at"))

    at = F.aggregate("spans", none, put)["at"]
    return packed.select(key, F.explode(F.arrays_zip("spans", at.alias("lane"))).alias("z")).select(key, F.col("z.spans.i").alias(lane_of), F.col("z.spans.s").alias(start), F.col("z.spans.e").alias(end), F.col("z.lane").alias("lane"))


def changes(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change) of the rows of `after` that are new or revised: same id with other content, or the content of another id."""
    old = before.select(F.col(key).alias("k"), F.col(content).alias("c"))
    met = after.join(old, after[key] == old["k"], "left")
    held = old.groupBy(F.col("c").alias("held")).agg(F.count("*").alias("n"))
    found = met.join(held, met[content] == held["held"], "left")
    change = F.when(F.col("k").isNotNull(), F.when(~F.col("c").eqNullSafe(F.col(content)), "revised")).when(F.col("n").isNotNull(), "revised").otherwise("new")
    return found.select(key, change.alias("change")).where("change IS NOT NULL")
