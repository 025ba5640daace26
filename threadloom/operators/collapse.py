"""Twin collapse applied: one mapping of dropped copies to those that stay, over every table that names entries.

What the dropped copies hold moves first: sightings and participants as sets, children,
a missing parent, gaps of a quoted keeper, and the offset that a copy's clock reveals of
the client that quoted it.  Applied again, the same mapping changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import nearest_offset
from ..tables import written
from . import align, twins
from .identity import repoint


def mapping(plan: DataFrame, copies: DataFrame) -> DataFrame:
    """(drop_id, keep_id) of a plan of twins, without the copies that hold words of their own."""
    plan = written(plan)
    own = align.annotated(plan, copies).select("entry_id")
    return written(plan.where("decision = 'drop'").join(own, "entry_id", "left_anti").select(F.col("entry_id").alias("drop_id"), "keep_id"))


def measured_offsets(moved: DataFrame, entries: DataFrame, sightings: DataFrame) -> DataFrame:
    """(person, entry_id, at, offset, measured_from): at which offset the client of a host wrote the clock of a message whose instant is known.

    Only for direct keepers, and for copies that exactly one host with a person quotes.
    """
    keep = entries.where("NOT quoted").select(F.col("entry_id").alias("keep_id"), F.col("ts").alias("known"))
    drop = entries.select(F.col("entry_id").alias("drop_id"), F.col("ts").alias("written"))
    host = entries.select(F.col("entry_id").alias("seen_in"), F.col("person_id").alias("person"), F.col("ts").alias("at"))
    seen = sightings.where("kind = 'quoted'").join(moved, F.col("entry_id") == F.col("drop_id"), "left_semi").select(F.col("entry_id").alias("drop_id"), "seen_in").join(host, "seen_in")
    one = seen.groupBy("drop_id").agg(F.count("*").alias("hosts"), F.min("seen_in").alias("entry_id"), F.min("person").alias("person"), F.min("at").alias("at")).where("hosts = 1 AND person IS NOT NULL")
    rows = moved.join(one, "drop_id").join(keep, "keep_id").join(drop, "drop_id")
    found = rows.withColumn("offset", nearest_offset(F.expr("(written - known) div 60")))
    return found.groupBy("person", "entry_id", "offset").agg(F.min("at").alias("at"), F.min("drop_id").alias("measured_from")).select("person", "entry_id", "at", "offset", "measured_from")


def entries_after(entries: DataFrame, moved: DataFrame) -> DataFrame:
    """Entries (entry_id, parent_id, quoted, subject, tz, person_id, text and others) without the dropped ones.

    Children of a dropped entry get its keeper.  A keeper without a parent, or whose
    parent is one of its own copies, takes the parent of the first copy, by id, that has
    another one.  Gaps of a quoted keeper are filled by the first copy that has a value,
    its text gives way to the longest.
    """
    drops = moved.join(entries.select(F.col("entry_id").alias("drop_id"), F.col("parent_id").alias("up"), "subject", "tz", "person_id", "text"), "drop_id")
    first = lambda c, held: F.min(F.when(held, F.struct("drop_id", c)))[c].alias(f"its_{c}")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    per = drops.groupBy("keep_id").agg(
        F.array_sort(F.collect_list(F.struct("drop_id", "up"))).alias("ups"),
        first("subject", filled("subject")), first("tz", filled("tz")), first("person_id", F.col("person_id").isNotNull()),
        F.max_by("text", F.struct(F.length(F.coalesce("text", F.lit(""))), -F.col("drop_id"))).alias("its_text"),
    )
    rows = entries.join(moved.select(F.col("drop_id").alias("entry_id")), "entry_id", "left_anti").join(per.withColumnRenamed("keep_id", "entry_id"), "entry_id", "left")

    def step(parent, copy):
        parent = F.when(~parent.eqNullSafe(copy["drop_id"]), parent)
        earlier = F.exists(F.col("ups"), lambda x: (x["drop_id"] == copy["up"]) & (x["drop_id"] <= copy["drop_id"]))
        return F.coalesce(parent, F.when((copy["up"] != F.col("entry_id")) & ~earlier, copy["up"]))

    parent = F.when(F.col("ups").isNull(), F.col("parent_id")).otherwise(F.aggregate("ups", F.col("parent_id"), step))
    gap = lambda c: F.when(F.col("quoted"), F.coalesce(F.when(filled(c), F.col(c)), F.col(f"its_{c}"), F.col(c))).otherwise(F.col(c))
    longer = F.col("quoted") & (F.length(F.coalesce("its_text", F.lit(""))) > F.length(F.coalesce("text", F.lit(""))))
    new = {
        "parent_id": parent, "subject": gap("subject"), "tz": gap("tz"),
        "person_id": F.when(F.col("quoted"), F.coalesce("person_id", "its_person_id")).otherwise(F.col("person_id")),
        "text": F.when(longer, F.col("its_text")).otherwise(F.col("text")),
    }
    told = rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in entries.columns])
    return repoint(told, "parent_id", moved)


def sightings_after(sightings: DataFrame, moved: DataFrame) -> DataFrame:
    """Sightings (entry_id, seen_in, kind and others) of what stays: one for each of the three, a keeper's own before those of its copies."""
    marked = sightings.withColumns({"was": F.col("entry_id"), "was_in": F.col("seen_in")})
    told = repoint(repoint(marked, "entry_id", moved), "seen_in", moved)
    own = F.struct(F.col("was") != F.col("entry_id"), F.col("was_in") != F.col("seen_in"), F.col("was"), F.col("was_in"))
    place = F.row_number().over(Window.partitionBy("entry_id", "seen_in", "kind").orderBy(own))
    return told.withColumn("place", place).where("place = 1").select(*sightings.columns)


def participants_after(participants: DataFrame, moved: DataFrame) -> DataFrame:
    """Participants (entry_id, person_id, role and others) of what stays, equal ones once."""
    return repoint(participants, "entry_id", moved, once=True)


def without(rows: DataFrame, moved: DataFrame, column: str = "entry_id") -> DataFrame:
    """Rows of a table that goes with its entry (attachments, vectors, details): those of dropped entries go."""
    return rows.join(moved.select(F.col("drop_id").alias(column)), column, "left_anti").select(*rows.columns)


def find_twins(blocks: DataFrame, copies: DataFrame) -> DataFrame:
    """(entry_id, twin) of new quoted blocks that are a copy of one stored message; both are as in `twins.pairs`.

    The one direct copy among those that fit is the twin, with no direct one the only
    quoted one.  Copies of which the block answers inside do not fit.  ids of blocks and
    copies differ.
    """
    columns = ["entry_id", "person", "wall", "text", "quoted"]
    new = blocks.withColumn("quoted", F.lit(True)).select(columns)
    every = new.unionByName(copies.select(columns))
    fit = twins.pairs(every).where("reason IS NULL")
    ids = new.select(F.col("entry_id").alias("new"))
    ways = fit.select("a", "b").unionByName(fit.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = ways.join(ids, F.col("a") == F.col("new"), "left_semi").join(ids, F.col("b") == F.col("new"), "left_anti").select(F.col("a").alias("entry_id"), F.col("b").alias("keep_id"))
    inside = align.annotated(met.withColumn("decision", F.lit("drop")), every).select("entry_id", "keep_id")
    held = met.join(inside, ["entry_id", "keep_id"], "left_anti").join(copies.select(F.col("entry_id").alias("keep_id"), "quoted"), "keep_id")
    per = held.groupBy("entry_id").agg(F.count_if(~F.col("quoted")).alias("direct"), F.count("*").alias("n"), F.min(F.when(~F.col("quoted"), F.col("keep_id"))).alias("one"), F.min("keep_id").alias("any"))
    return per.where("direct = 1 OR (direct = 0 AND n = 1)").select("entry_id", F.coalesce("one", "any").alias("twin"))
