"""Keeping a corpus whole as messages come in: parents, gaps of quoted entries, sightings and cursors.

Each function takes the state and one batch of news and gives the state after it, so that
it can run as it is or in the `foreachBatch` of a stream; all are idempotent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relate import latest


def chat_time(stamp: Column) -> Column:
    """The instant of a chat stamp such as 1700000000.000123, exact to the microsecond; null for what is none."""
    whole, part = F.regexp_extract(stamp, r"^(\d{1,11})(?:\.(\d{1,9}))?$", 1), F.regexp_extract(stamp, r"^(\d{1,11})(?:\.(\d{1,9}))?$", 2)
    micros = F.when(part == "", F.lit(0)).otherwise(F.substring(F.rpad(part, 6, "0"), 1, 6).cast("long"))
    return F.when(whole != "", F.timestamp_micros(whole.cast("long") * 1_000_000 + micros))


def chat_author(user: Column, bot: Column, username: Column) -> Column:
    """struct<kind, value> of who wrote: the user, else the bot, else the name shown; null where none is stated."""
    some = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c))
    of = lambda kind, c: F.when(some(c).isNotNull(), F.struct(F.lit(kind).alias("kind"), some(c).alias("value")))
    return F.coalesce(of("uid", user), of("uid", bot), of("name", username))


def resolve_parents(entries: DataFrame) -> DataFrame:
    """Entries (entry_id, source, container, ref, parent_ref, parent_id) with the parents found that were missing.

    Mail names its parent's message id among all mail, chat a stamp in its own channel.
    A parent that is set stays; nobody is their own parent; of several with the name, the
    smallest id is taken.  Run again when late parents have come, it links what was open.
    """
    scope = lambda: F.when(F.col("source") == "mail", F.lit("")).otherwise(F.col("container"))
    open_ = entries.where("parent_id IS NULL AND parent_ref IS NOT NULL").select("entry_id", "source", scope().alias("scope"), F.col("parent_ref").alias("name"))
    held = entries.where("ref IS NOT NULL").select("source", scope().alias("scope"), F.col("ref").alias("name"), F.col("entry_id").alias("found"))
    links = open_.join(held, ["source", "scope", "name"]).where("found <> entry_id").groupBy("entry_id").agg(F.min("found").alias("found"))
    return entries.join(links, "entry_id", "left").withColumn("parent_id", F.coalesce("parent_id", "found")).select(*entries.columns)


def set_parents(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """Entries with the parents of `edges` (entry_id, to), where there is none yet and it is not the entry itself."""
    new = edges.where("to <> entry_id").groupBy("entry_id").agg(F.min("to").alias("to"))
    return entries.join(new, "entry_id", "left").withColumn("parent_id", F.coalesce("parent_id", "to")).select(*entries.columns)


def enrich(entries: DataFrame, stated: DataFrame) -> DataFrame:
    """Entries with the gaps of quoted ones filled from `stated` (entry_id, subject, tz, person_id, text): what is empty is taken, and the longer text.

    A message of its own is never changed.  Of several statements the longest text goes first.
    """
    one = stated.groupBy("entry_id").agg(F.max_by(F.struct("subject", "tz", "person_id", "text"), F.struct(F.length(F.coalesce("text", F.lit(""))), F.coalesce("text", F.lit("")))).alias("s"))
    rows = entries.join(one, "entry_id", "left")
    may = F.col("quoted") & F.col("s").isNotNull()
    filled = lambda c: F.when(may, F.coalesce(F.when(F.col(c) != "", F.col(c)), F.col(f"s.{c}"))).otherwise(F.col(c))
    longer = F.length(F.coalesce("s.text", F.lit(""))) > F.length(F.coalesce("text", F.lit("")))
    new = {"subject": filled("subject"), "tz": filled("tz"), "person_id": F.when(may, F.coalesce("person_id", "s.person_id")).otherwise(F.col("person_id")), "text": F.when(may & longer, F.col("s.text")).otherwise(F.col("text"))}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in entries.columns])


def sight(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Sightings (entry_id, seen_in, kind, detail) with one row for each of the first three; the latest detail stays."""
    key = ["entry_id", "seen_in", "kind"]
    every = stored.withColumn("round", F.lit(0)).unionByName(seen.withColumn("round", F.lit(1)))
    return latest(every, key, ["round", "detail"]).select(*stored.columns)


def save_progress(cursors: DataFrame, walked: DataFrame) -> DataFrame:
    """Cursors (source, container, position, frontier, complete, walked) after a walk that was cut short: position and count move, the frontier does not."""
    key = ["source", "container"]
    new = walked.select(*key, F.col("position").alias("new_position"), F.col("walked").alias("new_walked"), F.lit(True).alias("new"))
    rows = cursors.join(new, key, "full")
    return rows.select(*key, F.when(F.col("new"), F.col("new_position")).otherwise(F.col("position")).alias("position"), "frontier", F.when(F.col("new"), F.lit(False)).otherwise(F.col("complete")).alias("complete"), F.coalesce("new_walked", "walked").alias("walked"))


def save_complete(cursors: DataFrame, done: DataFrame) -> DataFrame:
    """Cursors after walks that reached their end: the frontier is the later of the old and the new one, and none keeps the old."""
    key = ["source", "container"]
    new = done.select(*key, F.col("frontier").alias("new_frontier"), F.col("walked").alias("new_walked"), F.lit(True).alias("new"))
    rows = cursors.join(new, key, "full")
    return rows.select(*key, F.when(F.col("new"), F.lit(None).cast("string")).otherwise(F.col("position")).alias("position"), F.greatest("frontier", "new_frontier").alias("frontier"), F.coalesce("new", "complete").alias("complete"), F.coalesce("new_walked", "walked").alias("walked"))
