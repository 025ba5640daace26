"""Walks over the listed envelopes of mailboxes: where each resumes, why it stops, and the cursor it leaves.

A listing is (source, container, place, id, ts): the envelopes of a container from the
newest, `place` from 0, `ts` in seconds or null where the date cannot be read.  Cursors
are those of `corpus.save_progress`; `position` is the place that the next page begins at.

A container without a cursor is not walked.  A null or empty position begins at the front.
One behind the end has expired and does so too.  A date that is null never ends a walk.
Repeated places are read as often as they stand there.  All is joins and partial
aggregates on the container, so a container of any size is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import corpus

#: Envelopes a page, and the seconds by which a walk overlaps the frontier of the one before.
PAGE, LOOK_BACK = 500, 48 * 3600
KEY = ["source", "container"]


def walks(listing: DataFrame, cursors: DataFrame, size: int = PAGE, most: int | None = None) -> DataFrame:
    """(source, container, start, end, stop, pages, resumed, frontier, walked): the places from `start` up to `end` are read.

    `stop` is `frontier` at the first envelope that the last whole walk covers, `exhausted`
    at the end of the container, `max` where `most` envelopes are read and more follow.
    """
    length = listing.groupBy(*KEY).agg((F.max("place") + 1).alias("n"))
    at = F.expr("CASE WHEN NOT complete THEN try_cast(position AS BIGINT) END")
    known = cursors.join(length, KEY, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    known = known.select(*KEY, "n", F.when(at.between(0, F.col("n") - 1), at).alias("at"), (F.col("frontier") - LOOK_BACK).alias("floor"), "frontier", "walked")
    known = known.select(*KEY, "n", F.coalesce("at", F.lit(0).cast("long")).alias("start"), F.col("at").isNotNull().alias("resumed"), "floor", "frontier", "walked")
    covered = listing.join(known.where("floor IS NOT NULL").select(*KEY, "start", "floor"), KEY).where("place >= start AND ts <= floor").groupBy(*KEY).agg(F.min("place").alias("met"))
    bound = F.least("n", F.col("start") + most) if most else F.col("n")
    rows = known.join(covered, KEY, "left").withColumn("bound", bound).withColumn("at_floor", F.coalesce(F.col("met") < F.col("bound"), F.lit(False)))
    stop = F.when(F.col("at_floor"), "frontier").when(F.col("bound") == F.col("n"), "exhausted").otherwise("max")
    end = F.when(F.col("at_floor"), F.col("met")).otherwise(F.col("bound"))
    read = end - F.col("start")
    # the envelope at the floor has been listed, the one behind a bound has not
    pages = F.greatest(F.lit(1), F.ceil((read + F.col("at_floor").cast("int")) / size))
    return rows.select(*KEY, "start", end.alias("end"), stop.alias("stop"), pages.cast("long").alias("pages"), "resumed", "frontier", "walked")


def reads(listing: DataFrame, found: DataFrame) -> DataFrame:
    """The envelopes that the walks read, all columns of the listing."""
    return listing.join(found.select(*KEY, "start", "end"), KEY).where("place >= start AND place < end").select(*listing.columns)


def cursors_after(cursors: DataFrame, listing: DataFrame, found: DataFrame) -> DataFrame:
    """Cursors after the walks: a bounded one moves the position, one that covers its container the frontier."""
    newest = reads(listing, found).groupBy(*KEY).agg(F.max("ts").alias("newest"))
    cut = found.where("stop = 'max'").select(*KEY, F.col("end").cast("string").alias("position"), (F.coalesce("walked", F.lit(0)) + F.col("end") - F.col("start")).alias("walked"))
    done = found.where("stop <> 'max'").join(newest, KEY, "left").select(*KEY, F.col("newest").alias("frontier"), F.lit(0).cast("long").alias("walked"))
    return corpus.save_complete(corpus.save_progress(cursors, cut), done)
