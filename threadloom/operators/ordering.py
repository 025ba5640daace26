"""Order of messages that never puts an answer above what it answers, and lanes of the graph of answers.

`order` gives what a queue of ready messages gives from which the least is taken each
time, a message being ready once its parent is out.  Nothing is queued here.  A message
that is larger than its answers holds all of them back, so what decides is, on the way
from the root down to a message, the largest of all, then the largest below that one, and
so on to the message itself: its `way`.  Ways, compared as arrays, are in the queue's
order.  The way of a path is that of its lower part after those elements of its upper
part's way that are larger, which is associative, so paths are doubled and a chain of any
length takes a logarithm of rounds.  Where answers are later than what they answer, which
is the rule, a way is one element.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written


def numbered(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    """Rows with `place`, their number from 1 within each `by` in the given order, however many rows one `by` has.

    Rows are dealt by ranges of (by, order), numbered within each part, and moved on by
    what earlier parts hold.  The part is written with the rows, so it is not counted anew.
    """
    parts = rows.repartitionByRange(F.col(by), *order).withColumn("part", F.spark_partition_id())
    parts = written(parts)
    held = parts.groupBy(by, "part").agg(F.count("*").alias("held"))
    # one row for each part that a `by` reaches into
    before = held.select(F.col(by).alias("of"), F.col("part").alias("its"), F.coalesce(F.sum("held").over(Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(by, "part").orderBy(*order))
    joined = parts.withColumn("place", own).join(before, (F.col(by).eqNullSafe(F.col("of"))) & (F.col("part") == F.col("its")))
    return joined.withColumn("place", (F.col("place") + F.col("before")).cast("long")).drop("part", "of", "its", "before")


def order(messages: DataFrame) -> DataFrame:
    """(timeline, id, place): messages (timeline, id, parent, key, pos) by key, then id, with each behind its parent.

    ids are unique in a timeline; a parent outside it counts as none.  Messages that no
    root leads to, on or below a cycle of parents, come last, by pos.  A null key is the
    least.  Other columns are ignored.
    """
    m = messages.select("timeline", "id", "parent", "key", "pos")
    known = m.select(F.col("timeline").alias("t"), F.col("id").alias("known"))
    up = m.join(known, (F.col("timeline") == F.col("t")) & (F.col("parent") == F.col("known")), "left")
    step = written(up.select("timeline", "id", "pos", F.col("known").alias("up"), F.array(F.struct("key", "id")).alias("way")))
    left = -1
    while True:
        still = step.where("up IS NOT NULL").count()
        if still == left or not still:
            break
        left = still
        above = step.select(F.col("timeline").alias("t"), F.col("id").alias("above"), F.col("up").alias("next"), F.col("way").alias("upper"))
        held = F.concat(F.filter("upper", lambda x: x > F.get("way", F.lit(0))), F.col("way"))
        joined = step.join(above, (F.col("timeline") == F.col("t")) & (F.col("up") == F.col("above")), "left")
        step = written(joined.select("timeline", "id", "pos", F.col("next").alias("up"), F.when(F.col("upper").isNull(), F.col("way")).otherwise(held).alias("way")))
    lost = F.col("up").isNotNull()
    ways = step.select("timeline", "id", F.when(lost, F.col("pos")).alias("last"), F.when(~lost, F.col("way")).alias("way"))
    # nulls come first: rooted ones by way, then the others by pos
    return numbered(ways, "timeline", F.col("last").asc_nulls_first(), F.col("way"), F.col("id")).select("timeline", "id", "place")


def _lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lanes of rows (stretch, timeline, id, parent, place, held) in order; only lanes that are held are kept between rows."""
    current, holders, lane_of = None, [], {}
    for batch in batches:
        lanes = []
        for timeline, stretch, node, parent, held in zip(*(batch.column(c).to_pylist() for c in ("timeline", "stretch", "id", "parent", "held"))):
            if (timeline, stretch) != current:
                current, holders, lane_of = (timeline, stretch), [], {}
            lane = lane_of.pop(parent, None) if parent is not None else None
            if lane is None:
                free = [k for k, h in enumerate(holders) if h is None]
                lane = free[0] if free else len(holders)
                if not free:
                    holders.append(None)
            holders[lane] = node if held else None
            if held:
                lane_of[node] = lane
            lanes.append(lane)
        yield pa.RecordBatch.from_arrays([batch.column("timeline"), batch.column("id"), batch.column("place"), pa.array(lanes, pa.int32())], ["timeline", "id", "place", "lane"])


def graph_lanes(messages: DataFrame) -> DataFrame:
    """(timeline, id, place, lane): messages (timeline, id, parent, place) in lanes, so that each branch shows.

    In order of place, a message takes the lane that its parent holds, else the lowest
    free one; it holds it while it has answers to come, so the first answer inherits and
    later ones branch off.  A parent outside the timeline counts as none; one whose
    answers all stand before it holds its lane to the end.

    A timeline is cut wherever no lane is held; a stretch between two cuts streams
    through one task, which keeps the open lanes and no rows.
    """
    m = messages.select("timeline", "id", "parent", "place")
    parents = m.select(F.col("timeline").alias("t"), F.col("id").alias("of"), F.col("place").alias("at"))
    linked = m.join(parents, (F.col("timeline") == F.col("t")) & (F.col("parent") == F.col("of")), "left")
    first = linked.where("of IS NOT NULL").groupBy("timeline", "of").agg(F.min(F.when(F.col("place") > F.col("at"), F.col("place"))).alias("until")).select(F.col("timeline").alias("t2"), F.col("of").alias("of2"), "until", F.lit(True).alias("held"))
    rows = linked.select("timeline", "id", F.col("of").alias("parent"), "place").join(first, (F.col("timeline") == F.col("t2")) & (F.col("id") == F.col("of2")), "left")
    end = F.when(F.col("held"), F.coalesce("until", F.lit(1 << 60)))
    by = Window.partitionBy("timeline").orderBy("place")
    open_until = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce(open_until < F.col("place"), F.lit(True)).cast("long")
    stretches = rows.withColumn("cut", cut).withColumn("stretch", F.sum("cut").over(by)).select("timeline", "stretch", "id", "parent", "place", F.coalesce("held", F.lit(False)).alias("held"))
    dealt = stretches.repartition("timeline", "stretch").sortWithinPartitions("timeline", "stretch", "place")
    kinds = {f.name: f.dataType.simpleString() for f in m.schema}
    schema = f"timeline {kinds['timeline']}, id {kinds['id']}, place {kinds['place']}, lane int"
    return dealt.mapInArrow(_lanes, schema)
