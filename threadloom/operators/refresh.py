"""A timeline made again: what to read, which chains to propose, what is selected, and what has grown.

Chains found by a timeline's queries are proposed unless they are accepted; those that
stand on the page stay, found or not.  Every step is a join or a grouping on one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_ext_id
from . import relate, timeline

#: The forms in which a run's label states its day.
LABELS = ["d MMM yyyy", "d MMMM yyyy", "yyyy-MM-dd"]


def after_date(label: Column) -> Column:
    """The day of a run's label as yyyy/MM/dd, from which the next one asks for mail; empty where the label states none."""
    read = [F.try_to_timestamp(F.trim(label), F.lit(x)) for x in LABELS]
    return F.coalesce(F.date_format(F.coalesce(*read), "yyyy/MM/dd"), F.lit(""))


def to_read(listed: DataFrame, known: DataFrame) -> DataFrame:
    """(id, pass) of the listed messages (pass, turn, id) that are not known (id): each once, by the first pass that lists it.

    A null or empty id cannot be read.  What is known only from a quote has no id, so it is read.
    """
    new = listed.where(F.col("id").cast("string") != "").groupBy("id").agg(F.min_by("pass", F.struct("turn", "pass")).alias("pass"))
    return new.join(known.select("id"), "id", "left_anti")


def passes(listed: DataFrame, reading: DataFrame, put: DataFrame) -> DataFrame:
    """(pass, seen, fetched, created, changed) of every pass; `put` (id, change) says what storing the read ones did."""
    seen = listed.groupBy("pass").agg(F.count("*").alias("seen"))
    done = reading.join(put.select("id", "change"), "id", "left").groupBy("pass").agg(F.count("*").alias("fetched"), F.count_if(F.col("change") == "created").alias("created"), F.count_if(F.col("change") == "changed").alias("changed"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("fetched", "created", "changed")]
    return seen.join(done, "pass", "left").select("pass", "seen", *zero)


def candidates(found: DataFrame, threads: DataFrame, accept: DataFrame, include_new: bool = False) -> DataFrame:
    """Chains found (query, turn, rank, root_id, container, ...) that no thread (container) shows, once each, with `accepted`.

    A chain counts for the query of the smallest turn that finds it, at its best rank
    there.  `accept` (root_id) names what was decided for; a null container is no thread.
    """
    rest = [c for c in found.columns if c != "root_id"]
    one = found.groupBy("root_id").agg(F.min_by(F.struct(*rest), F.struct("turn", "rank")).alias("r")).select("root_id", "r.*")
    new = one.join(threads.select("container").distinct(), "container", "left_anti")
    decided = accept.select("root_id").distinct().withColumn("named", F.lit(True))
    return new.join(decided, "root_id", "left").withColumn("accepted", F.coalesce("named", F.lit(include_new))).drop("named")


def accepted(proposals: DataFrame, accept: DataFrame) -> DataFrame:
    """(root_id) of all that is accepted, once each; one that is no candidate any more stays, so a decision can be stated twice."""
    return proposals.where("accepted").select("root_id").unionByName(accept.where("root_id IS NOT NULL").select("root_id")).distinct()


def membership(threads: DataFrame, sources: DataFrame, shown: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(container) of threads to take whole, and (ref) of messages to take one by one.

    A mail thread, and one that the corpus does not know, is one conversation and is taken
    whole.  A channel is not, so it is held to the messages shown (container, ref) before.
    """
    of = threads.where("container <> ''").select("container").distinct().join(sources, "container", "left")
    whole = of.where("source IS NULL OR source = 'mail'").select("container")
    single = shown.where((F.col("container") != "") & is_ext_id(F.col("ref"))).join(whole, "container", "left_anti")
    return whole, single.select("ref").distinct()


def selected(entries: DataFrame, whole: DataFrame, single: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries (entry_id, parent_id, container, ref, ...) of the new page: whole threads, single messages and accepted roots (root_id), with every chain that holds one."""
    seeds = entries.join(whole, "container", "left_semi").select("entry_id").unionByName(entries.join(single, "ref", "left_semi").select("entry_id"))
    seeds = seeds.unionByName(entries.join(roots.select(F.col("root_id").alias("entry_id")), "entry_id", "left_semi").select("entry_id"))
    return timeline.closure(entries, seeds)


def report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(container, before, after, change) of threads (container, count): added, grown, shrunk, same, or unranked where the new page has none of it."""
    return relate.growth(before, after, "container", "count").withColumn("change", F.when(F.col("change") == "gone", "unranked").otherwise(F.col("change")))


def carried(before: DataFrame, asked: DataFrame, fields: list[str], today: str) -> DataFrame:
    """Heads of timelines (timeline, label, runs, ...fields) after the refresh: what `asked` leaves null or empty is taken from before.

    The label that is replaced ends the list of runs, unless it is empty or stands there
    last already; a label that is not asked for is `today`.  Only known timelines are made again.
    """
    new = asked.select("timeline", F.col("label").alias("new_label"), *[F.col(f).alias(f"new_{f}") for f in fields])
    rows = before.join(new, "timeline")
    some = lambda c: F.when(F.length(c.cast("string")) > 0, c)
    runs = F.coalesce("runs", F.array().cast("array<string>"))
    kept = F.when((F.coalesce("label", F.lit("")) == "") | F.coalesce(F.try_element_at(runs, F.lit(-1)) == F.col("label"), F.lit(False)), runs).otherwise(F.concat(runs, F.array("label")))
    return rows.select("timeline", F.coalesce(some(F.col("new_label")), F.lit(today)).alias("label"), kept.alias("runs"), *[F.coalesce(some(F.col(f"new_{f}")), F.col(f)).alias(f) for f in fields])
