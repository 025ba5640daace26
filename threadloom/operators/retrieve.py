"""Search results as they are used: people in filters, structural queries, chains with their best members, expansion, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, normalise_identity
from .search import RRF

#: Defaults of a query: results, candidates of each list, members shown of a chain.
LIMIT, CANDIDATES, MEMBERS = 20, 500, 3
#: Defaults of expansion: least matched entries, and entries after which no further chain starts.
LEAST_MATCHED, MOST_ENTRIES = 2, 300


def people_named(names: DataFrame, identities: DataFrame, people: DataFrame) -> DataFrame:
    """(person_id) of whoever a name of `names` (name) is an address, a user id or a display name of; blank names are nobody's."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), normalise_identity(F.lit(k), F.col("name")).alias("value")) for k in ("email", "uid", "name")])
    asked = names.select(F.explode(kinds).alias("a")).select("a.*").where("value IS NOT NULL").distinct()
    held = identities.select("kind", "value", "person_id")
    called = people.select(F.lit("name").alias("kind"), F.lower(collapse(F.col("name"))).alias("value"), "person_id")
    return held.unionByName(called).join(asked, ["kind", "value"], "left_semi").select("person_id").distinct()


def written_by(entries: DataFrame, ids: list[int] | None, named: DataFrame | None) -> DataFrame:
    """Entries whose author is one of the ids or of the people named; without either, all of them."""
    if ids is None and named is None:
        return entries
    wanted = entries.sparkSession.createDataFrame([(i,) for i in ids or ()], "person_id long")
    wanted = wanted.unionByName(named.select("person_id")) if named is not None else wanted
    return entries.join(wanted.distinct(), "person_id", "left_semi")


def involving(entries: DataFrame, participants: DataFrame, wanted: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """Entries with a participant (entry_id, person_id, role) among the wanted people, in one of the roles if any are given."""
    part = participants.where(F.col("role").isin(*roles)) if roles else participants
    return entries.join(part.join(wanted.select("person_id").distinct(), "person_id", "left_semi").select("entry_id"), "entry_id", "left_semi")


def attached(entries: DataFrame, attachments: DataFrame, has: bool | None) -> DataFrame:
    """Entries with attachments (entry_id), those without, or all for None."""
    return entries if has is None else entries.join(attachments.select("entry_id"), "entry_id", "left_semi" if has else "left_anti")


def recent(entries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(entry_id, score, rank) of the latest entries, ties to the larger id, for a query without text."""
    best = entries.select("entry_id", "ts").orderBy(F.desc("ts"), F.desc("entry_id")).limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("entry_id")))
    return best.withColumn("rank", rank).select("entry_id", (F.lit(1.0) / (RRF + F.col("rank"))).alias("score"), "rank")


def best_members(hits: DataFrame, found: DataFrame, n: int = MEMBERS) -> DataFrame:
    """(root_id, i, entry_id, score): the n best hits of each chain."""
    place = F.row_number().over(Window.partitionBy("root_id").orderBy(F.desc("score"), "entry_id"))
    return hits.join(found.select("entry_id", "root_id"), "entry_id").withColumn("i", place).where(F.col("i") <= n).select("root_id", "i", "entry_id", "score")


def expansion(chains: DataFrame, top: int, least: int = LEAST_MATCHED, ratio: float = 0.0, cap: int = MOST_ENTRIES) -> DataFrame:
    """Chains (root_id, score, matched, entries) with `refused`: why one is not shown whole, null if it is.

    Relevance gates come first; of the chains that pass, the `top` best are shown, and
    none starts after `cap` entries have been (0: no bound).  A chain is never cut.  The
    chains are the results of one search, few by their limit.
    """
    gate = F.when(F.col("matched") < least, F.concat(F.col("matched").cast("string"), F.lit(f" matched of {least} asked for")))
    gate = gate.when((F.lit(ratio) > 0) & (F.col("entries") > 0) & (F.col("matched") / F.col("entries") < ratio), F.concat(F.format_number(F.col("matched") / F.col("entries"), 2), F.lit(f" of it matched, {ratio:.2f} asked for")))
    order = Window.partitionBy(F.col("gate").isNull()).orderBy(F.desc("score"), "root_id")
    rows = chains.withColumn("gate", gate).withColumn("nth", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum("entries").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    late = F.when(F.col("nth") > top, f"{top} chains are shown already").when((F.lit(cap) > 0) & (F.col("before") >= cap), f"{cap} entries are shown already")
    return rows.withColumn("refused", F.coalesce("gate", late)).select(*chains.columns, "refused")


def expanded(chains: DataFrame, found: DataFrame, entries: DataFrame, hits: DataFrame, snippet: Column) -> DataFrame:
    """(root_id, place, entry_id, mark, excerpt): the members of chains by time, each marked match or chain; a match shows its snippet."""
    own = found.select("entry_id", "root_id").join(chains.where("refused IS NULL").select("root_id"), "root_id")
    rows = entries.join(own, "entry_id").join(hits.select("entry_id", F.lit(True).alias("hit")), "entry_id", "left")
    place = F.row_number().over(Window.partitionBy("root_id").orderBy("ts", "entry_id")) - 1
    return rows.select("root_id", place.cast("long").alias("place"), "entry_id", F.when(F.col("hit"), "match").otherwise("chain").alias("mark"), F.coalesce(F.when(F.col("hit"), snippet), collapse(F.col("text"))).alias("excerpt"))


def subject_of(root: Column, best: Column, label: Column) -> Column:
    """The first of a chain's subjects that is not blank: the root's, the best hit's, the conversation's label."""
    some = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", c)
    return F.coalesce(some(root), some(best), some(label))


def why(prose: Column, identifier: Column, similar: Column, similarity: Column) -> Column:
    """The ranks that a result has in the lists, such as `[prose 2, id 1, similar 4 @ 0.71]`."""
    part = lambda name, rank: F.when(rank.isNotNull(), F.concat(F.lit(name), rank.cast("string")))
    return F.concat(F.lit("["), F.concat_ws(", ", part("prose ", prose), part("id ", identifier), F.when(similar.isNotNull(), F.concat(F.lit("similar "), similar.cast("string"), F.lit(" @ "), F.format_string("%.2f", similarity)))), F.lit("]"))


def labels(containers: DataFrame, channels: DataFrame, people: DataFrame) -> DataFrame:
    """(container, label): #name of a known channel, the name of the person that @uid is, else the container itself."""
    of = containers.select("container").distinct()
    named = of.join(channels.select(F.col("channel").alias("container"), F.col("name").alias("channel_name")), "container", "left")
    uid = F.when(F.col("container").startswith("@"), F.substring("container", 2, 1 << 20))
    named = named.withColumn("uid", uid).join(people.select("uid", F.col("name").alias("person_name")), "uid", "left")
    return named.select("container", F.coalesce(F.concat(F.lit("#"), "channel_name"), "person_name", "container").alias("label"))


def dominant_source(entries: DataFrame) -> DataFrame:
    """(container, source): the source of most entries, ties to the first by name."""
    counts = entries.where("container IS NOT NULL").groupBy("container", "source").agg(F.count("*").alias("n"))
    ranked = counts.groupBy("container").agg(F.max("n").alias("n")).join(counts, ["container", "n"])
    return ranked.groupBy("container").agg(F.min("source").alias("source"))
