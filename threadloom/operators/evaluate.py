"""Retrieval metrics of ranked lists against judged sets, and zone fits against observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import zone_offset


def metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query, recall, ndcg, rr) of each query with something relevant.

    `ranked` has query, entry_id and rank from 1; `relevant` has query and entry_id.
    Gains are 0 or 1, and the ideal list is capped at k.
    """
    wanted = relevant.distinct().groupBy("query").agg(F.count("*").alias("wanted"))
    hits = ranked.join(relevant.distinct(), ["query", "entry_id"]).groupBy("query").agg(
        F.count_if(F.col("rank") <= k).alias("found"),
        F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.min("rank").alias("first"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("wanted"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    out = wanted.join(hits, "query", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("query", zero(F.col("found") / F.col("wanted")).alias("recall"), zero(F.col("dcg") / ideal).alias("ndcg"), zero(1 / F.col("first")).alias("rr"))


def metrics_of_scores(scored: DataFrame, k: int, score: str = "s") -> DataFrame:
    """`metrics` of rows (query, entry_id, s, relevant), ranked by score, then the smaller id.

    Only the k best of a query are put in order, which Spark does in partial limits; the
    place of the best relevant one is a count of those before it, so no query's rows are
    sorted or gathered whole.
    """
    order = F.struct(F.col(score), -F.col("entry_id"))
    best = scored.groupBy("query").agg(F.count_if("relevant").alias("wanted"), F.max(F.when(F.col("relevant"), order)).alias("best")).where("wanted > 0")
    first = scored.join(best, "query").groupBy("query", "wanted").agg((F.count_if(order > F.col("best")) + 1).alias("first"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(score), "entry_id"))
    top = scored.withColumn("rank", rank).where(F.col("rank") <= k).where("relevant").groupBy("query").agg(F.count("*").alias("found"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("wanted"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return first.join(top, "query", "left").select("query", zero(F.col("found") / F.col("wanted")).alias("recall"), zero(F.col("dcg") / ideal).alias("ndcg"), (1 / F.col("first")).alias("rr"))


def fit_zones(observed: DataFrame, zones: list[str]) -> DataFrame:
    """(person, verdict, zones): which zones give every stated offset of a person.

    `observed` has person, ts (an instant) and offset in minutes.  Offsets of 0 say
    nothing of a place: with those alone the verdict is utc, without any row there is
    none, moved where no zone fits all, else placed.  The candidates are a short list.
    """
    per = observed.where("offset IS NOT NULL").select("person", "ts", "offset", F.posexplode(F.array(*map(F.lit, zones))).alias("place", "zone"))
    fits = per.where("offset <> 0").groupBy("person", "place", "zone").agg(F.bool_and(zone_offset(F.col("ts"), F.col("zone")) == F.col("offset")).alias("ok"))
    good = fits.groupBy("person").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("ok"), F.struct("place", "zone")))), lambda x: x["zone"]).alias("zones"))
    people = observed.where("offset IS NOT NULL").select("person").distinct()
    verdict = F.when(F.col("zones").isNull(), "utc").when(F.size("zones") == 0, "moved").otherwise("placed")
    return people.join(good, "person", "left").select("person", verdict.alias("verdict"), F.coalesce("zones", F.array().cast("array<string>")).alias("zones"))


def report(cases: DataFrame, results: DataFrame) -> DataFrame:
    """One row of means over the judged cases, and of what the cases without an answer let through.

    `cases` has query, recall, ndcg, rr and expect_empty; `results` query and similarity
    of every result.  A case without an answer is clean if nothing was returned.
    """
    counts = results.groupBy("query").agg(F.count("*").alias("n"), F.max("similarity").alias("top"))
    rows = cases.join(counts, "query", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    mean = lambda c: F.avg(F.when(~F.col("expect_empty"), F.col(c))).alias(c)
    return rows.agg(
        F.count_if(~F.col("expect_empty")).alias("judged"), mean("recall"), mean("ndcg"), mean("rr"), F.count_if("expect_empty").alias("negative"),
        F.count_if(F.col("expect_empty") & (F.col("n") == 0)).alias("clean"), F.coalesce(F.sum(F.when(F.col("expect_empty"), F.col("n"))), F.lit(0)).alias("leaked"), F.max(F.when(F.col("expect_empty"), F.col("top"))).alias("top_noise"),
    )


def floor_sweep(similarities: DataFrame, floors: list[float]) -> DataFrame:
    """(floor, lost, left): how many true results (`hit`) lie below each floor, and how many of the others do not."""
    wanted = F.explode(F.array(*[F.lit(float(f)) for f in floors])).alias("floor")
    below = F.col("similarity") < F.col("floor")
    return similarities.select("hit", "similarity", wanted).groupBy("floor").agg(F.count_if(F.col("hit") & below).alias("lost"), F.count_if(~F.col("hit") & ~below).alias("left"))


def compared(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of two reports by query, with the change of each column."""
    old = before.select("query", *[F.col(c).alias(f"{c}_before") for c in columns])
    both = old.join(after.select("query", *columns), "query", "full")
    return both.select("query", *[x for c in columns for x in (F.col(f"{c}_before"), F.col(c), (F.col(c) - F.col(f"{c}_before")).alias(f"{c}_change"))])
