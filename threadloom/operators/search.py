"""Lexical search: BM25 of words and of phrases, substrings, snippets, fusion by reciprocal rank, chain scores."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..tables import written

K1, B, RRF = 1.2, 0.75, 60
LEAST_IDF = 1e-6


def _gain(i: int) -> Column:
    tf, n = F.col(f"t{i}"), F.col(f"n{i}")
    idf = F.greatest(F.log((F.col("n") - n + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def bm25(entries: DataFrame, terms: list[str], entry: str = "entry_id", text: str = "text") -> DataFrame:
    """(entry_id, score) of the entries that hold every term.

    Document counts and mean length are of the whole table.  One pass over the texts:
    each row carries only its length and one count for each query term.
    """
    own = tokens(F.col(text))
    often = lambda t: F.size(F.filter("w", lambda x: x == t))
    rows = entries.select(F.col(entry).alias("entry_id"), own.alias("w")).select("entry_id", F.size("w").alias("dl"), *[often(t).alias(f"t{i}") for i, t in enumerate(terms)])
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"n{i}") for i in range(len(terms))])

    every = rows.where(" AND ".join(f"t{i} > 0" for i in range(len(terms))) or "false")
    # the statistics are one row
    return every.join(F.broadcast(stats)).select("entry_id", sum((_gain(i) for i in range(len(terms))), F.lit(0.0)).alias("score"))


def write_postings(entries: DataFrame, path: str, entry: str = "entry_id", text: str = "text", buckets: int = 256) -> None:
    """Index texts for `bm25_postings`: (token, entry_id, tf, dl) by bucket of the token, and the counts of the whole table.

    A text is tokenised once; counts of words are whole before the shuffle, which deals
    each bucket's rows over several files by entry, so a frequent word is never one task's.
    """
    own = entries.select(F.col(entry).alias("entry_id"), tokens(F.col(text)).alias("w"))
    rows = own.select("entry_id", F.size("w").alias("dl"), F.explode("w").alias("token")).groupBy("entry_id", "dl", "token").agg(F.count("*").cast("int").alias("tf"))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    dealt.repartition("bucket", F.pmod(F.xxhash64("entry_id"), F.lit(4))).sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{path}/postings")
    own.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"), F.lit(buckets).alias("buckets")).write.parquet(f"{path}/stats")


def bm25_postings(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """(entry_id, score) as `bm25` gives, from an index: only the buckets and row groups of the query's words are read."""
    wanted = sorted(set(terms))
    stats = spark.read.parquet(f"{path}/stats")
    size = stats.first()["buckets"]
    # xxhash64 of a word is the same here as where the index was written; one row for each term
    asked = spark.createDataFrame([(t,) for t in wanted], "token string").select(F.pmod(F.xxhash64("token"), F.lit(size)).cast("int").alias("b")).distinct().collect() if wanted else []
    found = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin([r["b"] for r in asked]) & F.col("token").isin(wanted))
    holders = found.groupBy("token").agg(F.count("*").alias("held"))
    gain = F.greatest(F.log((F.col("n") - F.col("held") + 0.5) / (F.col("held") + 0.5)), F.lit(LEAST_IDF)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # one row for each term, and one of statistics
    rows = found.join(F.broadcast(holders), "token").join(F.broadcast(stats))
    return rows.groupBy("entry_id").agg(F.sum(gain).alias("score"), F.count("*").alias("matched")).where(F.col("matched") == len(wanted)).select("entry_id", "score")


def containing(entries: DataFrame, needle: str, entry: str = "entry_id", text: str = "text") -> DataFrame:
    """(entry_id, score): how often each text holds a string of three characters or more, whatever its case."""
    low = F.lower(F.col(text))
    hits = ((F.length(low) - F.length(F.replace(low, F.lit(needle.lower()), F.lit("")))) / len(needle)).cast("double")
    return entries.where(low.contains(needle.lower()) & F.lit(len(needle) >= 3)).select(F.col(entry).alias("entry_id"), hits.alias("score"))


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best with their rank from 1; ties go to the smaller id."""
    best = found.orderBy(F.desc("score"), "entry_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "entry_id")))


def fuse(lists: list[DataFrame], k: int, constant: int = RRF) -> DataFrame:
    """Ranked lists by the sum of 1 / (constant + rank); every list has the same vote."""
    union = lists[0].select("entry_id", "rank")
    for x in lists[1:]:
        union = union.unionByName(x.select("entry_id", "rank"))
    return top(union.groupBy("entry_id").agg(F.sum(F.lit(1.0) / (constant + F.col("rank"))).alias("score"), F.count("*").alias("lists")), k)


def chain_scores(hits: DataFrame, found: DataFrame, k: int | None) -> DataFrame:
    """Chains by the damped sum of their members' scores: the i-th best counts 1/i; the k best, or all in no order."""
    place = F.row_number().over(Window.partitionBy("root_id").orderBy(F.desc("score"), "entry_id"))
    rows = hits.join(found, "entry_id").withColumn("i", place)
    chains = rows.groupBy("root_id").agg(F.sum(F.col("score") / F.col("i")).alias("score"), F.count("*").alias("matched"), F.min_by("entry_id", "i").alias("best"))
    return chains.orderBy(F.desc("score"), "root_id").limit(k) if k is not None else chains


def query_terms(asked: str) -> list[str]:
    """Terms of a query: quoted runs whole, else words, without marks at either end; an open quote runs to the end."""
    found = re.findall(r'"([^"]*)"?|([^\s"]+)', asked)
    return [t for t in (re.sub(r"^[\W_]+|[\W_]+$", "", a or b) for a, b in found) if t]


def is_identifier(term: str) -> bool:
    """Whether a term holds a digit, or a hyphen between letters or digits."""
    return bool(re.search(r"\d|[^\W_]-[^\W_]", term))


def phrases(entries: DataFrame, terms: list[str], fields: dict[str, float], entry: str = "entry_id") -> DataFrame:
    """(entry_id, score) of entries that hold every term, as a run of words, in one of the weighted columns.

    Counts of a phrase are weighted by column; lengths and document counts are of the
    whole table, over all columns.  The words of a row never leave it.
    """
    wanted = [t for t in (re.findall("[a-z0-9]+", x.lower()) for x in terms) if t]
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))

    def often(c: str, phrase: list[str]) -> Column:
        # where the first word stands as a whole word and the others follow; occurrences may overlap
        rest = "".join(f"[^a-z0-9]++{w}(?![a-z0-9])" for w in phrase[1:])
        return F.regexp_count(low(c), F.lit(f"(?<![a-z0-9]){phrase[0]}(?![a-z0-9])(?={rest})"))

    length = sum((F.size(tokens(F.col(c))) for c in fields), F.lit(0))
    # numbers only, so texts are read once
    rows = written(entries.select(F.col(entry).alias("entry_id"), length.alias("dl"), *[sum((often(c, p) * F.lit(float(x)) for c, x in fields.items()), F.lit(0.0)).alias(f"t{i}") for i, p in enumerate(wanted)]))
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"n{i}") for i in range(len(wanted))])
    every = rows.where(" AND ".join(f"t{i} > 0" for i in range(len(wanted))) or "false")
    # the statistics are one row
    return every.join(F.broadcast(stats)).select("entry_id", sum((_gain(i) for i in range(len(wanted))), F.lit(0.0)).alias("score"))


def snippet(text: Column, terms: list[str], width: int = 12) -> Column:
    """The window of words around the first match, matches in brackets, an ellipsis where words are left out; null without a match."""
    wanted = [w for t in terms for w in re.findall("[a-z0-9]+", t.lower())]
    w = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")
    hit = lambda x: F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", "")).isin(*wanted)

    def found(w: Column) -> Column:
        # one pattern over all words; none of them holds a space
        bare = F.split(F.lower(F.regexp_replace(F.array_join(w, " "), "[^A-Za-z0-9 ]", "")), " ", -1)
        at = F.array_min(F.filter(F.array(*[F.array_position(bare, x) for x in wanted]), lambda i: i > 0)) if wanted else F.lit(0)
        return F.struct(w.alias("w"), F.coalesce(at, F.lit(0)).cast("int").alias("at"))

    def shown(x: Column) -> Column:
        w, at = x["w"], x["at"]
        start = F.greatest(at - width // 2, F.lit(1))
        words = F.array_join(F.transform(F.slice(w, start, width), lambda y: F.when(hit(y), F.concat(F.lit("["), y, F.lit("]"))).otherwise(y)), " ")
        return F.when(at > 0, F.concat(F.when(start > 1, "… ").otherwise(""), words, F.when(start + width - 1 < F.size(w), " …").otherwise("")))

    return F.get(F.transform(F.transform(F.array(w), found), shown), F.lit(0))
