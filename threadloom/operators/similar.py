"""Multiset overlap of texts and repeated endings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..tables import written


def word_counts(texts: DataFrame, entry: str = "entry_id", text: str = "text") -> DataFrame:
    """(entry_id, token, k) of every text, tokenised once; counts are whole before anything is shuffled."""
    return texts.select(F.col(entry).alias("entry_id"), F.explode(tokens(F.col(text))).alias("token")).groupBy("entry_id", "token").agg(F.count("*").alias("k"))


def bags(texts: DataFrame, entry: str = "entry_id", text: str = "text") -> DataFrame:
    """(entry_id, bag) of every text with words: its tokens as a set, the k-th of equal ones marked by k.

    Two bags share as many elements as the texts' multisets of tokens.  A text goes once
    to where its entry belongs, and its words are counted there.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.select(F.col(entry).alias("entry_id"), F.col(text).alias("text")).repartition(parts, "entry_id")
    marked = F.transform(F.sequence(F.lit(1), F.col("k").cast("int")), lambda i: F.when(i == 1, F.col("token")).otherwise(F.concat(F.col("token"), F.lit(" "), i.cast("string"))))
    return word_counts(dealt).groupBy("entry_id").agg(F.flatten(F.collect_list(marked)).alias("bag"))


def similarity(pairs: DataFrame, texts: DataFrame, entry: str = "entry_id", text: str = "text") -> DataFrame:
    """Pairs (a, b) of entries with their numbers of words `na` and `nb`, `overlap` (size of the multiset intersection of tokens) and `similarity` (Dice, 0 for two empty texts).

    Only texts that are in a pair are tokenised, each once; what is joined are bags of
    words, one row a pair, and nothing is grouped by pair or word afterwards.
    """
    used = pairs.select(F.col("a").alias("used")).unionByName(pairs.select(F.col("b").alias("used"))).distinct()
    held = written(bags(texts.join(used, texts[entry] == used["used"], "left_semi"), entry, text))
    out = pairs
    for s in "ab":
        out = out.join(held.select(F.col("entry_id").alias(s), F.col("bag").alias(f"bag_{s}")), s, "left")
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    met = F.coalesce(F.size(F.array_intersect("bag_a", "bag_b")), F.lit(0))
    overlap = F.when(F.col("bag_a").isNull() | F.col("bag_b").isNull(), 0).otherwise(met).cast("long")
    out = out.select(*pairs.columns, size("bag_a").alias("na"), size("bag_b").alias("nb"), overlap.alias("overlap"))
    return out.withColumn("similarity", F.when(F.col("na") + F.col("nb") > 0, 2.0 * F.col("overlap") / (F.col("na") + F.col("nb"))).otherwise(0.0))


def endings(messages: DataFrame, entry: str, author: str, domain: str, text: str, least: int = 2, most: int = 25, repeats: int = 3) -> DataFrame:
    """(entry, lines, count, senders, scope): the longest ending that repeats.

    An ending of n lines, never the whole message, counts for its author if `repeats`
    messages of the author end so, or for the domain if as many of the domain do, from
    two authors, and it is strictly longer than the author's.  Blank lines count for
    nothing, at the end or inside.  What is grouped are digests, with partial counts, and
    the digests of all endings are written once.
    """
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: ~x.rlike(r"^\s*$"))
    rows = messages.select(F.col(entry).alias("entry_id"), F.col(author).alias("author"), F.col(domain).alias("domain"), lines.alias("lines"))
    lengths = F.sequence(F.lit(least), F.least(F.lit(most), F.size("lines") - 1))
    each = rows.where(F.size("lines") > least).withColumn("n", F.explode(lengths))
    each = each.select("entry_id", "author", "domain", "n", F.md5(F.array_join(F.transform(F.slice("lines", F.size("lines") - F.col("n") + 1, F.col("n")), F.trim), "\n")).alias("key"))
    each = written(each)
    by_author = each.groupBy("author", "n", "key").agg(F.count("*").alias("count")).where(F.col("count") >= repeats).select("author", "n", "key", "count", F.lit(1).cast("long").alias("senders"), F.lit("author").alias("scope"))
    by_domain = each.groupBy("domain", "n", "key", "author").agg(F.count("*").alias("c")).groupBy("domain", "n", "key").agg(F.sum("c").alias("count"), F.count("*").alias("senders")).where((F.col("count") >= repeats) & (F.col("senders") >= 2)).withColumn("scope", F.lit("domain"))
    found = each.join(by_author, ["author", "n", "key"]).select("entry_id", "n", "count", "senders", "scope").unionByName(each.join(by_domain, ["domain", "n", "key"]).select("entry_id", "n", "count", "senders", "scope"))
    # the longest; at the same length the author's own
    best = F.max(F.struct("n", (F.col("scope") == "author").alias("own"), "count", "senders", "scope")).alias("best")
    return found.groupBy("entry_id").agg(best).select("entry_id", F.col("best.n").alias("lines"), "best.count", "best.senders", "best.scope")
