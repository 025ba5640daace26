"""Copies of one message: candidate pairs, reasons, groups, and which copy stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import LEAST, MOST, nearest_offset
from ..functions.text import tokens
from ..tables import written
from .groups import groups
from .relate import band_join
from .similar import similarity

WINDOW, WORDS, RECALL, HEAD = 26 * 3600, 25, 0.85, 0.75
RUN, REACH, SLACK = 8, 48, 1


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two short arrays, by one row of the table for each element of a."""
    m = F.size(b)
    zero = F.transform(b, lambda _: F.lit(0))

    def step(row: Column, x: Column) -> Column:
        def cell(left: Column, j: Column) -> Column:
            before = F.when(j > 0, F.get(row, j - 1)).otherwise(0)
            beside = F.when(j > 0, F.get(left, j - 1)).otherwise(0)
            return F.concat(left, F.array(F.when(F.get(b, j) == x, before + 1).otherwise(F.greatest(F.get(row, j), beside))))

        return F.aggregate(F.sequence(F.lit(0), m - 1), F.array().cast("array<int>"), cell)

    return F.when((m > 0) & (F.size(a) > 0), F.get(F.aggregate(a, zero, step), m - 1)).otherwise(0)


def head_similarity(a: Column, b: Column) -> Column:
    """Share of the first words of a that stand, in order, near the start of b.

    The length of the common subsequence as bits of one number: a bit of `row` is 0 where
    the table's row grows, and a word of b moves all of the row by one sum.
    """
    head = F.slice(a, 1, RUN)
    full = (1 << RUN) - 1

    def step(row: Column, x: Column) -> Column:
        hits = sum((F.when(F.get(head, F.lit(i)) == x, 1 << i).otherwise(0) for i in range(RUN)), F.lit(0))
        met = row.bitwiseAND(hits)
        return (row + met).bitwiseOR(row.bitwiseAND(F.bitwise_not(hits))).bitwiseAND(F.lit(full))

    common = lambda: F.lit(RUN) - F.bit_count(F.aggregate(F.slice(b, 1, REACH), F.lit(full), step))
    # the same first words, as most twins have: all are common
    same = head == F.slice(b, 1, RUN)
    return F.when(F.size(head) > 0, F.when(same, 1.0).otherwise(common() / F.size(head))).otherwise(0.0)


def twin_offset(gap: Column, quoted_a: Column, quoted_b: Column) -> Column:
    """The offset in minutes that a gap of b behind a, in seconds, can be; null if it can be none.

    Against a direct copy, whose clock is the true instant, it is the stated clock less
    that instant and lies within the bounds of zones; between two quoted copies it is a
    difference of offsets, which only the lattice of quarter hours binds.  A minute of
    slack is left on either.
    """
    minutes = F.round(gap / 60) * F.when(quoted_a & ~quoted_b, -1).otherwise(1)
    near = nearest_offset(minutes)
    bound = (quoted_a & quoted_b) | minutes.between(LEAST - SLACK, MOST + SLACK)
    return F.when(bound & (F.abs(minutes - near) <= SLACK), near)


def pairs(copies: DataFrame) -> DataFrame:
    """(a, b, gap, reason) of copies (entry_id, person, wall, text, quoted) of a person at most 26 hours apart.

    `reason` is null where the pair are twins, else the first gate that it fails.  Texts
    are joined only to pairs near in time, and word counts come before similarities.
    """
    near = written(band_join(copies.where("person IS NOT NULL"), "person", "wall", "entry_id", WINDOW))
    own = written(copies.select("entry_id", "quoted", F.slice(tokens(F.col("text")), 1, REACH).alias("head")))
    side = lambda s: own.select(*[F.col(c).alias(s if c == "entry_id" else f"{c}_{s}") for c in own.columns])
    both = similarity(near, copies).join(side("a"), "a").join(side("b"), "b")
    reason = (
        F.when(~F.col("quoted_a") & ~F.col("quoted_b"), "two direct copies")
        .when(F.least("na", "nb") < WORDS, "too few words")
        .when(twin_offset(F.col("gap"), F.col("quoted_a"), F.col("quoted_b")).isNull(), "no zone explains the gap")
        .when(F.col("overlap") < RECALL * F.least("na", "nb"), "words differ")
        .when((head_similarity(F.col("head_a"), F.col("head_b")) < HEAD) | (head_similarity(F.col("head_b"), F.col("head_a")) < HEAD), "beginnings differ")
    )
    return written(both.select("a", "b", "gap", reason.alias("reason")))


def plan(copies: DataFrame, links: DataFrame) -> DataFrame:
    """(entry_id, group, keep_id, decision) for members of twin groups; copies may have `attachments`.

    refuse: two direct copies in a group, or a copy with attachments would be dropped.  A
    direct copy stays; with none, the one of most words, then of the smallest id.
    """
    own = copies.select("entry_id", "quoted", F.size(tokens(F.col("text"))).alias("words"), (F.coalesce("attachments", F.lit(0)) if "attachments" in copies.columns else F.lit(0)).alias("attachments"))
    members = groups(links.where("reason IS NULL"), node="entry_id").join(own, "entry_id")
    best = F.max_by("entry_id", F.struct(~F.col("quoted"), F.col("words"), -F.col("entry_id"))).alias("keep_id")
    ends = members.groupBy("group").agg(best, F.count_if(~F.col("quoted")).alias("direct"))
    each = members.join(ends, "group")
    loses = each.groupBy("group").agg(F.bool_or((F.col("entry_id") != F.col("keep_id")) & (F.col("attachments") > 0)).alias("loses"))
    refused = (F.col("direct") > 1) | F.col("loses")
    decision = F.when(refused, "refuse").when(F.col("entry_id") == F.col("keep_id"), "keep").otherwise("drop")
    return each.join(loses, "group").select("entry_id", "group", F.when(~refused, F.col("keep_id")).alias("keep_id"), decision.alias("decision"))
