"""Where one rendition of a message has words that another lacks: inline answers against signatures and notices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..tables import written
from .embed import own_words
from .similar import similarity

#: Most words of a text that is aligned, and the run of inserted words that is an answer.
MOST, RUN = 2000, 5
#: What mail clients write into a text and people do not.
RESIDUE = (r"(?i)https?://\S+", r"(?i)mailto:\S*", r"(?i)\[cid:[^\]]*\]", r"(?i)\[image:[^\]]*\]", r"<[^>\n]*>", r"\S+@\S+", r"(?i)\S+\.(?:png|jpe?g|gif|bmp|webp|pdf|csv|xlsx?|docx?)\b")

FOUND = "measured boolean, before int, inside int, longest int, appended int, astride int"


def prose_words(body: Column, quoted: Column) -> Column:
    """Words that a person wrote: of a direct copy its own part only, without links, addresses, placeholders and file names."""
    text = F.when(quoted, F.coalesce(body, F.lit(""))).otherwise(own_words(body))
    for pattern in RESIDUE:
        text = F.regexp_replace(text, pattern, " ")
    return tokens(text)


def align(a: list[str], b: list[str]) -> np.ndarray:
    """(k, 2) places of a longest common subsequence, in order; where either word can be left out, that of a is.

    A row of lengths is a running maximum, so the table takes one vector step for each
    word of a.  What both end with is matched word by word and needs no table.
    """
    whole, same = (len(a), len(b)), 0
    while same < min(whole) and a[-1 - same] == b[-1 - same]:
        same += 1
    tail = np.arange(same)[:, None] + np.array(whole) - same
    a, b = a[: whole[0] - same], b[: whole[1] - same]
    number = {w: i for i, w in enumerate({*a, *b})}
    x, y = (np.array([number[w] for w in t], np.int64) for t in (a, b))
    table = np.zeros((len(a) + 1, len(b) + 1), np.int16)
    for i in range(len(a)):
        row = table[i]
        table[i + 1, 1:] = np.maximum.accumulate(np.where(y == x[i], row[:-1] + 1, row[1:]))
    out, i, j = [], len(a), len(b)
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return np.concatenate([np.array(out[::-1], np.int64).reshape(-1, 2), tail])


def divergence(base: list[str], later: list[str]) -> tuple:
    """What `later` has beyond `base`: (measured, before, inside, longest, appended, astride), as numbers of words.

    Words between two neighbouring words of base are inside; where base skips words as
    well, the texts part there, and they are astride.
    """
    if len(base) > MOST or len(later) > MOST:
        return False, 0, 0, 0, 0, 0
    at = align(base, later)
    if not len(at):
        return True, 0, 0, 0, 0, 0
    runs, skips = np.diff(at[:, 1]) - 1, np.diff(at[:, 0]) > 1
    within = runs[~skips]
    return True, int(at[0, 1]), int(within.sum()), int(within.max(initial=0)), int(len(later) - 1 - at[-1, 1]), int(runs[skips].sum())


def divergences(pairs: DataFrame, base: str, later: str) -> DataFrame:
    """Every row and column of `pairs` (two arrays of words) with the numbers of `divergence`; nothing is shuffled."""
    names = [f.split()[0] for f in FOUND.split(", ")]
    types = [pa.bool_()] + [pa.int32()] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.schema.names.index(base), b.schema.names.index(later)
            got = [divergence(p.as_py() or [], q.as_py() or []) for p, q in zip(b.column(x), b.column(y))]
            columns = [pa.array([g[i] for g in got], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, *names])

    from pyspark.sql.types import StructType

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, *StructType.fromDDL(FOUND).fields]))


def annotated(plan: DataFrame, copies: DataFrame) -> DataFrame:
    """(entry_id, keep_id, inside, longest, reason) of the copies that a plan drops and that hold words of their own.

    `answered inside`: somebody wrote a run of RUN words or more into the text; `too long
    to place`: over MOST words and not contained in the copy that stays.  Only the dropped
    copies and their keepers are tokenised.
    """
    drops = plan.where("decision = 'drop'").select("entry_id", "keep_id")
    used = written(drops.select("entry_id").unionByName(drops.select(F.col("keep_id").alias("entry_id"))).distinct())
    own = written(copies.join(used, "entry_id", "left_semi").select("entry_id", prose_words(F.col("text"), F.col("quoted")).alias("words")))
    both = drops.join(own.select("entry_id", F.col("words").alias("later")), "entry_id").join(own.select(F.col("entry_id").alias("keep_id"), F.col("words").alias("base")), "keep_id")
    found = written(divergences(both, "base", "later"))
    # those too long to align are few: their words are counted, each text once
    long_ = found.where("NOT measured").select(F.to_json(F.struct(F.lit("later").alias("of"), "entry_id", "keep_id")).alias("a"), F.to_json(F.struct(F.lit("base").alias("of"), "entry_id", "keep_id")).alias("b"), "later", "base", "entry_id", "keep_id")
    texts = long_.select(F.col("a").alias("entry_id"), F.array_join("later", " ").alias("text")).unionByName(long_.select(F.col("b").alias("entry_id"), F.array_join("base", " ").alias("text")))
    beyond = similarity(long_.select("a", "b", "entry_id", "keep_id"), texts).where("overlap < na").select("entry_id", "keep_id", F.lit(True).alias("beyond"))
    found = found.join(beyond, ["entry_id", "keep_id"], "left")
    reason = F.when(~F.col("measured"), F.when(F.col("beyond"), "too long to place")).when(F.col("longest") >= RUN, "answered inside")
    return found.withColumn("reason", reason).where("reason IS NOT NULL").select("entry_id", "keep_id", "inside", "longest", "reason")
