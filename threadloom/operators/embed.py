"""Vectors of messages: what is embedded, by whom, what is pending, nearest neighbours and coverage."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector
from .peel import blocks

#: Least words with a letter, most characters, and the version of this preparation.
LEAST_WORDS, MOST_CHARS, PREPARED = 5, 6000, 1
#: Fixed value: marks of replies and forwards before a subject.
_PREFIXES = r"(?i)^\s*(?:(?:re|aw|fw|fwd|rv|sv|vs|antw)\s*(?:\[\d+\])?\s*:\s*)+"


def own_words(body: Column) -> Column:
    """The first part of a body if the sender wrote it: neither quoted nor behind a boundary; else empty."""
    first = F.get(blocks(body), F.lit(0))
    return F.coalesce(F.when((first["depth"] == 0) & (first["kind"] == "visible"), first["text"]), F.lit(""))


def content_words(text: Column) -> Column:
    """Number of words that hold a letter."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"\p{L}")))


def prepared(source: Column, subject: Column, body: Column) -> Column:
    """struct<text, reason> of what a model is given: subject, a blank line, own words with URLs as hosts; a reason where it is skipped."""
    own = F.when(source == "mail", own_words(body)).otherwise(F.coalesce(body, F.lit("")))
    own = F.regexp_replace(own, r"(?i)\bhttps?://([^\s/?#]+)[^\s]*", "$1")
    head = F.trim(F.regexp_replace(F.coalesce(subject, F.lit("")), _PREFIXES, ""))
    whole = F.concat(F.when(head != "", F.concat(head, F.lit("\n\n"))).otherwise(""), own)
    text = F.regexp_replace(F.regexp_replace(whole, r"\n{3,}", "\n\n"), r"\A\s+|\s+\z", "")
    reason = F.when(text == "", "no text").when(content_words(text) < LEAST_WORDS, "too short")
    cut = F.substring(text, 1, MOST_CHARS)
    clipped = F.when(F.length(text) > MOST_CHARS, F.regexp_replace(F.when(F.substring(text, MOST_CHARS + 1, 1).rlike(r"\s"), cut).otherwise(F.regexp_replace(cut, r"\s+\S*\z", "")), r"\s+\z", "")).otherwise(text)
    return F.struct(F.when(reason.isNull(), clipped).otherwise("").alias("text"), reason.alias("reason"))


class Embedder(Protocol):
    """A model: its name, its width, and unit vectors of texts in their order."""

    model: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """A model without weights: each word adds 1 or -1 at a place that its 32-bit FNV-1a hash gives; same text, same vector."""

    def __init__(self, model: str = "hash", dim: int = 64):
        self.model, self.dim = model, dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = 0x811C9DC5
                for byte in word.encode("utf-8", "surrogatepass"):
                    h = (h ^ byte) * 0x01000193 & 0xFFFFFFFF
                out[i, h % self.dim] += -1 if h >> 31 else 1
        length = np.sqrt((out**2).sum(1, keepdims=True))
        if not length.all():
            raise ValueError("a text without direction has no embedding")
        return out / length


def pending(texts: DataFrame, stored: DataFrame, model: str, dim: int) -> DataFrame:
    """Rows of `texts` (entry_id, text, reason, body_sha) that the model has no vector for, or one of another text, preparation or width."""
    have = stored.where(F.col("model") == model).select("entry_id", F.col("body_sha").alias("sha"), F.col("prepared").alias("p"), F.col("dim").alias("d"))
    stale = F.col("sha").isNull() | (F.col("sha") != F.col("body_sha")) | (F.col("p") != PREPARED) | (F.col("d") != dim)
    return texts.join(have, "entry_id", "left").where(stale).select(*texts.columns)


def backfill(todo: DataFrame, embedder: Embedder, batch: int = 256) -> DataFrame:
    """Rows to upsert for what is pending: vectors, or the reason why there is none.

    Each task embeds its rows in batches where they lie.  What has been written is no
    longer pending, so a run that was stopped goes on where it was.
    """

    def run(batches):
        for b in batches:
            texts, reasons = b.column(1).to_pylist(), b.column(2).to_pylist()
            vectors: list = [None] * len(texts)
            some = [i for i, r in enumerate(reasons) if r is None]
            for at in range(0, len(some), batch):
                part = some[at : at + batch]
                for i, v in zip(part, embedder.embed([texts[i] for i in part])):
                    vectors[i] = v.astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(vectors, pa.list_(pa.float32()))], ["entry_id", "reason", "body_sha", "embedding"])

    rows = todo.select("entry_id", "text", "reason", "body_sha").mapInArrow(run, "entry_id long, reason string, body_sha string, embedding array<float>")
    return rows.withColumns({"model": F.lit(embedder.model), "dim": F.lit(embedder.dim), "prepared": F.lit(PREPARED)})


def merge(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows with those of `fresh` in place of the same (entry_id, model)."""
    return stored.join(fresh.select("entry_id", "model"), ["entry_id", "model"], "left_anti").select(*fresh.columns).unionByName(fresh)


def prune(stored: DataFrame, keep: str) -> DataFrame:
    """Rows of the model that stays."""
    return stored.where(F.col("model") == keep)


def coverage(stored: DataFrame, texts: DataFrame) -> DataFrame:
    """(model, dim, vectors, skipped, stale) for each model, against the present texts."""
    now = texts.select("entry_id", F.col("body_sha").alias("now"))
    return stored.join(now, "entry_id", "left").groupBy("model").agg(
        F.max("dim").alias("dim"), F.count_if(F.col("embedding").isNotNull()).alias("vectors"), F.count_if(F.col("embedding").isNull()).alias("skipped"),
        F.count_if(~F.col("body_sha").eqNullSafe(F.col("now"))).alias("stale"),
    )


def nearest(stored: DataFrame, asked: list[float], model: str, k: int = 100, least: float = 0.0, among: DataFrame | None = None) -> DataFrame:
    """(entry_id, similarity, rank): the k unit vectors of a model nearest to one, ties to the smaller id.

    Only vectors of the query's width count; a floor of 0 is none; `among` (entry_id)
    narrows the entries before any product.
    """
    rows = stored.where((F.col("model") == model) & F.col("embedding").isNotNull() & (F.size("embedding") == len(asked)))
    rows = rows.join(among.select("entry_id").distinct(), "entry_id", "left_semi") if among is not None else rows
    found = rows.select("entry_id", vector.dot(F.col("embedding"), F.array(*map(F.lit, asked))).alias("similarity"))
    found = found.where(F.col("similarity") >= least) if least else found
    best = found.orderBy(F.desc("similarity"), "entry_id").limit(k)
    return best.withColumn("rank", F.row_number().over(_order()))


def _order():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("similarity"), "entry_id")
