"""Reading what chat and mail exports hold, and keyed upserts of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relate import latest


def latest_chunk(rows: DataFrame, key: list[str], chunk: str = "CHUNK_ID") -> DataFrame:
    """Of rows that several chunks of an archive repeat, those of the highest chunk."""
    return latest(rows, key, [chunk])


def unwrap(responses: DataFrame, value: str, data: str) -> DataFrame:
    """Rows of the data of JSON envelopes {ok, data, error}; an envelope that is not ok is an error."""
    got = F.from_json(value, f"struct<ok: boolean, data: array<{data}>, error: struct<code: string, message: string>>")
    checked = F.when(got["ok"], got["data"]).otherwise(F.raise_error(F.concat_ws(": ", F.lit("source refused"), got["error"]["code"], got["error"]["message"])))
    return responses.select(F.explode(checked).alias("r")).select("r.*")


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], digest: str) -> DataFrame:
    """All rows after the upsert, with `change`: created, changed, same or kept (not in the incoming)."""
    old, new = stored.select(F.struct(*stored.columns).alias("old"), *key), incoming.select(F.struct(*stored.columns).alias("new"), *key)
    both = old.join(new, key, "full")
    change = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "created").when(F.col(f"old.{digest}").eqNullSafe(F.col(f"new.{digest}")), "same").otherwise("changed")
    return both.select(change.alias("change"), F.coalesce("new", "old").alias("r")).select("r.*", "change")


def insert_absent(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows and those incoming rows whose key is new and whole."""
    new = incoming.dropna(subset=key).dropDuplicates(key).join(stored.select(*key), key, "left_anti")
    return stored.unionByName(new.select(*stored.columns))
