"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..tables import written  # noqa: F401

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder, with the named columns only (all if none are named)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of `df` has, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Give the memory that Arrow holds without using it back to the system; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow in batches of about BATCH_BYTES; a row that is larger is a batch of its own.

    Spark's own bound is 64 MB.  A batch lies in the executor outside its heap and in the
    worker, there also as what is made of it, and neither gives all of that back by
    itself, so that it adds up over the tasks and stages of a session.  Spark reads the
    setting when the rows are computed, so it stays in the session; one that the session
    has already is left as it is.
    """
    conf = df.sparkSession.conf
    if BATCH not in conf.getAll:
        conf.set(BATCH, BATCH_BYTES)

    def lean(batches):
        for out in run(batches):
            yield out
            del out
            give_back()

    return df.mapInArrow(lean, schema)
