"""Stages that turn raw documents into packed training sequences.

Toxic documents go, boilerplate lines go, one document of each group of near copies
stays, secrets are masked, and what is left is packed.  Each stage's rows are written as
Parquet and read again as the next one's input.

In every stage but the last, columns stay as they are, whatever their names; a null id or
source stays null, a null text null and an empty one empty; a text of any length is taken
whole; repeated rows share one fate; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import line_dedup, ngram_join, packing, secrets, toxicity
from threadloom.llm.common import table, written


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the input, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(columns) if "n_chars" in columns else docs.select(columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold; a null text is scored as an empty one."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; null is a source too."""
    # copies of one document can be over the ratio; the next stage leaves one of them
    return _sized(line_dedup.drop_boilerplate(docs, never_empty=True), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group; those without words or without an id all stay, as do rows that share the id."""
    return ngram_join.first_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask for each secret."""
    return _sized(secrets.redact(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document's tokens; a null or empty text is the end token alone."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_jaccard_join", drop_near_copies), ("secret_scan", mask_secrets), ("packing", pack)]
#: A trained classifier and an online packer cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
