"""The opN_* queries and their SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, html_text, line_dedup, media, ngram_join, packing, periods, pii, secrets, topk, toxicity
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.report(media.store(table(spark, sf_dir, "documents", "doc_id", "text")))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.spans(table(spark, sf_dir, "documents", "doc_id", "text")))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.spans(table(spark, sf_dir, "documents", "doc_id", "text")))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.report(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text")))


def repeated_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """From which word on, and with which period, a tenth of the documents repeat themselves; a null id never."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    a = h // 10 % n
    return None if h % 10 else (a, 1 + (n - a) // (3 + h // 10 % 8))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.report(periods.find_runs(table(spark, sf_dir, "documents", "doc_id", "text"), rewrite=repeated_tail))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents", "lang", "source", "text"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.ORACLE_SQL, "op6_exact_top_k": topk.ORACLE_SQL, "op11_decontamination": decontaminate.ORACLE_SQL, "op13_divergence": divergence.ORACLE_SQL}
