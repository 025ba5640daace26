"""Searches of `documents` by index, each with the SQL that states the same by a scan; each query builds its index from the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector
from ..operators import index, search
from ..tables import shared_dir
from .queries import NEEDLE, _read, query


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/threadloom/{uuid.uuid4().hex}"


def _words(spark: SparkSession, docs: DataFrame, terms: list[str], stemmed: bool) -> DataFrame:
    path = _place(spark)
    index.write_index(docs, path, ("source", "text"), "doc_id", stemmed=stemmed)
    return index.match(spark, path, terms, {"source": 4.0})


def _holding(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = _place(spark)
    index.write_grams(docs, path, "doc_id")
    return index.holding(docs, path, NEEDLE, "doc_id")


_GAIN = f"greatest(ln((n - held + 0.5) / (held + 0.5)), {search.LEAST_IDF}) * tf * {search.K1 + 1} / (tf + {search.K1} * ({1 - search.B} + {search.B} * dl / avgdl))"
_TOKENS = lambda c: f"regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}]+')"
_PHRASE = f"""w AS (SELECT doc_id, {_TOKENS('source')} AS s, {_TOKENS('text')} AS t FROM documents),
ph AS (SELECT doc_id, len(s) + len(t) AS dl, 4.0 * len(list_filter(range(1, len(s)), lambda i: s[i] = 'of' AND s[i + 1] = 'the')) + len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS tf FROM w),
phrased AS (SELECT doc_id AS entry_id, round({_GAIN}, 6) AS score FROM ph, (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE tf > 0) AS held FROM ph) WHERE tf > 0)"""
_NEEDLE = f"""nd AS (SELECT doc_id, greatest(length(coalesce(text, '')) - 2, 0) AS dl, (length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), '{NEEDLE}', ''))) // {len(NEEDLE)} AS tf FROM documents),
needled AS (SELECT doc_id AS entry_id, round({_GAIN}, 6) AS score FROM nd, (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE tf > 0) AS held FROM nd) WHERE tf > 0)"""
_TOP = lambda t: f"SELECT entry_id, row_number() OVER (ORDER BY score DESC, entry_id) AS rank FROM {t} QUALIFY rank <= 500"


@query(f"WITH {_PHRASE} SELECT * FROM phrased")
def index_phrases(spark, sf_dir):
    return _words(spark, _read(spark, sf_dir, "documents"), ["of the"], stemmed=False).select("entry_id", F.round("score", 6).alias("score"))


@query()
def index_stems(spark, sf_dir):
    return _words(spark, _read(spark, sf_dir, "documents"), ["of thes"], stemmed=True).select("entry_id", F.round("score", 6).alias("score"))


@query(f"WITH {_NEEDLE} SELECT * FROM needled")
def index_substrings(spark, sf_dir):
    return _holding(spark, _read(spark, sf_dir, "documents")).select("entry_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_PHRASE}, {_NEEDLE},
vec AS (SELECT e.vec_id AS entry_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q),
lists AS ({_TOP('phrased')} UNION ALL {_TOP('needled')} UNION ALL {_TOP("(SELECT * FROM vec WHERE score >= 0.1)")})
SELECT entry_id, round(sum(1.0::DOUBLE / ({search.RRF} + rank)), 9) AS score, count(*) AS lists FROM lists GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def search_hybrid(spark, sf_dir):
    """Ranks of words, of identifiers and of vectors over a floor, each with the same vote."""
    docs, rows = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "embeddings")
    asked = rows.orderBy("vec_id").limit(1).select(F.col("embedding").alias("asked"))
    # one row
    near = rows.join(F.broadcast(asked)).select(F.col("vec_id").alias("entry_id"), F.round(vector.dot(F.col("embedding"), F.col("asked")), 6).alias("score")).where("score >= 0.1")
    found = [_words(spark, docs, ["of the"], stemmed=False), _holding(spark, docs), near]
    lists = [search.top(x.withColumn("score", F.round("score", 6)), 500) for x in found]
    return search.fuse(lists, 50).select("entry_id", F.round("score", 9).alias("score"), "lists")
