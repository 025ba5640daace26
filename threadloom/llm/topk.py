"""Exact top-k by inner product: blocks of descending norm, rotated partial sums, residual bounds.

Vectors are turned to integers.  Candidates are dealt by descending norm into blocks of
bounded size; queries into blocks as well.  The first block, of the longest vectors,
gives each query a k-th best score.  Of the other pairs of a query block and a candidate
block, those are left out, before vectors are sent anywhere, whose (longest query) *
(longest candidate) is under the k-th score of each query of the block; each other pair
is worked through by a task of its own, where a query is skipped if its own length
allows no better score; inside a block,
vectors are rotated by the right singular vectors of a sample, so that the first few
components hold most of the length, and (partial product) + (length of the query's
rest) * (length of the candidate's rest) bounds the score (Cauchy-Schwarz).  Only the
pairs whose bound reaches the k-th score get the exact integer product.

The rotation is fitted on SAMPLE rows at most; any rotation gives the same results, a
poor one only prunes less.  A group holds one block of each side, whatever the data.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SAMPLE = 2048
SCALE = 1024.0
CANDIDATES, QUERIES = 4096, 1024
BLOCK = "block long, longest double, ids binary, vectors binary"
FOUND = "q long, query_id long, vec_id long, score long"
LOWS = "array<struct<query_id:bigint,low:bigint>>"


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(False))


def integer_vectors(vectors: DataFrame, vec_id: str, vector: str, scale: float = SCALE) -> DataFrame:
    """(vec_id, v array<bigint>, norm double) of the rows whose id and whole vector are given and finite."""
    x = F.col(vector).cast("array<double>")
    rows = vectors.where(F.col(vec_id).isNotNull() & _usable(x)).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda y: F.floor(y * scale).cast("long")).alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double"))))


def _blocks(rows: DataFrame, size: int, width: int) -> tuple[int, DataFrame]:
    """Deal rows, longest vectors first, to blocks of about `size` rows; how many blocks, and their packed rows."""
    parts = max(1, math.ceil(rows.count() / size))

    def run(batches):
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]  # a range of `size` rows or so
        if not got:
            return
        t = pa.Table.from_batches(got)
        ids, norms = t["vec_id"].to_numpy(), t["norm"].to_numpy()
        flat = t["v"].combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        ends = flat.offsets.to_numpy()
        vectors = np.zeros((len(ids), width), np.int64)
        values = flat.values.to_numpy()
        for i in range(len(ids)):
            v = values[ends[i] : ends[i + 1]]
            vectors[i, : len(v)] = v
        order = np.lexsort((ids, -norms))
        part, out = TaskContext.get().partitionId(), []
        for a in range(0, len(order), size):
            o = order[a : a + size]
            out.append((part, float(norms[o[0]]), ids[o].astype("<i8").tobytes(), vectors[o].astype("<i8").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out), (pa.int64(), pa.float64(), pa.binary(), pa.binary()))], ["block", "longest", "ids", "vectors"])

    return parts, written(rows.repartitionByRange(parts, F.col("norm").desc(), F.col("vec_id")).mapInArrow(run, BLOCK))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        at = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= at)
        return some[np.lexsort((ids[some], -scores[some]))][:k]
    return np.lexsort((ids, -scores))[:k]


def _products(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of c with q."""
    if not c.size or float(np.abs(c).max()) * float(np.abs(q).max(initial=0)) * c.shape[1] < 2**52:
        return (c.astype(float) @ q.astype(float)).astype(np.int64)
    return c @ q


def search_block(q: dict, c: dict, known: dict[int, int], k: int, rotation: np.ndarray, lead: int, chunk: int = 512) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of every pair of two blocks that may be among a query's k best.

    known: by query, the k-th best score of another block.
    """
    width = rotation.shape[0]
    qi, ci = (np.frombuffer(x["ids"], "<i8") for x in (q, c))
    qv, cv = (np.frombuffer(x["vectors"], "<i8").reshape(-1, width) for x in (q, c))
    qr, cr = qv.astype(float) @ rotation, cv.astype(float) @ rotation
    rest = lambda x: np.sqrt((x[:, lead:] ** 2).sum(1))
    qrest, crest, qnorm, cnorm = rest(qr), rest(cr), np.sqrt((qr**2).sum(1)), np.sqrt((cr**2).sum(1))
    low = np.array([known.get(int(x), -np.inf) for x in qi], float)
    found: list[list[np.ndarray]] = [[] for _ in qi]
    best: list[np.ndarray] = [np.empty(0, np.int64) for _ in qi]
    for a in range(0, len(ci), chunk):
        b = slice(a, a + chunk)
        live = np.flatnonzero(qnorm * cnorm[a] * (1 + 1e-9) + 1 >= low)  # the chunk's first vector is its longest
        if not len(live):
            break
        bound = qr[live, :lead] @ cr[b, :lead].T + np.outer(qrest[live], crest[b])
        open_ = bound + 1 + 1e-9 * np.outer(qnorm[live], cnorm[b]) >= low[live, None]
        for row, j in enumerate(live):
            some = np.flatnonzero(open_[row]) + a
            some = some[ci[some] != qi[j]]
            if not len(some):
                continue
            scores = _products(cv[some], qv[j])
            good = scores >= low[j]
            found[j].append(np.stack([ci[some][good], scores[good]]))
            best[j] = np.concatenate([best[j], scores[good]])
            if len(best[j]) >= k:
                best[j] = np.partition(best[j], len(best[j]) - k)[len(best[j]) - k :]
                low[j] = max(low[j], best[j].min())
    out = []
    for j, parts in enumerate(found):
        if parts:
            ids, scores = np.concatenate(parts, 1)
            out += [(int(qi[j]), int(ids[x]), int(scores[x])) for x in _best(scores, ids, k)]
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", candidates_at_once: int = CANDIDATES, queries_at_once: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products.

    Components become floor(1024 * x).  `queries` tells which rows of `vectors` are
    queries; every row but those with the query's own id is a candidate.  Ties go to the
    smaller id.  Rows with a null id, a null vector or a null or non-finite component
    take no part; an empty vector, and components that a shorter vector lacks, count as
    0.  A repeated candidate row is found as often as it occurs; a repeated query row is
    searched once.  With fewer than k candidates there are fewer rows; an empty table
    gives none.
    """
    spark = vectors.sparkSession
    rows = written(integer_vectors(vectors, vec_id, vector))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    sample = rows.orderBy(F.xxhash64("vec_id"), "norm").limit(SAMPLE).select("v").collect()
    fit = np.zeros((max(1, len(sample)), width))
    for i, (v,) in enumerate(sample):
        fit[i, : len(v)] = v
    _, weight, rotation = np.linalg.svd(fit, full_matrices=True)
    rotation = np.ascontiguousarray(rotation.T)
    energy = np.cumsum(np.append(weight, np.zeros(width - len(weight))) ** 2)
    lead = min(width, max(1, math.ceil(width / 4), int(np.searchsorted(energy, 0.8 * energy[-1])) + 1))

    parts, candidates = _blocks(rows, candidates_at_once, width)
    q_parts, asked = _blocks(rows.where(queries).dropDuplicates(), queries_at_once, width)
    asked = asked.withColumnRenamed("block", "q").withColumn("lows", F.lit(None).cast(LOWS))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for q in left.to_pylist():
            known = {x["query_id"]: x["low"] for x in q["lows"] or ()}
            for c in right.to_pylist():
                out += [(q["q"], *x) for x in search_block(q, c, known, k, rotation, lead)]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 4)], ["q", "query_id", "vec_id", "score"])

    def pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
        return queries.groupBy("q", "block").cogroup(candidates.groupBy("q", "block")).applyInArrow(run, FOUND)

    each_q = F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1)).cast("array<bigint>"))
    every = seeds = written(pairs(asked.withColumn("block", F.lit(0).cast("long")), candidates.where("block = 0").withColumn("q", each_q)))
    if parts > 1:
        kth = seeds.groupBy("q", "query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("low")).where("low is not null")
        lows = kth.groupBy("q").agg(F.collect_list(F.struct("query_id", "low")).alias("lows"))
        # pairs of blocks are told apart by lengths alone, before any vector is sent
        have = kth.groupBy("q").agg(F.count("*").alias("have"), F.min("low").alias("least"))
        own = asked.groupBy("q").agg(F.max("longest").alias("norm"), F.sum(F.length("ids") / 8).alias("n")).join(have, "q", "left")
        others = own.withColumn("block", F.explode(F.sequence(F.lit(1), F.lit(parts - 1)).cast("array<bigint>")))
        sizes = candidates.groupBy("block").agg(F.max("longest").alias("longest"))
        open_ = F.col("least").isNull() | (F.col("have") < F.col("n")) | (F.col("norm") * F.col("longest") * (1 + 1e-9) + 1 >= F.col("least"))
        left_over = written(others.join(sizes, "block").where(open_).select("q", "block"))
        left = asked.drop("lows", "longest").join(lows, "q", "left").join(left_over, "q")
        every = seeds.unionByName(pairs(left, candidates.join(left_over, "block")))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 10
"""
