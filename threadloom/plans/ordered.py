"""Queries over the order of timelines, with SQL where SQL can state it.

Customers stand for messages: the one some sevens of keys before is what a customer
answers, a few answer themselves or a later one, and times run anyhow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordering
from .queries import _read, query


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    parent = F.when(k % 97 == 0, k).when(k % 89 == 0, k + 7).otherwise(k - 7 * (1 + k % 3))
    return _read(spark, sf_dir, "customer").select((k % 7).alias("timeline"), k.alias("id"), parent.alias("parent"), (k * 7919 % 1009).alias("key"), k.alias("pos"))


@query("""WITH RECURSIVE m AS (
  SELECT c_custkey % 7 AS timeline, c_custkey AS id, CASE WHEN c_custkey % 97 = 0 THEN c_custkey WHEN c_custkey % 89 = 0 THEN c_custkey + 7 ELSE c_custkey - 7 * (1 + c_custkey % 3) END AS parent,
         c_custkey * 7919 % 1009 * 10000000000 + c_custkey AS k FROM customer),
down AS (
  SELECT timeline, id, [k] AS way FROM m WHERE parent NOT IN (SELECT id FROM m)
  UNION ALL
  SELECT m.timeline, m.id, list_append(list_filter(d.way, lambda x: x > m.k), m.k) FROM down d JOIN m ON m.parent = d.id AND m.timeline = d.timeline)
SELECT m.timeline, m.id, row_number() OVER (PARTITION BY m.timeline ORDER BY d.id IS NULL, d.way, m.id) AS place FROM m LEFT JOIN down d USING (id)""")
def timeline_order(spark, sf_dir):
    return ordering.order(_messages(spark, sf_dir))


@query()
def timeline_graph(spark, sf_dir):
    m = _messages(spark, sf_dir)
    placed = ordering.order(m).join(m.select("timeline", "id", "parent"), ["timeline", "id"])
    return ordering.graph_lanes(placed)
