"""Queries over walks of listed mailboxes, each with the SQL that states the same.

Events stand for envelopes and users for containers, each listed from the newest.  By
container a walk has no cursor yet, one with a frontier, one cut short, or an expired one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import listing
from .queries import _read, query

#: Envelopes a page and a walk.
SIZE, MOST = 10, 40


def _listed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    at = F.when(F.col("event_id") % 13 > 0, F.unix_timestamp("ts"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")) - 1
    rows = _read(spark, sf_dir, "events").select(F.lit("mail").alias("source"), F.col("user_id").cast("string").alias("container"), place.cast("long").alias("place"), F.col("event_id").alias("id"), at.alias("ts"))
    kind = F.col("container").cast("long") % 4
    front = F.when(kind.isin(1, 3), F.max("ts") - 3600 * F.col("container").cast("long")).cast("long")
    held = rows.groupBy("source", "container").agg(front.alias("frontier"))
    position = F.when(kind == 2, F.lit("3")).when(kind == 3, F.lit("1000000"))
    return rows, held.select("source", "container", position.alias("position"), "frontier", (kind == 1).alias("complete"), F.lit(5).cast("long").alias("walked"))


_WALKS = f"""l AS (SELECT user_id AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) - 1 AS place, event_id AS id, CASE WHEN event_id % 13 > 0 THEN epoch(date_trunc('second', ts))::BIGINT END AS ts FROM events),
k AS (SELECT c, count(*) AS n, CASE WHEN c % 4 IN (1, 3) THEN max(ts) - 3600 * c END AS frontier, CASE WHEN c % 4 = 2 AND count(*) > 3 THEN 3 ELSE 0 END AS start, c % 4 = 2 AND count(*) > 3 AS resumed FROM l GROUP BY 1),
s AS (SELECT k.*, least(n, start + {MOST}) AS bound, (SELECT min(place) FROM l WHERE l.c = k.c AND place >= k.start AND l.ts <= k.frontier - {listing.LOOK_BACK}) AS met FROM k),
w AS (SELECT *, coalesce(met < bound, false) AS low, CASE WHEN coalesce(met < bound, false) THEN met ELSE bound END AS "end", CASE WHEN coalesce(met < bound, false) THEN 'frontier' WHEN bound = n THEN 'exhausted' ELSE 'max' END AS stop FROM s)"""


@query(f"""WITH {_WALKS} SELECT c::VARCHAR AS container, stop, start, "end", resumed, greatest(1, ceil(("end" - start + low::INT) / {SIZE}))::BIGINT AS pages FROM w""")
def mail_walks(spark, sf_dir):
    return listing.walks(*_listed(spark, sf_dir), SIZE, MOST).select("container", "stop", "start", "end", "resumed", "pages")


@query(f"""WITH {_WALKS} SELECT c::VARCHAR AS container, id FROM l JOIN w USING (c) WHERE place >= start AND place < "end" """)
def mail_reads(spark, sf_dir):
    rows, cursors = _listed(spark, sf_dir)
    return listing.reads(rows, listing.walks(rows, cursors, SIZE, MOST)).select("container", "id")


@query(f"""WITH {_WALKS}, r AS (SELECT c, max(ts) AS newest FROM l JOIN w USING (c) WHERE place >= start AND place < "end" GROUP BY 1)
SELECT c::VARCHAR AS container, CASE WHEN stop = 'max' THEN "end" END AS position, CASE WHEN stop = 'max' THEN frontier ELSE greatest(frontier, newest) END AS frontier,
 stop <> 'max' AS complete, CASE WHEN stop = 'max' THEN 5 + "end" - start ELSE 0 END AS walked FROM w LEFT JOIN r USING (c)""")
def mail_cursors(spark, sf_dir):
    rows, cursors = _listed(spark, sf_dir)
    after = listing.cursors_after(cursors, rows, listing.walks(rows, cursors, SIZE, MOST))
    return after.select("container", F.col("position").cast("long").alias("position"), "frontier", "complete", "walked")
