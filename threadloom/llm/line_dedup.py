"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate on a host if the share of the host's pages that hold it
exceeds a ratio.  The share is (pages of the host with the line) / (pages of the
host); a page that repeats a line counts once.

Plan: each page is turned into its distinct line digests (16 bytes each), which are
counted by (host, digest) with map-side partial sums, so neither a hot host nor a hot
line puts its rows into one task.  A host has at most (mean distinct lines of a page)
/ ratio boilerplate lines, so the digests of a host fit in one array; that small table
is written and joined back to the pages.  Spark broadcasts it only if its measured
size is under `spark.sql.autoBroadcastJoinThreshold`; otherwise it is a shuffled join
whose hot hosts adaptive execution splits.  The texts are then shuffled at most once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

RATIO = 0.05
#: A line that one page alone has is no repeat, however few pages its host has.
REPEATED = 2


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line)))


def boilerplate_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = REPEATED) -> DataFrame:
    """(host, digest, n_pages, host_pages) of the lines over the ratio.

    Lines are compared after trimming blanks; blank lines never count.  A null host is
    a host of its own.  A line must be on `min_pages` pages: at 1, a host of fewer than
    1 / ratio pages would lose every line.  Repeated rows count as separate pages.
    """
    rows = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    digests = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _digest))
    counts = rows.select("host", F.explode(digests).alias("digest")).groupBy("host", "digest").agg(F.count("*").alias("n_pages"))
    totals = rows.groupBy("host").agg(F.count("*").alias("host_pages"))
    often = counts.where(F.col("n_pages") >= min_pages)
    return (
        often.alias("c")
        .join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
        .where(F.col("n_pages") > ratio * F.col("host_pages"))
        .select("c.host", "digest", "n_pages", "host_pages")
    )


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = REPEATED, never_empty: bool = False) -> DataFrame:
    """Every row and column of `pages`, with boilerplate lines taken out of `text`.

    Adds n_lines (lines before; 0 for a null text) and n_dropped.  A null text stays
    null, an empty one has one blank line and stays empty.  Columns of `pages` with the
    added names are replaced.  An empty table gives an empty table.

    With `never_empty`, a text all of whose lines that are not blank would go stays as it
    is: where copies of one page are over the ratio, each of its lines is.
    """
    own_host, digests, own_kept = (fresh(pages, c) for c in ("host_of_lines", "digests", "kept"))
    found = boilerplate_lines(pages, host, text, ratio, min_pages).groupBy("host").agg(F.collect_set("digest").alias("digests"))
    per_host = written(found.select(F.col("host").alias(own_host), F.col("digests").alias(digests)))
    joined = pages.join(per_host, pages[host].eqNullSafe(per_host[own_host]), "left")
    lines = _lines(F.col(text))
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(digests), _digest(x)))
    some = F.col(digests).isNotNull() & F.col(text).isNotNull()
    if never_empty:
        kept = F.when(F.exists(kept, lambda x: F.trim(x) != ""), kept).otherwise(lines)
    out = joined.withColumn(own_kept, F.when(some, kept))
    columns = [c for c in pages.columns if c.lower() not in ("n_lines", "n_dropped")]
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
    return out.select(
        *[F.when(some, F.array_join(own_kept, "\n")).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in columns],
        n_lines.alias("n_lines"),
        F.when(some, n_lines - F.size(own_kept)).otherwise(F.lit(0)).cast("long").alias("n_dropped"),
    )


#: DuckDB SQL of `drop_boilerplate(documents)`, with the columns of op1.
ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
counts AS (
  SELECT source, trim(line, ' ') AS line, count(DISTINCT doc_id) AS n_pages
  FROM lines WHERE trim(line, ' ') <> '' GROUP BY 1, 2),
totals AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY 1),
boiler AS (
  SELECT c.source, c.line FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE n_pages >= {REPEATED} AND n_pages > {RATIO} * host_pages),
marked AS (
  SELECT l.doc_id, l.line, l.pos, b.line IS NULL AS keep
  FROM lines l LEFT JOIN boiler b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line, ' ') = b.line),
again AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep) AS kept,
         count(*) AS n_lines, count(*) FILTER (WHERE NOT keep) AS n_dropped
  FROM marked GROUP BY 1)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(a.kept, '') END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE a.n_lines END AS n_lines, a.n_dropped
FROM documents d JOIN again a USING (doc_id)
"""
