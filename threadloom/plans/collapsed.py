"""Queries over twins that are collapsed, each with the SQL that states the same.

Each turn has copies, in six shapes by conversation: one quoted later, one with
attachments, two direct ones, three quoted ones, one answered inside, one quoted earlier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import collapse, twins
from ..tables import written
from .queries import _ENTRIES, entries, query


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, parent_id, person, person_id, ts, text, quoted, attachments, subject, tz) of every copy."""
    e = entries(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    known = e.select(F.col("entry_id").alias("up"))
    e = e.join(known, F.col("parent_id") == F.col("up"), "left")
    kind = F.col("container") % 6
    words = F.split("text", " ")
    inside = (kind == 4) & (F.size(words) >= 20)
    answered = F.concat(F.array_join(F.slice(words, 1, 9), " "), F.lit(" so here we all agree with that point "), F.array_join(F.slice(words, 10, F.greatest(F.size(words) - 9, F.lit(0))), " "))
    person = F.col("entry_id").cast("string").alias("person")
    row = lambda i, parent, ts, text, quoted, attachments: e.select((F.col("entry_id") + i).alias("entry_id"), parent.cast("long").alias("parent_id"), person, F.col("entry_id").alias("person_id"), (F.col("ts") + ts).alias("ts"), text.alias("text"), quoted.alias("quoted"), attachments.cast("int").alias("attachments"), F.lit("").alias("subject"), F.lit("").alias("tz"), kind.alias("kind"))
    none, no = F.lit(None), F.lit(0)
    own = row(0, F.col("up") + F.when(F.col("entry_id") % 2 == 0, 500).otherwise(0), no, F.col("text"), kind == 3, no)
    late = row(500, none, F.when(kind == 5, -3600).otherwise(7200), F.when(inside, answered).otherwise(F.col("text")), F.lit(True), (kind == 1).cast("int"))
    more = row(400, none, F.when(kind == 3, 3600).otherwise(60), F.when(kind == 3, F.concat("text", F.lit(" and some more words"))).otherwise(F.col("text")), kind == 3, no).where("kind IN (2, 3)")
    return own.unionByName(late).unionByName(more).drop("kind")


_COPIES = f"""{_ENTRIES}, e AS (
  SELECT *, container % 6 AS kind, coalesce(text, '') AS x, string_split(coalesce(text, ''), ' ') AS w, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) >= {twins.WORDS} AS big,
         CASE WHEN parent_id IN (SELECT entry_id FROM entries) THEN parent_id END AS up FROM entries),
c AS (
  SELECT entry_id, up + CASE WHEN entry_id % 2 = 0 THEN 500 ELSE 0 END AS parent_id, x, entry_id AS of, kind = 3 AS quoted, ts FROM e
  UNION ALL SELECT entry_id + 500, NULL, CASE WHEN kind = 4 AND len(w) >= 20 THEN array_to_string(w[1:9], ' ') || ' so here we all agree with that point ' || array_to_string(w[10:], ' ') ELSE x END, entry_id, true, ts + CASE WHEN kind = 5 THEN -3600 ELSE 7200 END FROM e
  UNION ALL SELECT entry_id + 400, NULL, x || CASE WHEN kind = 3 THEN ' and some more words' ELSE '' END, entry_id, kind = 3, ts + CASE WHEN kind = 3 THEN 3600 ELSE 60 END FROM e WHERE kind IN (2, 3)),
m AS (
  SELECT entry_id + 500 AS drop_id, entry_id AS keep_id FROM e WHERE big AND (kind IN (0, 5) OR kind = 4 AND len(w) < 20)
  UNION ALL SELECT entry_id + d, entry_id + 400 FROM e, (VALUES (0), (500)) v(d) WHERE big AND kind = 3)"""


def _moved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    copies = written(_copies(spark, sf_dir))
    clocks = copies.withColumnRenamed("ts", "wall")
    return copies, collapse.mapping(twins.plan(clocks, twins.pairs(clocks)), clocks)


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every late copy is seen in the turn after, and so is every second turn itself."""
    e = entries(spark, sf_dir).select("entry_id")
    held = e.select(F.col("entry_id").alias("seen_in"))
    late = e.select((F.col("entry_id") + 500).alias("entry_id"), (F.col("entry_id") + 1).alias("seen_in"))
    own = e.where("entry_id % 2 = 0").select("entry_id", (F.col("entry_id") + 1).alias("seen_in"))
    return late.unionByName(own).join(held, "seen_in", "left_semi").select("entry_id", "seen_in", F.lit("quoted").alias("kind"))


_SEEN = "seen AS (SELECT entry_id + 500 AS entry_id, entry_id + 1 AS seen_in FROM entries WHERE entry_id + 1 IN (SELECT entry_id FROM entries) UNION ALL SELECT entry_id, entry_id + 1 FROM entries WHERE entry_id % 2 = 0 AND entry_id + 1 IN (SELECT entry_id FROM entries))"


@query(f"""WITH {_COPIES} SELECT c.entry_id, coalesce(p.keep_id, coalesce(c.parent_id, o.parent_id)) AS parent_id, md5(c.x) AS digest
FROM c LEFT JOIN c o ON o.entry_id = c.of AND c.entry_id = c.of + 400 AND o.entry_id IN (SELECT drop_id FROM m)
LEFT JOIN m p ON p.drop_id = coalesce(c.parent_id, o.parent_id) WHERE c.entry_id NOT IN (SELECT drop_id FROM m)""")
def twins_collapsed(spark, sf_dir):
    copies, moved = _moved(spark, sf_dir)
    return collapse.entries_after(copies, moved).select("entry_id", "parent_id", F.md5("text").alias("digest"))


@query(f"""WITH {_COPIES}, {_SEEN} SELECT DISTINCT coalesce(a.keep_id, s.entry_id) AS entry_id, coalesce(b.keep_id, s.seen_in) AS seen_in, 'quoted' AS kind
FROM seen s LEFT JOIN m a ON a.drop_id = s.entry_id LEFT JOIN m b ON b.drop_id = s.seen_in""")
def twin_sightings(spark, sf_dir):
    return collapse.sightings_after(_sightings(spark, sf_dir), _moved(spark, sf_dir)[1])


@query(f"""WITH {_COPIES}, {_SEEN} SELECT h.entry_id AS person, h.entry_id, h.ts AS at, CASE WHEN d.ts > k.ts THEN 120 ELSE -60 END AS "offset", d.entry_id AS measured_from
FROM m JOIN c k ON k.entry_id = m.keep_id AND NOT k.quoted JOIN c d ON d.entry_id = m.drop_id JOIN seen s ON s.entry_id = d.entry_id JOIN c h ON h.entry_id = s.seen_in""")
def twin_offsets(spark, sf_dir):
    copies, moved = _moved(spark, sf_dir)
    return collapse.measured_offsets(moved, copies, _sightings(spark, sf_dir))
