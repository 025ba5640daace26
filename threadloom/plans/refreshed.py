"""Queries over timelines made again, each with the SQL that states the same.

Conversations stand for threads: even ones mail, odd ones channels, in which every fourth
turn begins a chain of its own.  All but those that leave 4 by 5 stand on the page, with
their first three turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chains, refresh, retrieve, search, timeline
from .queries import _ENTRIES, _ROOTS, _read, entries, query

#: What the timeline asks for, in turn, and how many chains each may find.
ASKED, LIMIT = ["tion", "ent", "the"], 30


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = F.col("container") % 2 == 0
    e = entries(spark, sf_dir).withColumn("parent_id", F.when(F.col("entry_id") % 4 > 0, F.col("parent_id"))).withColumn("conv", F.col("container"))
    return e.withColumn("source", F.when(mail, "mail").otherwise("slack")).withColumn("ref", F.concat("source", F.lit(":"), F.col("entry_id").cast("string"))).withColumn("container", F.col("container").cast("string"))


_REPLIES = _ENTRIES.replace("CASE WHEN turn > 0 THEN", "CASE WHEN turn % 4 > 0 THEN")


def _page(e: DataFrame) -> DataFrame:
    return e.where("conv % 5 <> 4 AND entry_id % 1000 < 3")


def _accept(e: DataFrame) -> DataFrame:
    """Every third conversation that is not shown was decided for, by its first message."""
    return e.where("conv % 5 = 4 AND conv % 3 = 0 AND entry_id % 1000 = 0").select(F.col("entry_id").alias("root_id"))


_HITS = " UNION ALL ".join(f"SELECT {i} AS turn, '{w}' AS query, entry_id, (length(lower(text)) - length(replace(lower(text), '{w}', ''))) / {len(w)} AS score FROM entries WHERE contains(lower(text), '{w}')" for i, w in enumerate(ASKED))


@query(f"""WITH RECURSIVE {_REPLIES}, {_ROOTS}, hits AS ({_HITS}),
placed AS (SELECT turn, query, root_id, score, row_number() OVER (PARTITION BY turn, root_id ORDER BY score DESC, entry_id) AS i FROM hits JOIN roots USING (entry_id)),
scored AS (SELECT turn, query, root_id, round(sum(score / i), 6) AS score, count(*) AS matched FROM placed GROUP BY ALL),
found AS (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY score DESC, root_id) AS rank FROM scored QUALIFY rank <= {LIMIT}),
first AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY root_id ORDER BY turn, rank) = 1)
SELECT root_id, query, rank, matched, e.container % 3 = 0 AND root_id % 1000 = 0 AS accepted FROM first f JOIN entries e ON e.entry_id = f.root_id WHERE e.container % 5 = 4""")
def refresh_candidates(spark, sf_dir):
    e = _replies(spark, sf_dir)
    of = chains.roots(e)
    found = None
    for turn, asked in enumerate(ASKED):
        scored = search.chain_scores(search.containing(e, asked), of, None).select(F.col("root_id").alias("entry_id"), F.round("score", 6).alias("score"), "matched")
        ranked = search.top(scored, LIMIT).select(F.lit(turn).alias("turn"), F.lit(asked).alias("query"), "rank", F.col("entry_id").alias("root_id"), "matched")
        found = ranked if found is None else found.unionByName(ranked)
    found = found.join(e.select(F.col("entry_id").alias("root_id"), "container"), "root_id")
    return refresh.candidates(found, _page(e).select("container"), _accept(e)).select("root_id", "query", "rank", "matched", "accepted")


@query(f"""WITH RECURSIVE {_REPLIES}, {_ROOTS}, r AS (SELECT *, container % 5 <> 4 AS shown, entry_id % 1000 < 3 AS old FROM entries JOIN roots USING (entry_id)),
kept AS (SELECT root_id FROM r GROUP BY 1 HAVING bool_or(shown AND container % 2 = 0 OR shown AND old OR NOT shown AND container % 3 = 0 AND entry_id % 1000 = 0)),
b AS (SELECT container, count(*) AS n FROM r WHERE shown AND old GROUP BY 1), a AS (SELECT container, count(*) AS n FROM r JOIN kept USING (root_id) GROUP BY 1)
SELECT coalesce(b.container, a.container)::VARCHAR AS container, b.n AS before, a.n AS after,
 CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'unranked' WHEN a.n > b.n THEN 'grown' WHEN a.n < b.n THEN 'shrunk' ELSE 'same' END AS change
FROM b FULL JOIN a ON a.container = b.container""")
def refresh_report(spark, sf_dir):
    e = _replies(spark, sf_dir)
    page = _page(e)
    threads = page.select("container").distinct()
    whole, single = refresh.membership(threads, retrieve.dominant_source(e), page)
    after = refresh.selected(e, whole, single, _accept(e))
    count = lambda rows: timeline.threads(rows.withColumn("subject", F.lit(""))).select("container", "count")
    return refresh.report(count(page), count(after))


@query("""WITH l AS (SELECT event_type AS pass, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS turn, user_id * 100 + event_id % 100 AS id FROM events),
f AS (SELECT id, arg_min(pass, (turn, pass)) AS pass FROM l WHERE id % 3 > 0 GROUP BY 1),
d AS (SELECT pass, count(*) AS fetched, count(*) FILTER (WHERE id % 2 = 0) AS created, count(*) FILTER (WHERE id % 4 = 1) AS changed FROM f GROUP BY 1)
SELECT pass, count(*) AS seen, coalesce(any_value(fetched), 0) AS fetched, coalesce(any_value(created), 0) AS created, coalesce(any_value(changed), 0) AS changed FROM l LEFT JOIN d USING (pass) GROUP BY 1""")
def refresh_passes(spark, sf_dir):
    name = (F.col("user_id") * 100 + F.col("event_id") % 100).alias("id")
    turn = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    listed = _read(spark, sf_dir, "events").select(F.col("event_type").alias("pass"), turn.alias("turn"), name)
    known = listed.where("id % 3 = 0").select("id").distinct()
    put = listed.select("id").distinct().withColumn("change", F.expr("CASE WHEN id % 2 = 0 THEN 'created' WHEN id % 4 = 1 THEN 'changed' ELSE 'same' END"))
    return refresh.passes(listed, refresh.to_read(listed, known), put)
