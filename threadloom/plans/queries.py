"""Queries over the driver's tables, each with the SQL that states the same.

Turns of `conversations` stand for messages that answer the turn before; `documents`
for bodies with an author (source) and a domain (lang); `events`, `customer`, `orders`
and `lineitem` for participation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock, text, vector
from ..operators import chains, chrono, evaluate, relate, search, similar

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as messages: entry_id, parent_id, container, person, ts (seconds), text."""
    at = F.col("conv_id") * 1000 + F.col("turn")
    return _read(spark, sf_dir, "conversations").select(at.alias("entry_id"), F.when(F.col("turn") > 0, at - 1).alias("parent_id"), F.col("conv_id").alias("container"), F.col("role").alias("person"), (1_600_000_000 + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("ts"), "text")


_ENTRIES = """entries AS (
  SELECT conv_id * 1000 + turn AS entry_id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent_id, conv_id AS container,
         role AS person, 1600000000 + conv_id * 3600 + turn * 60 AS ts, text FROM conversations)"""
_ROOTS = """up AS (
  SELECT e.entry_id, e.entry_id AS cur, 0::BIGINT AS depth FROM entries e
  UNION ALL
  SELECT u.entry_id, p.entry_id, u.depth + 1 FROM up u JOIN entries e ON e.entry_id = u.cur JOIN entries p ON p.entry_id = e.parent_id WHERE u.depth < 64),
roots AS (SELECT entry_id, arg_max(cur, depth) AS root_id, max(depth) AS depth FROM up GROUP BY 1)"""


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = entries(spark, sf_dir)
    return e, chains.roots(e)


@query(f"""WITH {_ENTRIES} SELECT count(*) AS entries, count(DISTINCT container) AS containers, count(DISTINCT person) AS people,
 count(*) FILTER (WHERE parent_id IS NULL) AS roots,
 count(*) FILTER (WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT entry_id FROM entries)) AS unresolved FROM entries""")
def corpus_stats(spark, sf_dir):
    e = entries(spark, sf_dir)
    known = e.select(F.col("entry_id").alias("k"))
    rows = e.join(known, e["parent_id"] == known["k"], "left")
    return rows.agg(F.count("*").alias("entries"), F.countDistinct("container").alias("containers"), F.countDistinct("person").alias("people"), F.count_if(F.col("parent_id").isNull()).alias("roots"), F.count_if(F.col("parent_id").isNotNull() & F.col("k").isNull()).alias("unresolved"))


@query(f"WITH RECURSIVE {_ENTRIES}, {_ROOTS} SELECT entry_id, root_id, depth FROM roots")
def chain_members(spark, sf_dir):
    return _found(spark, sf_dir)[1]


@query(f"""WITH RECURSIVE {_ENTRIES}, {_ROOTS} SELECT root_id, count(DISTINCT entry_id) AS entries, min(ts) AS first_ts, max(ts) AS last_ts,
 array_to_string(list_sort(list(DISTINCT person)), ',') AS labels FROM entries JOIN roots USING (entry_id) GROUP BY 1""")
def chain_meta(spark, sf_dir):
    return chains.chain_meta(*_found(spark, sf_dir))


@query(f"""WITH RECURSIVE {_ENTRIES}, {_ROOTS}, fork AS (SELECT parent_id AS entry_id, count(*) AS n FROM entries WHERE parent_id IS NOT NULL GROUP BY 1)
SELECT root_id, count(*) AS entries, max(depth) AS deepest, count(*) FILTER (WHERE n IS NULL) AS leaves, count(*) FILTER (WHERE n > 1) AS forks
FROM roots LEFT JOIN fork USING (entry_id) GROUP BY 1""")
def chain_shape(spark, sf_dir):
    e, found = _found(spark, sf_dir)
    fork = e.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("entry_id")).agg(F.count("*").alias("n"))
    return found.join(fork, "entry_id", "left").groupBy("root_id").agg(F.count("*").alias("entries"), F.max("depth").alias("deepest"), F.count_if(F.col("n").isNull()).alias("leaves"), F.count_if(F.col("n") > 1).alias("forks"))


#: The words that the search queries look for, and a part of a word.
TERMS, NEEDLE = ["the", "of"], "tion"


def _bm25(source: str, key: str) -> str:
    tf = [f"len(list_filter(w, lambda x: x = '{t}'))" for t in TERMS]
    part = lambda i: f"greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), {search.LEAST_IDF}) * t{i} * {search.K1 + 1} / (t{i} + {search.K1} * ({1 - search.B} + {search.B} * dl / avgdl))"
    return f"""toks AS (SELECT {key} AS entry_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM {source}),
counted AS (SELECT entry_id, len(w) AS dl, {", ".join(f"{x} AS t{i}" for i, x in enumerate(tf))} FROM toks),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl, {", ".join(f"count(*) FILTER (WHERE t{i} > 0) AS n{i}" for i in range(len(tf)))} FROM counted),
bm AS (SELECT entry_id, {" + ".join(map(part, range(len(tf))))} AS score FROM counted, stats WHERE {" AND ".join(f"t{i} > 0" for i in range(len(tf)))})"""


@query(f"WITH {_bm25('documents', 'doc_id')} SELECT entry_id, round(score, 6) AS score FROM bm")
def search_bm25(spark, sf_dir):
    return search.bm25(_read(spark, sf_dir, "documents"), TERMS, "doc_id").select("entry_id", F.round("score", 6).alias("score"))


_CONTAIN = f"""has AS (SELECT doc_id AS entry_id, (length(lower(text)) - length(replace(lower(text), '{NEEDLE}', ''))) / {len(NEEDLE)} AS score
FROM documents WHERE contains(lower(text), '{NEEDLE}'))"""


@query(f"WITH {_CONTAIN} SELECT entry_id, score::DOUBLE AS score FROM has")
def search_substring(spark, sf_dir):
    return search.containing(_read(spark, sf_dir, "documents"), NEEDLE, "doc_id")


_RANKED = lambda t: f"SELECT entry_id, row_number() OVER (ORDER BY round(score, 6) DESC, entry_id) AS rank FROM {t} QUALIFY rank <= 500"


@query(f"""WITH {_bm25('documents', 'doc_id')}, {_CONTAIN}, lists AS ({_RANKED('bm')} UNION ALL {_RANKED('has')})
SELECT entry_id, round(sum(1.0::DOUBLE / ({search.RRF} + rank)), 9) AS score, count(*) AS lists FROM lists GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def search_fused(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    lists = [search.top(x.withColumn("score", F.round("score", 6)), 500) for x in (search.bm25(docs, TERMS, "doc_id"), search.containing(docs, NEEDLE, "doc_id"))]
    return search.fuse(lists, 20).select("entry_id", F.round("score", 9).alias("score"), "lists")


@query(f"""WITH RECURSIVE {_ENTRIES}, {_ROOTS}, {_bm25('entries', 'entry_id')},
placed AS (SELECT entry_id, root_id, round(score, 6) AS score, row_number() OVER (PARTITION BY root_id ORDER BY round(score, 6) DESC, entry_id) AS i FROM bm JOIN roots USING (entry_id))
SELECT root_id, round(sum(score / i), 6) AS score, count(*) AS matched, arg_min(entry_id, i) AS best FROM placed GROUP BY 1 ORDER BY sum(score / i) DESC, 1 LIMIT 20""")
def search_chains(spark, sf_dir):
    e, found = _found(spark, sf_dir)
    hits = search.bm25(e, TERMS).withColumn("score", F.round("score", 6))
    return search.chain_scores(hits, found, 20).withColumn("score", F.round("score", 6))


@query("""SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY 2 DESC, 1 LIMIT 100""")
def vector_nearest(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings")
    asked = rows.orderBy("vec_id").limit(1).select(F.col("embedding").alias("asked"))
    # one row
    found = rows.join(F.broadcast(asked)).select("vec_id", F.round(vector.dot(F.col("embedding"), F.col("asked")), 6).alias("similarity"))
    return found.orderBy(F.desc("similarity"), "vec_id").limit(100)


@query("SELECT vec_id, len(embedding)::INT AS dim, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length FROM embeddings")
def vector_lengths(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dim"), F.round(vector.norm(F.col("embedding")), 6).alias("length"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.vec_id IS NULL OR len(e.embedding) <> 64")
def vector_pending(spark, sf_dir):
    docs, have = _read(spark, sf_dir, "documents").select("doc_id"), _read(spark, sf_dir, "embeddings")
    return docs.join(have, docs["doc_id"] == have["vec_id"], "left").where("vec_id IS NULL OR size(embedding) <> 64").select("doc_id")


@query("""WITH q AS (SELECT label, min(vec_id) AS asked FROM embeddings GROUP BY 1),
sims AS (SELECT q.asked AS query, e.vec_id AS entry_id, round(list_dot_product(e.embedding::DOUBLE[], a.embedding::DOUBLE[]), 6) AS s FROM q JOIN embeddings a ON a.vec_id = q.asked, embeddings e WHERE e.vec_id <> q.asked),
ranked AS (SELECT query, entry_id, row_number() OVER (PARTITION BY query ORDER BY s DESC, entry_id) AS rank FROM sims),
rel AS (SELECT q.asked AS query, e.vec_id AS entry_id FROM q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.asked),
wanted AS (SELECT query, count(*) AS wanted FROM rel GROUP BY 1),
hits AS (SELECT query, count(*) FILTER (WHERE rank <= 10) AS found, sum(1 / log2(rank + 1)) FILTER (WHERE rank <= 10) AS dcg, min(rank) AS first FROM ranked JOIN rel USING (query, entry_id) GROUP BY 1)
SELECT query, round(coalesce(found / wanted, 0), 6) AS recall, round(coalesce(dcg / list_sum(list_transform(range(1, least(wanted, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg, round(coalesce(1 / first, 0), 6) AS rr
FROM wanted LEFT JOIN hits USING (query)""")
def eval_metrics(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings")
    asked = rows.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("q")).select("label", F.col("q.vec_id").alias("query"), F.col("q.embedding").alias("asked"))
    # a row for each label
    # stated queries against all rows: one query for each label
    sims = rows.join(asked.select(F.col("label").alias("of"), "query", "asked")).where("vec_id <> query")
    scored = sims.select("query", F.col("vec_id").alias("entry_id"), F.round(vector.dot(F.col("embedding"), F.col("asked")), 6).alias("s"), F.col("label").eqNullSafe(F.col("of")).alias("relevant"))
    return evaluate.metrics_of_scores(scored, 10).select("query", *[F.round(c, 6).alias(c) for c in ("recall", "ndcg", "rr")])


@query(r"SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') || chr(0)) AS body_sha FROM documents")
def body_digest(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.body_sha(F.col("text")).alias("body_sha"))


@query("SELECT min(doc_id) AS kept, count(*) AS copies, count(DISTINCT source) AS places FROM documents GROUP BY coalesce(text, '') HAVING count(*) > 1")
def repeated_bodies(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("body"))
    return docs.groupBy("body").agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies"), F.countDistinct("source").alias("places")).where("copies > 1").drop("body")


@query(f"""WITH {_ENTRIES}, t AS (SELECT entry_id, parent_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM entries),
c AS (SELECT entry_id, w, count(*) AS k FROM t GROUP BY 1, 2), n AS (SELECT entry_id, sum(k) AS n FROM c GROUP BY 1),
o AS (SELECT e.entry_id, sum(least(a.k, b.k)) AS overlap FROM entries e JOIN c a ON a.entry_id = e.entry_id JOIN c b ON b.entry_id = e.parent_id AND a.w = b.w GROUP BY 1)
SELECT e.entry_id, coalesce(o.overlap, 0)::INT AS overlap, round(CASE WHEN coalesce(x.n, 0) + coalesce(y.n, 0) = 0 THEN 0 ELSE 2.0::DOUBLE * coalesce(o.overlap, 0) / (coalesce(x.n, 0) + coalesce(y.n, 0)) END, 6) AS similarity
FROM entries e JOIN entries p ON p.entry_id = e.parent_id LEFT JOIN o ON o.entry_id = e.entry_id LEFT JOIN n x ON x.entry_id = e.entry_id LEFT JOIN n y ON y.entry_id = e.parent_id""")
def reply_similarity(spark, sf_dir):
    e = entries(spark, sf_dir)
    known = e.select(F.col("entry_id").alias("b"))
    pairs = e.select(F.col("entry_id").alias("a"), F.col("parent_id").alias("b")).join(known, "b", "left_semi").select("a", "b")
    return similar.similarity(pairs, e).select(F.col("a").alias("entry_id"), F.col("overlap").cast("int"), F.round("similarity", 6).alias("similarity"))


@query("""WITH l AS (SELECT doc_id, source, lang, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_full_match(x, '[ \\t\\x0B\\f\\r]*')) AS l FROM documents),
e AS (SELECT doc_id, source, lang, n, array_to_string(list_transform(l[len(l) - n + 1 :], lambda x: trim(x, ' ')), chr(10)) AS key FROM (SELECT *, unnest(range(2, least(25, len(l) - 1) + 1)) AS n FROM l WHERE len(l) > 2)),
a AS (SELECT source, n, key, count(*) AS c FROM e GROUP BY ALL HAVING count(*) >= 3),
d AS (SELECT lang, n, key, count(*) AS c, count(DISTINCT source) AS s FROM e GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT source) >= 2),
f AS (SELECT doc_id, n, 1 AS own, c, 1 AS s, 'author' AS scope FROM e JOIN a USING (source, n, key) UNION ALL SELECT doc_id, n, 0, c, s, 'domain' FROM e JOIN d USING (lang, n, key))
SELECT doc_id AS entry_id, n::INT AS lines, c AS count, s AS senders, scope FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, own DESC) = 1""")
def repeated_endings(spark, sf_dir):
    return similar.endings(_read(spark, sf_dir, "documents"), "doc_id", "source", "lang", "text")


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS sent, count(*) FILTER (WHERE event_type <> 'purchase') AS received, min(ts) AS first_ts, max(ts) AS last_ts
FROM events GROUP BY 1""")
def people_activity(spark, sf_dir):
    return _read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("sent"), F.count_if(F.col("event_type") != "purchase").alias("received"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""SELECT n_name, count(DISTINCT c_custkey) AS people, max(o_orderdate) AS last_seen FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def domain_standing(spark, sf_dir):
    n, c, o = (_read(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    last = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    return c.join(last, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.countDistinct("c_custkey").alias("people"), F.max("last").alias("last_seen"))


@query("""SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1, 2""")
def latest_wins(spark, sf_dir):
    return relate.latest(_read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"])


@query("""SELECT event_id, user_id FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 1 DAY FROM events) AND ts < (SELECT min(ts) + INTERVAL 8 DAY FROM events)
AND event_type IN ('click', 'view', 'purchase') AND NOT coalesce(value < 10 OR json_extract(props, '$.k')::INT > 90, false)""")
def filtered_entries(spark, sf_dir):
    rows = _read(spark, sf_dir, "events")
    # the first instant is one row
    first = rows.agg(F.min("ts").alias("t0"))
    noise = F.coalesce((F.col("value") < 10) | (F.get_json_object("props", "$.k").cast("int") > 90), F.lit(False))
    kept = rows.where(F.col("event_type").isin("click", "view", "purchase") & ~noise)
    return kept.join(F.broadcast(first), F.expr("ts >= t0 + INTERVAL 1 DAY AND ts < t0 + INTERVAL 8 DAY")).select("event_id", "user_id")


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS involved FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def involving(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))).alias("involved"))
    return _read(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def unattended(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    return _read(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_custkey, count(*) AS rows FROM orders GROUP BY 1 HAVING bool_and(coalesce(o_orderstatus <> 'P', false))")
def on_every_entry(spark, sf_dir):
    return relate.every(_read(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus <> 'P'")


_SECONDS = "floor(epoch(ts))::BIGINT"


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))


@query(f"""WITH e AS (SELECT event_id, user_id, {_SECONDS} AS at FROM events)
SELECT x.user_id AS key, x.event_id AS a, y.event_id AS b, y.at - x.at AS gap FROM e x JOIN e y ON x.user_id = y.user_id AND y.at - x.at BETWEEN 0 AND 26 * 60 AND (x.at < y.at OR x.event_id < y.event_id)""")
def near_pairs(spark, sf_dir):
    return relate.band_join(_timed(spark, sf_dir), "user_id", "at", "event_id", 26 * 60)


@query(f"""WITH e AS (SELECT event_id, user_id, {_SECONDS} AS at FROM events),
p AS (SELECT x.user_id AS key, x.event_id AS a, y.event_id AS b, (y.at - x.at) / 60.0 AS m FROM e x JOIN e y ON x.user_id = y.user_id AND y.at - x.at BETWEEN 0 AND 14 * 3600 AND (x.at < y.at OR x.event_id < y.event_id))
SELECT key, count(*) AS pairs FROM p WHERE abs(m - round(m / 15) * 15) <= 1 GROUP BY 1""")
def lattice_pairs(spark, sf_dir):
    m = F.col("gap") / 60
    return relate.band_join(_timed(spark, sf_dir), "user_id", "at", "event_id", 14 * 3600).where(F.abs(m - clock.nearest_offset(m)) <= 1).groupBy("key").agg(F.count("*").alias("pairs"))


@query(f"""WITH e AS (SELECT event_id, user_id, {_SECONDS} AS sec FROM events),
s AS (SELECT *, CASE WHEN sec - lag(sec) OVER w > 3600 OR lag(sec) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY sec)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY sec) AS g FROM s)
SELECT user_id, min(sec) AS run, count(*) AS n, max(sec) AS until FROM g GROUP BY user_id, g""")
def twin_runs(spark, sf_dir):
    return relate.runs(_timed(spark, sf_dir), ["user_id"], "at", 3600).groupBy("user_id", "run").agg(F.count("*").alias("n"), F.max("at").alias("until"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
s AS (SELECT unnest([0.5, 0.9, 0.99])::DOUBLE AS share) SELECT event_type, share, value FROM r, s WHERE i = floor(share * (n - 1))""")
def rank_quantiles(spark, sf_dir):
    return relate.nearest_rank(_read(spark, sf_dir, "events"), "event_type", "value", [0.5, 0.9, 0.99])


@query("""WITH m AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS mid FROM events), a AS (SELECT user_id, count(*) AS n FROM events, m WHERE ts < mid GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events, m WHERE ts >= mid GROUP BY 1)
SELECT user_id, a.n AS before, b.n AS after, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'gone' WHEN b.n > a.n THEN 'grown' WHEN b.n < a.n THEN 'shrunk' ELSE 'same' END AS change FROM a FULL JOIN b USING (user_id)""")
def growth_report(spark, sf_dir):
    rows = _read(spark, sf_dir, "events")
    # one row
    mid = F.broadcast(rows.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("mid")))
    part = lambda c: rows.join(mid, F.expr(c)).groupBy("user_id").agg(F.count("*").alias("n"))
    return relate.growth(part("ts < mid"), part("ts >= mid"), "user_id", "n")


@query("""SELECT o_custkey AS container, count(*) AS n, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS opener, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen FROM orders GROUP BY 1""")
def thread_rollup(spark, sf_dir):
    at = F.struct("o_orderdate", "o_orderkey")
    return _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("container")).agg(F.count("*").alias("n"), F.min_by("o_orderkey", at).alias("opener"), F.max_by("o_orderkey", at).alias("last"), F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"))


@query("""SELECT o_orderkey, strftime(o_orderdate, 'm-%Y%m%d') || CASE WHEN row_number() OVER w > 1 THEN '-' || row_number() OVER w ELSE '' END AS anchor
FROM orders WINDOW w AS (PARTITION BY o_orderdate::DATE ORDER BY o_orderkey)""")
def anchors(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy(F.to_date("o_orderdate")).orderBy("o_orderkey"))
    base = F.concat(F.lit("m-"), F.date_format("o_orderdate", "yyyyMMdd"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.when(n > 1, F.concat(base, F.lit("-"), n.cast("string"))).otherwise(base).alias("anchor"))


_LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


_LINES = """b AS (SELECT l_orderkey AS entry_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS block,
  l_shipdate AS sent, CASE WHEN l_returnflag = 'R' THEN 600 WHEN l_returnflag = 'A' THEN -300 END AS off FROM lineitem)"""


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as the quoted blocks of a body: place, stated clock, and an offset on some."""
    block = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE))
    off = F.when(F.col("l_returnflag") == "R", 600).when(F.col("l_returnflag") == "A", -300)
    return _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry_id"), block.alias("block"), F.col("l_shipdate").cast("timestamp_ntz").alias("sent"), off.alias("offset"))


@query(f"""WITH {_LINES}, r AS (SELECT entry_id, row_number() OVER (PARTITION BY entry_id ORDER BY block) AS nested, row_number() OVER (PARTITION BY entry_id ORDER BY sent - to_minutes(coalesce(off, 60)) DESC, block) AS dated FROM b)
SELECT entry_id, count(*) AS blocks, count(*) FILTER (WHERE nested <> dated) AS moved FROM r GROUP BY 1""")
def moved_blocks(spark, sf_dir):
    return chrono.moved(chrono.order(_stamped(spark, sf_dir), presumed=60))


@query(f"""WITH {_LINES}, w AS (SELECT *, sent - to_minutes(coalesce(off, 840)) AS lo, sent - to_minutes(coalesce(off, -720)) + CASE WHEN sent = date_trunc('day', sent) THEN INTERVAL 24 HOUR ELSE INTERVAL 0 HOUR END AS hi FROM b),
p AS (SELECT *, min(hi) OVER v AS least, arg_min(block, (hi, block)) OVER v AS "outer" FROM w WINDOW v AS (PARTITION BY entry_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT entry_id, block, "outer", (epoch(lo) - epoch(least))::BIGINT AS excess FROM p WHERE lo > least""")
def impossible_blocks(spark, sf_dir):
    return chrono.impossible(_stamped(spark, sf_dir))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_events(spark, sf_dir):
    from ..streaming.intake import window_counts

    return window_counts(_read(spark, sf_dir, "events"), "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""WITH {_ENTRIES} SELECT entry_id, CASE WHEN length(coalesce(text, '')) > 400 THEN trim(regexp_replace(substring(text, 1, 400), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') || '…' ELSE trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') END AS lead FROM entries""")
def lead_excerpts(spark, sf_dir):
    return entries(spark, sf_dir).select("entry_id", text.excerpt(F.coalesce("text", F.lit("")), 400).alias("lead"))
