"""Queries over parents, sightings, search results, addresses and vectors, each with the SQL that states the same.

As in the other plans, turns stand for messages and TPC-H rows for people and places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address
from ..operators import chains, embed, identity, retrieve, search
from ..sources import corpus
from .queries import _ENTRIES, _ROOTS, _bm25, _read, entries, query


def _referring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns without parents, but with what names them: even conversations as mail, odd ones as chat whose stamps repeat from channel to channel."""
    mail = F.col("container") % 2 == 0
    name = lambda n: F.when(mail, F.concat(F.lit("<"), n.cast("string"), F.lit("@x>"))).otherwise((n % 1000).cast("string"))
    e = entries(spark, sf_dir)
    return e.select("entry_id", F.when(mail, "mail").otherwise("chat").alias("source"), F.col("container").cast("string").alias("container"), name(F.col("entry_id")).alias("ref"), name(F.col("parent_id")).alias("parent_ref"), F.lit(None).cast("long").alias("parent_id"))


@query(f"""WITH {_ENTRIES}, r AS (SELECT *, CASE WHEN container % 2 = 0 THEN 'mail' ELSE 'chat' END AS source,
  CASE WHEN container % 2 = 0 THEN '<' || entry_id || '@x>' ELSE (entry_id % 1000)::VARCHAR END AS ref,
  CASE WHEN container % 2 = 0 THEN '<' || parent_id || '@x>' ELSE (parent_id % 1000)::VARCHAR END AS parent_ref FROM entries)
SELECT a.entry_id, min(b.entry_id) AS parent_id FROM r a LEFT JOIN r b ON a.parent_ref = b.ref AND a.source = b.source AND a.entry_id <> b.entry_id AND (a.source = 'mail' OR a.container = b.container) GROUP BY 1""")
def parents_resolved(spark, sf_dir):
    return corpus.resolve_parents(_referring(spark, sf_dir)).select("entry_id", "parent_id")


@query("""WITH s AS (SELECT user_id AS entry_id, event_type AS seen_in, event_id % 3 AS kind, event_id AS detail, event_id % 2 AS round FROM events)
SELECT entry_id, seen_in, kind, arg_max(detail, (round, detail)) AS detail FROM s GROUP BY 1, 2, 3""")
def sightings(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").alias("entry_id"), F.col("event_type").alias("seen_in"), (F.col("event_id") % 3).alias("kind"), F.col("event_id").alias("detail"))
    return corpus.sight(rows.where("detail % 2 = 0"), rows.where("detail % 2 = 1"))


@query("""WITH q AS (SELECT doc_id AS entry_id, doc_id % 2 = 0 AS quoted, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS subject, CASE WHEN doc_id % 5 = 0 THEN doc_id END AS person_id, substring(coalesce(text, ''), 1, 40) AS t, coalesce(text, '') AS whole FROM documents)
SELECT entry_id, CASE WHEN quoted AND subject = '' THEN 'stated' ELSE subject END AS subject, CASE WHEN quoted THEN coalesce(person_id, 7) ELSE person_id END AS person_id,
 md5(CASE WHEN quoted AND length(whole) > length(t) THEN whole ELSE t END) AS digest FROM q""")
def quoted_enriched(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").dropDuplicates(["doc_id"])
    text = F.coalesce("text", F.lit(""))
    held = docs.select(F.col("doc_id").alias("entry_id"), (F.col("doc_id") % 2 == 0).alias("quoted"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("subject"), F.lit("").alias("tz"), F.when(F.col("doc_id") % 5 == 0, F.col("doc_id")).alias("person_id"), F.substring(text, 1, 40).alias("text"))
    stated = docs.select(F.col("doc_id").alias("entry_id"), F.lit("stated").alias("subject"), F.lit("UTC").alias("tz"), F.lit(7).cast("long").alias("person_id"), text.alias("text"))
    return corpus.enrich(held, stated).select("entry_id", "subject", "person_id", F.md5("text").alias("digest"))


@query("""WITH o AS (SELECT c_nationkey % 4 AS source, c_nationkey AS container, min(c_custkey) AS a, max(c_custkey) AS b FROM customer GROUP BY 1, 2)
SELECT source, container, CASE WHEN container % 3 = 0 THEN b END AS position, CASE WHEN container % 3 = 1 THEN greatest(a, b - 100) ELSE a END AS frontier, container % 3 <> 0 AS complete FROM o""")
def cursors(spark, sf_dir):
    o = _read(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") % 4).alias("source"), F.col("c_nationkey").alias("container")).agg(F.min("c_custkey").alias("a"), F.max("c_custkey").alias("b"))
    held = o.select("source", "container", F.lit(None).cast("string").alias("position"), F.col("a").alias("frontier"), F.lit(True).alias("complete"), F.lit(1).alias("walked"))
    cut = o.where("container % 3 = 0").select("source", "container", F.col("b").cast("string").alias("position"), F.lit(2).alias("walked"))
    done = o.where("container % 3 = 1").select("source", "container", (F.col("b") - 100).alias("frontier"), F.lit(3).alias("walked"))
    after = corpus.save_complete(corpus.save_progress(held, cut), done)
    return after.select("source", "container", F.col("position").cast("long"), "frontier", "complete")


@query(f"""WITH {_ENTRIES} SELECT entry_id, row_number() OVER (ORDER BY ts DESC, entry_id DESC)::INT AS rank, round(1.0::DOUBLE / ({search.RRF} + row_number() OVER (ORDER BY ts DESC, entry_id DESC)), 9) AS score FROM entries ORDER BY ts DESC, entry_id DESC LIMIT 100""")
def search_recent(spark, sf_dir):
    return retrieve.recent(entries(spark, sf_dir), 100).select("entry_id", "rank", F.round("score", 9).alias("score"))


_PLACED = f"""{_ENTRIES}, {_ROOTS}, {_bm25('entries', 'entry_id')},
placed AS (SELECT entry_id, root_id, round(score, 6) AS score, row_number() OVER (PARTITION BY root_id ORDER BY round(score, 6) DESC, entry_id) AS i FROM bm JOIN roots USING (entry_id))"""


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = entries(spark, sf_dir)
    return e, chains.roots(e), search.bm25(e, ["the", "of"]).withColumn("score", F.round("score", 6))


@query(f"WITH RECURSIVE {_PLACED} SELECT root_id, i::INT AS i, entry_id, score FROM placed WHERE i <= {retrieve.MEMBERS}")
def search_members(spark, sf_dir):
    _, found, hits = _hits(spark, sf_dir)
    return retrieve.best_members(hits, found)


_GATED = f"""{_PLACED}, c AS (SELECT root_id, sum(score / i) AS score, count(*) AS matched FROM placed GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20),
n AS (SELECT root_id, count(*) AS entries FROM roots GROUP BY 1), g AS (SELECT c.*, entries, matched >= 2 AND matched / entries >= 0.4 AS good FROM c JOIN n USING (root_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY good ORDER BY score DESC, root_id) AS nth, coalesce(sum(entries) OVER (PARTITION BY good ORDER BY score DESC, root_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)"""


def _expansion(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    e, found, hits = _hits(spark, sf_dir)
    best = search.chain_scores(hits, found, 20).join(found.groupBy("root_id").agg(F.count("*").alias("entries")), "root_id")
    return e, found, hits, retrieve.expansion(best, top=6, ratio=0.4, cap=20)


@query(f"""WITH RECURSIVE {_GATED} SELECT root_id, matched, entries, NOT (good AND nth <= 6 AND before < 20) AS refused FROM o""")
def search_expansion(spark, sf_dir):
    return _expansion(spark, sf_dir)[3].select("root_id", "matched", "entries", F.col("refused").isNotNull().alias("refused"))


@query(f"""WITH RECURSIVE {_GATED} SELECT r.root_id, row_number() OVER (PARTITION BY r.root_id ORDER BY e.ts, e.entry_id) - 1 AS place, e.entry_id, CASE WHEN b.entry_id IS NULL THEN 'chain' ELSE 'match' END AS mark
FROM o JOIN roots r USING (root_id) JOIN entries e USING (entry_id) LEFT JOIN bm b USING (entry_id) WHERE good AND nth <= 6 AND before < 20""")
def search_expanded(spark, sf_dir):
    e, found, hits, gated = _expansion(spark, sf_dir)
    return retrieve.expanded(gated, found, e, hits, search.snippet(F.col("text"), ["the", "of"])).drop("excerpt")


@query("""WITH c AS (SELECT o_custkey AS container, o_orderstatus AS source, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT container, arg_min(source, (-n, source)) AS source FROM c GROUP BY 1""")
def container_sources(spark, sf_dir):
    return retrieve.dominant_source(_read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("container"), F.col("o_orderstatus").alias("source")))


_PEOPLE = """people AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Ann O''Neil' WHEN 1 THEN 'Bob Ray (Sales)' WHEN 2 THEN 'Tom' ELSE 'Eva | Acme' END AS name,
 CASE c_custkey % 6 WHEN 0 THEN 'ann.oneil' WHEN 1 THEN 'bray' WHEN 2 THEN 'sales-team' WHEN 3 THEN 'noreply+7' WHEN 4 THEN 'tom' ELSE 'x' END AS local,
 CASE c_custkey % 5 WHEN 0 THEN 'mail.acme.co.nz' WHEN 1 THEN 'gmail.com' WHEN 2 THEN 'noreply.github.com' WHEN 3 THEN 'acme.example' ELSE 'local' END AS domain FROM customer)"""


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda n, *of: F.element_at(F.array(*map(F.lit, of)), (F.col("c_custkey") % n + 1).cast("int"))
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), pick(4, "Ann O'Neil", "Bob Ray (Sales)", "Tom", "Eva | Acme").alias("name"), pick(6, "ann.oneil", "bray", "sales-team", "noreply+7", "tom", "x").alias("local"), pick(5, "mail.acme.co.nz", "gmail.com", "noreply.github.com", "acme.example", "local").alias("domain"))


@query(f"""WITH {_PEOPLE} SELECT id, local IN ('sales-team', 'noreply+7') AS role, local = 'noreply+7' AS unattended, domain = 'gmail.com' AS webmail, domain = 'noreply.github.com' AS sending,
 CASE WHEN domain LIKE '%acme%' THEN 'Acme' WHEN domain LIKE '%github%' THEN 'Github' END AS organisation,
 (name LIKE 'Ann%' AND local = 'ann.oneil') OR (name LIKE 'Tom%' AND local = 'tom') AS spelt,
 (name LIKE 'Ann%' AND local = 'ann.oneil') OR (name LIKE 'Tom%' AND local = 'tom') OR (name LIKE 'Bob%' AND local = 'bray') AS agrees,
 CASE WHEN name LIKE 'Ann%' THEN 'ann,oneil' WHEN name LIKE 'Bob%' THEN 'bob,ray' WHEN name LIKE 'Tom%' THEN 'tom' ELSE 'eva' END AS words FROM people""")
def address_gates(spark, sf_dir):
    full, local, name = F.concat("local", F.lit("@"), "domain"), F.col("local"), F.col("name")
    return _people(spark, sf_dir).select("id", address.is_role(local).alias("role"), address.is_unattended(local).alias("unattended"), address.is_webmail(F.col("domain")).alias("webmail"), address.is_sending_host(F.col("domain")).alias("sending"), address.organisation(full).alias("organisation"), address.local_spells(full, name).alias("spelt"), address.address_names(local, name).alias("agrees"), F.array_join(address.name_words(name), ",").alias("words"))


@query(f"""WITH {_PEOPLE}, a AS (SELECT id, name, local FROM people WHERE id % 3 = 0), b AS (SELECT id + 1 AS other, name AS called FROM people)
SELECT a.id AS drop_id, b.other AS keep_id, CASE WHEN local IN ('sales-team', 'noreply+7') THEN 'role' WHEN split_part(lower(name), ' ', 1) <> split_part(lower(called), ' ', 1) THEN 'names' END AS refused
FROM a JOIN b ON b.other = a.id""")
def domain_merges(spark, sf_dir):
    """Each third customer at two hosts, the second held under the name of the customer before."""
    p = _people(spark, sf_dir)
    at = lambda host: F.concat("local", F.lit("."), F.col("id").cast("string"), F.lit(f"@{host}")).alias("value")
    old = p.where("id % 3 = 0").select(F.lit("email").alias("kind"), at("old.example"), F.col("id").alias("person_id"))
    new = p.select(F.lit("email").alias("kind"), at("new.example"), (-F.col("id")).alias("person_id"))
    names = p.select(F.col("id").alias("person_id"), "name").unionByName(p.select((-F.col("id") - 1).alias("person_id"), "name"))
    plan = identity.domain_plan(old.unionByName(new), "old.example", "new.example", names)
    return plan.select("drop_id", (-F.col("keep_id")).alias("keep_id"), F.when(F.col("refused").startswith("role"), "role").when(F.col("refused").isNotNull(), "names").alias("refused"))


@query(f"""WITH {_ENTRIES}, t AS (SELECT entry_id, regexp_replace('talk ' || container || chr(10) || chr(10) || regexp_replace(coalesce(text, ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS t FROM entries),
w AS (SELECT *, len(list_filter(string_split_regex(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: regexp_matches(x, '\\p{{L}}'))) AS words, substring(t, 1, {embed.MOST_CHARS}) AS cut, substring(t, {embed.MOST_CHARS} + 1, 1) AS next FROM t)
SELECT entry_id, CASE WHEN words < {embed.LEAST_WORDS} THEN 'too short' END AS reason,
  md5(CASE WHEN words < {embed.LEAST_WORDS} THEN '' WHEN length(t) <= {embed.MOST_CHARS} THEN t
    ELSE regexp_replace(CASE WHEN regexp_matches(next, '[ \\t\\n\\x0B\\f\\r]') THEN cut ELSE regexp_replace(cut, '[ \\t\\n\\x0B\\f\\r]+[^ \\t\\n\\x0B\\f\\r]*\\z', '') END, '[ \\t\\n\\x0B\\f\\r]+\\z', '') END) AS digest FROM w""")
def embed_texts(spark, sf_dir):
    e = entries(spark, sf_dir).withColumn("subject", F.concat(F.lit("Re: AW[2]: talk "), F.col("container").cast("string")))
    return e.select("entry_id", embed.prepared(F.lit("chat"), F.col("subject"), F.col("text")).alias("p")).select("entry_id", "p.reason", F.md5("p.text").alias("digest"))


@query(f"""WITH {_ENTRIES}, w AS (SELECT entry_id, len(list_filter(string_split_regex('talk ' || coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: regexp_matches(x, '\\p{{L}}'))) AS words FROM entries)
SELECT 'hash' AS model, 32 AS dim, count(*) FILTER (WHERE words >= {embed.LEAST_WORDS}) AS vectors, count(*) FILTER (WHERE words < {embed.LEAST_WORDS}) AS skipped, 0 AS stale FROM w""")
def embed_coverage(spark, sf_dir):
    """Vectors of half of the turns are stored, the rest is pending and filled in; all of them are covered then."""
    e = entries(spark, sf_dir)
    p = embed.prepared(F.lit("chat"), F.lit("talk"), F.col("text"))
    texts = e.select("entry_id", p.alias("p")).select("entry_id", "p.text", "p.reason", F.md5("p.text").alias("body_sha"))
    model = embed.HashEmbedder(dim=32)
    stored = embed.backfill(texts.where("entry_id % 2 = 0"), model)
    every = embed.merge(stored, embed.backfill(embed.pending(texts, stored, model.model, model.dim), model))
    return embed.coverage(every, texts).withColumn("stale", F.col("stale").cast("int"))
