"""Queries over quoted messages, people, twins, timelines and phrases.

The driver's tables hold no quoted mail and no addresses, so both are built here from
whole tables: a turn quotes the two turns before it, and customers get addresses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..operators import chains, identity, peel, search, timeline, twins
from .queries import _ENTRIES, _ROOTS, _read, entries, query

_SPACE = r"[ \t\n\x0B\f\r]+"


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, text): each turn above a quote of the turn before, which quotes the one before that."""
    e = entries(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    up = lambda n: e.select((F.col("entry_id") + n).alias("entry_id"), F.col("container").alias(f"c{n}"), F.col("person").alias(f"p{n}"), F.timestamp_seconds("ts").alias(f"ts{n}"), F.col("text").alias(f"x{n}"))
    rows = e.join(up(1), "entry_id", "left").join(up(2), "entry_id", "left")
    marked = lambda t: F.regexp_replace(t, "(?m)^", "> ")

    def quote(n: int, text):
        line = F.concat(F.lit("\n\nOn "), F.date_format(f"ts{n}", "EEE, d MMM yyyy 'at' HH:mm"), F.lit(", "), F.col(f"p{n}"), F.lit(" <"), F.col(f"p{n}"), F.col(f"c{n}").cast("string"), F.lit("@example.org>\nwrote:\n"))
        return F.when(F.col(f"x{n}").isNull(), "").otherwise(F.concat(line, marked(text)))

    return rows.select("entry_id", F.concat("text", quote(1, F.concat("x1", quote(2, F.col("x2"))))).alias("text"))


_BLOCKS = f"""own AS (SELECT entry_id, person, container, ts, trim(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g'), ' ') AS t FROM entries),
every AS (
  SELECT entry_id, 0 AS pos, 0 AS depth, 'visible' AS kind, NULL AS sender, NULL AS address, NULL::BIGINT AS sent, t FROM own WHERE t <> ''
  UNION ALL
  SELECT o.entry_id, n, n - 1, 'attribution', q.person, q.person || q.container || '@example.org', q.ts - q.ts % 60, q.t
  FROM own o, (SELECT unnest([1, 2]) AS n), own q WHERE q.entry_id = o.entry_id - n)"""


@query(f"""WITH {_ENTRIES}, {_BLOCKS}
SELECT entry_id, (row_number() OVER (PARTITION BY entry_id ORDER BY pos) - 1)::INT AS block, depth::INT AS depth, kind, sender, address, sent, md5(t) AS digest FROM every""")
def peel_blocks(spark, sf_dir):
    found = peel.recover(bodies(spark, sf_dir))
    return found.select("entry_id", "block", "depth", "kind", "sender", "address", F.unix_timestamp("sent").alias("sent"), F.md5(collapse(F.col("text"))).alias("digest"))


@query(f"""WITH {_ENTRIES}, {_BLOCKS}
SELECT 'quote:' || substring(sha256(address || chr(0) || strftime(make_timestamp(sent * 1000000), '%Y-%m-%dT%H:%M:%SZ')), 1, 32) AS key, count(*) AS hosts, min(entry_id) AS first_host, max(length(t)) AS n_chars
FROM every WHERE kind <> 'visible' GROUP BY 1""")
def quoted_messages(spark, sf_dir):
    each = peel.distinct_blocks(peel.recover(bodies(spark, sf_dir)))
    return each.groupBy("key").agg(F.count("*").alias("hosts"), F.min("entry_id").alias("first_host"), F.max(F.length(collapse(F.col("text")))).cast("long").alias("n_chars"))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    value = F.concat(F.lit("Person"), (key % 97).cast("string"), F.when(key % 3 == 0, "+news").otherwise(""), F.lit("@N"), (F.col("c_nationkey") % 5).cast("string"), F.lit(".example.org"))
    return _read(spark, sf_dir, "customer").select(F.lit("email").alias("kind"), value.alias("value"), F.when(key % 5 == 0, value).otherwise(F.concat(F.lit("Person "), (key % 97).cast("string"))).alias("name"), key.alias("ts"))


_MENTIONS = r"""raw AS (SELECT 'Person' || (c_custkey % 97) || CASE WHEN c_custkey % 3 = 0 THEN '+news' ELSE '' END || '@N' || (c_nationkey % 5) || '.example.org' AS v,
  'Person ' || (c_custkey % 97) AS called, c_custkey AS ts FROM customer),
mentions AS (SELECT lower(v) AS value, regexp_replace(lower(v), '^([^+@]+)\+[^@]*@', '\1@') AS base, CASE WHEN ts % 5 = 0 THEN NULL ELSE called END AS name, ts FROM raw),
persons AS (SELECT base, min(ts) AS person_id, arg_min(name, (ts, name)) FILTER (WHERE name IS NOT NULL) AS name FROM mentions GROUP BY 1)"""


@query(f"WITH {_MENTIONS} SELECT DISTINCT m.value, m.base AS person, p.name FROM mentions m JOIN persons p USING (base)")
def identity_resolve(spark, sf_dir):
    found = identity.resolve(_mentions(spark, sf_dir))
    # the id is a hash; the base mailbox is the same for all of a person
    person = found.groupBy("person_id").agg(F.min(F.regexp_replace("value", r"\+[^@]*@", "@")).alias("person"))
    return found.join(person, "person_id").select("value", "person", "name")


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities as found, each literal address held by the first customer who has it."""
    return _mentions(spark, sf_dir).groupBy("kind", F.lower("value").alias("value")).agg(F.min("ts").alias("person_id"))


_HELD = f"{_MENTIONS}, held AS (SELECT value, min(ts) AS person_id FROM mentions GROUP BY 1)"


@query(rf"""WITH {_HELD}, t AS (SELECT *, regexp_replace(value, '^([^+@]+)\+[^@]*@', '\1@') AS base FROM held)
SELECT t.person_id, t.value, t.base, CASE WHEN b.person_id IS NULL THEN 'rename' WHEN b.person_id = t.person_id THEN 'same' ELSE 'merge' END AS decision, b.person_id AS keep_id
FROM t LEFT JOIN held b ON b.value = t.base WHERE t.base <> t.value""")
def plus_addresses(spark, sf_dir):
    return identity.plus_plan(_held(spark, sf_dir))


@query(f"""WITH {_HELD} SELECT a.person_id AS drop_id, b.person_id AS keep_id, b.value FROM held a JOIN held b ON b.value = replace(a.value, '@n1.', '@n2.')
WHERE a.value LIKE '%@n1.example.org' AND a.person_id <> b.person_id""")
def domain_alias(spark, sf_dir):
    return identity.domain_plan(_held(spark, sf_dir), "n1.example.org", "n2.example.org")


@query(f"""WITH {_HELD}, keyed AS (SELECT DISTINCT person_id, split_part(value, '@', 1) AS key, 'same local part' AS reason FROM held
  UNION SELECT c_custkey, lower(c_mktsegment) || c_nationkey, 'same name' FROM customer),
f AS (SELECT reason, key, min(person_id) AS a FROM keyed GROUP BY 1, 2)
SELECT a, person_id AS b, array_to_string(list_sort(list(DISTINCT reason)), '; ') AS reasons FROM keyed JOIN f USING (reason, key) WHERE person_id > a GROUP BY 1, 2""")
def merge_candidates(spark, sf_dir):
    names = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("name"))
    return identity.merge_candidates(_held(spark, sf_dir), names)


@query("""WITH m AS (SELECT o_custkey, count(*) AS messages FROM orders GROUP BY 1),
p AS (SELECT c_custkey AS person_id, 'ann' || c_custkey % 11 || '@' || c_nationkey AS g, CASE WHEN c_custkey % 4 = 0 THEN 'ray' WHEN c_custkey % 90 = 1 THEN 'van ray' END AS surname, coalesce(messages, 0) AS messages
  FROM customer LEFT JOIN m ON o_custkey = c_custkey WHERE c_custkey % 50 <> 7),
s AS (SELECT g, count(DISTINCT surname) AS surnames, arg_max(person_id, (surname IS NOT NULL, messages, -person_id)) AS keep_id FROM p GROUP BY 1 HAVING count(*) > 1)
SELECT person_id, g AS "group", CASE WHEN surnames > 1 THEN 'refuse' WHEN person_id = keep_id THEN 'keep' ELSE 'merge' END AS decision, CASE WHEN surnames <= 1 THEN keep_id END AS keep_id FROM p JOIN s USING (g)""")
def first_name_merges(spark, sf_dir):
    key = F.col("c_custkey")
    counts = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("messages"))
    name = F.concat(F.lit("Ann"), (key % 11).cast("string"), F.when(key % 50 == 7, "@x.org").when(key % 8 == 0, " Ray (Sales)").when(key % 4 == 0, " B Ray").when(key % 90 == 1, " van Ray | Acme").when(key % 10 == 3, " R").otherwise(""))
    people = _read(spark, sf_dir, "customer").join(counts, "c_custkey", "left").select(key.alias("person_id"), name.alias("name"), F.col("c_nationkey").cast("string").alias("org"), "messages")
    return identity.first_name_plan(people)


@query("""WITH RECURSIVE m AS (SELECT c_custkey AS drop_id, c_custkey // 2 AS keep_id FROM customer WHERE c_custkey % 16 <> 0),
up AS (SELECT drop_id, keep_id FROM m UNION ALL SELECT up.drop_id, m.keep_id FROM up JOIN m ON m.drop_id = up.keep_id),
last AS (SELECT drop_id, keep_id FROM up WHERE keep_id NOT IN (SELECT drop_id FROM m))
SELECT coalesce(keep_id, o_custkey) AS person_id, count(*) AS messages FROM orders LEFT JOIN last ON drop_id = o_custkey GROUP BY 1""")
def merged_activity(spark, sf_dir):
    merges = _read(spark, sf_dir, "customer").where("c_custkey % 16 <> 0").select(F.col("c_custkey").alias("drop_id"), F.floor(F.col("c_custkey") / 2).alias("keep_id"))
    rows = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person_id"))
    return identity.repoint(rows, "person_id", identity.survivors(merges)).groupBy("person_id").agg(F.count("*").alias("messages"))


@query(f"""WITH {_ENTRIES}, w AS (SELECT entry_id FROM entries WHERE len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) >= {twins.WORDS})
SELECT entry_id, entry_id AS "group", entry_id AS keep_id, 'keep' AS decision FROM w UNION ALL SELECT entry_id + 500, entry_id, entry_id, 'drop' FROM w""")
def twin_plan(spark, sf_dir):
    """A quoted copy of every turn, two hours off; persons are the conversation's turns."""
    e = entries(spark, sf_dir)
    rows = e.select("entry_id", F.col("entry_id").cast("string").alias("person"), F.col("ts").alias("wall"), "text", F.lit(False).alias("quoted"))
    copies = rows.unionByName(rows.withColumns({"entry_id": F.col("entry_id") + 500, "wall": F.col("wall") + 7200, "quoted": F.lit(True)}))
    return twins.plan(copies, twins.pairs(copies))


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).withColumn("subject", F.concat(F.lit("talk "), (F.floor(F.col("entry_id") % 1000 / 3)).cast("string")))


_SELECTED = f"{_ENTRIES}, {_ROOTS}, sel AS (SELECT e.*, root_id, 'talk ' || (entry_id % 1000) // 3 AS subject FROM entries e JOIN roots USING (entry_id))"


@query(f"""WITH RECURSIVE {_SELECTED}
SELECT x.root_id, row_number() OVER (PARTITION BY x.root_id ORDER BY x.ts, x.entry_id) - 1 AS place, x.entry_id, p.entry_id AS parent_id, CASE WHEN p.subject IS DISTINCT FROM x.subject THEN x.subject END AS subject, x.parent_id IS NOT NULL AND p.entry_id IS NULL AS orphan
FROM sel x LEFT JOIN sel p ON p.entry_id = x.parent_id AND (p.ts, p.entry_id) < (x.ts, x.entry_id)""")
def timeline_messages(spark, sf_dir):
    rows = _selected(spark, sf_dir)
    return timeline.messages(rows, chains.roots(rows)).select("root_id", "place", "entry_id", "parent_id", "subject", "orphan")


@query(f"""WITH RECURSIVE {_SELECTED} SELECT container, arg_min(subject, (ts, entry_id)) AS subject, count(*) AS count, min(ts) AS first_ts, max(ts) AS last_ts FROM sel
WHERE root_id IN (SELECT root_id FROM sel WHERE contains(lower(text), 'tion')) GROUP BY 1""")
def timeline_threads(spark, sf_dir):
    rows = _selected(spark, sf_dir)
    return timeline.threads(timeline.closure(rows, search.containing(rows, "tion")))


@query(f"""WITH RECURSIVE {_SELECTED}, m AS (
  SELECT x.*, p.entry_id AS pid, CASE WHEN p.entry_id IS NULL OR p.subject IS DISTINCT FROM x.subject THEN x.subject END AS shown
  FROM sel x LEFT JOIN sel p ON p.entry_id = x.parent_id AND (p.ts, p.entry_id) < (x.ts, x.entry_id))
SELECT root_id, count(*) AS messages, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(shown, (ts, entry_id)) AS subject,
 array_to_string(list_sort(list(DISTINCT person)), ',') AS "cast", count(*) FILTER (WHERE parent_id IS NOT NULL AND pid IS NULL) AS orphans FROM m GROUP BY 1""")
def timeline_documents(spark, sf_dir):
    rows = _selected(spark, sf_dir)
    return timeline.documents(timeline.messages(rows, chains.roots(rows)))


@query()
def timeline_lanes(spark, sf_dir):
    spans = _read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    return timeline.lanes(spans, "user_id", "first", "last", "event_type")


@query("""WITH a AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || '.' ELSE coalesce(text, '') END AS t FROM documents)
SELECT id, CASE WHEN id IN (SELECT id FROM a) THEN 'revised' WHEN t IN (SELECT t FROM a) THEN 'revised' ELSE 'new' END AS change FROM b
WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.id = b.id AND a.t = b.t)""")
def timeline_changes(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("t"))
    sha = lambda t: F.sha2(t, 256).alias("content")
    after = docs.select("id", sha(F.when(F.col("id") % 7 == 0, F.concat("t", F.lit("."))).otherwise(F.col("t"))))
    return timeline.changes(docs.where("id % 3 <> 0").select("id", sha(F.col("t"))), after, "id", "content")


@query(f"""WITH w AS (SELECT doc_id AS entry_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w, len(regexp_extract_all(lower(coalesce(source, '')), '[a-z0-9]+')) AS m FROM documents),
c AS (SELECT entry_id, len(w) + m AS dl, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS t FROM w),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE t > 0) AS k FROM c)
SELECT entry_id, round(greatest(ln((n - k + 0.5) / (k + 0.5)), {search.LEAST_IDF}) * t * {search.K1 + 1} / (t + {search.K1} * ({1 - search.B} + {search.B} * dl / avgdl)), 6) AS score FROM c, s WHERE t > 0""")
def search_phrases(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return search.phrases(docs, search.query_terms('"of the"'), {"source": 4.0, "text": 1.0}, "doc_id").select("entry_id", F.round("score", 6).alias("score"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
a AS (SELECT *, list_position(list_transform(w, lambda x: lower(regexp_replace(x, '[^A-Za-z0-9]', '', 'g')) = 'the'), true) AS pos FROM w),
b AS (SELECT *, greatest(pos - 6, 1) AS s FROM a WHERE pos > 0)
SELECT doc_id, CASE WHEN s > 1 THEN '… ' ELSE '' END || array_to_string(list_transform(w[s : s + 11], lambda x: CASE WHEN lower(regexp_replace(x, '[^A-Za-z0-9]', '', 'g')) = 'the' THEN '[' || x || ']' ELSE x END), ' ')
 || CASE WHEN s + 11 < len(w) THEN ' …' ELSE '' END AS snippet FROM b""")
def search_snippets(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", search.snippet(F.col("text"), ["the"]).alias("snippet")).where("snippet IS NOT NULL")
