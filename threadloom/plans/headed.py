"""Queries over mail headers and the people of timelines, with SQL where SQL can state it.

Customers stand for addressees, orders for dates, events for mentions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import headers
from ..operators import cast, embed
from .queries import _read, query


@query("""WITH c AS (SELECT c_custkey AS k, 'u' || c_custkey || '@x' || c_nationkey || '.org' AS a FROM customer),
e AS (
  SELECT k, 1 AS pos, a AS address, 'Ray, Ann ' || k AS name FROM c
  UNION ALL SELECT k, 2, 'b.' || a, CASE WHEN k % 2 = 0 THEN 'Bob (Bo) ' || k ELSE 'Jürg ' || k END FROM c
  UNION ALL SELECT k, 3, CASE WHEN k % 3 = 0 THEN NULL ELSE 'c.' || a END, CASE WHEN k % 3 = 0 THEN 'Team ' || k WHEN k % 3 = 1 THEN '' ELSE 'Cy; ' || k END FROM c
  UNION ALL SELECT k, 4, 'd.' || a, '' FROM c)
SELECT k AS id, pos, address, name FROM e""")
def header_addresses(spark, sf_dir):
    """Four addressees a customer: a quoted name, an encoded or commented one, a name alone or a comment, and a member of a group."""
    k = F.col("c_custkey").cast("string")
    a = F.concat(F.lit("U"), k, F.lit("@X"), F.col("c_nationkey").cast("string"), F.lit(".org"))
    second = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('"Bob (Bo) '), k, F.lit('" <b.'), a, F.lit(">"))).otherwise(F.concat(F.lit("=?utf-8?q?J=C3=BCrg_"), k, F.lit("?= (old)\r\n <b."), a, F.lit(">")))
    third = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Team "), k)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("<c."), a, F.lit(">"))).otherwise(F.concat(F.lit("c."), a, F.lit(" (Cy; "), k, F.lit(")")))
    header = F.concat(F.lit('"Ray, Ann '), k, F.lit('" <'), a, F.lit(">, "), second, F.lit("; "), third, F.lit(", Others: d."), a, F.lit(";"))
    rows = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.posexplode(headers.addresses(header)).alias("pos", "x"))
    return rows.select("id", (F.col("pos") + 1).alias("pos"), "x.address", "x.name")


@query("""SELECT o_orderkey AS id, epoch(o_orderdate::TIMESTAMP)::BIGINT + (o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 - m * 60 AS at, l AS label, m AS "offset"
FROM orders, (VALUES (0, '+1000', 600), (1, '-0330', -210), (2, 'GMT', 0), (3, 'EST', -300), (4, 'XYZ', 0)) z(i, l, m) WHERE o_orderkey % 5 = i""")
def header_dates(spark, sf_dir):
    k = F.col("o_orderkey")
    zone = F.get(F.array(*map(F.lit, ("+1000", "-0330", "GMT", "EST", "XYZ"))), (k % 5).cast("int"))
    day = F.when(k % 2 == 0, F.date_format("o_orderdate", "EEE, d MMM yyyy")).otherwise(F.date_format("o_orderdate", "d MMM yyyy"))
    text = F.concat(day, F.format_string(" %02d:%02d", (k % 24).cast("int"), (k % 60).cast("int")), F.when(k % 3 == 0, ":00").otherwise(""), F.lit(" "), zone, F.when(k % 4 == 0, " (a zone)").otherwise(""))
    return _read(spark, sf_dir, "orders").select(k.alias("id"), headers.header_date(text).alias("d")).select("id", "d.at", "d.label", "d.offset")


@query()
def timeline_cast(spark, sf_dir):
    """Events as mentions: users by id, address or name, addresses shared by neighbours."""
    u = F.col("user_id")
    shared = F.concat(F.lit("u"), (u - u % 3).cast("string"), F.lit("@x.org"))
    kind = F.col("event_id") % 4
    mentions = _read(spark, sf_dir, "events").select(
        F.col("event_type").alias("timeline"), F.col("event_id").alias("pos"), F.when(kind < 2, u).alias("person"), F.when(kind % 2 == 0, shared).alias("address"), F.concat(F.lit("User "), u.cast("string")).alias("name"),
        F.array(F.concat(F.lit("u"), (u + 7).cast("string"), F.lit("@x.org"))).alias("others"), F.when(u % 2 == 0, "Acme").alias("org"), (kind == 0).alias("named"), (u % 5 > 0).alias("direct"),
    )
    return cast.people(mentions)


_GAP = "[ \\t\\n\\x0B\\f\\r]"


@query(f"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)\\bhttps?://([^ \\t\\n\\x0B\\f\\r/?#]+)[^ \\t\\n\\x0B\\f\\r]*', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{_GAP}+|{_GAP}+$', '', 'g') AS t FROM documents),
w AS (SELECT *, len(list_filter(string_split_regex(t, '{_GAP}+'), lambda x: regexp_matches(x, '\\p{{L}}'))) AS words, substring(t, 1, {embed.MOST_CHARS}) AS cut, substring(t, {embed.MOST_CHARS} + 1, 1) AS next FROM t)
SELECT doc_id AS entry_id, CASE WHEN t = '' THEN 'no text' WHEN words < {embed.LEAST_WORDS} THEN 'too short' END AS reason,
  md5(CASE WHEN words < {embed.LEAST_WORDS} THEN '' WHEN length(t) <= {embed.MOST_CHARS} THEN t
    ELSE regexp_replace(CASE WHEN regexp_matches(next, '{_GAP}') THEN cut ELSE regexp_replace(cut, '{_GAP}+[^ \\t\\n\\x0B\\f\\r]*\\z', '') END, '{_GAP}+\\z', '') END) AS digest FROM w""")
def embed_documents(spark, sf_dir):
    """What a model is given of whole documents, many of which are longer than what it takes."""
    p = embed.prepared(F.lit("chat"), F.lit(""), F.col("text"))
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), p.alias("p")).select("entry_id", "p.reason", F.md5("p.text").alias("digest"))
