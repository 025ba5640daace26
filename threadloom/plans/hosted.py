"""Queries over HTML of messages, each with the SQL that states the same.

Each turn becomes a mail whose HTML quotes the turn before it, in one of three ways: in
the containers of one kind of client (which quote the turn before that one too), below
header lines, or only by half.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import markup
from .queries import _ENTRIES, entries, query


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host_id, html) of every turn."""
    own = entries(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    shown = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    # ids repeat where a conversation has over a thousand turns: each turn stays one host
    up = lambda n: own.groupBy((F.col("entry_id") + n).alias("entry_id")).agg(F.min("text").alias(f"x{n}"))
    rows = own.join(up(1), "entry_id", "left").join(up(2), "entry_id", "left")

    def quote(text, below=None):
        inner = [F.lit("<div>"), shown(text), F.lit("</div>")] + ([below] if below is not None else [])
        return F.when(text.isNull(), "").otherwise(F.concat(F.lit('<div class="gmail_quote"><div class="gmail_attr">On Thu, 7 May 2026 at 04:38, Ann wrote:</div><blockquote class="gmail_quote">'), *inner, F.lit("</blockquote></div>")))

    wrapped = F.concat(F.lit('<div dir="ltr">'), shown(F.col("text")), F.lit("</div>"), quote(F.col("x1"), quote(F.col("x2"))))
    lines = F.when(F.col("x1").isNull(), "").otherwise(F.concat(F.lit("<p><b>From:</b> Ann Ray</p><p><b>Sent:</b> Thursday, 7 May 2026</p><p>"), shown(F.col("x1")), F.lit("</p>")))
    plain = F.concat(F.lit("<div><p>"), shown(F.col("text")), F.lit("</p>"), lines, F.lit("</div>"))
    half = F.concat(F.lit('<div dir="ltr">'), shown(F.col("text")), F.lit("</div>"), quote(F.expr("substring(x1, 1, length(x1) div 2)")))
    kind = F.col("container") % 3
    return rows.select(F.col("entry_id").alias("host_id"), F.when(kind == 0, wrapped).when(kind == 1, plain).otherwise(half).alias("html"))


_SHOWN = "replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""WITH {_ENTRIES} SELECT entry_id AS host_id, CASE WHEN regexp_matches(coalesce(text, ''), '[^\\x00-\\x20\\x{{85}}\\x{{A0}}]') THEN md5(CASE WHEN container % 3 = 1 THEN '<div><p>' || {_SHOWN} || '</p></div>' ELSE '<div dir="ltr">' || {_SHOWN} || '</div>' END) END AS digest FROM entries""")
def own_markup(spark, sf_dir):
    return markup.own_bodies(_hosts(spark, sf_dir)).select("host_id", F.md5("html").alias("digest"))


@query(f"""WITH {_ENTRIES} SELECT e.entry_id, e.entry_id + 1 AS host_id, 1.0::DOUBLE AS f1,
  md5(CASE WHEN e.container % 3 = 1 THEN '<p>' || {_SHOWN.replace('text', 'e.text')} || '</p>' ELSE '<div>' || {_SHOWN.replace('text', 'e.text')} || '</div>' END) AS digest
FROM entries e JOIN entries h ON h.entry_id = e.entry_id + 1 WHERE e.container % 3 < 2 AND len(regexp_extract_all(lower(coalesce(e.text, '')), '[a-z0-9]+')) >= {markup.WORDS}""")
def recovered_markup(spark, sf_dir):
    own = entries(spark, sf_dir).select("entry_id", "text")
    seen = own.select("entry_id", F.explode(F.array(F.col("entry_id") + 1, F.col("entry_id") + 2)).alias("host_id"))
    found = markup.recover(own, seen, markup.quoted_blocks(_hosts(spark, sf_dir)))
    return found.select("entry_id", "host_id", "f1", F.md5("html").alias("digest"))
