"""Benchmark decontamination by winnowing, in DataFrame functions only.

An item is known by its windows of WINDOW consecutive words (a shorter item is one
window).  Of the k-gram hashes of a window the least, the leftmost of equal ones, is its
fingerprint; sliding the window over a document selects about 2 in 7 of its k-grams.
Any span of a document that equals a window therefore selects that window's fingerprint
at the same place of the span: no shared span of WINDOW words or more can be missed.

1. Fingerprints of the documents are kept where an item's window has the same one (a
   semi join; the documents' texts and the other fingerprints go no further).
2. Each such place is extended to the windows around it, which are held against the
   items' windows by digests of their words.  Equal texts share one digest of the text
   and are judged once.
3. Hits are merged to counts of words, and joined to the items that have the window.

The table of item windows is written, so Spark broadcasts it only under its own
threshold on a measured size; beyond that all joins are shuffled on hashes, and adaptive
execution splits a passage that many documents share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WINDOW = 10
#: What parts words, in lowered text.
BETWEEN = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; null has none."""
    text = F.coalesce(text, F.lit(""))
    # lower() maps more than A-Z, but not in ASCII, where it is much the faster
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    # split() is several times as fast as taking matches out, which copies the text for each
    return F.array_remove(F.split(lowered, f"[{BETWEEN}]+", -1), "")


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often a lambda in `use` reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _upto(n: Column) -> Column:
    """1 to n, empty if n < 1."""
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), n))


def fingerprints(of: Column, span: Column) -> Column:
    """array<struct<pos, hash>> of the selected k-grams of an array of words; pos counts words from 1.

    Every span of `span` words holds a selected k-gram that depends on its words alone.
    """
    k = F.shiftright(span + 1, 1)
    wide = span - k + 1

    def select(grams: Column) -> Column:
        def least(i: Column) -> Column:
            return _let(F.slice(grams, i, wide), lambda near: (i + F.array_position(near, F.array_min(near)) - 1).cast("int"))

        places = F.array_distinct(F.transform(_upto(F.size(grams) - wide + 1), least))
        return F.transform(places, lambda p: F.struct(p.alias("pos"), F.get(grams, p - 1).alias("hash")))

    def grams(hashes: Column) -> Column:
        return F.transform(_upto(F.size(hashes) - k + 1), lambda i: F.xxhash64(F.slice(hashes, i, k)))

    return _let(F.transform(of, lambda w: F.xxhash64(w)), lambda h: _let(grams(h), select))


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, span, key, hash): a row for each window of each item, with its fingerprint."""
    rows = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    spans = rows.withColumn("span", F.least(F.lit(window), F.size("w")))
    each = spans.withColumn("start", F.explode(_upto(F.size("w") - F.col("span") + 1)))
    own = F.slice("w", F.col("start"), F.col("span"))
    fingerprint = F.get(fingerprints(own, F.col("span")), F.lit(0))["hash"]
    return each.select("item_id", "span", F.unhex(F.md5(F.array_join(own, " "))).alias("key"), fingerprint.alias("hash")).distinct()


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, known): (doc_id, digest, n_words) of every document, (digest, start, span, key, words) of the windows found, and the item windows.

    start counts words from 1; words is the window's text.  Texts that are equal share a
    digest, which stands for them in `hits`.
    """
    known = written(item_windows(items, item_id, item_text, window))
    # lengths of windows, ten at most; short items alone bring other ones than `window`
    lengths = sorted(r[0] for r in known.select("span").distinct().collect())
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    found = F.lit(None).cast("array<struct<span:int,pos:int,hash:bigint>>")
    if lengths:

        def of_span(w: Column, span: int) -> Column:
            return F.transform(fingerprints(w, F.lit(span)), lambda x: F.struct(F.lit(span).alias("span"), x["pos"].alias("pos"), x["hash"].alias("hash")))

        found = _let(words(F.col("text")), lambda w: F.flatten(F.array(*[of_span(w, span) for span in lengths])))
    marks = source.select(digest.alias("digest"), F.explode(found).alias("m")).select("digest", "m.*")
    places = marks.join(known.select("span", "hash").distinct(), ["span", "hash"], "left_semi").groupBy("digest").agg(F.collect_set(F.struct("span", "pos")).alias("places"))
    places = written(places)

    def around(w: Column) -> Column:
        def starts(p: Column) -> Column:
            # a k-gram of (span + 1) // 2 words starts at most span // 2 words into its window
            back = F.shiftright(p["span"], 1)
            first, last = F.greatest(F.lit(1), p["pos"] - back), F.least(p["pos"], F.size(w) - p["span"] + 1)
            return F.when(first > last, F.array().cast("array<struct<span:int,start:int>>")).otherwise(F.transform(F.sequence(first, last), lambda s: F.struct(p["span"].alias("span"), s.alias("start"))))

        windows = F.array_distinct(F.flatten(F.transform(F.col("places"), starts)))
        return F.struct(F.size(w).alias("n_words"), F.transform(windows, lambda x: F.struct(x["start"].alias("start"), x["span"].alias("span"), F.array_join(F.slice(w, x["start"], x["span"]), " ").alias("words"))).alias("windows"))

    keyed = source.withColumn("digest", digest).join(places, "digest", "left")
    rows = written(keyed.select("doc_id", "digest", _let(words(F.col("text")), around).alias("s")).select("doc_id", "digest", "s.*"))
    opened = rows.select("digest", F.explode("windows").alias("x")).select("digest", "x.*").distinct().withColumn("key", F.unhex(F.md5("words")))
    hits = opened.join(known.select("span", "key").distinct(), ["span", "key"], "left_semi").select("digest", "start", "span", "key", "words")
    return rows.select("doc_id", "digest", F.col("n_words").cast("long").alias("n_words")), written(hits), known


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids) of every row of `docs`: how many of its words lie in a window of an item, and of which items.

    item_ids is sorted as strings.  A null or empty text has no words and no hits; a null
    doc_id stays null, repeated rows are judged each.  An item without words is never
    found; what a null item_id holds is hit but names no item; items of one id are one.
    An empty table of items hits nothing.  Other columns of both tables are ignored.
    """
    rows, hits, known = overlaps(docs, items, doc_id, text, item_id, item_text, window)
    places = hits.select("digest", "start", (F.col("start") + F.col("span")).alias("stop")).distinct()
    before = F.max("stop").over(Window.partitionBy("digest").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    gain = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    n_hit = places.select("digest", gain.alias("gain")).groupBy("digest").agg(F.sum("gain").alias("n_hit"))
    named = known.where(F.col("item_id").isNotNull()).select("span", "key", F.col("item_id").cast("string").alias("item_id"))
    of_items = hits.select("digest", "span", "key").distinct().join(named, ["span", "key"]).select("digest", "item_id").distinct()
    item_ids = of_items.groupBy("digest").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    found = written(n_hit.join(item_ids, "digest", "left"))
    out = rows.join(found, "digest", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def report(found: DataFrame) -> DataFrame:
    """The columns of op11."""
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: DuckDB SQL of `report(decontaminate(documents, benchmark))`: every window of every document, without fingerprints.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^{BETWEEN}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^{BETWEEN}]+') AS w FROM benchmark),
items AS (SELECT item_id, w, least({WINDOW}, len(w)) AS span FROM b WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, span, array_to_string(w[s:s + span - 1], ' ') AS key
  FROM (SELECT item_id, w, span, unnest(range(1, len(w) - span + 2)) AS s FROM items)),
places AS (
  SELECT doc_id, s, span, array_to_string(w[s:s + span - 1], ' ') AS key
  FROM (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS s
        FROM d, (SELECT DISTINCT span FROM windows) WHERE len(w) >= span)),
hits AS (SELECT DISTINCT p.doc_id, p.s, p.span, w.item_id FROM places p JOIN windows w USING (span, key)),
hit_words AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(s, s + span)) AS place FROM hits) GROUP BY 1),
hit_items AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id)
"""
