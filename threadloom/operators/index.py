"""Indexes of words with their places and of trigrams, and searches that read only the buckets of what is asked.

The index of words holds, by bucket of the token, each entry's places of each token, so
phrases are found by shifting and intersecting places.  Tokens are words without case and
accents, cut to Porter's stems.  Places ascend, and Parquet's second format stores
ascending numbers as packed differences.  The index of trigrams holds which entries have
which three characters; who holds all of a needle's is read again and checked exactly.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import K1, LEAST_IDF, B, is_identifier, query_terms

_WORD = re.compile(r"[^\W_]+")
#: Words, or trigrams of each text, that a task gathers before it hands their rows on.
BLOCK = 500_000

# Suffixes of Porter's steps 2, 3 and 4 (M. F. Porter, An algorithm for suffix stripping, 1980).
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
_BY_LENGTH = lambda suffixes: sorted(suffixes, key=len, reverse=True)
_STEPS = [(_BY_LENGTH(STEP2), STEP2), (_BY_LENGTH(STEP3), STEP3)]
_LAST = _BY_LENGTH(STEP4)


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel behind a consonant."""
    out = ""
    for x in word:
        out += "v" if x in "aeiou" or (x == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(word).count("vc")


def _short(word: str) -> bool:
    """Whether a word ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """Porter's stem of a word in lower case; words of other letters than a-z, and of one or two, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith("s") and not word.endswith("ss"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif (cut := next((s for s in ("ed", "ing") if word.endswith(s)), None)) and "v" in _shape(word[: -len(cut)]):
        word = word[: -len(cut)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word[-2:-1] == word[-1] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for suffixes, to in _STEPS:
        if (cut := next((s for s in suffixes if word.endswith(s)), None)) and _measure(word[: -len(cut)]):
            word = word[: -len(cut)] + to[cut]
    if cut := next((s for s in _LAST if word.endswith(s)), None):
        rest = word[: -len(cut)]
        if _measure(rest) > 1 and (cut != "ion" or rest.endswith(("s", "t"))):
            word = rest
    if word.endswith("e") and ((m := _measure(word[:-1])) > 1 or (m == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def index_words(text: str | None, stemmed: bool = True) -> list[str]:
    """The tokens of a text: runs of letters and digits without case and accents."""
    text = (text or "").lower()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    found = _WORD.findall(text)
    return [stem(w) for w in found] if stemmed else found


def _bucket(token: str, buckets) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def write_index(entries: DataFrame, path: str, fields: tuple[str, ...], entry: str = "entry_id", buckets: int = 64, stemmed: bool = True) -> None:
    """Index the words of the named columns for `match`.

    `path`/postings has, by bucket of the token, a row (token, field, entries, dls, places)
    for each token of a block of texts: the entries that hold it, their numbers of words
    over all fields, and its places in each.  So rows are a block's tokens, not each
    text's.  Texts are read once, postings shuffled once, a bucket's rows over several
    files, so a frequent word is never one task's.  Rows without a token have words of blocks.
    """
    kind = entries.schema[entry].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            words = 0
            for ident, *texts in zip(*(c.to_pylist() for c in batch.columns)):
                read = [index_words(t, stemmed) for t in texts]
                dl = sum(map(len, read))
                held += [(ident, field, dl, found) for field, found in enumerate(read) if found]
                words += dl
                if words > BLOCK:
                    yield _postings(held, words, batch.column(0).type)
                    held, words = [], 0
            yield _postings(held, words, batch.column(0).type)

    own = entries.select(F.col(entry).alias("entry_id"), *[F.col(f) for f in fields])
    rows = own.mapInArrow(run, _columns("postings", kind))
    bucket = F.when(F.col("token").isNull(), F.lit(-1)).otherwise(_bucket("token", buckets))
    dealt = rows.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64(F.get("entries", F.lit(0))), F.lit(4))).sortWithinPartitions("bucket", "token")
    dealt.write.option("parquet.writer.version", "v2").partitionBy("bucket").parquet(f"{path}/postings")
    blocks = _blocks(entries.sparkSession, f"{path}/postings", kind).where("bucket = -1")
    total = entries.agg(F.count("*").alias("n"))
    stats = blocks.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words")).join(total)
    stats.select("n", (F.col("words") / F.greatest(F.col("n"), F.lit(1))).alias("avgdl"), F.lit(buckets).alias("buckets"), F.lit(stemmed).alias("stemmed"), F.lit(kind).alias("kind"), F.array(*map(F.lit, fields)).alias("fields")).write.parquet(f"{path}/stats")


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys starts, and the end."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), len(new)).astype(np.int32)


def _postings(held: list[tuple], words: int, ident: pa.DataType) -> pa.RecordBatch:
    """Rows of a block of (entry, field, number of words, words), and one for how many words it has."""
    coded = pa.array(list(itertools.chain.from_iterable(h[3] for h in held)), pa.string()).dictionary_encode()
    size = np.array([len(h[3]) for h in held], np.int64)
    text = np.repeat(np.arange(len(held)), size)
    place = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    field = np.array([h[1] for h in held], np.int32)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((field[text], code))  # stable: texts and places ascend
    code, text = code[order], text[order]
    entry = _starts(code, field[text], text)
    row = _starts(code[entry[:-1]], field[text[entry[:-1]]])
    of, first = text[entry[:-1]], entry[row[:-1]]
    ends = pa.array(np.append(row, row[-1]), pa.int32())
    lists = lambda values: pa.ListArray.from_arrays(ends, values)
    idents = pa.array([h[0] for h in held], ident).take(pa.array(of))
    dls = pa.array(np.array([h[2] for h in held], np.int32)[of])
    places = pa.ListArray.from_arrays(pa.array(entry), pa.array(place[order].astype(np.int32)))
    more = lambda x, last: pa.concat_arrays([x, last])
    tokens = more(coded.dictionary.take(pa.array(code[first])), pa.nulls(1, pa.string()))
    fields = more(pa.array(field[text[first]], pa.int32()), pa.nulls(1, pa.int32()))
    count = more(pa.nulls(len(first), pa.int64()), pa.array([words], pa.int64()))
    return pa.RecordBatch.from_arrays([tokens, fields, lists(idents), lists(dls), lists(places), count], ["token", "field", "entries", "dls", "places", "words"])


def _columns(name: str, kind: str) -> str:
    return f"gram string, entries array<{kind}>" if name == "grams" else f"token string, field int, entries array<{kind}>, dls array<int>, places array<array<int>>, words long"


def _blocks(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of blocks; the schema is stated, as an index of an empty table has no files."""
    return spark.read.schema(f"{_columns(path.rsplit('/', 1)[-1], kind)}, bucket int").parquet(path)


def _each(blocks: DataFrame) -> DataFrame:
    """A row for each entry of a block's row: (token, field, entry_id, dl, places) or (gram, entry_id)."""
    if "gram" in blocks.columns:
        return blocks.select("gram", F.explode("entries").alias("entry_id"))
    return blocks.select("token", "field", F.inline(F.arrays_zip(F.col("entries").alias("entry_id"), F.col("dls").alias("dl"), "places")))


def _read(spark: SparkSession, path: str, column: str, wanted: list[str], stats) -> DataFrame:
    """The postings of these tokens: partition pruning by bucket, then row groups by token."""
    buckets = stats["buckets"]
    # one row for each token of a query
    of = spark.createDataFrame([(w,) for w in wanted], f"{column} string").select(_bucket(column, buckets).alias("b")).distinct().collect()
    return _each(_blocks(spark, path, stats["kind"]).where(F.col("bucket").isin([r["b"] for r in of]) & F.col(column).isin(wanted)))


def _score(tf: Column, held: Column, dl: Column, n: Column, avgdl: Column) -> Column:
    idf = F.greatest(F.log((n - held + 0.5) / (held + 0.5)), F.lit(LEAST_IDF))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def match(spark: SparkSession, path: str, terms: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """(entry_id, score) of the entries that hold every term, a term of several words as a phrase within one field.

    The score is BM25 over phrases; a field's hits count by its weight (1 if none is
    given).  Terms without a word, and no terms, match nothing.  Texts are not read.
    """
    stats = spark.read.parquet(f"{path}/stats").first()
    phrases = [index_words(t, stats["stemmed"]) for t in terms]
    if not phrases or not all(phrases):
        return _each(_blocks(spark, f"{path}/postings", stats["kind"]).where("false")).select("entry_id", F.lit(0.0).alias("score"))
    rows = _read(spark, f"{path}/postings", "token", sorted({w for p in phrases for w in p}), stats)
    weight = F.element_at(F.array(*[F.lit(float((weights or {}).get(f, 1.0))) for f in stats["fields"]]), F.col("field") + 1)
    found = None
    for p in phrases:
        if len(p) == 1:
            hits = rows.where(F.col("token") == p[0]).select("entry_id", "dl", (F.size("places") * weight).alias("tf"))
        else:
            # where the phrase would start, by each of its words
            starts = [F.max(F.when(F.col("token") == w, F.col("places"))).alias(f"p{k}") for k, w in enumerate(p)]
            per = rows.where(F.col("token").isin(p)).groupBy("entry_id", "dl", "field").agg(*starts)
            both = F.col("p0")
            for k in range(1, len(p)):
                both = F.array_intersect(both, _shifted(F.col(f"p{k}"), k))
            hits = per.select("entry_id", "dl", (F.size(both) * weight).alias("tf")).where("tf > 0")
        hits = hits.groupBy("entry_id", "dl").agg(F.sum("tf").alias("tf"))
        # one row
        held = hits.agg(F.count("*").alias("held"))
        one = hits.join(F.broadcast(held)).select("entry_id", _score(F.col("tf"), F.col("held"), F.col("dl"), F.lit(stats["n"]), F.lit(stats["avgdl"])).alias("one"))
        found = one.withColumnRenamed("one", "score") if found is None else found.join(one, "entry_id").select("entry_id", (F.col("score") + F.col("one")).alias("score"))
    return found


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def write_grams(entries: DataFrame, path: str, entry: str = "entry_id", text: str = "text", buckets: int = 64) -> None:
    """Index the trigrams of a column for `holding`: a row (gram, entries) for each gram of a block of texts, by bucket of the gram, and the table's counts."""
    kind = entries.schema[entry].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list] = {}
            seen = 0
            for ident, text in zip(*(c.to_pylist() for c in batch.columns)):
                low = (text or "").lower()
                for gram in {low[i : i + 3] for i in range(len(low) - 2)}:
                    held.setdefault(gram, []).append(ident)
                    seen += 1
                if seen > BLOCK:
                    yield _grams(held, batch.column(0).type)
                    held, seen = {}, 0
            yield _grams(held, batch.column(0).type)

    rows = entries.select(F.col(entry).alias("entry_id"), F.col(text).alias("text")).mapInArrow(run, _columns("grams", kind))
    dealt = rows.withColumn("bucket", _bucket("gram", buckets)).repartition("bucket", F.pmod(F.xxhash64(F.get("entries", F.lit(0))), F.lit(4))).sortWithinPartitions("bucket", "gram")
    dealt.write.option("parquet.writer.version", "v2").partitionBy("bucket").parquet(f"{path}/grams")
    size = F.greatest(F.length(F.coalesce(F.col(text), F.lit(""))) - 2, F.lit(0))
    entries.agg(F.count("*").alias("n"), F.coalesce(F.avg(size), F.lit(0.0)).alias("avgdl"), F.lit(buckets).alias("buckets"), F.lit(kind).alias("kind")).write.parquet(f"{path}/stats")


def _grams(held: dict[str, list], ident: pa.DataType) -> pa.RecordBatch:
    ends = pa.array([0, *itertools.accumulate(map(len, held.values()))], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.ListArray.from_arrays(ends, pa.array(list(itertools.chain.from_iterable(held.values())), ident))], ["gram", "entries"])


def holding(entries: DataFrame, path: str, needle: str, entry: str = "entry_id", text: str = "text") -> DataFrame:
    """(entry_id, score) of the entries whose text holds a string of three characters or more, whatever its case.

    Only entries that hold all of its trigrams are read and checked.  The score is BM25,
    over how often it occurs; occurrences may overlap.  A shorter needle matches nothing.
    """
    spark, low = entries.sparkSession, needle.lower()
    stats = spark.read.parquet(f"{path}/stats").first()
    wanted = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if not wanted:
        return entries.where("false").select(F.col(entry).alias("entry_id"), F.lit(0.0).alias("score"))
    have = _read(spark, f"{path}/grams", "gram", wanted, stats).groupBy("entry_id").agg(F.countDistinct("gram").alias("k")).where(F.col("k") == len(wanted)).select(F.col("entry_id").alias("candidate"))
    own = F.lower(F.col(text))
    tf = (F.size(F.split(own, f"(?={re.escape(low)})", -1)) - F.when(F.startswith(own, F.lit(low)), 0).otherwise(1)).cast("double")
    checked = entries.join(have, entries[entry] == have["candidate"], "left_semi").where(own.contains(low))
    hits = checked.select(F.col(entry).alias("entry_id"), tf.alias("tf"), (F.length(F.col(text)) - 2).alias("dl"))
    # one row
    held = hits.agg(F.count("*").alias("held"))
    return hits.join(F.broadcast(held)).select("entry_id", _score(F.col("tf"), F.col("held"), F.col("dl"), F.lit(stats["n"]), F.lit(stats["avgdl"])).alias("score"))


def expressions(asked: str) -> tuple[list[str], list[str]]:
    """Terms of a query for the index of words, and those for the index of trigrams: identifiers of three characters or more."""
    terms = query_terms(asked)
    return terms, [t for t in terms if is_identifier(t) and len(t) >= 3]
