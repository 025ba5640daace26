"""Audit of how each source's words differ from the other sources of its language.

Counting is done in DuckDB, inside Spark tasks: each task counts terms of its documents
and hands on partial counts; shards by hash of language and term hold all counts of a
term, so they decide which terms a language keeps, and later form partial sums over the
pairs of sources that share a term.  Spark adds up sums and ranks.

With p = 1 + floor(SCALE * (count + 1) / (N + V)), the divergence of source a from b is the
sum of f(p_a, p_b) = floor((p_a - p_b)^2 / p_b) over all kept terms of the language.  Most
terms are missing from most sources, and a missing term's p0 depends on the source alone:

    sum f(p_a, p_b) = V f(p0_a, p0_b)
                    + sum over terms of a of [f(p_a, p0_b) - f(p0_a, p0_b)]
                    + sum over terms of b of [f(p0_a, p_b) - f(p0_a, p0_b)]
                    + sum over terms of both of [f(p_a, p_b) - f(p_a, p0_b) - f(p0_a, p_b) + f(p0_a, p0_b)]

so shards join only sources that have the term, and the two sums in the middle come from
how many terms of a source have which count.  All of it is in integers; as the p of a
group add up to at most SCALE + V, every sum stays under (SCALE + V)^2.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE, MIN_DOCS, TOP = 1_000_000_000, 3, 200
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of texts that are counted at once, partial counts that a task holds, and sources that a shard pairs with all at once.
BYTES, HELD, SOURCES = 4_000_000, 300_000, 256
COUNTS = "lang string, source string, term string, n long, docs long"


def _connect():
    import duckdb

    return duckdb.connect(config={"threads": 1})


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """The rows of a batch, cut where texts add up to BYTES."""
    sizes = pc.binary_length(batch.column("text")).to_pylist()
    first = held = 0
    for i, size in enumerate(sizes):
        held += size
        if held >= BYTES or i == len(sizes) - 1:
            yield pa.Table.from_batches([batch.slice(first, i - first + 1)])
            first, held = i + 1, 0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts; a row with an empty term for each group, as it may have no other."""
    con = _connect()
    con.execute("CREATE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")

    def flush() -> Iterator[pa.RecordBatch]:
        rows = con.execute("SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL").to_arrow_table()
        con.execute("TRUNCATE held")
        yield from rows.to_batches(max_chunksize=50_000)

    for batch in batches:
        for piece in _pieces(batch):
            con.register("piece", piece)
            con.execute(f"""
                INSERT INTO held
                WITH rows AS (SELECT row_number() OVER () AS i, lang, source, CASE WHEN strlen(text) = length(text) THEN lower(text) ELSE translate(text, '{_UPPER}', '{_LOWER}') END AS text FROM piece),
                terms AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM rows),
                each AS (SELECT i, lang, source, term, count(*) AS n FROM terms GROUP BY ALL)
                SELECT lang, source, term, sum(n), count(*) FROM each GROUP BY ALL
                UNION ALL SELECT DISTINCT lang, source, '', 0, 0 FROM piece""")
            con.unregister("piece")
            if con.execute("SELECT count(*) FROM held").fetchall()[0][0] > HELD:
                yield from flush()
    yield from flush()
    con.close()


def _loaded(con, batches: Iterator[pa.RecordBatch]) -> bool:
    """Put a shard's rows into table `shard`; False if there are none."""
    some = False
    for batch in batches:
        if batch.num_rows:
            con.register("batch", pa.Table.from_batches([batch]))
            con.execute("INSERT INTO shard SELECT * FROM batch" if some else "CREATE TABLE shard AS SELECT * FROM batch")
            con.unregister("batch")
            some = True
    return some


def _kept(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Counts of a shard's terms that enough documents of the language have; `term_first` marks one row of each."""
    con = _connect()
    if _loaded(con, batches):
        rows = con.execute(f"""
            SELECT lang, source, term, n, (sum(n) OVER w)::BIGINT AS lang_n, (row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1)::BIGINT AS term_first
            FROM shard WINDOW w AS (PARTITION BY lang, term) QUALIFY sum(docs) OVER w >= {int(min_docs)}""").to_arrow_table()
        yield from rows.to_batches(max_chunksize=50_000)
    con.close()


def _partial(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """A shard's highest terms of each group, and its partial sums over pairs of sources that share a term."""
    con = _connect()
    if _loaded(con, batches):
        p = lambda n, total: f"(1 + {SCALE}::HUGEINT * {n} // (({total})::HUGEINT + v))::BIGINT"
        con.execute(f"CREATE TABLE one AS SELECT lang, source, term, {p('(n + 1)', 'n_group')} AS p, {p('1', 'n_group')} AS p0, {p('(lang_n + 1)', 'n_lang')} AS q FROM shard")
        f = lambda x, y: f"({x} - {y}) * ({x} - {y}) // {y}"
        rows = con.execute(f"""
            SELECT lang, source, 'term' AS part, term AS item, {f('p', 'q')} AS value FROM one WHERE p > q
            QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {int(top)}""").to_arrow_table()
        yield from rows.to_batches(max_chunksize=50_000)
        con.execute("CREATE TABLE numbered AS SELECT lang, source, (row_number() OVER (ORDER BY lang, source) - 1) // ? AS block FROM (SELECT DISTINCT lang, source FROM one)", [SOURCES])
        for block in range(con.execute("SELECT coalesce(max(block), -1) + 1 FROM numbered").fetchall()[0][0]):
            rows = con.execute(f"""
                SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum({f('a.p', 'b.p')} - {f('a.p', 'b.p0')} - {f('a.p0', 'b.p')} + {f('a.p0', 'b.p0')})::BIGINT AS value
                FROM one a JOIN numbered n ON n.block = {block} AND n.lang = a.lang AND n.source = a.source
                JOIN one b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL""").to_arrow_table()
            yield from rows.to_batches(max_chunksize=50_000)
    con.close()


def _f(x: str, y: str) -> str:
    return f"(({x} - {y}) * ({x} - {y})) div {y}"


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from each other one of its language, and by which terms it stands out.

    Part `pair`: item is another source of the language, value its divergence, all ranks.
    Part `term`: item is a kept term that the source has more often than its language,
    ranks up to `top`.  Ranks go by value, descending, then by item.  A language keeps the
    terms that `min_docs` of its documents have; where it keeps none, values are 0.  A
    null text, language or source is an empty one; repeated rows count each.  Other
    columns are ignored, an empty table gives no rows.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    # summed by source first, so a common term brings a shard one row a source
    counts = written(rows.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept_schema = "lang string, source string, term string, n long, lang_n long, term_first long"
    kept = written(counts.where("term <> ''").repartition("lang", "term").mapInArrow(lambda x: _kept(x, min_docs), kept_schema))

    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.sum("term_first").alias("firsts"))
    groups = counts.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").na.fill(0, ["n_group", "firsts"])
    langs = groups.groupBy("lang").agg(F.sum("n_group").alias("n_lang"), F.sum("firsts").alias("v"))
    sized = groups.join(langs, "lang").select("lang", "source", "n_group", "n_lang", "v", F.expr(f"1 + {SCALE} div greatest(n_group + v, 1L)").alias("p0"))
    groups = written(sized)

    with_totals = kept.select("lang", "source", "term", "n", "lang_n").join(groups.select("lang", "source", "n_group", "n_lang", "v"), ["lang", "source"])
    partial = written(with_totals.repartition("lang", "term").mapInArrow(lambda x: _partial(x, top), "lang string, source string, part string, item string, value long"))

    # sums over the terms of one of the two: by how many of its terms have which count
    tallies = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(groups.select("lang", "source", "n_group", "v"), ["lang", "source"])
    tallies = tallies.select("lang", "source", "terms", F.expr(f"1 + CAST({SCALE} AS DECIMAL(20, 0)) * (n + 1) div (n_group + v)").alias("p"))
    side = lambda x, name: groups.select("lang", F.col("source").alias(name), F.col("p0").alias(x), "v")
    pairs = written(side("x0", "source").join(side("y0", "item").drop("v"), "lang").where("source <> item"))
    of_a = pairs.join(tallies, ["lang", "source"]).select("lang", "source", "item", F.expr(f"terms * ({_f('p', 'y0')} - {_f('x0', 'y0')})").alias("value"))
    of_b = pairs.join(tallies.withColumnRenamed("source", "item"), ["lang", "item"]).select("lang", "source", "item", F.expr(f"terms * ({_f('x0', 'p')} - {_f('x0', 'y0')})").alias("value"))
    of_none = pairs.select("lang", "source", "item", F.expr(f"v * ({_f('x0', 'y0')})").alias("value"))
    of_both = partial.where("part = 'pair'").select("lang", "source", "item", "value")
    sums = of_none.unionByName(of_a).unionByName(of_b).unionByName(of_both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = partial.where("part = 'term'").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    ranked = sums.withColumn("rank", F.row_number().over(by)).withColumn("part", F.lit("pair"))
    return ranked.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


#: DuckDB SQL of `audit(documents)`: every kept term for every pair of sources.
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
terms AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY ALL HAVING count(DISTINCT i) >= {MIN_DOCS}),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(c.n, 0) AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
v AS (SELECT lang, count(*) AS v, sum(n) AS n_lang FROM kept GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS n_group FROM dense GROUP BY ALL),
p AS (
  SELECT lang, source, term, n, (1 + {SCALE}::HUGEINT * (n + 1) // (n_group + v))::BIGINT AS p, (1 + {SCALE}::HUGEINT * (lang_n + 1) // (n_lang + v))::BIGINT AS q
  FROM dense JOIN v USING (lang) JOIN totals USING (lang, source)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
joint AS (
  SELECT * FROM pairs UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM joint QUALIFY part = 'pair' OR rank <= {TOP}
"""
