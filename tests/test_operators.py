"""Rules of single operators on rows written out here."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from threadloom.functions import clock, text, vector
from threadloom.operators import chains, evaluate, relate, search, similar
from threadloom.sources import ingest
from threadloom.streaming import intake


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "got, want",
    [
        (lambda: text.clean_subject(F.lit("Re: FWD: re : Plan")), "Plan"),
        (lambda: text.clean_subject(F.lit(None).cast("string")), ""),
        (lambda: text.normalise_identity(F.lit("email"), F.lit(" <Ann@Example.ORG> ")), "ann@example.org"),
        (lambda: text.normalise_identity(F.lit("uid"), F.lit("<@u12>")), "U12"),
        (lambda: text.normalise_identity(F.lit("name"), F.lit("  ")), None),
        (lambda: text.base_address(F.lit("ann+news@example.org")), "ann@example.org"),
        (lambda: text.base_address(F.lit("+x@example.org")), "+x@example.org"),
        (lambda: text.short_urls(F.lit("see https://example.org/a/b?c now")), "see example.org now"),
        (lambda: text.human_size(F.lit(1536)), "1.5 KB"),
        (lambda: text.human_size(F.lit(0)), "0 B"),
        (lambda: clock.format_offset(F.lit(-330)), "-0530"),
        (lambda: clock.offset_minutes(F.lit("+05:30")), 330),
        (lambda: clock.offset_minutes(F.lit("+19:00")), None),
        (lambda: clock.nearest_offset(F.lit(-52.5)), -60),
        (lambda: clock.zone_offset(F.lit("2024-01-15 00:00:00").cast("timestamp"), F.lit("Australia/Sydney")), 660),
        (lambda: clock.zone_offset(F.lit("2024-07-15 00:00:00").cast("timestamp"), F.lit("Australia/Sydney")), 600),
        (lambda: vector.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))), None),
    ],
)
def test_expressions(spark, got, want):
    assert one(spark, got()) == want


def test_roots_of_chain_cycle_and_orphan(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5)], "entry_id long, parent_id long")
    got = {r["entry_id"]: (r["root_id"], r["depth"]) for r in chains.roots(rows).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [(1, 0), (1, 1), (1, 2), (4, 0)]
    assert got[5][0] in (5, 6) and got[6][0] in (5, 6)


def test_bm25_needs_every_term(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a"), (3, None), (4, "c d e")], "entry_id long, text string")
    assert [r["entry_id"] for r in search.bm25(rows, ["a", "b"]).collect()] == [1]
    assert search.bm25(rows, []).count() == 0
    assert [r["entry_id"] for r in search.containing(rows, "C D").collect()] == [4]


def test_fusion_counts_ranks_only(spark):
    a = search.top(spark.createDataFrame([(1, 9.0), (2, 1.0)], "entry_id long, score double"), 5)
    b = search.top(spark.createDataFrame([(2, 0.5)], "entry_id long, score double"), 5)
    got = search.fuse([a, b], 5).collect()
    assert [r["entry_id"] for r in got] == [2, 1] and got[0]["score"] == pytest.approx(1 / 62 + 1 / 61)


def test_band_join_matches_brute_force(spark):
    rows = [(i % 3, i, (i * 37) % 101) for i in range(60)]
    got = {(r["a"], r["b"]) for r in relate.band_join(spark.createDataFrame(rows, "k long, e long, t long"), "k", "t", "e", 10).collect()}
    want = {(a, b) for ka, a, ta in rows for kb, b, tb in rows if ka == kb and 0 <= tb - ta <= 10 and (ta < tb or a < b)}
    assert got == want


def test_similarity_of_multisets(spark):
    texts = spark.createDataFrame([(1, "a a b"), (2, "A b b"), (3, ""), (4, None)], "entry_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (3, 4), (1, 3)], "a long, b long")
    got = {(r["a"], r["b"]): (r["overlap"], r["similarity"]) for r in similar.similarity(pairs, texts).collect()}
    assert got == {(1, 2): (2, pytest.approx(2 / 3)), (3, 4): (0, 0.0), (1, 3): (0, 0.0)}


def test_endings_leave_blank_lines_out(spark):
    rows = [(i, "ann", "d", f"text {i}\nRegards\n" + "\n" * i + "Ann\n \n") for i in range(4)]
    got = similar.endings(spark.createDataFrame(rows, "id long, author string, domain string, text string"), "id", "author", "domain", "text").collect()
    assert {(r["entry_id"], r["lines"], r["count"]) for r in got} == {(i, 2, 4) for i in range(4)}


def test_nearest_rank_over_ranges(spark):
    rows = [("a", float(i * 7 % 101)) for i in range(101)] + [("b", 1.0)] * 9 + [("b", 2.0), (None, 3.0), ("c", None)]
    got = {(r["k"], r["share"]): r["value"] for r in relate.nearest_rank(spark.createDataFrame(rows, "k string, v double"), "k", "v", [0.0, 0.5, 0.9, 1.0]).collect()}
    assert [got["a", s] for s in (0.0, 0.5, 0.9, 1.0)] == [0.0, 50.0, 90.0, 100.0]
    assert [got["b", s] for s in (0.5, 0.9, 1.0)] == [1.0, 1.0, 2.0] and got[None, 0.5] == 3.0 and ("c", 0.5) not in got


def test_postings_give_the_scores_of_the_scan(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"alpha beta w{i % 7} " + "alpha " * (i % 3)) for i in range(60)] + [(90, None), (91, "")], "entry_id long, text string")
    search.write_postings(texts, str(tmp_path / "index"), buckets=4)
    for terms in (["alpha", "w3"], ["beta"], ["nowhere"], []):
        want = {r["entry_id"]: r["score"] for r in search.bm25(texts, terms).collect()}
        got = {r["entry_id"]: r["score"] for r in search.bm25_postings(spark, str(tmp_path / "index"), terms).collect()}
        assert got == pytest.approx(want)


def test_metrics_of_scores_match_ranks(spark):
    rng = random.Random(5)
    rows = [(q, e, round(rng.random(), 1), rng.random() < 0.2) for q in range(6) for e in range(80)]
    scored = spark.createDataFrame(rows, "query long, entry_id long, s double, relevant boolean")
    got = {r["query"]: (r["recall"], r["ndcg"], r["rr"]) for r in evaluate.metrics_of_scores(scored, 10).collect()}
    for q in range(6):
        ranked = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        hits = [i for i, r in enumerate(ranked, 1) if r[3]]
        dcg, ideal = sum(1 / math.log2(i + 1) for i in hits if i <= 10), sum(1 / math.log2(i + 1) for i in range(1, min(len(hits), 10) + 1))
        assert got[q] == pytest.approx((sum(i <= 10 for i in hits) / len(hits), dcg / ideal, 1 / hits[0]))


def test_endings_scope(spark):
    rows = [(i, "ann" if i < 3 else "bob", "d", f"text {i}\nRegards\n{'Ann' if i < 3 else 'Bob'}\nNotice\nlegal") for i in range(5)] + [(9, "eve", "d", "Notice\nlegal")]
    got = {r["entry_id"]: (r["lines"], r["scope"], r["count"]) for r in similar.endings(spark.createDataFrame(rows, "id long, author string, domain string, text string"), "id", "author", "domain", "text").collect()}
    assert got[0] == (4, "author", 3) and got[3] == (2, "domain", 5) and 9 not in got


def test_zone_fit(spark):
    at = lambda m: dt.datetime(2024, m, 15)
    rows = [("syd", at(1), 660), ("syd", at(7), 600), ("utc", at(1), 0), ("moved", at(1), 660), ("moved", at(7), -300), ("none", at(1), None)]
    got = {r["person"]: (r["verdict"], r["zones"]) for r in evaluate.fit_zones(spark.createDataFrame(rows, "person string, ts timestamp, offset int"), ["Australia/Sydney", "Europe/Berlin", "America/Chicago"]).collect()}
    assert got == {"syd": ("placed", ["Australia/Sydney"]), "utc": ("utc", []), "moved": ("moved", [])}


def test_ingest(spark):
    chunks = spark.createDataFrame([("u", 1, "old"), ("u", 3, "new"), ("v", 2, "x")], "ID string, CHUNK_ID long, name string")
    assert {(r["ID"], r["name"]) for r in ingest.latest_chunk(chunks, ["ID"]).collect()} == {("u", "new"), ("v", "x")}
    have, more = (spark.createDataFrame(x, "id long, sha string") for x in ([(1, "a"), (2, "b"), (4, "d")], [(1, "a"), (2, "c"), (3, "z")]))
    assert {(r["id"], r["change"]) for r in ingest.upsert(have, more, ["id"], "sha").collect()} == {(1, "same"), (2, "changed"), (3, "created"), (4, "kept")}
    assert {(r["id"], r["sha"]) for r in ingest.insert_absent(have, more, ["id"]).collect()} == {(1, "a"), (2, "b"), (3, "z"), (4, "d")}
    good = spark.createDataFrame([('{"ok":true,"data":[{"id":"m1"}]}',)], "value string")
    assert [r["id"] for r in ingest.unwrap(good, "value", "struct<id: string>").collect()] == ["m1"]
    with pytest.raises(Exception, match="source refused"):
        ingest.unwrap(spark.createDataFrame([('{"ok":false,"error":{"code":"gone"}}',)], "value string"), "value", "struct<id: string>").collect()


def test_stream_drops_repeats(spark, tmp_path):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, h)) for h in (0, 1, 1)] + [(2, dt.datetime(2024, 1, 1, 3))], "id long, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = intake.intake(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["id"])
    run = stream.writeStream.format("memory").queryName("taken").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r["id"] for r in spark.table("taken").collect()) == [1, 2]
    assert intake.sessions(rows, "id").count() == 3
