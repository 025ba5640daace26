"""Rules of addresses, vectors, search results and of keeping a corpus whole, on rows written out here."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import address, clock, text
from threadloom.operators import align, chrono, embed, evaluate, identity, retrieve
from threadloom.sources import corpus


def each(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", column(F.col("v")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def test_addresses(spark):
    assert each(spark, ["sales-team", "noreply+1", "HR", "l.mccorley", "hrm", "+admin", None], address.is_role) == [True, True, True, False, False, False, None]
    assert each(spark, ["alerts.eu", "manager"], address.is_unattended) == [True, False]
    got = each(spark, ["a+b@x.org", "+b@x.org", "a@x.org", "z+caf_=e=x.com@y.org", "z+bob=x.com@y.org", "a+b+c@x.org", "a@b+c.org"], address.mailbox)
    assert [tuple(g) if g else None for g in got] == [("a@x.org", "b"), None, None, None, None, ("a@x.org", "b+c"), None]
    assert each(spark, [' "Ann Ray" ', "Ann Ray <", "'Ann' <", None], address.clean_name) == ["Ann Ray", "Ann Ray", "Ann", ""]
    assert each(spark, ["Ann O'Neil (Support)", "K | Arvida", "J. Smith-Lee"], address.name_words) == [["ann", "oneil"], [], ["smith", "lee"]]
    assert each(spark, ["x@mail.acme.co.nz", "x@gmail.com", "x@acme.example", "x@local", "x", "x@co.nz"], address.organisation) == ["Acme", None, "Acme", None, None, "Co"]
    assert each(spark, ["a@x.org"], lambda v: address.organisation(v, {"x.org": "Xylem"})) == ["Xylem"]
    got = each(spark, ["Ann Ray <ann@x.org", "Ann Ray", "<ann@x.org>", "Ann <a@x.org>"], address.welded)
    assert [tuple(g) if g else None for g in got] == [("Ann Ray", "ann@x.org"), None, None, ("Ann", "a@x.org")]
    assert each(spark, ["Bob Ray (Sales)", "Bob J Ray", "bob van ray", "B", "", None], lambda v: address.contradiction(F.lit("Bob Ray"), v)) == [None, None, "different surnames: ray, van ray", None, None, None]
    assert [r and tuple(r) for r in each(spark, ["Ann van Ray | X", "Ann", "a@b", "(x)"], address.name_parts)] == [("ann", "van ray"), ("ann", None), None, None]
    assert each(spark, ["Ann Ray", "Jo Ray", "Ann Lee", "Ann", "a@x"], lambda v: address.contradiction(F.lit("Ann Ray"), v)) == [None, "different first names: ann, jo", "different surnames: lee, ray", None, None]
    agrees = lambda v: address.address_names(F.substring_index(v, "/", 1), F.substring_index(v, "/", -1))
    assert each(spark, ["aking/Ann King", "tdempst/Tom Dempster", "ann.x/Ann King", "ellen/Bo Vantel", "ak/Ann King", "/Ann"], agrees) == [True, True, True, False, False, False]
    assert each(spark, ["Ann van Ray", "  "], address.initials) == ["AVR", ""]


def test_prepared_texts(spark):
    body = "See https://a.example.org/x/y?z=1 for the whole plan\n\n\n\nthanks\nOn 1 May 2024 08:00, P <p@p.org> wrote:\n> quoted words here"
    rows = [("mail", "Re: AW[2]: Plan", body), ("chat", None, "two words"), ("mail", "", "On 1 May 2024 08:00, P <p@p.org> wrote:\n> a b c d e f"), ("chat", "", None), ("chat", "s", "word " * 2000)]
    got = [r["p"] for r in spark.createDataFrame(rows, "source string, subject string, body string").select(embed.prepared(F.col("source"), F.col("subject"), F.col("body")).alias("p")).collect()]
    assert tuple(got[0]) == ("Plan\n\nSee a.example.org for the whole plan\n\nthanks", None)
    assert [tuple(g) for g in got[1:4]] == [("", "too short"), ("", "no text"), ("", "no text")]
    assert len(got[4]["text"]) <= embed.MOST_CHARS and got[4]["text"].endswith("word")


def test_vectors_are_filled_once(spark):
    texts = spark.createDataFrame([(1, "alpha beta", None, "s1"), (2, "beta gamma", None, "s2"), (3, "", "no text", "s3")], "entry_id long, text string, reason string, body_sha string")
    model = embed.HashEmbedder(dim=16)
    stored = embed.backfill(texts.where("entry_id <> 2"), model)
    todo = embed.pending(texts, stored, "hash", 16)
    assert [r["entry_id"] for r in todo.collect()] == [2] and embed.pending(texts, stored, "hash", 8).count() == 3
    every = embed.merge(stored, embed.backfill(todo, model))
    (c,) = embed.coverage(every, texts.withColumn("body_sha", F.when(F.col("entry_id") == 1, "new").otherwise(F.col("body_sha")))).collect()
    assert (c["model"], c["dim"], c["vectors"], c["skipped"], c["stale"]) == ("hash", 16, 2, 1, 1)
    asked = model.embed(["alpha beta"])[0]
    got = embed.nearest(every, [float(x) for x in asked], "hash", k=5).collect()
    assert [r["entry_id"] for r in got] == [1, 2] and got[0]["similarity"] == pytest.approx(1, abs=1e-6)
    assert embed.nearest(every, [float(x) for x in asked], "hash", least=0.99).count() == 1
    assert embed.nearest(every, [0.5] * 8, "hash").count() == 0 and embed.prune(every, "other").count() == 0
    with pytest.raises(ValueError):
        model.embed([" "])
    h = 0x811C9DC5
    for b in b"alpha":
        h = (h ^ b) * 0x01000193 % 2**32
    assert np.flatnonzero(embed.HashEmbedder(dim=8).embed(["Alpha"])[0]).tolist() == [h % 8]


def test_parents_late_and_ambiguous(spark):
    rows = [(1, "mail", "c", "<a>", None, None), (2, "mail", "d", "<b>", "<a>", None), (3, "mail", "d", "<a>", "<a>", None), (4, "chat", "c", "7", "5", None), (5, "chat", "x", "5", None, None), (6, "chat", "c", "5", "5", None), (7, "mail", "d", "<z>", "<late>", None), (8, "mail", "d", "<y>", "<a>", 99)]
    df = spark.createDataFrame(rows, "entry_id long, source string, container string, ref string, parent_ref string, parent_id long")
    got = lambda d: {r["entry_id"]: r["parent_id"] for r in corpus.resolve_parents(d).collect()}
    assert got(df) == {1: None, 2: 1, 3: 1, 4: 6, 5: None, 6: None, 7: None, 8: 99}
    late = df.unionByName(spark.createDataFrame([(9, "mail", "q", "<late>", None, None)], df.schema))
    assert got(late)[7] == 9
    edges = spark.createDataFrame([(1, 1), (5, 4), (5, 6), (8, 1)], "entry_id long, to long")
    assert {r["entry_id"]: r["parent_id"] for r in corpus.set_parents(df, edges).collect()} == {1: None, 2: None, 3: None, 4: None, 5: 4, 6: None, 7: None, 8: 99}


def test_parents_of_a_stream_come_late(spark, tmp_path):
    """Micro-batches of chat rows: what the second brings is found for what the first left open."""
    schema = "entry_id long, source string, container string, ref string, parent_ref string, parent_id long"
    where, state = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([(2, "chat", "c", "20", "10", None)], schema).coalesce(1).write.json(where)
    spark.createDataFrame([(1, "chat", "c", "10", None, None)], schema).coalesce(1).write.mode("append").json(where)
    rounds = []

    def take(batch, n):
        held = spark.read.parquet(f"{state}/{rounds[-1]}") if rounds else batch.limit(0)
        new = held.join(batch.select("entry_id"), "entry_id", "left_anti").unionByName(batch)
        corpus.resolve_parents(new).write.parquet(f"{state}/{n}")
        rounds.append(n)

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(where)
    rows.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert len(rounds) == 2 and {(r["entry_id"], r["parent_id"]) for r in spark.read.parquet(f"{state}/{rounds[-1]}").collect()} == {(1, None), (2, 1)}


def test_chat_times_and_authors(spark):
    got = each(spark, ["1700000000.000123", "1700000000", "1700000000.5", "x", None], lambda v: F.unix_micros(corpus.chat_time(v)))
    assert got == [1700000000000123, 1700000000000000, 1700000000500000, None, None]
    rows = [("U1", "B1", "n"), (" ", "B1", "n"), (None, None, "n"), (None, "", None)]
    got = [r["a"] for r in spark.createDataFrame(rows, "u string, b string, n string").select(corpus.chat_author(F.col("u"), F.col("b"), F.col("n")).alias("a")).collect()]
    assert [tuple(g) if g else None for g in got] == [("uid", "U1"), ("uid", "B1"), ("name", "n"), None]


def test_gaps_and_cursors(spark):
    held = spark.createDataFrame([(1, True, "", "UTC", None, "short"), (2, False, "", "", None, ""), (3, True, "s", "", 5, "long enough")], "entry_id long, quoted boolean, subject string, tz string, person_id long, text string")
    said = spark.createDataFrame([(1, "new", "X", 7, "longer text"), (1, "old", "Y", 8, "l"), (2, "n", "n", 1, "n"), (3, "n", "+0100", 9, "tiny")], "entry_id long, subject string, tz string, person_id long, text string")
    assert {tuple(r) for r in corpus.enrich(held, said).collect()} == {(1, True, "new", "UTC", 7, "longer text"), (2, False, "", "", None, ""), (3, True, "s", "+0100", 5, "long enough")}
    at = lambda d: dt.datetime(2024, 1, d)
    cur = spark.createDataFrame([("m", "a", "p1", at(5), False, 3), ("m", "b", None, at(9), True, 1)], "source string, container string, position string, frontier timestamp, complete boolean, walked int")
    done = spark.createDataFrame([("m", "a", at(3), 9), ("m", "c", None, 1)], "source string, container string, frontier timestamp, walked int")
    got = {r["container"]: (r["position"], r["frontier"], r["complete"], r["walked"]) for r in corpus.save_complete(cur, done).collect()}
    assert got == {"a": (None, at(5), True, 9), "b": (None, at(9), True, 1), "c": (None, None, True, 1)}
    cut = spark.createDataFrame([("m", "b", "p7", 4)], "source string, container string, position string, walked int")
    assert {r["container"]: (r["position"], r["frontier"], r["complete"]) for r in corpus.save_progress(cur, cut).collect()}["b"] == ("p7", at(9), False)


def test_people_in_filters(spark):
    ids = spark.createDataFrame([("email", "ann@x.org", 1), ("uid", "U7", 2), ("name", "bob ray", 3)], "kind string, value string, person_id long")
    people = spark.createDataFrame([(1, "Ann"), (4, "Eva  Lee")], "person_id long, name string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    found = lambda *n: {r["person_id"] for r in retrieve.people_named(names(*n), ids, people).collect()}
    assert found("ANN@x.org") == {1} and found("u7", "Eva Lee") == {2, 4} and found("Bob Ray", "ann") == {1, 3} and found(" ", None) == set()
    entries = spark.createDataFrame([(10, 1, 5), (11, 2, 7), (12, None, 7)], "entry_id long, person_id long, ts long")
    by = lambda *a: {r["entry_id"] for r in retrieve.written_by(entries, *a).collect()}
    assert by(None, None) == {10, 11, 12} and by([2], None) == {11} and by(None, retrieve.people_named(names(" "), ids, people)) == set()
    part = spark.createDataFrame([(10, 1, "to"), (11, 1, "cc")], "entry_id long, person_id long, role string")
    one = spark.createDataFrame([(1,)], "person_id long")
    assert {r["entry_id"] for r in retrieve.involving(entries, part, one).collect()} == {10, 11} and {r["entry_id"] for r in retrieve.involving(entries, part, one, ["cc"]).collect()} == {11}
    files = part.where("role = 'cc'")
    assert [retrieve.attached(entries, files, x).count() for x in (None, True, False)] == [3, 1, 2]
    assert [r["entry_id"] for r in retrieve.recent(entries, 2).collect()] == [12, 11]


def test_expansion_gates(spark):
    rows = [("a", 9.0, 5, 10), ("b", 8.0, 1, 3), ("c", 7.0, 3, 8), ("d", 6.0, 2, 40), ("e", 5.0, 4, 4), ("f", 4.0, 2, 2)]
    df = spark.createDataFrame(rows, "root_id string, score double, matched long, entries long")
    got = {r["root_id"]: r["refused"] for r in retrieve.expansion(df, top=3, ratio=0.1, cap=15).collect()}
    assert got["a"] is None and got["c"] is None and got["b"] == "1 matched of 2 asked for" and got["d"] == "0.05 of it matched, 0.10 asked for" and got["e"] == "18 entries are shown already" or got["e"] == "15 entries are shown already"
    assert got["f"] == "3 chains are shown already"
    assert {r["root_id"] for r in retrieve.expansion(df, top=9, cap=0).where("refused IS NULL").collect()} == {"a", "c", "d", "e", "f"}


def test_labels_and_reasons(spark):
    c = spark.createDataFrame([("C1",), ("@U1",), ("@U9",), ("mail",)], "container string")
    got = retrieve.labels(c, spark.createDataFrame([("C1", "general")], "channel string, name string"), spark.createDataFrame([("U1", "Ann")], "uid string, name string"))
    assert {tuple(r) for r in got.collect()} == {("C1", "#general"), ("@U1", "Ann"), ("@U9", "@U9"), ("mail", "mail")}
    row = spark.range(1).select(retrieve.why(F.lit(2), F.lit(None).cast("int"), F.lit(4), F.lit(0.711)).alias("w"), retrieve.subject_of(F.lit(" "), F.lit(None).cast("string"), F.lit("#g")).alias("s")).first()
    assert tuple(row) == ("[prose 2, similar 4 @ 0.71]", "#g")


def test_blocks_by_date(spark):
    at = lambda *a: dt.datetime(2024, 3, *a)
    rows = [(1, 0, at(10, 9), 0), (1, 1, at(11, 9), 0), (1, 2, None, None), (1, 3, at(9, 12), None), (2, 0, at(5, 12), None), (2, 1, at(6, 13), None), (2, 2, at(6, 15), None), (3, 0, at(5, 0), 60), (3, 1, at(5, 20), 60)]
    df = spark.createDataFrame(rows, "entry_id long, block int, sent timestamp, offset int")
    got = {(r["entry_id"], r["block"]): (r["nested"], r["dated"]) for r in chrono.order(df).collect()}
    assert [got[1, i] for i in range(4)] == [(1, 2), (2, 1), (None, None), (3, 3)]
    assert {tuple(r) for r in chrono.moved(chrono.order(df)).collect()} == {(1, 3, 2), (2, 3, 3 - 1), (3, 2, 2)}
    # 2: 25 hours can be zones, 27 cannot; 3: midnight takes the day
    assert {tuple(r) for r in chrono.impossible(df).collect()} == {(1, 1, 0, 24 * 3600), (2, 2, 0, 3600)}
    minutes = each(spark, ["AEST", "edt", "+05:30", "-0800", "z", "XYZ", "+1500"], clock.offset_minutes)
    assert minutes == [600, -240, 330, -480, 0, None, None]


def test_people_who_share_everything(spark):
    part = spark.createDataFrame([(1, 1), (2, 1), (1, 2), (2, 2), (1, 3), (3, 3), (4, 4), (4, 5)], "entry_id long, person_id long")
    entries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "entry_id long, container string")
    asked = spark.createDataFrame([(1, 2), (1, 3), (4, 5), (9, 1)], "person_id long, other long")
    of = lambda by: {tuple(r) for r in identity.shares_every(asked, part, entries, by).collect()}
    assert of("entry_id") == {(1, 2), (4, 5)} and of("container") == {(1, 2), (1, 3)}
    assert {tuple(r) for r in identity.weights(part).collect()} == {(1, 2), (2, 2), (3, 2), (4, 1), (5, 1)}
    ids = spark.createDataFrame([("email", "a@old.x", 1), ("email", "a@new.x", 1), ("email", "b@y", 2), ("email", "b@z", 2), ("uid", "U", 3)], "kind string, value string, person_id long")
    assert {tuple(r) for r in identity.sole_domains(ids, spark.createDataFrame([("old.x", "new.x")], "old string, to string")).collect()} == {(1, "new.x")}


def test_evaluation_reports(spark):
    cases = spark.createDataFrame([("a", 1.0, 0.5, 1.0, False), ("b", 0.0, 0.0, 0.0, False), ("c", None, None, None, True), ("d", None, None, None, True)], "query string, recall double, ndcg double, rr double, expect_empty boolean")
    results = spark.createDataFrame([("a", 0.9), ("c", 0.4), ("c", 0.6)], "query string, similarity double")
    assert tuple(evaluate.report(cases, results).first()) == (2, 0.5, 0.25, 0.5, 2, 1, 2, 0.6)
    sims = spark.createDataFrame([(True, 0.9), (True, 0.5), (False, 0.6), (False, 0.3)], "hit boolean, similarity double")
    assert {tuple(r) for r in evaluate.floor_sweep(sims, [0.4, 0.6, 0.95]).collect()} == {(0.4, 0, 1), (0.6, 1, 1), (0.95, 2, 0)}
    (r,) = evaluate.compared(cases.where("query = 'b'"), cases.where("query = 'a'").withColumn("query", F.lit("b")), ["recall"]).collect()
    assert tuple(r) == ("b", 0.0, 1.0, 1.0)


def test_meetings_and_sources(spark):
    rows = [(None, None, "Accepted: lunch", ""), (None, None, "We accepted it", "<p>Notes: x</p>"), (False, "note", "", ""), (None, "note", None, None), (None, None, "plan", "Bob shared a recap for Monday")]
    got = [r["m"] for r in spark.createDataFrame(rows, "f boolean, k string, s string, b string").select(text.is_meeting(*map(F.col, "fksb")).alias("m")).collect()]
    assert got == [True, True, False, True, True]
    assert each(spark, ["mail:<a>", "slack:c:1", "mail: a", "quote:x", ""], text.is_ext_id) == [True, True, False, False, False]
    got = each(spark, ["unspooled from msg 12, mail:<a>", "slack:c:1", "from a friend"], text.provenance)
    assert [tuple(g) for g in got] == [("ids", ["12", "mail:<a>"]), ("ids", ["slack:c:1"]), ("prose", None)]


def test_divergences(spark):
    base = [f"w{i}" for i in range(30)]
    assert align.divergence(base, ["x", *base, "y", "z"]) == (True, 1, 0, 0, 2, 0)
    assert align.divergence(base, [*base[:10], *"abcdefg", *base[10:20], "h", *base[20:]]) == (True, 0, 8, 7, 0, 0)
    assert align.divergence(base, [*base[:10], "a", "b", *base[14:]]) == (True, 0, 0, 0, 0, 2)
    assert align.divergence(base, []) == (True, 0, 0, 0, 0, 0) and align.divergence(base, ["q"]) == (True, 0, 0, 0, 0, 0)
    assert align.divergence(["a"] * 2001, ["a"])[0] is False
    rng = random.Random(2)

    def longest(a, b):
        return 0 if not a or not b else longest(a[1:], b[1:]) + 1 if a[0] == b[0] else max(longest(a[1:], b), longest(a, b[1:]))

    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        at = align.align(a, b)
        assert len(at) == longest(a, b) and all(a[i] == b[j] for i, j in at) and (np.diff(at, axis=0) > 0).all()


def test_answers_inside_a_copy_are_told(spark):
    words = [f"word{i}" for i in range(60)]
    text = " ".join(words)
    inside = " ".join([*words[:20], "no we do not want that at all", *words[20:]])
    far = " ".join(f"v{i}" for i in range(2100))
    copies = spark.createDataFrame([(1, text, False), (2, inside, True), (3, text + " sent from my phone <http://x.org/a> photo.jpg", True), (4, far + " own", True), (5, far, False), (6, far, True)], "entry_id long, text string, quoted boolean")
    plan = spark.createDataFrame([(1, 1, "keep"), (2, 1, "drop"), (3, 1, "drop"), (4, 5, "drop"), (6, 5, "drop"), (5, 5, "keep")], "entry_id long, keep_id long, decision string")
    got = {r["entry_id"]: (r["inside"], r["longest"], r["reason"]) for r in align.annotated(plan, copies).collect()}
    assert got == {2: (8, 8, "answered inside"), 4: (0, 0, "too long to place")}
    assert each(spark, ["see https://a.b/c mailto:x@y.z [cid:1] <img> pic.PNG end"], lambda v: F.array_join(align.prose_words(v, F.lit(True)), " ")) == ["see end"]
