"""Refreshed timelines: plain cases of what is read, proposed, selected, reported and carried over."""

from pyspark.sql import functions as F

from threadloom.operators import refresh


def test_days_of_labels(spark):
    rows = spark.createDataFrame([("1 Feb 2026",), ("12 March 2026",), (" 2026-03-04 ",), ("last week",), ("",), (None,)], "label string")
    assert [r[0] for r in rows.select(refresh.after_date(F.col("label"))).collect()] == ["2026/02/01", "2026/03/12", "2026/03/04", "", "", ""]


LISTED = "pass string, turn int, id string"


def test_a_message_is_read_once_by_the_first_pass(spark):
    listed = spark.createDataFrame([("q", 0, "a"), ("q", 0, "b"), ("t", 1, "b"), ("t", 1, "c"), ("t", 1, "c"), ("t", 1, None), ("t", 1, ""), ("u", 2, "a")], LISTED)
    known = spark.createDataFrame([("a",), (None,)], "id string")
    reading = refresh.to_read(listed, known)
    assert {tuple(r) for r in reading.collect()} == {("b", "q"), ("c", "t")}
    put = spark.createDataFrame([("b", "created"), ("c", "changed")], "id string, change string")
    got = {r["pass"]: (r["seen"], r["fetched"], r["created"], r["changed"]) for r in refresh.passes(listed, reading, put).collect()}
    assert got == {"q": (2, 1, 1, 0), "t": (5, 1, 0, 1), "u": (1, 0, 0, 0)}
    # a second time nothing is new
    again = refresh.to_read(listed, known.unionByName(put.select("id")))
    assert again.count() == 0
    assert refresh.passes(listed.limit(0), again, put).count() == 0


FOUND = "query string, turn int, rank int, root_id long, container string"
ROOT = "root_id long"


def test_a_new_chain_is_proposed_unless_accepted(spark):
    found = spark.createDataFrame([("x", 0, 2, 1, "A"), ("y", 1, 1, 1, "A"), ("x", 0, 1, 2, "B"), ("y", 1, 2, 3, "C"), ("y", 1, 3, 4, None)], FOUND)
    threads = spark.createDataFrame([("B",), ("B",), (None,)], "container string")
    accept = spark.createDataFrame([(3,), (3,), (9,), (None,)], ROOT)
    some = refresh.candidates(found, threads, accept)
    assert {(r["root_id"], r["query"], r["rank"], r["accepted"]) for r in some.collect()} == {(1, "x", 2, False), (3, "y", 2, True), (4, "y", 3, False)}
    assert sorted(r[0] for r in refresh.accepted(some, accept).collect()) == [3, 9]
    every = refresh.candidates(found, threads, accept, include_new=True)
    assert sorted(r[0] for r in refresh.accepted(every, accept.limit(0)).collect()) == [1, 3, 4]


def _entries(spark):
    rows = [(1, None, "mailA", "mail"), (2, None, "mailA", "mail"), (3, None, "chan", "slack"), (4, 3, "chan", "slack"), (5, None, "chan", "slack"), (6, None, "mailB", "mail"), (7, 6, "mailB", "mail")]
    return spark.createDataFrame(rows, "entry_id long, parent_id long, container string, source string").withColumn("ref", F.concat("source", F.lit(":"), F.col("entry_id").cast("string")))


def test_threads_grow_whole_and_channels_by_their_chains(spark):
    """A reply whose parent is not known comes with its mail thread; a channel brings only chains it showed."""
    e = _entries(spark)
    shown = spark.createDataFrame([("mailA", "mail:1"), ("chan", "slack:3"), ("chan", "unspooled from msg 4"), (None, "slack:5"), ("chan", None)], "container string, ref string")
    threads = spark.createDataFrame([("mailA",), ("chan",), ("gone",), ("",), (None,)], "container string")
    sources = spark.createDataFrame([("mailA", "mail"), ("chan", "slack"), ("mailB", "mail")], "container string, source string")
    whole, single = refresh.membership(threads, sources, shown)
    assert sorted(r[0] for r in whole.collect()) == ["gone", "mailA"]
    assert [r[0] for r in single.collect()] == ["slack:3"]
    none = spark.createDataFrame([], ROOT)
    ids = lambda roots: sorted(r["entry_id"] for r in refresh.selected(e, whole, single, roots).collect())
    assert ids(none) == [1, 2, 3, 4]
    assert ids(spark.createDataFrame([(6,), (77,)], ROOT)) == [1, 2, 3, 4, 6, 7]


def test_the_report_names_what_grew_and_what_left(spark):
    before = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "container string, count long")
    after = spark.createDataFrame([("a", 2), ("b", 2), ("d", 1)], "container string, count long")
    got = {r["container"]: (r["before"], r["after"], r["change"]) for r in refresh.report(before, after).collect()}
    assert got == {"a": (1, 2, "grown"), "b": (2, 2, "same"), "c": (3, None, "unranked"), "d": (None, 1, "added")}
    assert {r["change"] for r in refresh.report(before, before).collect()} == {"same"}


def test_heads_keep_what_is_not_asked_anew(spark):
    head = "timeline int, label string, runs array<string>, title string, people array<string>"
    before = spark.createDataFrame([(1, "1 Feb 2026", ["1 Jan 2026"], "Plan", ["a@x"]), (2, "1 Feb 2026", ["1 Feb 2026"], "", None), (3, None, None, "T", []), (4, "x", [], "left", [])], head)
    asked = spark.createDataFrame([(1, None, "", []), (2, "3 Mar 2026", "New", ["b@x"]), (3, "", None, None), (9, "y", "z", None)], "timeline int, label string, title string, people array<string>").withColumn("people", F.to_json("people"))
    before = before.withColumn("people", F.to_json("people"))
    asked = asked.withColumn("people", F.when(F.col("people") != "[]", F.col("people")))
    got = {r["timeline"]: tuple(r)[1:] for r in refresh.carried(before, asked, ["title", "people"], "2 Apr 2026").collect()}
    assert got == {1: ("2 Apr 2026", ["1 Jan 2026", "1 Feb 2026"], "Plan", '["a@x"]'), 2: ("3 Mar 2026", ["1 Feb 2026"], "New", '["b@x"]'), 3: ("2 Apr 2026", [], "T", "[]")}
