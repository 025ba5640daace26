"""Walks of paged mailboxes, by the source of Spark and over a listing, against one another and against plain cases."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom.sources import corpus, listing, paged

DAY = 86400
T0 = 1_700_000_000


def box_of(threads, broken=(), bare=False, log=None):
    """A mailbox of {container: [(id, ts), ...]} whose tokens are places; defined here so that workers get it by value."""

    class Box:
        def __init__(self):
            self.threads, self.broken, self.bare, self.log = threads, broken, bare, log

        def page(self, container, size, token):
            from threadloom.sources.paged import Expired

            if token in self.broken:
                raise Expired(token)
            rows, at = self.threads[container], int(token or 0)
            after = at + size
            more = after < len(rows)
            return rows[at:after], str(after) if more and not self.bare else None, more

        def read(self, name):
            if self.log:
                with open(self.log, "a") as f:
                    f.write(name + "\n")
            return {"thread": "t" + name, "message_id": f"<{name}@x>", "body": "text of " + name, "truncated": name.endswith("7")}

    return Box()


def listed(container, n, start=T0):
    return [(f"{container}{i}", start - i * DAY) for i in range(n)]


def read(spark, box, asked, **options):
    spark.dataSource.register(paged.paged(box))
    return spark.read.format("paged_mail").options(cursors=json.dumps(asked), **options).load()


def after(rows):
    return {r["container"]: (r["position"], r["frontier"], r["stop"], r["walked"]) for r in paged.cursors(rows).collect()}


def ids(rows):
    return sorted(r["id"] for r in paged.messages(rows).collect())


def test_every_page_is_walked(spark):
    rows = read(spark, box_of({"q": listed("q", 12), "none": []}), [{"container": "q"}, {"container": "none"}], size=4).cache()
    assert ids(rows) == sorted(f"q{i}" for i in range(12))
    assert rows.where("id IS NULL AND container = 'q'").count() == 3
    assert after(rows) == {"q": (None, T0, "exhausted", 0), "none": (None, None, "exhausted", 0)}
    assert paged.messages(rows).where("truncated").count() == 1
    one = paged.entries(paged.messages(rows)).where("ref = '<q3@x>'").first()
    assert (one["container"], one["parent_ref"], one["text"]) == ("tq3", None, "text of q3")


def test_a_bound_says_so_and_the_next_run_goes_on(spark):
    box = box_of({"q": listed("q", 10)})
    rows = read(spark, box, [{"container": "q", "frontier": None}], size=3, most=4)
    assert ids(rows) == ["q0", "q1", "q2", "q3"]
    assert after(rows) == {"q": ("4", None, "max", 4)}
    rows = read(spark, box, [{"container": "q", "position": "4", "walked": 4}], size=3)
    assert ids(rows) == [f"q{i}" for i in range(4, 10)]
    assert after(rows) == {"q": (None, T0 - 4 * DAY, "exhausted", 0)}


def test_a_bound_met_at_the_end_is_exhausted(spark):
    assert after(read(spark, box_of({"q": listed("q", 4)}), [{"container": "q"}], size=4, most=4))["q"][2] == "exhausted"


def test_a_top_up_stops_two_days_below_the_frontier(spark):
    rows = read(spark, box_of({"q": listed("q", 30)}), [{"container": "q", "frontier": T0 - 3 * DAY}], size=4)
    assert ids(rows) == [f"q{i}" for i in range(5)]
    assert after(rows) == {"q": (None, T0, "frontier", 0)}


def test_unread_dates_never_stop_a_walk(spark):
    rows = read(spark, box_of({"q": [("a", T0), ("b", None), ("c", T0 - 30 * DAY)]}), [{"container": "q", "frontier": T0}])
    assert ids(rows) == ["a", "b"]


def test_an_expired_token_begins_again_once(spark):
    box = box_of({"q": listed("q", 6)}, broken=("old",))
    assert ids(read(spark, box, [{"container": "q", "position": "old"}], size=4)) == [f"q{i}" for i in range(6)]
    with pytest.raises(Exception, match="Expired"):
        ids(read(spark, box_of({"q": listed("q", 6)}, broken=("4",)), [{"container": "q"}], size=4))


def test_an_empty_page_is_not_the_end():
    class Gap:
        def page(self, container, size, token):
            return {None: ([], "a", True), "a": ([("m", T0)], None, False)}[token]

    state = paged.step(Gap(), "q", paged.begun(), 5, 0, True)
    assert (state["stop"], state["token"], state["ids"]) == ("", "a", "")
    assert paged.step(Gap(), "q", state, 5, 0, False)["stop"] == "exhausted"


def test_more_without_a_token_is_an_error(spark):
    with pytest.raises(Exception, match="without a page token"):
        ids(read(spark, box_of({"q": listed("q", 6)}, bare=True), [{"container": "q"}], size=4))


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Each trigger takes a page of each container; a restart goes on from the log and reads no message twice."""
    log = str(tmp_path / "log")
    threads = {"a": listed("a", 7), "b": listed("b", 2)}

    def run(batches):
        spark.dataSource.register(paged.paged(box_of(threads, log=log)))
        stream = spark.readStream.format("paged_mail").options(cursors=json.dumps([{"container": "a"}, {"container": "b"}]), size="3").load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).start()
        try:
            for _ in range(200):
                q.awaitTermination(0.2)
                assert q.exception() is None
                p = q.lastProgress
                if p and p["batchId"] >= batches:
                    break
            else:
                raise AssertionError("the stream took no batch")
        finally:
            q.stop()

    run(0)
    run(2)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert ids(rows) == sorted([f"a{i}" for i in range(7)] + ["b0", "b1"])
    # a batch that was cut short may read again, what is written is whole and once
    assert {*open(log).read().split()} == {*ids(rows)}
    assert after(rows) == {"a": (None, T0, "exhausted", 0), "b": (None, T0, "exhausted", 0)}

    threads["b"].insert(0, ("new", T0 + DAY))
    run(3)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert "new" in ids(rows) and ids(rows).count("a0") == 1


CURSORS = "source string, container string, position string, frontier bigint, complete boolean, walked bigint"


@pytest.mark.parametrize("most", [None, 5])
def test_a_listing_is_walked_as_the_source_walks_it(spark, most):
    threads = {c: [(f"{c}{i}", None if i % 4 == 3 else T0 - i * DAY // 2 * (1 + j)) for i in range(n)] for j, (c, n) in enumerate({"a": 0, "b": 1, "c": 5, "d": 11, "e": 12, "f": 30}.items())}
    asked = [("mail", c, p, f, p is None and f is not None, 2) for c, p, f in [("a", "4", None), ("b", None, None), ("c", None, T0 - DAY), ("d", "3", T0), ("e", "3", None), ("f", None, T0)]]
    held = spark.createDataFrame(asked, CURSORS)
    rows = spark.createDataFrame([("mail", c, i, name, at) for c, some in threads.items() for i, (name, at) in enumerate(some)], "source string, container string, place bigint, id string, ts bigint")
    found = listing.walks(rows, held, 3, most)
    live = read(spark, box_of(threads), [{"container": c, "position": p, "frontier": f, "walked": w} for _, c, p, f, _, w in asked], size=3, most=most or 0).cache()
    assert sorted(r["id"] for r in listing.reads(rows, found).collect()) == ids(live)
    pages = {r["container"]: r["n"] for r in live.where("id IS NULL").groupBy("container").agg(F.count("*").alias("n")).collect()}
    stops = after(live)
    # a place behind the end of the empty container is an empty page there, and a new start here
    assert {r["container"]: (r["stop"], r["pages"]) for r in found.collect()} == {c: (stops[c][2], n) for c, n in pages.items()}
    got = {r["container"]: r for r in listing.cursors_after(held, rows, found).collect()}
    for _, c, _, f, _, _ in asked:
        position, frontier, stop, walked = stops[c]
        want = f if frontier is None else max(frontier, f or frontier)
        assert (got[c]["position"], got[c]["frontier"], got[c]["complete"], got[c]["walked"]) == (position, want, stop != "max", walked)


def test_listings_of_odd_rows(spark):
    """No listing, no cursors, cursors that cannot be read, and walks that run twice."""
    none = spark.createDataFrame([], "source string, container string, place bigint, id string, ts bigint")
    held = spark.createDataFrame([("mail", "q", "x", None, False, None)], CURSORS)
    assert [(r["start"], r["end"], r["stop"], r["resumed"]) for r in listing.walks(none, held).collect()] == [(0, 0, "exhausted", False)]
    assert listing.walks(none, held.limit(0)).count() == 0
    rows = spark.createDataFrame([("mail", "q", i, f"m{i}", T0 - i) for i in range(9)], none.schema)
    once = listing.cursors_after(held, rows, listing.walks(rows, held, 2, 4))
    twice = listing.cursors_after(once, rows, listing.walks(rows, once, 2, 4))
    assert [(r["position"], r["walked"]) for r in twice.collect()] == [("8", 8)]
    assert corpus.save_progress(once, once.limit(0).select("source", "container", "position", "walked")).first()["position"] == "4"
