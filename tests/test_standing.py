"""Cursors of a stream of walks: pages, repeats, frontiers, restarts and walks that stand still."""

import random

import pytest

from threadloom.streaming import standing

ROWS = "container string, id string, position string, frontier bigint, stop string, walked bigint, page bigint"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    yield spark
    spark.conf.set(name, old) if old else spark.conf.unset(name)


def run(spark, at, batches, patience=3_600_000, until=lambda got: True):
    """The rows given for each file of pages, each read by a run of its own that goes on from the log of the one before.

    A stream with timers of the clock goes on in empty batches, so a run is stopped when
    all rows are read and `until` holds.
    """
    out = []
    for rows in batches:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{at}/in")
        got = []
        stream = spark.readStream.schema(ROWS).parquet(f"{at}/in")
        q = standing.standing(stream, patience).writeStream.outputMode("update").option("checkpointLocation", f"{at}/log").trigger(processingTime="500 milliseconds").foreachBatch(lambda df, _, got=got: got.extend(tuple(r) for r in df.collect())).start()
        try:
            for _ in range(120):
                q.awaitTermination(0.5)
                if any(p["numInputRows"] for p in q.recentProgress) and until(got):
                    break
        finally:
            q.stop()
        assert q.exception() is None
        out.append(sorted(got, key=lambda r: (r[0], r[5])))
    return out


def page(c, n, position=None, frontier=None, stop=None, walked=0):
    return (c, None, position, frontier, stop, walked, n)


def test_cursors_move_with_pages(rocks, tmp_path):
    got = run(rocks, tmp_path, [
        [page("a", 2, "8", walked=8), page("a", 1, "4", walked=4), page("b", 1, None, 50, "exhausted"), ("a", "m1", None, None, None, None, None), page(None, 1)],
        [page("a", 2, "8", walked=8), page("a", 3, None, 90, "frontier"), page("b", 2, None, 40, "exhausted"), page("c", 1, "5", None, "max", 5)],
        [page("b", 3, "x", walked=1)],
    ])
    assert got[0] == [("a", "8", None, False, 8, 2, False), ("b", None, 50, True, 0, 1, False)]
    # a page that comes again is no news, and a frontier never goes back
    assert got[1] == [("a", None, 90, True, 0, 3, False), ("b", None, 50, True, 0, 2, False), ("c", "5", None, False, 5, 1, False)]
    assert got[2] == [("b", "x", 50, False, 1, 3, False)]


def test_a_walk_that_stands_still_is_told_once(rocks, tmp_path):
    rows = [page("a", 1, "4", walked=4), page("b", 1, None, 9, "exhausted")]
    got = run(rocks, tmp_path, [rows, [page("c", 1, None, 9, "exhausted")]], patience=1, until=lambda got: any(r[6] or r[0] == "c" for r in got))
    told = [r for some in got for r in some if r[6]]
    assert told == [("a", "4", None, False, 4, 1, True)]
    assert [r for some in got for r in some if not r[6]] == [("a", "4", None, False, 4, 1, False), ("b", None, 9, True, 0, 1, False), ("c", None, 9, True, 0, 1, False)]


def test_pages_in_any_order_leave_the_same_cursor():
    """Pages fold in order to what a plain reading of the whole walk says."""
    dice = random.Random(3)
    for _ in range(200):
        pages = [(None, dice.choice([None, dice.randrange(9)]), dice.choice(["frontier", "exhausted"]), 0, i) if dice.random() < 0.4 else (str(i), None, dice.choice([None, "max"]), i, i) for i in range(1, dice.randrange(2, 9))]
        held = None
        for p in pages + [dice.choice(pages)]:
            held = standing.moved(held, *p) or held
        tops = [p[1] for p in pages if p[2] in ("frontier", "exhausted") and p[1] is not None]
        last = pages[-1]
        covered = last[2] in ("frontier", "exhausted")
        assert held == (last[0], max(tops, default=None), covered, 0 if covered else last[3], last[4])
