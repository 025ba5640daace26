"""Zones of unlabelled clocks against passes in order of ids."""

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np

from threadloom.operators import zones

SYDNEY, WANDERER, NOWHERE, ZULU = 1, 2, 3, 4


def at(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp())


OBSERVED = [(SYDNEY, at("2026-07-01T02:00:00"), 600, False), (SYDNEY, at("2026-01-15T02:00:00"), 660, True), (SYDNEY, at("2026-01-16T02:00:00"), 0, False), (WANDERER, at("2026-04-08T05:30:00"), 330, False), (WANDERER, at("2026-05-25T05:21:00"), 600, False), (ZULU, 5, 0, False)]


def placed_by(spark, rows=OBSERVED, names=zones.ZONES):
    return zones.places(spark.createDataFrame(rows, "person long, at long, offset int, measured boolean"), names)


def run(spark, nodes, placed):
    df = spark.createDataFrame([(*n, "x") for n in nodes], "id long, parent long, person long, wall long, offset int, state string").repartition(3)
    return {r["id"]: r for r in zones.resolve(df, placed).collect()}


def test_places(spark):
    got = {r["person"]: r for r in placed_by(spark).collect()}
    assert got[SYDNEY]["verdict"] == "placed" and got[SYDNEY]["zones"] == ["Australia/Sydney"]
    assert (got[SYDNEY]["stated"], got[SYDNEY]["measured"], got[SYDNEY]["bare"]) == (1, 1, 1)
    assert (got[WANDERER]["verdict"], got[WANDERER]["seen"], got[WANDERER]["zones"]) == ("moved", [330, 600], [])
    assert (got[ZULU]["verdict"], got[ZULU]["seen"]) == ("utc", [])
    one = placed_by(spark, [(9, at("2026-07-01T02:00:00"), 600, False)]).first()
    assert one["zones"] == ["Australia/Sydney", "Australia/Brisbane"]
    entries = spark.createDataFrame([(1, 5, 60), (1, 6, None), (None, 7, 60)], "person long, wall long, offset int")
    assert zones.observations(entries, entries.withColumnRenamed("wall", "at")).count() == 2


def test_states(spark):
    placed = placed_by(spark)
    mail = lambda i, up, who, t, off: (i, up, who, at(t), off)
    quoted = lambda i, up, who, t: (i, up, who, at(t), None)
    # the clock is of who quotes, not of the sender
    got = run(spark, [quoted(10, 0, NOWHERE, "2026-08-10T09:00:00"), mail(11, 10, SYDNEY, "2026-08-10T00:30:00", 600)], placed)
    assert (got[10]["state"], got[10]["offset"], got[11]["state"]) == ("inferred", 600, "stated")
    assert "+1000" in got[10]["evidence"] and "Australia/Sydney" in got[10]["evidence"]
    got = run(spark, [quoted(10, None, SYDNEY, "2026-08-10T09:00:00"), quoted(11, 10, NOWHERE, "2026-08-10T11:00:00")], placed)
    assert [got[i]["state"] for i in (10, 11)] == ["unknown", "unknown"] and got[10]["offset"] is None and got[11]["evidence"] == "quoted by nobody"
    # nothing separates a traveller's offsets, or the order does
    got = run(spark, [quoted(9, 0, NOWHERE, "2026-04-01T09:00:00"), quoted(10, 9, NOWHERE, "2026-04-15T09:00:00"), quoted(11, 10, WANDERER, "2026-04-30T09:00:00")], placed)
    assert (got[10]["state"], got[10]["left"], got[10]["offset"]) == ("ambiguous", 2, None) and "+0530, +1000" in got[10]["evidence"]
    got = run(spark, [mail(9, 0, SYDNEY, "2026-04-15T03:30:00", 600), quoted(10, 9, NOWHERE, "2026-04-15T14:00:00"), mail(11, 10, WANDERER, "2026-04-15T05:00:00", 330)], placed)
    assert (got[10]["state"], got[10]["offset"], got[10]["offered"]) == ("inferred", 600, 2)
    # an order that no candidate allows
    got = run(spark, [mail(9, 0, SYDNEY, "2026-08-13T00:00:00", 600), quoted(10, 9, NOWHERE, "2026-08-10T09:00:00"), mail(11, 10, SYDNEY, "2026-08-14T00:00:00", 600)], placed)
    assert (got[10]["state"], got[10]["offset"]) == ("rejected", None)
    # an hour between two unlabelled clocks is none, three days are
    for day, state in ((10, "inferred"), (13, "rejected")):
        got = run(spark, [quoted(9, 0, NOWHERE, f"2026-08-{day}T09:00:00"), quoted(10, 9, NOWHERE, "2026-08-10T08:00:00"), mail(11, 10, SYDNEY, "2026-08-14T00:00:00", 600)], placed)
        assert got[10]["state"] == state
    # a sentinel has no seconds
    got = run(spark, [mail(9, 0, SYDNEY, "2026-08-10T00:00:45", 600), quoted(10, 9, NOWHERE, "2026-08-10T10:00:00"), mail(11, 10, SYDNEY, "2026-08-10T01:00:00", 600)], placed)
    assert (got[10]["state"], got[10]["offset"]) == ("inferred", 600)
    # cycles of parents, a message that is its own, and a summer time that starts in the window
    got = run(spark, [quoted(1, 2, SYDNEY, "2026-08-10T09:00:00"), quoted(2, 1, SYDNEY, "2026-08-10T09:00:00"), quoted(3, 3, SYDNEY, "2026-08-10T09:00:00"), quoted(4, 0, 1, "2026-04-05T00:30:00"), quoted(5, 4, SYDNEY, "2026-04-06T00:00:00"), (6, None, None, None, None)], placed)
    assert got[4]["state"] == "ambiguous" and got[6]["state"] == "unknown" and got[3]["state"] == "inferred"


def in_order(nodes, of):
    """Passes over the messages by id, each seeing what is settled so far; of: person -> (zones, seen)."""
    by, kids = {n[0]: n for n in nodes}, {}
    for n in nodes:
        if n[1] in by:
            kids.setdefault(n[1], []).append(n[0])
    out = {n[0]: ("stated", n[4]) for n in nodes if n[4] is not None}
    offsets = lambda z, t: int((datetime.fromtimestamp(t, UTC).astimezone(ZoneInfo(z)).utcoffset() or timedelta()).total_seconds() // 60)

    def window(i):
        wall = by[i][3]
        if i in out:
            start = wall if out[i][0] == "stated" else wall - out[i][1] * 60
            return start, start + 59 * (out[i][0] == "inferred")
        return wall - 840 * 60, wall + 720 * 60 + 86400 * (wall % 86400 == 0)

    live = {}
    for i, _, _, _, stated in nodes:
        found = []
        for k in kids.get(i, []) if stated is None else []:
            names, seen = of.get(by[k][2], ([], []))
            for o in [offsets(z, t) for z in names for t in window(i)] or seen:
                if o not in found:
                    found.append(o)
        if found:
            live[i] = found
    offered, changed = {i: len(c) for i, c in live.items()}, True
    while changed:
        changed = False
        for i in sorted(live):
            lo = window(by[i][1])[0] if by[i][1] in by else -(1 << 60)
            hi = min((window(k)[1] for k in kids.get(i, [])), default=1 << 60)
            kept = [o for o in live[i] if by[i][3] - o * 60 + 59 >= lo and by[i][3] - o * 60 <= hi]
            changed |= len(kept) != len(live[i])
            live[i] = kept
            if len(kept) == 1:
                out[i] = ("inferred", kept[0])
                del live[i]
                changed = True
    for n in nodes:
        if n[0] not in out:
            out[n[0]] = ("ambiguous" if live.get(n[0]) else "rejected" if n[0] in live else "unknown", None)
    return {i: (*v, offered.get(i, 0)) for i, v in out.items()}


def test_same_as_passes_in_order(spark):
    r = np.random.default_rng(4)
    people = {1: (["Australia/Sydney"], []), 2: ([], [330, 600]), 3: ([], [-480, 0, 330, 600]), 4: (["Europe/London"], []), 5: ([], [-300, 60]), 6: ([], [])}
    rows = [(p, "placed" if z else "moved" if s else "utc", z, s, 1, 0, 0) for p, (z, s) in people.items()]
    placed = spark.createDataFrame(rows, "person long, verdict string, zones array<string>, seen array<int>, stated long, measured long, bare long")
    nodes, base = [], at("2026-03-28T22:00:00")
    for tree in range(90):
        ids = 100 * tree + r.permutation(100)[: int(r.integers(2, 14))]
        for k, i in enumerate(ids.tolist()):
            up = int(ids[int(r.integers(0, k))]) if k and r.random() < 0.95 else int(r.choice(ids)) if r.random() < 0.3 else None
            wall = base + tree * 40_000 + int(r.integers(0, 30)) * 1800 + k * int(r.integers(0, 5)) * 900
            nodes.append((i, up, int(r.integers(1, 8)), wall, int(r.choice([0, 330, 600])) if r.random() < 0.25 else None))
    got = {i: (x["state"], x["offset"], x["offered"]) for i, x in run(spark, nodes, placed).items()}
    want = in_order(sorted(nodes), people)
    assert got == want
    assert {s for s, _, _ in want.values()} == {"stated", "inferred", "ambiguous", "rejected", "unknown"}
    assert sum(s == "inferred" and n > 1 for s, _, n in want.values()) > 10


def test_report_and_empty(spark):
    placed = placed_by(spark)
    empty = spark.createDataFrame([], "id long, parent long, person long, wall long, offset int")
    got = {(r["part"], r["name"]): r["n"] for r in zones.report(zones.resolve(empty, placed), placed).collect()}
    assert got == {("people", "placed"): 1, ("people", "moved"): 1, ("people", "utc"): 1, ("messages", "chosen by order"): 0}
