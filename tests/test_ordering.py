"""Order by a queue of ready messages, and lanes by a fold over rows."""

import heapq

import numpy as np

from threadloom.operators import ordering


def queued(rows):
    """ids in the order of a queue; rows are (timeline, id, parent, key, pos) of one timeline."""
    by = {r[1]: r for r in rows}
    kids, ready, out = {}, [], []
    for r in rows:
        if r[2] in by:
            kids.setdefault(r[2], []).append(r)
        else:
            ready.append((r[3], r[1]))
    heapq.heapify(ready)
    while ready:
        _, at = heapq.heappop(ready)
        out.append(at)
        for k in kids.get(at, []):
            heapq.heappush(ready, (k[3], k[1]))
    seen = set(out)
    return out + [r[1] for r in sorted(rows, key=lambda r: r[4]) if r[1] not in seen]


def folded(rows):
    """id -> lane; rows are (id, parent) in order."""
    known = {i for i, _ in rows}
    wanted = {p for _, p in rows if p in known}
    holders, out = [], {}
    for i, p in rows:
        lane = holders.index(p) if p in known and p in holders else -1
        if lane < 0:
            lane = holders.index(None) if None in holders else len(holders)
            if lane == len(holders):
                holders.append(None)
        holders[lane] = i if i in wanted else None
        out[i] = lane
    return out


def forest():
    r = np.random.default_rng(9)
    rows = []
    for t in range(40):
        n = int(r.integers(1, 60))
        for i in range(n):
            up = None if r.random() < 0.1 else int(r.integers(0, n)) if r.random() < 0.1 else int(r.integers(max(0, i - 6), i + 1)) if i else 99999
            rows.append((f"t{t}", i, up, int(r.integers(0, 20)), int(r.integers(0, 10**6))))
    rows += [("chain", i, i - 1 if i else None, (i * 7919) % 1013, i) for i in range(700)]
    return rows + [("up", i, i - 1 if i else None, i, i) for i in range(300)] + [("down", i, i - 1 if i else None, -i, i) for i in range(300)] + [("self", 1, 1, 5, 1), ("self", 2, 1, 4, 0), ("self", 3, None, 9, 7)]


def test_order_and_lanes(spark):
    rows = forest()
    df = spark.createDataFrame(rows, "timeline string, id long, parent long, key long, pos long").repartition(5)
    placed = ordering.order(df)
    got = {}
    for r in placed.collect():
        got.setdefault(r["timeline"], {})[r["place"]] = r["id"]
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for t, own in by.items():
        assert [got[t][k + 1] for k in range(len(own))] == queued(own), t
    with_parent = placed.join(df.select("timeline", "id", "parent"), ["timeline", "id"])
    lanes = {}
    for r in ordering.graph_lanes(with_parent).collect():
        lanes.setdefault(r["timeline"], {})[r["id"]] = r["lane"]
    for t, own in by.items():
        up = {r[1]: r[2] for r in own}
        assert lanes[t] == folded([(i, up[i]) for i in queued(own)]), t
    # in any other order too, where answers may stand above what they answer
    shuffled = df.selectExpr("timeline", "id", "parent", "pos * 1000 + id AS place")
    lanes = {}
    for r in ordering.graph_lanes(shuffled).collect():
        lanes.setdefault(r["timeline"], {})[r["id"]] = r["lane"]
    for t, own in by.items():
        assert lanes[t] == folded([(r[1], r[2]) for r in sorted(own, key=lambda r: r[4] * 1000 + r[1])]), t
    assert ordering.order(df.limit(0)).count() == 0 and ordering.graph_lanes(with_parent.limit(0)).count() == 0
