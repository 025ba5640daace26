"""Collapse of twins against copies absorbed one after the other."""

import numpy as np

from threadloom.operators import collapse

TEXT = " ".join(f"w{i * i % 83} of{i}" for i in range(30))


def absorbed(entries, moves):
    rows = {r["entry_id"]: dict(r) for r in entries}
    for keep in sorted({k for _, k in moves}):
        for drop in sorted(d for d, k in moves if k == keep):
            for r in rows.values():
                if r["parent_id"] == drop and r["entry_id"] != keep:
                    r["parent_id"] = keep
            k, d = rows[keep], rows.pop(drop)
            if k["parent_id"] == drop:
                k["parent_id"] = None
            if k["parent_id"] is None and d["parent_id"] not in (None, keep, drop):
                k["parent_id"] = d["parent_id"]
            if k["quoted"]:
                k["subject"] = k["subject"] or d["subject"]
                k["person_id"] = k["person_id"] if k["person_id"] is not None else d["person_id"]
                k["text"] = max(k["text"], d["text"], key=len)
    return rows


def test_entries_and_what_goes_with_them(spark):
    r = np.random.default_rng(7)
    rows, moves = [], []
    for g in range(60):
        ids = (10 * g + r.permutation(10)[: int(r.integers(1, 6))]).tolist()
        rows += [(i, int(r.integers(0, 600)) if r.random() < 0.4 else int(r.choice(ids)) if r.random() < 0.4 else None, bool(r.random() < 0.6), str(r.choice(["", "s", "t"])), "", int(r.integers(0, 9)) if r.random() < 0.5 else None, "x" * int(r.integers(0, 40))) for i in ids]
        moves += [(d, ids[0]) for d in ids[1:]]
    known = {x[0] for x in rows}
    rows = [(i, p if p in known and p != i else None, *rest) for i, p, *rest in rows]
    df = spark.createDataFrame(rows, "entry_id long, parent_id long, quoted boolean, subject string, tz string, person_id long, text string").repartition(3)
    moved = spark.createDataFrame(moves, "drop_id long, keep_id long")
    after = collapse.entries_after(df, moved)
    got = {x["entry_id"]: x.asDict() for x in after.collect()}
    want = absorbed([x.asDict() for x in df.collect()], moves)
    for x in want.values():
        x["tz"] = ""
    assert got.keys() == want.keys()
    assert [(i, c) for i in want for c in ("parent_id", "subject", "person_id", "quoted") if got[i][c] != want[i][c]] == []
    assert all(len(got[i]["text"]) == len(want[i]["text"]) for i in want)
    again = {x["entry_id"]: x.asDict() for x in collapse.entries_after(after, moved).collect()}
    assert again == got
    seen = spark.createDataFrame([(d, k, "quoted", f"{d}") for d, k in moves] + [(k, k, "quoted", "own") for _, k in moves[:5]] + [(k, d, "forward", "f") for d, k in moves], "entry_id long, seen_in long, kind string, detail string").distinct()
    told = collapse.sightings_after(seen, moved)
    keys = [(x["entry_id"], x["seen_in"], x["kind"]) for x in told.collect()]
    assert len(keys) == len(set(keys)) and {e for e, s, _ in keys} | {s for _, s, _ in keys} <= set(want)
    assert {x["entry_id"] for x in told.where("detail = 'own'").collect()} == {k for _, k in moves[:5]}
    assert sorted(map(tuple, collapse.sightings_after(told, moved).collect())) == sorted(map(tuple, told.collect()))
    parts = spark.createDataFrame([(d, 1, "to") for d, _ in moves] + [(k, 1, "to") for _, k in moves], "entry_id long, person_id long, role string")
    assert collapse.participants_after(parts, moved).count() == len({k for _, k in moves})
    assert collapse.without(parts, moved).where(f"entry_id IN ({', '.join(str(d) for d, _ in moves)})").count() == 0


def test_new_blocks_find_their_twin(spark):
    inside = TEXT.split()
    inside = " ".join([*inside[:20], "no we did not say that at all", *inside[20:]])
    stored = [(1, "a", 0, TEXT, False), (2, "b", 0, TEXT, False), (3, "b", 60, TEXT, False), (4, "c", 0, TEXT, True), (5, "d", 0, TEXT, True), (6, "d", 900, TEXT, True), (7, "e", 0, TEXT, False), (8, "a", 7200, TEXT, True)]
    blocks = [(101, "a", 3600, TEXT), (102, "b", 3600, TEXT), (103, "c", 7200, TEXT), (104, "d", 1800, TEXT), (105, "e", 3600, inside), (106, "e", 200 * 3600, TEXT), (107, None, 0, TEXT), (108, "a", 3600, "too short"), (109, "a", 3600, TEXT)]
    copies = spark.createDataFrame(stored, "entry_id long, person string, wall long, text string, quoted boolean")
    new = spark.createDataFrame(blocks, "entry_id long, person string, wall long, text string")
    assert {r["entry_id"]: r["twin"] for r in collapse.find_twins(new, copies).collect()} == {101: 1, 103: 4, 109: 1}
