"""Runs of repeated words, by Crochemore's partition refinement.

Two places of a text are of one class at length l if the same l words start there.
Classes of length l + 1 come from those of length l: a class splits by the classes of the
places one word on.  Only the smaller halves of what split last need be looked at (the
largest part of a class keeps its name, and what follows it stays together), so each
place moves O(log n) times.  Where neighbouring members of a class of length l lie l
apart, a square starts; squares of one period at consecutive places form a run.

A run is asked to be at least POWER = 4 periods long, so at every length up to its period
each place in it has two equals.  Classes of fewer than three are dropped, and with them
the places before them; of prose next to nothing is left at length three.  The first
lengths are therefore formed by sorting all texts of a batch at once; from there each
text is refined alone, up to a quarter of its length, with the smaller halves.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POWER, LEAST = 4, 6
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Lengths that are formed by sorting, and words of texts that are sorted together.
SORTED, TOGETHER = 3, 1 << 18
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _merge(squares: dict[int, list[int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in the places where squares of each period start."""
    out = []
    for q, places in squares.items():
        at = np.unique(np.asarray(places, dtype=np.int64))
        cut = np.flatnonzero(np.diff(at) != 1) + 1
        first, last = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])]
        lengths = last - first + 2 * q
        good = lengths >= max(LEAST, POWER * q)
        out += zip(first[good].tolist(), lengths[good].tolist(), [q] * int(good.sum()))
    return out


class _Partition:
    """Classes of one text at a length, as linked lists in order of place."""

    def __init__(self, classes: dict[int, int], n: int, length: int):
        self.n, self.length = n, length
        self.of: dict[int, int] = {}
        self.next: dict[int, int] = {}
        self.prev: dict[int, int] = {}
        self.first: dict[int, int] = {}
        self.size: dict[int, int] = {}
        #: Places by the distance to the next member of their class; some are out of date.
        self.apart: dict[int, list[int]] = {}
        self.names = 0
        members: dict[int, list[int]] = {}
        for place, c in classes.items():
            members.setdefault(c, []).append(place)
        #: Members of the classes by which the next step splits.
        self.pivots = list(members.values())
        for pivot in self.pivots:
            self._open(pivot)
        #: Places that are out, where the next step has not yet looked at the place before.
        self.dead = [p + 1 for p in classes if p + 1 not in classes]

    def _open(self, members: list[int]) -> int:
        """A class of these places, in order; its name, over 0."""
        self.names += 1
        name, before = self.names, None
        self.first[name], self.size[name] = members[0], len(members)
        for place in members:
            self.of[place] = name
            self.prev[place] = before
            if before is not None:
                self.next[before] = place
                self._gap(before, place)
            before = place
        self.next[before] = None
        return name

    def _gap(self, place: int, after: int) -> None:
        if after - place >= self.length:
            self.apart.setdefault(after - place, []).append(place)

    def _take(self, name: int, place: int) -> None:
        """Take a place out of its class's list."""
        before, after = self.prev[place], self.next[place]
        if before is None:
            self.first[name] = after
        else:
            self.next[before] = after
        if after is not None:
            self.prev[after] = before
            if before is not None:
                self._gap(before, after)
        self.size[name] -= 1

    def _members(self, name: int) -> list[int]:
        out, at = [], self.first[name]
        while at is not None:
            out.append(at)
            at = self.next[at]
        return out

    def _drop(self, members: Iterable[int]) -> None:
        for place in members:
            del self.of[place]
        self.dead += members

    def squares(self) -> list[int]:
        """Places where a square of this length starts."""
        found = self.apart.pop(self.length, [])
        return [p for p in found if p in self.of and self.next[p] == p + self.length]

    def refine(self) -> None:
        """From classes of a length to those of the next one."""
        self.length += 1
        moved: dict[int, dict[int, list[int]]] = {}
        # what starts too near the end, or before a place that is out, is out as well
        gone = {p - 1 for p in [*self.dead, self.n - self.length + 2] if p - 1 in self.of}
        self.dead = []
        for place in gone:
            name = self.of[place]
            moved.setdefault(name, {})
            self._take(name, place)
        self._drop(gone)
        for at, pivot in enumerate(self.pivots):
            for place in pivot:
                if (name := self.of.get(place - 1)) is not None:
                    moved.setdefault(name, {}).setdefault(at, []).append(place - 1)
        self.pivots = []
        for name, groups in moved.items():
            parts = list(groups.values())
            for part in parts:
                for place in part:
                    self._take(name, place)
            rest = self.size[name]
            if rest < 3:
                self._drop(self._members(name))
                del self.size[name], self.first[name]
                rest = 0
            kept = []
            for part in parts:
                if len(part) < 3:
                    self._drop(part)
                else:
                    self._open(part)
                    kept.append(part)
            if not kept:
                continue
            largest = max(kept, key=len)
            if rest >= len(largest):
                self.pivots += kept
            else:
                self.pivots += [part for part in kept if part is not largest]
                if rest:
                    self.pivots.append(self._members(name))


def _refined(places: np.ndarray, classes: np.ndarray, n: int, squares: dict[int, list[int]]) -> None:
    """Squares of one text's periods over SORTED, from its classes of that length."""
    partition = _Partition(dict(zip(places.tolist(), classes.tolist())), n, SORTED)
    while partition.of and partition.length < n // POWER:
        partition.refine()
        if found := partition.squares():
            squares.setdefault(partition.length, []).extend(found)


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start and period; a text is an array of ids of its words (from 0)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    squares: list[dict[int, list[int]]] = [{} for _ in texts]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(texts)), sizes)
    ids = np.concatenate(texts).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    total = len(ids)
    # a text's ids are under its size, so adding its start keeps ids of texts apart
    classes, alive = ids + begins[owner], np.arange(total)
    ends = begins[owner + 1] if total else begins
    single = classes
    for length in range(1, SORTED + 1):
        if length > 1:
            inside = alive[alive + length <= ends[alive]]
            inside = inside[(classes[inside] >= 0) & (classes[inside + 1] >= 0)]
            keys = classes[inside] * total + single[inside + length - 1]
            alive = inside
        else:
            keys = classes
        _, new, counts = np.unique(keys, return_inverse=True, return_counts=True)
        keep = counts[new] >= 3
        alive, new = alive[keep], new[keep]
        classes = np.full(total, -1, dtype=np.int64)
        classes[alive] = new
        if not len(alive):
            break
        order = np.lexsort((alive, new))
        at, of = alive[order], new[order]
        for place in at[:-1][(np.diff(at) == length) & (np.diff(of) == 0)].tolist():
            squares[owner[place]].setdefault(length, []).append(place - int(begins[owner[place]]))
    if len(alive):
        cuts = np.flatnonzero(np.diff(owner[alive])) + 1
        for part in np.split(alive, cuts):
            doc = int(owner[part[0]])
            if sizes[doc] // POWER > SORTED:
                _refined(part - begins[doc], classes[part], int(sizes[doc]), squares[doc])
    return [sorted(_merge(s), key=lambda r: (r[0], r[2])) for s in squares]


def _read(text: str, rewrite: Callable | None, doc_id) -> tuple[list[str], np.ndarray]:
    """The words of a text and their ids."""
    words = WORD.findall(text)
    n = len(words)
    if rewrite and n and (found := rewrite(doc_id, n)):
        a, p = found
        words = words[:a] + [words[a + i % p] for i in range(n - a)]
    known: dict[str, int] = {}
    return words, np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)


def _collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period."""
    if not runs:
        return " ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return " ".join(w for w, k in zip(words, keep.tolist()) if k)


def _rows(batches: Iterator[pa.RecordBatch], rewrite: Callable | None) -> Iterator[pa.RecordBatch]:
    of_run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(of_run)), ("collapsed", pa.string())])

    def out(ids: list, read: list) -> pa.RecordBatch:
        found = runs_of([x for _, x in read])
        named = [[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found]
        columns = [ids, [len(w) for w, _ in read], named, [_collapse(w, r) for (w, _), r in zip(read, found)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

    for batch in batches:
        ids, read, size = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(doc_id)
            read.append(_read(text.as_py() or "", rewrite, doc_id))
            size += len(read[-1][0])
            if size >= TOGETHER:
                yield out(ids, read)
                ids, read, size = [], [], 0
        if ids:
            yield out(ids, read)


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rewrite: Callable | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs by start and period, and its text with one period of each run left.

    A run is a longest stretch of words with smallest period q, of at least 4 q and at
    least 6 words; start counts words from 0.  `collapsed` joins words by one space.  A
    null or empty text has no words, no runs and an empty `collapsed`; a null doc_id stays
    null, repeated rows are read each.  Texts are whole, whatever their length.  Other
    columns are ignored, an empty table gives no rows.

    `rewrite(doc_id, n)`, if given, may return (a, p): from word a on, the text's words
    are then replaced by repetitions of words a to a + p - 1.
    """
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(lambda x: _rows(x, rewrite), SCHEMA)


def report(found: DataFrame) -> DataFrame:
    """The columns of op12: the longest run of each row, and digests of all runs and of what collapsing leaves."""
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    # array_max takes the greatest length, then the smallest start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    some = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    return some.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
