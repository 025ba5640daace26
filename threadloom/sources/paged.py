"""A paged mailbox as a source of Spark: batch and stream, resumable between pages.

A mailbox is any object that can be pickled and has

- `page(container, size, token)`: ([(id, seconds or None), ...], token of the next page or None, whether more follow), newest first; it raises `Expired` for a token that it no longer knows;
- `read(id)`: a dict of the message with the fields of `FIELDS`, other fields left out.

Rows are messages (`id` set) and, after each page, one row of how the walk stands (`id`
null): `position`, `frontier`, `stop`, `walked` and the `page`'s number, from which `cursors` makes the table that
`corpus.save_progress` keeps.  `stop` is null while the walk goes on, else as in `listing`.

Containers are the queries or channels asked for, so their states travel in the options and
in the stream's offsets; ids of a page do too, messages never: tasks read those.  A page that
is empty but has more behind it is walked past.  More without a token is an error, as is an
expired token on a page that is not the first of a run; on the first the walk begins again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .listing import LOOK_BACK, PAGE

FIELDS = ["thread", "message_id", "in_reply_to", "references", "sender", "to", "cc", "labels", "date", "subject", "body", "html"]
SCHEMA = "container string, id string, " + ", ".join(f"`{f}` string" for f in FIELDS) + ", truncated boolean, position string, frontier bigint, stop string, walked bigint, page bigint"
#: Messages that one task of a stream reads.
SHARE = 50


class Expired(Exception):
    """A page token that the mailbox no longer knows."""


class Refused(Exception):
    """An answer that cannot be walked on from."""


def begun(position: str | None = None, frontier: int | None = None, walked: int = 0) -> dict:
    """The state of a walk that begins, from a cursor's position and frontier.

    Values are texts, as offsets of streams hold no nulls: an empty one stands for none.
    """
    floor = "" if frontier is None else str(frontier - LOOK_BACK)
    return {"token": position or "", "floor": floor, "newest": "" if frontier is None else str(frontier), "seen": "0", "walked": str(walked), "stop": "", "head": "", "ids": "", "page": "0"}


def step(mailbox, container: str, state: dict, size: int, most: int, first: bool) -> dict:
    """The state after one more page, with the page's ids to read; `first` says that this run has read none before."""
    seen = int(state["seen"])
    size = min(size, most - seen) if most else size
    token = state["token"] or None
    try:
        listed, after, more = mailbox.page(container, size, token)
    except Expired:
        if token is None or not first:
            raise
        token, listed, after, more = None, *mailbox.page(container, size, None)
    ids, newest, stop = [], state["newest"], ""
    for name, at in listed:
        if state["floor"] and at is not None and at <= int(state["floor"]):
            stop = "frontier"
            break
        ids.append(name)
        newest = str(max(at, int(newest or at))) if at is not None else newest
    if not stop and not more:
        stop = "exhausted"
    if not stop and not after:
        raise Refused(f"{container}: more was promised without a page token")
    seen += len(ids)
    if not stop and most and seen >= most:
        stop = "max"
    covered = stop in ("frontier", "exhausted")
    head = (listed[0][0] if listed else "") if token is None else state["head"]
    walked = 0 if covered else int(state["walked"]) + len(ids)
    return state | {"token": "" if covered else after, "newest": newest, "seen": str(seen), "walked": str(walked), "stop": stop, "head": head, "ids": "\n".join(ids), "page": str(int(state["page"]) + 1)}


def _message(mailbox, container: str, name: str) -> tuple:
    got = mailbox.read(name)
    return (container, name, *[got.get(f) for f in FIELDS], bool(got.get("truncated")), *[None] * 5)


def _standing(container: str, state: dict) -> tuple:
    # only a walk that covers its container may move the frontier
    covered = state["stop"] in ("frontier", "exhausted")
    frontier = int(state["newest"]) if covered and state["newest"] else None
    return (container, None, *[None] * len(FIELDS), None, state["token"] or None, frontier, state["stop"] or None, int(state["walked"]), int(state["page"]))


class _Part(InputPartition):
    def __init__(self, container: str, state: dict, ids: list[str], last: bool):
        self.container, self.state, self.ids, self.last = container, state, ids, last


class _Batch(DataSourceReader):
    def __init__(self, mailbox, starts: dict[str, dict], size: int, most: int):
        self.mailbox, self.starts, self.size, self.most = mailbox, starts, size, most

    def partitions(self):
        return [_Part(c, s, [], True) for c, s in sorted(self.starts.items())]

    def read(self, partition):
        c, state, first = partition.container, partition.state, True
        while not state["stop"]:
            state = step(self.mailbox, c, state, self.size, self.most, first)
            first = False
            for name in state["ids"].split("\n") if state["ids"] else ():
                yield _message(self.mailbox, c, name)
            yield _standing(c, state)


class _Stream(DataSourceStreamReader):
    """One page of every container a batch; an offset is the states after it, so a restart goes on behind the last page."""

    def __init__(self, mailbox, starts: dict[str, dict], size: int, most: int):
        self.mailbox, self.starts, self.size, self.most = mailbox, starts, size, most
        self.at: dict | None = None
        self.paged: set[str] = set()

    def initialOffset(self):
        return self.starts

    def latestOffset(self):
        self.at = {c: self._next(c, s) for c, s in (self.at or self.starts).items()}
        return self.at

    def _next(self, c: str, state: dict) -> dict:
        if state["stop"] == "max":
            return state
        if not state["stop"]:
            after = step(self.mailbox, c, state, self.size, self.most, c not in self.paged)
            self.paged.add(c)
            return after
        # a covered container is walked again once another envelope leads it
        frontier = int(state["newest"]) if state["newest"] else None
        after = step(self.mailbox, c, begun(None, frontier) | {"page": state["page"]}, self.size, self.most, True)
        return state if after["head"] == state["head"] else after

    def partitions(self, start, end):
        # on a restart the engine plans the last batch again, which says where the walk stood
        self.at = self.at or end
        parts = []
        for c, state in sorted(end.items()):
            if start.get(c) == state:
                continue
            ids = state["ids"].split("\n") if state["ids"] else []
            shares = [ids[i : i + SHARE] for i in range(0, len(ids), SHARE)] or [[]]
            parts += [_Part(c, state, some, i == len(shares) - 1) for i, some in enumerate(shares)]
        return parts

    def read(self, partition):
        for name in partition.ids:
            yield _message(self.mailbox, partition.container, name)
        if partition.last:
            yield _standing(partition.container, partition.state)


def paged(mailbox, name: str = "paged_mail") -> type[DataSource]:
    """A source over the mailbox, to be registered with `spark.dataSource.register`.

    Options: `cursors`, JSON of a list of {container, position, frontier, walked}, all but the
    first optional; `size`, envelopes a page; `most`, envelopes a walk (0: no bound).
    """

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return SCHEMA

        def _with(self, reader):
            asked = json.loads(self.options.get("cursors", "[]"))
            starts = {x["container"]: begun(x.get("position"), x.get("frontier"), x.get("walked") or 0) for x in asked}
            return reader(mailbox, starts, int(self.options.get("size", PAGE)), int(self.options.get("most", 0)))

        def reader(self, schema):
            return self._with(_Batch)

        def streamReader(self, schema):
            return self._with(_Stream)

    return Paged


def messages(rows: DataFrame) -> DataFrame:
    """The messages among the rows of a walk."""
    return rows.where("id IS NOT NULL").select("container", "id", *FIELDS, "truncated")


def cursors(rows: DataFrame) -> DataFrame:
    """(container, position, frontier, stop, walked) after the last page of each container's walk."""
    last = rows.where("id IS NULL").groupBy("container").agg(F.max_by(F.struct("position", "frontier", "stop", "walked"), "page").alias("r"))
    return last.select("container", "r.*")


def _first(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def entries(found: DataFrame) -> DataFrame:
    """Messages as entries (source, ref, container, parent_ref, sender, subject, text, html, date): the message id names an entry, or the mailbox's own id where there is none."""
    return found.select(F.lit("mail").alias("source"), F.coalesce(_first("message_id"), F.concat(F.lit("box:"), "id")).alias("ref"), F.col("thread").alias("container"), _first("in_reply_to").alias("parent_ref"), "sender", "subject", F.coalesce("body", F.lit("")).alias("text"), "html", "date")
