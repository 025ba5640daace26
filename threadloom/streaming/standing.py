"""Cursors kept by a stream of walks, with a timer for walks that stand still.

The rows are those of `sources.paged` that tell how a walk stands after each page.  The
state store must be RocksDB (`spark.sql.streaming.stateStore.providerClass`).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

SCHEMA = "container string, position string, frontier bigint, complete boolean, walked bigint, page bigint, stalled boolean"
_STATE = "position string, frontier bigint, complete boolean, walked bigint, page bigint"


def moved(held: tuple | None, position: str | None, frontier: int | None, stop: str | None, walked: int | None, page: int) -> tuple | None:
    """The cursor (position, frontier, complete, walked, page) after one page; null where the page was counted before.

    A walk under way or bounded moves position and count and leaves the frontier; one that
    covers its container clears both and takes the later frontier.
    """
    if held and page <= held[4]:
        return None
    before = held[1] if held else None
    if stop in ("frontier", "exhausted"):
        return None, max((x for x in (before, frontier) if x is not None), default=None), True, 0, page
    return position, before, False, walked or 0, page


class Standing(StatefulProcessor):
    """One cursor a container.  Each batch gives the cursors that it moved, and those that did not for `patience` milliseconds as stalled."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle):
        self.handle = handle
        self.cursor = handle.getValueState("cursor", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.cursor.get() if self.cursor.exists() else None
        after = None
        # pages of a batch come in any order; one row a page is kept of them
        for r in sorted({r["page"]: r for r in rows}.values(), key=lambda r: r["page"]):
            after = moved(after or held, r["position"], r["frontier"], r["stop"], r["walked"], r["page"]) or after
        if after is None:
            return
        self.cursor.update(after)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if not after[2]:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        yield Row(container=key[0], position=after[0], frontier=after[1], complete=after[2], walked=after[3], page=after[4], stalled=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.cursor.exists():
            c = self.cursor.get()
            yield Row(container=key[0], position=c[0], frontier=c[1], complete=c[2], walked=c[3], page=c[4], stalled=True)

    def close(self):
        pass


def standing(walks: DataFrame, patience: int = 3_600_000) -> DataFrame:
    """Cursors (SCHEMA) of a stream of walk rows, to be written in update mode; a page that comes again changes nothing.

    A walk that has not covered its container and gets no page for `patience` milliseconds
    is given once more with `stalled`; a bounded one is among them, as it waits to be asked.
    For the clock's timers the engine goes on in empty batches, so the stream wants a trigger
    with an interval; `availableNow` would not end.  Rows of messages and those without a container are passed over.
    """
    rows = walks.where("id IS NULL AND container IS NOT NULL AND page IS NOT NULL").select("container", "position", "frontier", "stop", "walked", "page")
    return rows.groupBy("container").transformWithState(statefulProcessor=Standing(patience), outputStructType=SCHEMA, outputMode="Update", timeMode="ProcessingTime")
