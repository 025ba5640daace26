"""Who takes part in a timeline: mentions by person, address or name, in the order in which they are met.

A mention goes to the first of its aliases (person, then address, else name) that is
bound; what it is mentioned by is bound to that row, and other addresses of the person
only where nothing holds them yet.  Two rows are never joined afterwards, so this is no
matter of connected components: the first binding stands.

Each timeline's mentions stream in order through one task, which keeps its people, not
its mentions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "seat int, name string, email string, org string, quoted_only boolean, aliases array<string>"


class _Cast:
    """The rows of one timeline, by what binds to them."""

    def __init__(self, timeline):
        self.timeline, self.rows, self.bound = timeline, [], {}

    def see(self, person, address: str, name: str, others: list[str], org: str, named: bool, direct: bool) -> None:
        if not (name or address):
            return
        aliases = [f"p:{person}"] if person is not None else []
        aliases += [f"a:{address}"] if address else []
        aliases = aliases or [f"n:{name.lower()}"]
        row = next((self.bound[a] for a in aliases if a in self.bound), None)
        if row is None:
            row = {"name": "", "email": "", "org": "", "direct": False}
            self.rows.append(row)
        for a in aliases:
            self.bound[a] = row
        for a in others:
            self.bound.setdefault(f"a:{a}", row)
        if named or not row["name"]:
            row["name"] = name or address
        row["email"] = row["email"] or address
        if org and (named or not row["org"]):
            row["org"] = org
        row["direct"] |= direct

    def out(self) -> list[tuple]:
        held: dict[int, list[str]] = {}
        for a, row in self.bound.items():
            held.setdefault(id(row), []).append(a)
        return [(self.timeline, i + 1, r["name"], r["email"], r["org"], not r["direct"], sorted(held.get(id(r), []))) for i, r in enumerate(self.rows)]


def people(mentions: DataFrame) -> DataFrame:
    """(timeline, seat, name, email, org, quoted_only, aliases), people numbered in the order in which they are met.

    `mentions` has timeline, pos (their order; equal ones go by the other columns),
    person, address, name, others (further addresses of the person), org, named (a
    sender, whose name and organisation outrank earlier ones) and direct (not only
    quoted).  Nulls are empty; a mention without name and address counts for nothing; a
    name alone binds where there is neither person nor address.
    """
    kind = mentions.schema["timeline"].dataType.simpleString()
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    yes = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    plain = mentions.select("timeline", "pos", "person", F.lower(F.coalesce("address", F.lit(""))).alias("address"), text("name"), F.coalesce("others", F.array().cast("array<string>")).alias("others"), text("org"), yes("named"), yes("direct"))
    dealt = plain.repartition("timeline").sortWithinPartitions("timeline", "pos", F.desc("named"), "person", "address", "name", "org")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cast, of, schema = None, None, None

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            types = (of, pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()))
            names = ["timeline", "seat", "name", "email", "org", "quoted_only", "aliases"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names)

        for batch in batches:
            of = batch.column(0).type
            for timeline, _, *mention in zip(*(c.to_pylist() for c in batch.columns)):
                if cast is None or timeline != cast.timeline:
                    if cast:
                        yield emit(cast.out())
                    cast = _Cast(timeline)
                cast.see(*mention)
        if cast:
            yield emit(cast.out())

    return dealt.mapInArrow(run, f"timeline {kind}, {SCHEMA}")


def unseated(mentions: DataFrame, seated: DataFrame) -> DataFrame:
    """Senders (timeline, name) of `mentions` that no row of `seated` is bound to or named by; none, if the cast is whole."""
    bound = seated.select("timeline", F.explode("aliases").alias("alias")).distinct()
    alias = F.when(F.col("person").isNotNull(), F.concat(F.lit("p:"), F.col("person").cast("string"))).when(F.coalesce("address", F.lit("")) != "", F.concat(F.lit("a:"), F.lower("address"))).otherwise(F.concat(F.lit("n:"), F.lower("name")))
    senders = mentions.where("named AND (coalesce(name, '') <> '' OR coalesce(address, '') <> '')").select("timeline", "name", alias.alias("alias"))
    return senders.join(bound, ["timeline", "alias"], "left_anti").select("timeline", "name").distinct()
