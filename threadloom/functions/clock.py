"""Offsets and zones as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least and largest offset of a zone, in minutes.
LEAST, MOST = -720, 840
#: Minutes of the labels of zones that are read.
LABELS = {
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "AWST": 480, "ACST": 570, "ACDT": 630, "GMT": 0, "UTC": 0, "Z": 0, "BST": 60,
    "CET": 60, "CEST": 120, "IST": 330, "PST": -480, "PDT": -420, "EST": -300, "EDT": -240,
}


def zone_offset(instant: Column, zone: Column) -> Column:
    """Minutes east of UTC of an IANA zone at an instant, summer time included."""
    return ((F.unix_timestamp(F.from_utc_timestamp(instant, zone)) - F.unix_timestamp(instant)) / 60).cast("int")


def nearest_offset(minutes: Column, step: int = 15) -> Column:
    """The nearest multiple of the step, halves away from zero."""
    return (F.round(minutes / step) * step).cast("int")


def format_offset(minutes: Column) -> Column:
    m = F.abs(minutes)
    return F.concat(F.when(minutes < 0, "-").otherwise("+"), F.format_string("%02d%02d", (m / 60).cast("int"), (m % 60).cast("int")))


def offset_minutes(label: Column) -> Column:
    """Minutes of +hh:mm, +hhmm, Z and the known labels; null for others and beyond the bounds."""
    sign = F.when(label.startswith("-"), -1).otherwise(1)
    of = lambda g: F.regexp_extract(label, r"^[+-](\d{2}):?(\d{2})$", g)
    numeric = F.when(of(1) != "", sign * (of(1).cast("int") * 60 + of(2).cast("int")))
    known = F.create_map(*[F.lit(x) for p in LABELS.items() for x in p])
    out = F.coalesce(F.try_element_at(known, F.upper(F.trim(label))), numeric)
    return F.when(out.between(LEAST, MOST), out)
