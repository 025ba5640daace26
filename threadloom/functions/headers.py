"""Lists of addresses and dates as mail headers state them, as column expressions.

A list is parted by its grammar: quoted strings, comments and addresses in angles hold
commas that part nothing; groups are named lists; what breaks the grammar is read as far
as it goes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .address import clean_name
from .clock import LEAST, MOST, offset_minutes

_QUOTED = r'"(?:\\.|[^"\\])*+"'
_COMMENT = r"\((?:\\.|[^()\\]|\((?:\\.|[^()\\])*+\))*+\)"
_ANGLE = r"<[^<>]*+>"
_ITEM = rf"(?s)((?:{_QUOTED}|{_COMMENT}|{_ANGLE}|[^,;])+)"
#: The name of a group, up to its colon.
_GROUP = rf'(?s)^\s*(?:{_QUOTED}|[^":<>@,;()])*+:(?!//)'
_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
_ENCODED = r"=\?([^?]+)\?([bBqQ])\?([^?]*)\?="


def decoded(text: Column) -> Column:
    """A header's text with its encoded words in UTF-8, Latin-1 or ASCII decoded; others stay as they are."""
    joined = F.regexp_replace(text, r"(\?=)\s+(=\?)", "$1$2")
    parts = F.split(joined, rf"(?={_ENCODED})|(?<=\?=)(?!\s*=\?)", -1)

    def one(x: Column) -> Column:
        part = lambda g: F.regexp_extract(x, rf"(?s)^{_ENCODED}$", g)
        charset = F.upper(part(1))
        known = charset.isin("UTF-8", "ISO-8859-1", "US-ASCII")
        raw = F.when(F.upper(part(2)) == "B", F.try_to_binary(part(3), F.lit("base64"))).otherwise(
            F.try_to_binary(F.array_join(F.transform(F.split(F.regexp_replace(part(3), "_", " "), r"(?=(?:=[0-9A-Fa-f]{2}))|(?<==[0-9A-Fa-f]{2})", -1), lambda y: F.when(y.rlike("^=[0-9A-Fa-f]{2}$"), F.substring(y, 2, 2)).otherwise(F.hex(F.encode(y, "UTF-8")))), ""), F.lit("hex"))
        )
        text_of = F.when(charset == "ISO-8859-1", F.decode(raw, "ISO-8859-1")).otherwise(F.try_validate_utf8(raw.cast("string")))
        return F.when(known & text_of.isNotNull(), text_of).otherwise(x)

    # most texts hold none, and are what they are
    return F.when(text.contains("=?"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def _unquoted(name: Column) -> Column:
    """A display name: quoted strings without quotes and escapes, white space as one space."""
    bare = F.regexp_replace(F.regexp_replace(name, r'(?s)"((?:\\.|[^"\\])*+)"', "$1"), r"(?s)\\(.)", "$1")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def addresses(header: Column) -> Column:
    """array<struct<address, name>> of a header, in order; addresses in lower case, null where a part is a name alone.

    A comment behind a bare address is its name.  Members of groups stand by themselves,
    an empty group gives none.  An angle that is never closed, a name welded to one, and
    a mailto: link are read where they hold one address.  Null and blank give none.
    """
    line = F.regexp_replace(F.coalesce(header, F.lit("")), r"\r?\n[ \t]+", " ")
    items = F.regexp_extract_all(line, F.lit(_ITEM), F.lit(1))

    # each step is a field of its own, so that what later steps share is found once
    def parted(item: Column) -> Column:
        bare = F.regexp_replace(item, rf"(?s)({_QUOTED})|{_COMMENT}", "$1")
        return F.struct(item.alias("item"), F.when(item.contains("("), bare).otherwise(item).alias("outside"))

    def angled(x: Column) -> Column:
        angle = F.regexp_extract(x["outside"], rf'(?s)^(?:{_QUOTED}|[^<"])*+<([^<>]*+)>', 1)
        opened = F.regexp_extract(x["outside"], rf'(?s)^((?:{_QUOTED}|[^<"])*+)<', 1)
        route = F.lower(F.trim(F.regexp_replace(F.regexp_replace(angle, r"(?s)^\s*@[^:]*:", ""), r"\s+", "")))
        has = x["outside"].contains("<")
        return F.struct(x["item"].alias("item"), x["outside"].alias("outside"), F.when(has, opened).otherwise("").alias("opened"), F.when(has, route).otherwise("").alias("route"))

    def named(x: Column) -> Column:
        name = F.when(x["opened"] != "", decoded(_unquoted(F.trim(x["opened"])))).otherwise("")
        return F.struct(*[x[c].alias(c) for c in ("item", "outside", "opened", "route")], name.alias("name"), F.trim(x["outside"]).alias("bare"))

    def one(x: Column) -> Column:
        item, outside, opened, route, name, bare = (x[c] for c in ("item", "outside", "opened", "route", "name", "bare"))
        comment = F.when(item.contains("("), F.regexp_extract(item, rf"(?s)^(?:{_QUOTED}|[^()\"])*?\(((?:\\.|[^()\\])*+)\)\s*$", 1)).otherwise("")
        links = F.regexp_extract_all(F.lower(item), F.lit(f"({_EMAIL})"), F.lit(1))
        is_link = F.lower(item).contains("mailto:") & (F.size(F.array_distinct(links)) == 1)
        loose = F.when(outside.contains("<"), F.regexp_extract(F.lower(outside), f"<[^>]*?({_EMAIL})", 1)).otherwise("")
        before = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(item, rf"(?s)^(.*?){_EMAIL}", 1)), r"(?i)mailto:\s*$", ""), r"^[\s<>(\[,:\"']+|[\s<>(\[,:\"']+$", "")
        got = lambda a, n: F.struct(F.nullif(a, F.lit("")).alias("address"), F.trim(n).alias("name"))
        return (
            F.when(is_link, got(F.get(links, F.lit(0)), F.when(before == F.get(links, F.lit(0)), "").otherwise(before)))
            .when(route != "", got(route, F.when(name != "", name).otherwise(decoded(comment))))
            .when(loose != "", got(loose, clean_name(opened)))
            .when(bare.contains("@") & ~bare.rlike(r"\s"), got(F.lower(bare), decoded(comment)))
            .otherwise(got(F.lit(""), clean_name(F.when(opened != "", name).otherwise(decoded(_unquoted(bare))))))
        )

    own = F.transform(items, lambda raw: F.trim(F.regexp_replace(raw, _GROUP, "")))
    for step in (parted, angled, named):
        own = F.transform(own, step)
    return F.filter(F.transform(own, one), lambda x: x["address"].isNotNull() | (x["name"] != ""))


#: What a year of two or three figures means is added to these.
_CENTURY = {"two_low": 2000, "two_high": 1900, "three": 1900}
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def header_date(text: Column) -> Column:
    """struct<at, label, offset> of a Date header: the instant in seconds, the zone as stated, minutes east of UTC.

    Weekday and seconds may be missing, comments count for nothing, a label that is not
    known counts as +0000 but is kept.  Null for anything else and for days that a month
    has not.
    """
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?s){_COMMENT}", " "), r"\s+", " "))
    shape = r"(?i)^(?:[a-z]{3,9} ?, ?)?(\d{1,2}) (jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* (\d{2,4}) (\d{1,2}) ?: ?(\d{2})(?: ?: ?(\d{2}))? ?([+-]\d{4}|[a-z]{1,5})$"
    part = lambda g: F.regexp_extract(plain, shape, g)
    number = lambda g: F.nullif(part(g), F.lit("")).cast("int")
    year = F.when(F.length(part(3)) == 2, number(3) + F.when(number(3) < 50, _CENTURY["two_low"]).otherwise(_CENTURY["two_high"])).when(F.length(part(3)) == 3, number(3) + _CENTURY["three"]).otherwise(number(3))
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(part(2))).cast("int")
    clock = (number(4) <= 23) & (number(5) <= 59) & (F.coalesce(number(6), F.lit(0)) <= 60)
    day = F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, number(1)), F.lit("yyyy-MM-dd")))
    stated = F.coalesce(offset_minutes(part(7)), F.when(~part(7).rlike("^[+-]"), 0))
    wall = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + number(4) * 3600 + number(5) * 60 + F.coalesce(number(6), F.lit(0))
    good = (plain != "") & (part(1) != "") & clock & day.isNotNull() & stated.between(LEAST, MOST)
    return F.when(good, F.struct((wall - stated * 60).alias("at"), part(7).alias("label"), stated.cast("int").alias("offset")))
