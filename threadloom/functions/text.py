"""String expressions over columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(text: Column) -> Column:
    """White space runs as one space, trimmed; null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def body_sha(*parts: Column) -> Column:
    """SHA-256 of the collapsed parts, each ended by a zero character."""
    return F.sha2(F.concat(*[x for p in parts for x in (collapse(p), F.chr(F.lit(0)))]).cast("binary"), 256)


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def normalise_identity(kind: Column, value: Column) -> Column:
    """One form for each identity: emails and names in lower case, user ids in upper case; null if nothing is left."""
    email = F.lower(F.regexp_replace(F.trim(value), r"^<|>$", ""))
    uid = F.upper(F.regexp_replace(F.trim(value), r"^<?@|>$", ""))
    out = F.when(kind == "email", email).when(kind == "uid", uid).otherwise(F.lower(collapse(value)))
    return F.when(out != "", out)


def clean_subject(subject: Column) -> Column:
    """The subject without its chain of reply and forward marks."""
    return F.trim(F.regexp_replace(F.coalesce(subject, F.lit("")), r"(?i)^\s*(?:(?:re|fwd?|aw|sv|vs)\s*:\s*)+", ""))


def base_address(address: Column) -> Column:
    """user+tag@host as user@host; other addresses, and those whose tag spells another mailbox, as they are."""
    other = F.regexp_extract(address, r"^[^+@]+\+([^@]*)@", 1).rlike(r"(?i)^caf_|[A-Za-z0-9._%+\-]+=[A-Za-z0-9.\-]+\.[A-Za-z]{2,}")
    return F.when(other, address).otherwise(F.regexp_replace(address, r"^([^+@]+)\+[^@]*@", "$1@"))


def mail_domain(address: Column) -> Column:
    return F.lower(F.regexp_extract(address, r"@([^@\s>]+)$", 1))


def short_urls(text: Column) -> Column:
    """Every URL as its host."""
    return F.regexp_replace(text, r"https?://([^/\s]+)\S*", "$1")


def human_size(n: Column) -> Column:
    """Bytes in the largest unit under 1024, with one decimal below ten."""
    units = ("B", "KB", "MB", "GB", "TB")
    power = F.least(F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")) / 10), F.lit(len(units) - 1)).cast("int")
    value = n / F.pow(F.lit(1024.0), power)
    shown = F.when((power > 0) & (value < 10), F.format_string("%.1f", value)).otherwise(F.format_string("%.0f", value))
    return F.concat(shown, F.lit(" "), F.element_at(F.array(*map(F.lit, units)), power + 1))


def excerpt(text: Column, n: int) -> Column:
    """The first n characters, collapsed, with an ellipsis where something is left out."""
    short = collapse(F.substring(text, 1, n))
    return F.when(F.length(text) > n, F.concat(short, F.lit("…"))).otherwise(short)


#: Words that lead the messages around a meeting.
_MEETING = r"(?i)^\s*(?:invitation|invite|updated invitation|canceled event|cancelled event|accepted|declined|tentative|notes|recap|note taker)\b[:\s]|^\s*\S.*\bshared (?:a|the) recap for\b"


def is_meeting(flag: Column, kind: Column, subject: Column, body: Column) -> Column:
    """Whether an entry is about a meeting only: as its flag says, else a note, or what its subject or its body without markup begins with."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), "<[^>]+>", " "), "(?i)&[a-z]+;", " "))
    return F.coalesce(flag, (F.coalesce(kind, F.lit("")) == "note") | F.coalesce(subject, F.lit("")).rlike(_MEETING) | plain.rlike(_MEETING))


def is_ext_id(value: Column) -> Column:
    """Whether a value names an entry: mail: or slack: and no blanks."""
    return value.rlike(r"^(?:mail|slack):[^ \t]*$")


def provenance(source: Column) -> Column:
    """struct<kind, ids>: the ids that a source lists, or prose."""
    text = F.trim(source)
    parts = F.split(F.regexp_replace(text, r"^unspooled from ", ""), ", ")
    ids = F.forall(parts, lambda p: p.rlike(r"^(?:msg \S+|(?:mail|slack|quote):\S+)$"))
    return F.struct(F.when(ids, "ids").otherwise("prose").alias("kind"), F.when(ids, F.transform(parts, lambda p: F.regexp_replace(p, "^msg ", ""))).alias("ids"))
