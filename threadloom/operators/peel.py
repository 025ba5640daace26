"""Messages recovered from what later messages quote.

One expression over the body finds every boundary: an attribution ("On … wrote:", which
may wrap), a block of header lines, or a rule before either.  Java's matcher takes the
leftmost one and goes on behind it, which is the single forward pass that the rules ask
for, so no row leaves the JVM and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse

# Words that open and close an attribution, and the keys of header lines.
OPENERS = ("on", "le", "el", "il", "em", "am", "op", "den", "på", "pe", "w dniu", "dnia", "vào", "在")
CLOSERS = (
    "wrote:", "sent:", "a écrit :", "a écrit:", "écrit:", "escribió:", "ha scritto:", "scritto:", "escreveu:", "schrieb:",
    "schreef:", "napisał:", "napisała:", "pisze:", "skrev:", "kirjoitti:", "đã viết:", "写道：", "작성:",
)
KEYS = (
    "from", "sent", "to", "subject", "cc", "bcc", "date", "reply-to", "von", "gesendet", "an", "betreff", "de", "enviado", "para",
    "asunto", "objet", "envoyé", "van", "verzonden", "aan", "da", "inviato", "oggetto", "fra", "sendt", "skickat", "till", "ämne", "assunto",
)
FIELDS = {
    "from": ("from", "von", "de", "da", "van", "fra"),
    "date": ("sent", "date", "gesendet", "enviado", "envoyé", "verzonden", "inviato", "sendt", "skickat"),
    "to": ("to", "an", "para", "aan", "till"),
    "cc": ("cc", "bcc"),
    "subject": ("subject", "betreff", "asunto", "objet", "oggetto", "ämne", "assunto", "onderwerp"),
    "message_id": ("message-id",),
}
#: Lines that an attribution, and the value of a header, may go on for.
WRAPS, FOLDS = 5, 6

_FLAGS = "(?imu)"
_Q = r"[ \t>]*"
_BLANK = rf"{_Q}$"
_OPEN = rf"(?:{'|'.join(OPENERS)})(?:[ \t]|$)"
_CLOSE = rf"(?:{'|'.join(c.replace(' ', '[ ]') for c in CLOSERS)})"
_ATTRIBUTION = rf"{_Q}(?={_OPEN})[^\n]*?(?:\n(?!{_BLANK})(?!{_Q}{_OPEN})[^\n]*?){{0,{WRAPS}}}?{_CLOSE}[^\n]*"
_KEY = rf"{_Q}\*?(?:{'|'.join(KEYS)})\*?[ \t]*:\*?[ \t]+[^\s][^\n]*"
_HEADER = rf"{_KEY}(?:(?:\n(?!{_BLANK})[^\n]*){{0,{FOLDS}}}?\n{_KEY})++"
_NAMED = r"(?:-{2,}\s?forwarded message\s?-{2,}|-{3,}\s?original message\s?-{3,}|begin forwarded message\s*:)[ \t]*$"
_BARE = r"(?:[-_]{10,}|\*{8,})[ \t]*$"
_NEXT = rf"(?:\n{_BLANK})*+\n(?:{_HEADER}|{_ATTRIBUTION})"
_BOUNDARY = rf"{_FLAGS}^(?:{_Q}(?:{_NAMED}(?:{_NEXT})?|{_BARE}{_NEXT})|{_ATTRIBUTION}|{_HEADER})"

_ADDRESS = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
_CLOCK = r"(?i)\b(\d{1,2}:\d{2}(?::\d{2})?\s*(?:am\b|pm\b)?)"
_DATES = ("d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy")
_CLOCKS = ("H:mm:ss", "H:mm", "h:mm:ss a", "h:mm a")


def _plain(text: Column) -> Column:
    """Without the marks of quoted lines and white space at the ends of lines."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^(?:[ \t]*>)+ ?", ""), r"(?m)[ \t]+$", "")


def blocks(body: Column) -> Column:
    """array<struct<depth, kind, sentinel, text>>: the parts of a body in order; empty for null.

    A part with neither a boundary nor text is left out.  `--` alone on a line ends the
    text of its part.  `kind` is visible, forward, attribution or header.
    """
    # marks that no text has: a body's own pair of these characters is parted by a space
    start, end = "\x01\x02", "\x02\x01"
    body = F.regexp_replace(F.coalesce(body, F.lit("")), "\r\n?", "\n")
    body = F.regexp_replace(body, "(?<=\x01)(?=\x02)|(?<=\x02)(?=\x01)", " ")
    body = F.regexp_replace(body, "\u00a0", " ")
    parts = F.split(F.regexp_replace(body, _BOUNDARY, f"{start}$0{end}"), start, -1)

    def one(part: Column) -> Column:
        has = part.contains(end)
        raw = F.when(has, F.substring_index(part, end, 1)).otherwise("")
        first = F.regexp_extract(F.when(has, raw).otherwise(part), r"^[ \t>]*", 0)
        sentinel = F.trim(_plain(raw))
        text = _plain(F.when(has, F.substring_index(part, end, -1)).otherwise(part))
        text = F.regexp_replace(text, r"(?ms)^--$.*", "")
        text = F.regexp_replace(F.regexp_replace(text, r"\A(?:\s*\n)+", ""), r"\s+\z", "")
        kind = (
            F.when(~has, "visible")
            .when(sentinel.rlike(rf"{_FLAGS}\A(?:{_NAMED}|{_BARE})"), "forward")
            .when(sentinel.rlike(rf"{_FLAGS}\A{_OPEN}"), "attribution")
            .otherwise("header")
        )
        return F.struct(
            (F.length(first) - F.length(F.replace(first, F.lit(">"), F.lit("")))).alias("depth"), kind.alias("kind"), sentinel.alias("sentinel"), text.alias("text")
        )

    return F.filter(F.transform(parts, one), lambda b: (b["sentinel"] != "") | (b["text"] != ""))


def sent_at(text: Column) -> Column:
    """The wall clock that a sentinel or a Date value states, as a timestamp read in UTC; null if it has no date before its clock."""
    clock = F.regexp_extract(text, _CLOCK, 1)
    date = F.regexp_extract(text, r"(?s)^(.*?)\b\d{1,2}:\d{2}", 1)
    date = F.regexp_replace(F.regexp_replace(date, r"(?i)\bsept\b\.?", "Sep"), r"\b(\d{1,2})\.( )", "$1$2")
    date = F.regexp_extract(date, r"(\d{1,2} \p{L}{3,9},? \d{4}|\p{L}{3,9} \d{1,2}, \d{4})[\s,]*(?:at|kl|à|um|alle|as)?[\s,]*$", 1)
    date = F.regexp_replace(date, r"(\p{L}), (\d{4})$", "$1 $2")
    day = F.coalesce(*[F.try_to_timestamp(date, F.lit(f)) for f in _DATES])
    clock = F.upper(F.trim(F.regexp_replace(F.regexp_replace(clock, r"\s+", " "), r"(?i)(\d)([ap]m)", "$1 $2")))
    at = F.coalesce(*[F.try_to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd "), clock), F.lit(f"yyyy-MM-dd {c}")) for c in _CLOCKS])
    return F.when(clock != "", F.coalesce(at, day))


def _person(text: Column) -> tuple[Column, Column]:
    """Name and address of `Name <address>`; a repeated mailto: address is not the name."""
    address = F.regexp_extract(text, _ADDRESS, 0)
    before = F.when(address != "", F.regexp_extract(text, rf"(?s)^(.*?){_ADDRESS}", 1)).otherwise(text)
    name = F.trim(F.regexp_replace(F.regexp_replace(before, r"[ <(\[,:]+$", ""), r"^[ \"',:]+|[ \"',:]+$", ""))
    name = F.when(F.lower(name).isin("mailto", "") | (name == address), None).otherwise(name)
    return name, F.when(address != "", address)


def _value(sentinel: Column, field: str) -> Column:
    """What the header lines of a field hold, folded lines included; several are joined by a comma."""
    line = rf"(?imu)^\*?(?:{'|'.join(FIELDS[field])})\*?[ \t]*:\*?[ \t]*([^\n]*(?:\n(?!\*?[\p{{L}}-]{{2,12}}\*?[ \t]*:)[^\n]*)*)"
    found = F.filter(F.transform(F.regexp_extract_all(sentinel, F.lit(line), F.lit(1)), lambda v: collapse(v)), lambda v: v != "")
    value = F.array_join(found, ", ") if field == "cc" else F.get(F.reverse(found), F.lit(0))
    return F.when(value != "", value)


def recover(entries: DataFrame, entry: str = "entry_id", body: str = "text") -> DataFrame:
    """A row for each block: entry_id, block (from 0), depth, kind, sentinel, text, sender, address, sent, subject, to, cc, key.

    `key` names the underlying message: a stated message id, else address and stated
    time, else the collapsed text.  `sent` is a wall clock, as no zone is applied.
    """
    rows = entries.select(F.col(entry).alias("entry_id"), F.posexplode(blocks(F.col(body))).alias("block", "b")).select("entry_id", "block", "b.*")
    bare = F.col("kind").isin("attribution", "visible")
    flat = collapse(F.col("sentinel"))
    head = F.regexp_replace(flat, rf"{_FLAGS}\A{_OPEN}[\s,]*", "")
    # the person stands behind the clock and its zone, before the last closing word
    behind = F.regexp_replace(head, rf"(?imu)^.*?\b\d{{1,2}}:\d{{2}}(?::\d{{2}})?\s*(?:am\b|pm\b)?(?:[\s,]*(?:(?-i:[A-Z]{{2,5}})\b|[+-]\d{{4}}\b))?", "")
    behind = F.regexp_replace(behind, rf"(?imsu){_CLOSE}(?!.*{_CLOSE}).*", "")
    who, where = _person(F.trim(behind))
    sender, address = _person(_value(F.col("sentinel"), "from"))
    when = sent_at(F.when(bare, head).otherwise(_value(F.col("sentinel"), "date")))
    out = rows.withColumns(
        {
            "sender": F.when(F.col("kind") == "attribution", who).when(~bare, sender),
            "address": F.when(F.col("kind") == "attribution", where).when(~bare, address),
            "sent": F.when(F.col("kind") != "visible", when),
            **{f: F.when(~bare, _value(F.col("sentinel"), f)) for f in ("subject", "to", "cc", "message_id")},
        }
    )
    half = lambda *parts: F.substring(F.sha2(F.concat_ws("\x00", *parts).cast("binary"), 256), 1, 32)
    stated = F.concat(F.lit("quote:"), half(F.lower("address"), F.date_format("sent", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    key = (
        F.when(F.col("message_id").isNotNull(), F.concat(F.lit("mail:"), F.regexp_replace("message_id", "[<>]", "")))
        .when(F.col("address").isNotNull() & F.col("sent").isNotNull(), stated)
        .otherwise(F.concat(F.lit("quote:t:"), half(collapse(F.col("text")))))
    )
    return out.withColumn("key", key).drop("message_id")


def distinct_blocks(found: DataFrame) -> DataFrame:
    """One row for each entry and key of the quoted blocks: the first place, the longest text, and the first stated value of each field."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("block"))).alias(c)
    # of texts as long, the first
    longest = F.max_by("text", F.struct(F.length("text"), -F.col("block"))).alias("text")
    fields = [first(c) for c in ("sender", "address", "sent", "subject", "to", "cc")]
    return found.where("kind <> 'visible'").groupBy("entry_id", "key").agg(F.min("block").alias("block"), F.min_by("depth", "block").alias("depth"), longest, *fields)


def edges(distinct: DataFrame) -> DataFrame:
    """(entry_id, key, child_key): each quoted message is answered by the one before it in the body; the first by the entry itself, where child_key is null."""
    return distinct.select("entry_id", "key", F.lag("key").over(Window.partitionBy("entry_id").orderBy("block")).alias("child_key"))
