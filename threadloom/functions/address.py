"""Addresses and the names beside them, as column expressions: roles, hosts, words of names, and whether the two agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse

# Local parts of roles, those of them that no human reads, webmail hosts, first
# labels of sending hosts, and middle labels of public suffixes.
ROLES = (
    "abuse accounting accounts admin administration alerts all automation automations billing bookings bot bounce bounces care careers "
    "contact contactus customerservice dev devnull donotreply do-not-reply enquiries enquiry everyone feedback finance help helpdesk hello hi hr "
    "info inquiries invoice invoices jobs legal mail mailer mailer-daemon manager marketing news newsletter no-reply noreply notification "
    "notifications office orders payments payroll postmaster privacy reception recruitment general inbox mailbox procurement pricing quotes "
    "reply rfp root sales security service staff subscriptions support system team tender tenders updates webmaster weekly digest digests"
).split()
UNATTENDED = (
    "alerts automation automations bot bounce bounces devnull digest donotreply do-not-reply mailer mailer-daemon no-reply noreply "
    "notification notifications postmaster system updates"
).split()
WEBMAIL = (
    "aol.com bigpond.com bigpond.net.au gmail.com googlemail.com gmx.com gmx.net hotmail.co.nz hotmail.co.uk hotmail.com hotmail.com.au "
    "icloud.com iinet.net.au internode.on.net live.com live.com.au mac.com me.com msn.com optusnet.com.au outlook.co.nz outlook.com "
    "outlook.com.au proton.me protonmail.com tpg.com.au xtra.co.nz yahoo.co.nz yahoo.com yahoo.com.au ymail.com"
).split()
SENDING = "bounce bounces donotreply do-not-reply no-reply noreply".split()
MIDDLE = "co com net org gov edu ac govt school asn id".split()
#: Fixed value: a mailbox that a tag spells with `=` for its `@`.
_SPELT = r"[A-Za-z0-9._%+\-]+=[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


def local_part(address: Column) -> Column:
    return F.regexp_extract(address, r"(?s)^(.*)@", 1)


def host(address: Column) -> Column:
    """What stands behind the last @, in lower case; empty without one."""
    return F.lower(F.regexp_extract(address, r"(?s)@([^@]*)$", 1))


def clean_name(name: Column) -> Column:
    """A display name without quotes around it and without an opened address behind it; twice, as one can hide the other."""
    once = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r"\s+<$", ""), r"^[\"']+|[\"']+$", "")
    return F.trim(once(once(F.coalesce(name, F.lit("")))))


def mailbox(address: Column) -> Column:
    """struct<base, tag> of user+tag@host; null where there is no tag, no user, or the tag names another mailbox."""
    user, tag = F.regexp_extract(local_part(address), r"(?s)^([^+]+)\+", 1), F.regexp_extract(local_part(address), r"(?s)^[^+]+\+(.*)$", 1)
    other = F.lower(tag).startswith("caf_") | tag.rlike(_SPELT)
    base = F.concat(user, F.lit("@"), F.regexp_extract(address, r"(?s)@([^@]*)$", 1))
    return F.when((user != "") & ~other, F.struct(base.alias("base"), tag.alias("tag")))


def _listed(local: Column, names: list[str]) -> Column:
    own = F.regexp_replace(F.lower(F.trim(local)), r"(?s)(?<=.)\+.*$", "")
    words = F.filter(F.split(own, r"[._\-]"), lambda w: F.length(w) >= 3)
    return own.isin(*names) | F.arrays_overlap(words, F.array(*map(F.lit, names)))


def is_role(local: Column) -> Column:
    """Whether a local part, or a word of three letters or more in it, names a role; a tag behind + does not count."""
    return _listed(local, ROLES)


def is_unattended(local: Column) -> Column:
    """Whether a local part names a sender that is no human."""
    return _listed(local, UNATTENDED)


def is_webmail(domain: Column) -> Column:
    return F.lower(F.trim(domain)).isin(*WEBMAIL)


def is_sending_host(domain: Column) -> Column:
    low = F.lower(F.trim(domain))
    return low.contains(".") & F.substring_index(low, ".", 1).isin(*SENDING)


def name_words(name: Column) -> Column:
    """Words of a name in lower case, two letters or more; what follows a parenthesis or a bar is a remark."""
    plain = F.replace(F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?s)[(|].*", "")), F.lit("'"), F.lit("\x01"))
    words = F.transform(F.regexp_extract_all(plain, F.lit("([a-z0-9\x01]+)"), F.lit(1)), lambda w: F.replace(w, F.lit("\x01"), F.lit("")))
    return F.filter(words, lambda w: F.length(w) >= 2)


def name_parts(name: Column) -> Column:
    """struct<first, surname> of `name_words`: the first of them, and the others, null if there are none; null for no words and for addresses."""
    words = name_words(name)
    surname = F.when(F.size(words) > 1, F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " "))
    return F.when((F.size(words) > 0) & ~name.contains("@"), F.struct(F.get(words, F.lit(0)).alias("first"), surname.alias("surname")))


def _squashed(local: Column) -> Column:
    return F.regexp_replace(F.lower(local), "[^a-z0-9]", "")


def address_names(local: Column, name: Column) -> Column:
    """Whether a local part agrees with a name: it holds a word of three letters or more, or is an initial and the beginning, of four letters or more, of another word."""
    own, words = _squashed(local), name_words(name)
    rest = F.substring(own, 2, 1 << 20)
    held = F.exists(words, lambda w: (F.length(w) >= 3) & F.contains(own, w))
    first = F.filter(words, lambda w: F.substring(w, 1, 1) == F.substring(own, 1, 1))
    spelt = F.exists(first, lambda i: F.exists(words, lambda w: (w != i) & F.startswith(w, rest)))
    return (own != "") & (held | ((F.length(rest) >= 4) & spelt))


def local_spells(address: Column, name: Column) -> Column:
    """Whether the local part holds every word of a name of three letters or more, of which there are words."""
    own, words = _squashed(local_part(address)), name_words(name)
    return address.contains("@") & (F.size(words) > 0) & F.forall(words, lambda w: (F.length(w) < 3) | F.contains(own, w))


def welded(value: Column) -> Column:
    """struct<name, address> of a name that an opened address is welded to; null for others."""
    name, address = F.trim(F.regexp_extract(value, r"(?s)^([^<]+?)\s*<([^<>\s]+@[^<>\s]+)>?\s*$", 1)), F.lower(F.regexp_extract(value, r"(?s)^([^<]+?)\s*<([^<>\s]+@[^<>\s]+)>?\s*$", 2))
    return F.when(address != "", F.struct(name.alias("name"), address.alias("address")))


def contradiction(a: Column, b: Column) -> Column:
    """Why two names cannot be of one human: first names or surnames that both state and that differ; null if nothing speaks against it."""
    x, y = name_parts(a), name_parts(b)
    both = lambda p: F.array_join(F.sort_array(F.array(x[p], y[p])), ", ")
    return F.when(x["first"] != y["first"], F.concat(F.lit("different first names: "), both("first"))).when(x["surname"] != y["surname"], F.concat(F.lit("different surnames: "), both("surname")))


def organisation(address: Column, overrides: dict[str, str] | None = None) -> Column:
    """The organisation of a mail host: as overridden, none for webmail, else the label left of the public suffix with a capital."""
    domain = host(address)
    labels = F.split(domain, r"\.")
    kept = F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0)))
    kept = F.when((F.size(kept) > 1) & F.element_at(kept, -1).isin(*MIDDLE), F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
    label = F.element_at(kept, -1)
    guess = F.when(~is_webmail(domain) & (F.size(labels) > 1), F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 1 << 20)))
    given = F.create_map(*[F.lit(x) for p in (overrides or {}).items() for x in p]) if overrides else None
    return F.coalesce(F.try_element_at(given, domain), guess) if overrides else guess


def initials(name: Column) -> Column:
    """First letters of the words of a name, as capitals."""
    return F.array_join(F.transform(F.filter(F.split(collapse(name), " "), lambda w: w != ""), lambda w: F.upper(F.substring(w, 1, 1))), "")
