"""People and the names and addresses they are known by: resolution, and plans of merges.

A plan is a table of decisions with reasons; `repoint` applies one to any table.  Rules
refuse where more than one answer is possible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import contradiction, is_role, local_part, name_parts
from ..functions.text import base_address, collapse, mail_domain, normalise_identity
from .groups import groups


def resolve(mentions: DataFrame) -> DataFrame:
    """(kind, value, person_id, name) of mentions (kind, value, name, ts).

    One person for each normalised identity; tags of plus addresses go to the person of
    the base mailbox.  The name is the earliest that is not an address; null if none is.
    """
    value = normalise_identity(F.col("kind"), F.col("value"))
    known = mentions.select("kind", value.alias("value"), F.when(collapse(F.col("name")) != "", collapse(F.col("name"))).alias("name"), "ts").where("value IS NOT NULL")
    anchor = F.when(F.col("kind") == "email", base_address(F.col("value"))).otherwise(F.col("value"))
    ids = known.withColumn("person_id", F.xxhash64("kind", anchor))
    real = F.col("name").isNotNull() & ~F.col("name").contains("@")
    names = ids.groupBy("person_id").agg(F.min_by(F.when(real, F.col("name")), F.when(real, F.struct("ts", "name"))).alias("name"))
    return ids.select("kind", "value", "person_id").distinct().join(names, "person_id").select("kind", "value", "person_id", "name")


def plus_plan(identities: DataFrame) -> DataFrame:
    """(person_id, value, base, decision, keep_id) for each plus address of (kind, value, person_id).

    merge: another person holds the base; same: the own person does; rename: nobody does.
    """
    mails = identities.where("kind = 'email'").select("person_id", "value")
    tagged = mails.where(base_address(F.col("value")) != F.col("value")).withColumn("base", base_address(F.col("value")))
    holders = mails.groupBy(F.col("value").alias("base")).agg(F.min("person_id").alias("keep_id"))
    decision = F.when(F.col("keep_id").isNull(), "rename").when(F.col("keep_id") == F.col("person_id"), "same").otherwise("merge")
    return tagged.join(holders, "base", "left").select("person_id", "value", "base", decision.alias("decision"), "keep_id")


def domain_plan(identities: DataFrame, old: str, to: str, names: DataFrame | None = None) -> DataFrame:
    """(drop_id, keep_id, value): holders of an address at the old domain and of the same local part at the new one.

    With `names` (person_id, name) there is `refused` too: the local part is a role's, or
    the names of the two cannot be of one human; null where nothing speaks against it.
    """
    mails = identities.where("kind = 'email'").select("person_id", "value", mail_domain(F.col("value")).alias("domain"))
    a = mails.where(F.col("domain") == old).select(F.col("person_id").alias("drop_id"), F.concat(F.substring_index("value", "@", 1), F.lit("@" + to)).alias("value"))
    b = mails.where(F.col("domain") == to).select(F.col("person_id").alias("keep_id"), "value")
    found = a.join(b, "value").where("drop_id <> keep_id").select("drop_id", "keep_id", "value").distinct()
    if names is None:
        return found
    called = lambda of, name: names.groupBy(F.col("person_id").alias(of)).agg(F.min("name").alias(name))
    both = found.join(called("drop_id", "dropped"), "drop_id", "left").join(called("keep_id", "kept"), "keep_id", "left")
    refused = F.when(is_role(local_part(F.col("value"))), "role mailbox").otherwise(contradiction(F.col("dropped"), F.col("kept")))
    return both.select("drop_id", "keep_id", "value", refused.alias("refused"))


def merge_candidates(identities: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b, reasons): people who may be the same, a being the smallest id of its group and b another of it.

    Groups are those of one local part (roles aside) at several domains and of one display
    name.  Members are paired with the first of their group, so a group of n gives n - 1
    rows and no member is lost.
    """
    local = F.substring_index("value", "@", 1)
    mails = identities.where("kind = 'email'").select("person_id", local.alias("key"), F.lit("same local part").alias("reason"))
    keyed = mails.where(~is_role(F.col("key"))).unionByName(names.where("name IS NOT NULL").select("person_id", F.lower("name").alias("key"), F.lit("same name").alias("reason"))).distinct()
    first = keyed.groupBy("reason", "key").agg(F.min("person_id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = keyed.join(first, ["reason", "key"]).where("person_id > a")
    return pairs.groupBy("a", F.col("person_id").alias("b")).agg(F.array_join(F.sort_array(F.collect_set("reason")), "; ").alias("reasons"))


def first_name_plan(people: DataFrame) -> DataFrame:
    """(person_id, group, decision, keep_id) of people (person_id, name, org, messages) who share a first name at an organisation.

    refuse: the group has two surnames or more; keep: the survivor, who has a surname,
    then most messages, then the smallest id; merge: the others.  Groups of one, and
    people whose name is an address or has no words, are left out.
    """
    named = people.where("org IS NOT NULL").withColumn("parts", name_parts(F.col("name"))).where("parts IS NOT NULL")
    own = named.select("person_id", "messages", F.concat_ws("@", "parts.first", F.lower("org")).alias("group"), F.col("parts.surname").alias("surname"))
    best = F.max_by("person_id", F.struct(F.col("surname").isNotNull(), F.coalesce("messages", F.lit(0)), -F.col("person_id"))).alias("keep_id")
    groups = own.groupBy("group").agg(F.count("*").alias("n"), F.countDistinct("surname").alias("surnames"), best).where("n > 1")
    decision = F.when(F.col("surnames") > 1, "refuse").when(F.col("person_id") == F.col("keep_id"), "keep").otherwise("merge")
    return own.join(groups, "group").select("person_id", "group", decision.alias("decision"), F.when(F.col("surnames") <= 1, F.col("keep_id")).alias("keep_id"))


def survivors(merges: DataFrame) -> DataFrame:
    """(drop_id, keep_id) with chains of merges of any length followed to their last survivor.

    Each id is dropped once at most, so a group of merges has one id that none drops; a
    circle of merges has none and is left out.
    """
    members = groups(merges, "drop_id", "keep_id")
    dropped = merges.select(F.col("drop_id").alias("node"))
    last = members.join(dropped, "node", "left_anti").select("group", F.col("node").alias("keep_id"))
    return members.join(dropped.distinct(), "node", "left_semi").join(last, "group").select(F.col("node").alias("drop_id"), "keep_id")


def repoint(rows: DataFrame, column: str, mapping: DataFrame, once: bool = False) -> DataFrame:
    """Rows with every dropped id replaced by its survivor; with `once`, rows that become equal count once."""
    name: Column = F.coalesce("keep_id", column).alias(column)
    out = rows.join(mapping, F.col(column) == F.col("drop_id"), "left").select(*[name if c == column else F.col(c) for c in rows.columns])
    return out.distinct() if once else out


def shares_every(asked: DataFrame, participants: DataFrame, entries: DataFrame, by: str = "entry_id") -> DataFrame:
    """Pairs of `asked` (person_id, other) whose other takes part in every entry of the person, or for `by` container in the thread of each.

    Participants are (entry_id, person_id), entries (entry_id, container).  A person on no
    entry has no such pair, and neither has one of an entry without a container.
    """
    part = participants.select("entry_id", "person_id").distinct()
    where = part.join(entries.select("entry_id", "container"), "entry_id") if by == "container" else part
    own = asked.distinct().join(where.select("person_id", by).distinct(), "person_id")
    there = where.select(F.col("person_id").alias("other"), by, F.lit(True).alias("met")).where(F.col(by).isNotNull()).distinct()
    met = own.join(there, ["other", by], "left").groupBy("person_id", "other").agg(F.bool_and(F.coalesce("met", F.lit(False))).alias("all"))
    return met.where("all").select("person_id", "other")


def weights(participants: DataFrame) -> DataFrame:
    """(person_id, weight): how many entries each person takes part in."""
    return participants.select("entry_id", "person_id").distinct().groupBy("person_id").agg(F.count("*").alias("weight"))


def sole_domains(identities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(person_id, domain) of people with one mail domain only, once the aliases (old, to) are followed one step."""
    mails = identities.where("kind = 'email'").select("person_id", mail_domain(F.col("value")).alias("domain")).where("domain <> ''")
    named = mails.join(aliases.select(F.col("old").alias("domain"), "to"), "domain", "left").select("person_id", F.coalesce("to", "domain").alias("domain"))
    return named.groupBy("person_id").agg(F.min("domain").alias("domain"), F.max("domain").alias("last")).where("domain = last").select("person_id", "domain")
