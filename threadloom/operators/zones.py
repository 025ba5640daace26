"""Which zone an unlabelled clock was written in, from where people are and who quotes whom.

A quoted message carries the clock of the client that quoted it, so the offsets of its
quoters' authors are its candidates; that a message is older than what quotes it rules
candidates out.  One candidate left is an inference, and an inferred clock narrows what
its neighbours can be.

Messages are settled in passes, in the order of their ids: within a pass a message sees
what earlier ids settled in the same pass, and of later ids what earlier passes did.
That order is kept without going through it: each settled message has the pass it
settles in, `t`; a neighbour sees it from pass t on if the neighbour's id is larger, else
from t + 1 on.  A candidate falls in the first pass that shows a neighbour ruling it out;
a message settles in the pass in which its last but one candidate falls.  Rounds over all
messages at once repeat this until no `t` changes.  A settled message rests on ones with
smaller (t, id) alone, so there is exactly one such end, and it is the ordered one; the
number of rounds is that of the longest line of inferences that rest on each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import LEAST, MOST, format_offset, zone_offset
from ..tables import written

#: The zones a person may be placed in, likeliest first.
ZONES = (
    "Australia/Sydney", "America/Los_Angeles", "Asia/Singapore", "Asia/Dhaka", "Europe/London", "Asia/Karachi", "Asia/Kolkata",
    "Pacific/Auckland", "Australia/Brisbane", "Australia/Perth", "Australia/Adelaide", "Australia/Darwin", "Asia/Kathmandu",
    "Asia/Colombo", "Asia/Manila", "Asia/Shanghai", "Asia/Tokyo", "Asia/Jakarta", "Asia/Bangkok", "Asia/Dubai", "Asia/Jerusalem",
    "Europe/Berlin", "Europe/Lisbon", "Europe/Moscow", "UTC", "Africa/Nairobi", "Africa/Johannesburg", "Africa/Lagos",
    "America/Denver", "America/Phoenix", "America/Chicago", "America/New_York", "America/Bogota", "America/Sao_Paulo",
    "America/Halifax", "America/Anchorage", "Pacific/Honolulu", "Pacific/Fiji", "Pacific/Chatham",
)
NEVER = 1 << 40


def observations(entries: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """(person, at, offset, measured): stated offsets of entries (person, wall, offset), and measured ones (person, at, offset).

    Rows without a person or an offset say nothing and are left out.
    """
    one = lambda df, at, is_measured: df.where("person IS NOT NULL AND offset IS NOT NULL").select("person", F.col(at).cast("long").alias("at"), F.col("offset").cast("int").alias("offset"), F.lit(is_measured).alias("measured"))
    stated = one(entries, "wall", False)
    return stated if measured is None else stated.unionByName(one(measured, "at", True))


def places(observed: DataFrame, zones: tuple[str, ...] = ZONES) -> DataFrame:
    """(person, verdict, zones, seen, stated, measured, bare) of everyone with an observation.

    Offsets of 0 are what a client writes that knows no zone: they are counted in `bare`
    and else left aside.  The verdict is utc where nothing else is left, placed where a
    zone gives every other offset at its time (`zones`, in the order given), else moved.
    A person's observations are folded, a flag for each zone, so none are gathered.
    """
    real = F.col("offset") != 0
    at = F.timestamp_seconds("at")
    flags = [F.bool_and(F.when(real, zone_offset(at, F.lit(z)) == F.col("offset"))).alias(f"z{i}") for i, z in enumerate(zones)]
    per = observed.groupBy("person").agg(
        F.array_sort(F.collect_set(F.when(real, F.col("offset")))).alias("seen"),
        F.count_if(real & ~F.col("measured")).alias("stated"),
        F.count_if(real & F.col("measured")).alias("measured"),
        F.count_if(~real).alias("bare"),
        *flags,
    )
    fits = F.filter(F.array(*[F.when(F.col(f"z{i}"), F.lit(z)) for i, z in enumerate(zones)]), lambda x: x.isNotNull())
    verdict = F.when(F.size("seen") == 0, "utc").when(F.size(fits) > 0, "placed").otherwise("moved")
    return per.select("person", verdict.alias("verdict"), fits.alias("zones"), "seen", "stated", "measured", "bare")


def candidates(verdict: Column, zones: Column, seen: Column, lo: Column, hi: Column) -> Column:
    """Offsets that a person's clock may show between two instants (seconds), likeliest first: of both ends, as summer time may start in between."""
    first, last = F.timestamp_seconds(lo), F.timestamp_seconds(hi)
    of_zones = F.array_distinct(F.flatten(F.transform(zones, lambda z: F.array(zone_offset(first, z), zone_offset(last, z)))))
    return F.when(verdict == "placed", of_zones).when(verdict == "moved", seen).otherwise(F.array().cast("array<int>"))


def _listed(offsets: Column) -> Column:
    return F.array_join(F.transform(offsets, format_offset), ", ")


def why(verdict: Column) -> Column:
    """What a verdict rests on; of a row of `places`, with nulls where there is none."""
    counts = F.concat(F.col("stated").cast("string"), F.lit(" stated and "), F.col("measured").cast("string"), F.lit(" measured"))
    return (
        F.when(verdict == "placed", F.concat(F.get("zones", F.lit(0)), F.lit(" gives all offsets: "), counts))
        .when(verdict == "moved", F.concat(F.lit("no zone gives all of "), _listed(F.col("seen"))))
        .when(verdict == "utc", F.concat(F.lit("+0000 alone, "), F.col("bare").cast("string"), F.lit(" times")))
        .otherwise("no offset known")
    )


def _settled(fallen: DataFrame) -> DataFrame:
    """(id, t, offset) of the messages that settle, from (id, offset, falls), the pass in which each candidate falls."""
    last = F.slice(F.sort_array(F.collect_list(F.struct("falls", "offset")), asc=False), 1, 2)
    per = fallen.groupBy("id").agg(last.alias("last"))
    t = F.greatest(F.lit(1), F.coalesce(F.get("last", F.lit(1))["falls"], F.lit(1))).cast("long")
    return per.select("id", t.alias("t"), F.get("last", F.lit(0))["offset"].alias("offset"), F.get("last", F.lit(0))["falls"].alias("until")).where("t < until").drop("until")


def resolve(nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, state, offset, offered, left, evidence) of every message.

    `nodes` has id (unique), parent (what it replies to), person, wall (seconds: the
    instant, or the clock as written where offset is null) and offset in minutes; `placed`
    is of `places`.  The state is stated, inferred (then offset is the one found),
    ambiguous (`left` candidates of those `offered`), rejected (all offered ones fell) or
    unknown.  A parent that is not in `nodes` counts as none, as does a null one; cycles
    of parents end; a null wall has no candidates and binds nobody.
    """
    half = F.when(F.pmod("wall", F.lit(86400)) == 0, 86400).otherwise(0)
    loose = F.col("offset").isNull()
    n = written(nodes.select("id", "parent", "person", F.col("wall").cast("long").alias("wall"), F.col("offset").cast("int").alias("offset")).select(
        "*", F.when(loose, F.col("wall") - MOST * 60).otherwise(F.col("wall")).alias("lo"), F.when(loose, F.col("wall") - LEAST * 60 + half).otherwise(F.col("wall")).alias("hi")))
    side = lambda p: n.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "person", "wall", "offset", "lo", "hi")])
    edges = n.select(F.col("id").alias("c_id"), F.col("person").alias("c_person"), F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"), F.col("parent").alias("p_id")).join(side("p"), "p_id")

    quoted = edges.where("p_offset IS NULL").join(placed.withColumnRenamed("person", "c_person"), "c_person", "left")
    clear = F.col("verdict").isin("placed", "moved")
    quoters = quoted.select(F.col("p_id").alias("id"), "c_id", "p_lo", "p_hi", "verdict", "zones", "seen", F.coalesce(clear, F.lit(False)).alias("clear"), why(F.col("verdict")).alias("why"))
    of = quoters.where("p_lo IS NOT NULL").select("id", "c_id", F.posexplode(candidates(F.col("verdict"), F.col("zones"), F.col("seen"), F.col("p_lo"), F.col("p_hi"))).alias("pos", "offset"))
    offered = of.groupBy("id", "offset").agg(F.min(F.struct("c_id", "pos")).alias("place"))

    # windows that hold whatever is found out later
    lower = edges.select(F.col("c_id").alias("id"), F.col("p_lo").alias("lower"))
    upper = edges.groupBy("p_id").agg(F.min("c_hi").alias("upper")).withColumnRenamed("p_id", "id")
    start = F.col("wall") - F.col("offset") * 60
    within = (F.col("lower").isNull() | (start + 59 >= F.col("lower"))) & (F.col("upper").isNull() | (start <= F.col("upper")))
    base = written(offered.join(n.select("id", "wall"), "id").join(lower, "id", "left").join(upper, "id", "left").select("id", "offset", "place", start.alias("start"), F.when(within, NEVER).otherwise(1).cast("long").alias("falls")))

    open_ids = base.where(F.col("falls") == NEVER).select("id").distinct()
    ends = edges.where("c_id <> p_id").select("c_id", "p_id")
    links = ends.select(F.col("c_id").alias("id"), F.col("p_id").alias("other"), F.lit(True).alias("older")).unionByName(ends.select(F.col("p_id").alias("id"), F.col("c_id").alias("other"), F.lit(False).alias("older")))
    links = written(links.join(open_ids, "id", "left_semi").join(open_ids.select(F.col("id").alias("other")), "other", "left_semi"))

    fallen, known = base.select("id", "offset", "start", "place", "falls"), None
    while True:
        settled = written(_settled(fallen).join(n.select("id", "wall"), "id").select("id", "t", "offset", (F.col("wall") - F.col("offset") * 60).alias("at")))
        if known is not None:
            change = settled.join(known, ["id", "t", "offset"], "left_anti").limit(1).count() + known.join(settled, ["id", "t", "offset"], "left_anti").limit(1).count()
            if not change:
                break
        known = settled
        seen = links.join(settled.select(F.col("id").alias("other"), "t", "at"), "other")
        seen = seen.select("id", "older", "at", (F.col("t") + F.when(F.col("other") > F.col("id"), 1).otherwise(0)).alias("shown"))
        out = F.when(F.col("older"), F.col("start") + 59 < F.col("at")).otherwise(F.col("start") > F.col("at") + 59)
        falls = base.where(F.col("falls") == NEVER).select("id", "offset", "start").join(seen, "id").where(out).groupBy("id", "offset").agg(F.min("shown").alias("shown"))
        fallen = written(base.join(falls, ["id", "offset"], "left").select("id", "offset", "start", "place", F.least("falls", "shown").alias("falls")))

    left = fallen.groupBy("id").agg(
        F.count("*").alias("offered"),
        F.count_if(F.col("falls") == NEVER).alias("left"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("falls") == NEVER, F.struct("place", "offset")))), lambda x: x["offset"]).alias("open"),
    )
    first = quoters.groupBy("id").agg(F.min(F.struct("c_id", "why")).alias("any"), F.min(F.when(F.col("clear"), F.struct("c_id", "why"))).alias("clear"))
    found = settled.select("id", F.col("offset").alias("inferred"))
    rows = n.select("id", "offset").join(left, "id", "left").join(found, "id", "left").join(first, "id", "left")
    state = F.when(F.col("offset").isNotNull(), "stated").when(F.col("inferred").isNotNull(), "inferred").when(F.col("offered").isNull(), "unknown").when(F.col("left") == 0, "rejected").otherwise("ambiguous")
    evidence = (
        F.when(state == "stated", "stated by the source")
        .when(state == "inferred", F.concat(format_offset(F.col("inferred")), F.lit(", of who quoted it: "), F.coalesce("clear.why", F.lit("the one that the order allows"))))
        .when(state == "ambiguous", F.concat(F.lit("one of "), _listed(F.col("open"))))
        .when(state == "rejected", "each offset of who quoted it would put it before what it answers or after what quotes it")
        .otherwise(F.coalesce(F.concat(F.lit("of who quoted it: "), F.col("any.why")), F.lit("quoted by nobody")))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select("id", state.alias("state"), F.coalesce("offset", "inferred").alias("offset"), zero("offered"), zero("left"), evidence.alias("evidence"))


def report(resolved: DataFrame, placed: DataFrame) -> DataFrame:
    """(part, name, n): people by verdict, messages by state, and of those how many inferences the order chose from several offered offsets."""
    people = placed.groupBy(F.col("verdict").alias("name")).agg(F.count("*").alias("n")).select(F.lit("people").alias("part"), "name", "n")
    states = resolved.groupBy(F.col("state").alias("name")).agg(F.count("*").alias("n")).select(F.lit("messages").alias("part"), "name", "n")
    chosen = resolved.agg(F.count_if((F.col("state") == "inferred") & (F.col("offered") > 1)).alias("n")).select(F.lit("messages").alias("part"), F.lit("chosen by order").alias("name"), "n")
    return people.unionByName(states).unionByName(chosen)
