"""Queries over clocks without a zone, each with the SQL that states the same.

Turns stand for messages; who wrote one and at which offset follow from its conversation
and place, so that some people stay, some move, and some write +0000 alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import zones
from .queries import _read, query

#: Zones without summer time, and what they give.
_FIXED = {"America/Phoenix": -420, "America/Bogota": -300, "Africa/Lagos": 60, "Asia/Kolkata": 330, "Asia/Tokyo": 540, "Australia/Brisbane": 600}
#: Rounds of the SQL; a conversation has at most eight turns.
_ROUNDS = 10


def _clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, parent, person, wall, offset): two of three turns state no offset and have the clock of who answered them; some are days off."""
    of = F.array(*map(F.lit, _FIXED.values()))
    person = lambda conv, turn: (conv * 3 + turn) % 40

    def offset(conv, turn):
        p = person(conv, turn)
        home, away = F.get(of, (p * 5 % 6).cast("int")), F.get(of, ((p * 7 + 1) % 6).cast("int"))
        return F.when(p % 4 == 2, 0).when((p % 4 == 0) | (turn % 2 == 0), home).otherwise(away)

    conv, turn = F.col("conv_id"), F.col("turn")
    stated = (conv + turn) % 3 == 0
    ts = 1_600_000_000 + conv * 3600 + turn * 1800 * (1 + conv % 7)
    off_days = F.when((conv % 11 == 0) & (turn % 4 == 1), 3 * 86400).otherwise(0)
    written = F.floor((ts + offset(conv, turn + 1) * 60 + off_days) / 60) * 60
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    return rows.select((conv * 1000 + turn).alias("id"), F.when(turn > 0, conv * 1000 + turn - 1).alias("parent"), person(conv, turn).alias("person"), F.when(stated, ts).otherwise(written).alias("wall"), F.when(stated, offset(conv, turn)).alias("offset"))


_OFFSET = lambda turn: f"""CASE WHEN (conv_id * 3 + {turn}) % 40 % 4 = 2 THEN 0 WHEN (conv_id * 3 + {turn}) % 40 % 4 = 0 OR ({turn}) % 2 = 0
    THEN {list(_FIXED.values())}[(conv_id * 3 + {turn}) % 40 * 5 % 6 + 1] ELSE {list(_FIXED.values())}[((conv_id * 3 + {turn}) % 40 * 7 + 1) % 6 + 1] END"""  # noqa: E731
_CLOCKS = f"""turns AS (SELECT DISTINCT conv_id, turn, 1600000000 + conv_id * 3600 + turn * 1800 * (1 + conv_id % 7) AS ts, (conv_id + turn) % 3 = 0 AS stated FROM conversations),
n AS (
  SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent, (conv_id * 3 + turn) % 40 AS person,
         CASE WHEN stated THEN ts ELSE (ts + {_OFFSET('turn + 1')} * 60 + CASE WHEN conv_id % 11 = 0 AND turn % 4 = 1 THEN 259200 ELSE 0 END) // 60 * 60 END AS wall,
         CASE WHEN stated THEN {_OFFSET('turn')} END AS off FROM turns),
seen AS (SELECT person, list_sort(list(DISTINCT off) FILTER (WHERE off <> 0)) AS seen, count(*) FILTER (WHERE off <> 0) AS stated, count(*) FILTER (WHERE off = 0) AS bare FROM n WHERE off IS NOT NULL GROUP BY 1)"""


def _rounds() -> str:
    """The candidates, and what each round finds out: f (in which pass a candidate falls) and s (in which one a message settles)."""
    settle = lambda f: f"""SELECT id, greatest(1, coalesce(l[2], 1)) AS t, o AS off, wall - o * 60 AS at FROM (SELECT id, list_sort(list(falls), 'DESC') AS l, arg_max(off, falls) AS o FROM {f} GROUP BY 1) JOIN n USING (id) WHERE greatest(1, coalesce(l[2], 1)) < l[1]"""
    out = f"""w AS (SELECT *, CASE WHEN off IS NULL THEN wall - 50400 ELSE wall END AS lo, CASE WHEN off IS NULL THEN wall + 43200 + CASE WHEN wall % 86400 = 0 THEN 86400 ELSE 0 END ELSE wall END AS hi FROM n),
f0 AS (
  SELECT DISTINCT p.id, o.off, p.wall - o.off * 60 AS start,
         CASE WHEN (g.lo IS NULL OR p.wall - o.off * 60 + 59 >= g.lo) AND p.wall - o.off * 60 <= c.hi THEN {zones.NEVER} ELSE 1 END AS falls
  FROM w p JOIN w c ON c.parent = p.id LEFT JOIN w g ON g.id = p.parent JOIN (SELECT person, unnest(seen) AS off FROM seen) o ON o.person = c.person WHERE p.off IS NULL),
s0 AS ({settle('f0')})"""
    for k in range(1, _ROUNDS):
        out += f""",
f{k} AS (
  SELECT f.id, f.off, f.start, least(any_value(f.falls), coalesce(min(s.t + CASE WHEN s.id > f.id THEN 1 ELSE 0 END) FILTER (WHERE CASE WHEN s.id < f.id THEN f.start + 59 < s.at ELSE f.start > s.at + 59 END), {zones.NEVER})) AS falls
  FROM f0 f LEFT JOIN s{k - 1} s ON s.id IN (f.id - 1, f.id + 1) GROUP BY ALL),
s{k} AS ({settle(f'f{k}')})"""
    return out


_RESOLVED = f"""{_CLOCKS}, {_rounds()},
r AS (
  SELECT n.id, CASE WHEN n.off IS NOT NULL THEN 'stated' WHEN s.id IS NOT NULL THEN 'inferred' WHEN f.id IS NULL THEN 'unknown' WHEN f.l = 0 THEN 'rejected' ELSE 'ambiguous' END AS state,
         coalesce(n.off, s.off)::INTEGER AS "offset", coalesce(f.o, 0) AS offered, coalesce(f.l, 0) AS "left"
  FROM n LEFT JOIN s{_ROUNDS - 1} s USING (id) LEFT JOIN (SELECT id, count(*) AS o, count(*) FILTER (WHERE falls = {zones.NEVER}) AS l FROM f{_ROUNDS - 1} GROUP BY 1) f USING (id)),
people AS (SELECT person, CASE WHEN len(coalesce(seen, [])) = 0 THEN 'utc' WHEN len(seen) = 1 THEN 'placed' ELSE 'moved' END AS verdict, coalesce(seen, []) AS seen, stated, bare FROM seen)"""


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = _clocks(spark, sf_dir)
    placed = zones.places(zones.observations(n), tuple(_FIXED))
    return zones.resolve(n, placed), placed


@query(f"""WITH {_CLOCKS} SELECT person, CASE WHEN len(coalesce(seen, [])) = 0 THEN 'utc' WHEN len(seen) = 1 THEN 'placed' ELSE 'moved' END AS verdict,
 CASE WHEN len(seen) = 1 THEN map({list(_FIXED.values())}, {list(_FIXED)})[seen[1]] END AS zone, array_to_string(coalesce(seen, []), ',') AS seen, stated, bare FROM seen""")
def zone_places(spark, sf_dir):
    placed = zones.places(zones.observations(_clocks(spark, sf_dir)), tuple(_FIXED))
    return placed.select("person", "verdict", F.get("zones", F.lit(0)).alias("zone"), F.array_join(F.col("seen").cast("array<string>"), ",").alias("seen"), "stated", "bare")


@query(f"WITH {_RESOLVED} SELECT * FROM r")
def zone_states(spark, sf_dir):
    return _resolved(spark, sf_dir)[0].drop("evidence")


@query(f"""WITH {_RESOLVED} SELECT 'people' AS part, verdict AS name, count(*) AS n FROM people GROUP BY ALL
UNION ALL SELECT 'messages', state, count(*) FROM r GROUP BY ALL
UNION ALL SELECT 'messages', 'chosen by order', count(*) FILTER (WHERE state = 'inferred' AND offered > 1) FROM r""")
def zone_report(spark, sf_dir):
    return zones.report(*_resolved(spark, sf_dir))
