"""Address lists, dates and casts of timelines."""

import random
from email.utils import formataddr, getaddresses, parsedate_to_datetime

import numpy as np
from pyspark.sql import functions as F

from threadloom.functions import headers
from threadloom.operators import cast


def each(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[1] for r in sorted(df.select("i", f(F.col("v")).alias("o")).collect())]


def listed(spark, values):
    return [[tuple(a) for a in r] for r in each(spark, values, headers.addresses)]


def test_addresses(spark):
    cases = {
        None: [], " ": [], ", ;,": [],
        "A@X.org": [("a@x.org", "")],
        "Ann Ray <Ann@x.org>, bob@y.org": [("ann@x.org", "Ann Ray"), ("bob@y.org", "")],
        '"Ray, Ann" <ann@x.org>; "B \\"Bo\\" Lee" <b@y.org>': [("ann@x.org", "Ray, Ann"), ("b@y.org", 'B "Bo" Lee')],
        "ann@x.org (Ann, Ray)": [("ann@x.org", "Ann, Ray")],
        "Ann (the (first) one) <ann@x.org>": [("ann@x.org", "Ann")],
        "Team: ann@x.org, Bob <b@y.org>;": [("ann@x.org", ""), ("b@y.org", "Bob")],
        "undisclosed-recipients:;": [],
        "Ann\r\n Ray <ann@x.org>,\r\n\tb@y.org": [("ann@x.org", "Ann Ray"), ("b@y.org", "")],
        "=?UTF-8?B?w4RubmU=?= <a@x.org>": [("a@x.org", "Änne")],
        "=?utf-8?q?J=C3=BCrg_?= =?utf-8?q?Ott?= <j@x.org>": [("j@x.org", "Jürg Ott")],
        "=?koi8-r?q?=C1?= <a@x.org>": [("a@x.org", "=?koi8-r?q?=C1?=")],
        "Ann Ray <ann@x.org": [("ann@x.org", "Ann Ray")],
        "Ann Ray": [(None, "Ann Ray")],
        "Ann <mailto:ann@x.org>": [("ann@x.org", "Ann")],
        "ann@x.org<mailto:ann@x.org>": [("ann@x.org", "")],
        "<@a,@b:ann@x.org>": [("ann@x.org", "")],
    }
    got = listed(spark, list(cases))
    assert dict(zip(cases, got)) == cases


def test_addresses_as_the_standard_library_writes_them(spark):
    r = random.Random(3)
    pick = lambda s, n: "".join(r.choice(s) for _ in range(n))
    lines = []
    for _ in range(300):
        some = [(pick('ab ,;<>()"\\.@é', r.randint(0, 9)).strip(), f"{pick('abc.+', 3).strip('.') or 'q'}@{pick('xyz', 3)}.org") for _ in range(r.randint(1, 4))]
        lines.append(", ".join(formataddr((" ".join(n.split()), a), "utf-8") for n, a in some))
    for line, got in zip(lines, listed(spark, lines)):
        from email.header import decode_header, make_header

        want = [(a.lower(), " ".join(str(make_header(decode_header(n))).split())) for n, a in getaddresses([line])]
        assert [a for a, _ in got] == [a for a, _ in want], line
        assert [" ".join(n.split()) for _, n in got] == [n for _, n in want], line


def test_dates(spark):
    texts = ["Thu, 7 May 2026 04:38:09 +1000", "7 May 2026 04:38 -0330", "Thu, 7 May 26 04:38:09 GMT", "Mon, 1 Jan 99 00:00:00 EST", "Thu, 07 May 2026 04:38:09 +0000 (UTC)", "29 Feb 2024 10:00:00 +0545"]
    for text, got in zip(texts, each(spark, texts, headers.header_date)):
        assert got["at"] == int(parsedate_to_datetime(text).timestamp()), text
        assert got["offset"] * 60 == (parsedate_to_datetime(text).utcoffset() or __import__("datetime").timedelta()).total_seconds()
    assert each(spark, ["Thu, 7 May 2026 04:38:09 XYZ"], headers.header_date)[0]["label"] == "XYZ"
    assert each(spark, [None, "", "yesterday", "30 Feb 2026 10:00 +0000", "7 May 2026 25:00 +0000", "7 May 2026 10:00", "7 May 2026 10:00 +2400"], headers.header_date) == [None] * 7


def folded(mentions):
    rows, key = [], {}
    for person, address, name, others, org, named, direct in mentions:
        if not name and not address:
            continue
        own = ([("p", person)] if person is not None else []) + ([("a", address)] if address else [])
        own = own or [("n", name.lower())]
        k = next((key[a] for a in own if a in key), None)
        if k is None:
            k = len(rows)
            rows.append(["", "", "", True])
        for a in own:
            key[a] = k
        for a in others:
            key.setdefault(("a", a), k)
        row = rows[k]
        row[0] = (name or address) if named or not row[0] else row[0]
        row[1] = row[1] or address
        row[2] = org if org and (named or not row[2]) else row[2]
        row[3] = row[3] and not direct
    return [tuple(x) for x in rows]


def test_cast(spark):
    r = np.random.default_rng(2)
    rows = []
    for pos in range(600):
        who = int(r.integers(0, 12))
        at = lambda k: f"u{k % 14}@x.org"
        rows.append((f"t{pos % 3}", pos, who if r.random() < 0.5 else None, at(who + int(r.integers(0, 3))) if r.random() < 0.6 else None, f"Name {who} {int(r.integers(0, 3))}" if r.random() < 0.8 else None, [at(who + 5)] if r.random() < 0.2 else None, f"org{who % 4}" if r.random() < 0.4 else None, bool(r.random() < 0.4), bool(r.random() < 0.3)))
    df = spark.createDataFrame(rows, "timeline string, pos long, person long, address string, name string, others array<string>, org string, named boolean, direct boolean").repartition(4)
    seated = cast.people(df)
    got = {}
    for x in sorted(seated.collect(), key=lambda x: (x["timeline"], x["seat"])):
        got.setdefault(x["timeline"], []).append((x["name"], x["email"], x["org"], x["quoted_only"]))
    for t in ("t0", "t1", "t2"):
        assert got[t] == folded([(p, a or "", n or "", o or [], g or "", nm, d) for tt, _, p, a, n, o, g, nm, d in rows if tt == t])
    assert cast.unseated(df, seated).count() == 0 and cast.unseated(df, seated.where("seat > 1")).count() > 0
    assert cast.people(df.limit(0)).count() == 0


def test_parts_of_addresses_are_found_once(spark, capsys):
    spark.createDataFrame([("a",)], "h string").select(headers.addresses(F.col("h"))).explain(True)
    shown = capsys.readouterr().out.split("== Physical Plan ==")[1]
    assert shown.count("regexp_") < 300, shown.count("regexp_")
