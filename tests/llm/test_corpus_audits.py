"""Decontamination, runs and divergence against plain versions, on odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import decontaminate, divergence, periods
from threadloom.llm.queries import repeated_tail

ODD = [None, "", " \n", "one", "Ünï ÇÀ", "a" * 300_000, "z " * 50_000, "\n" * 100_000]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def same_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def plain_overlaps(docs, items):
    known = []
    for item, text in items:
        w = same_words(text)
        span = min(10, len(w))
        known += [(item, tuple(w[i : i + span])) for i in range(len(w) - span + 1) if span]
    of = {}
    for item, key in known:
        of.setdefault(key, set()).add(item)
    spans = {len(k) for k in of}
    for doc, text in docs:
        w = same_words(text)
        hit, found = set(), set()
        for span in spans:
            for i in range(len(w) - span + 1):
                if (k := tuple(w[i : i + span])) in of:
                    hit |= set(range(i, i + span))
                    found |= of[k]
        names = sorted(str(x) for x in found if x is not None)
        yield doc, len(w), len(hit), len(names), digest(",".join(names)), bool(hit)


def overlapping():
    r = np.random.default_rng(5)
    some = lambda n, k=40: " ".join(f"Wör{i}" if i % 5 == 0 else f"w{i}" for i in r.integers(0, k, n))
    items = [(i, some(n)) for i, n in enumerate([10, 11, 25, 60, 9, 5, 2, 1])] + [(20, some(30)), (20, some(14)), (21, None), (22, " ."), (None, some(12)), (3, "x " * 40)]
    items += [(31, items[2][1]), (32, items[3][1][:200])]
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, items[0][1]), (7, items[2][1].upper().replace("Ö", "ö"))]
    for i in range(60):
        parts = [some(int(r.integers(0, 30)), 9 if i % 7 == 0 else 400)]
        for _ in range(int(r.integers(0, 4))):
            w = items[int(r.integers(0, len(items)))][1] or ""
            w = w.split()
            a = int(r.integers(0, len(w) + 1))
            parts += [", ".join(w[a : a + int(r.integers(5, 20))]), some(int(r.integers(0, 5)))]
        docs.append((100 + i, "; ".join(parts)))
    return docs + [(300, docs[-1][1]), (300, docs[-1][1]), (301, "q " + "x " * 3000)], items


def test_decontamination(spark):
    docs, items = overlapping()
    d = spark.createDataFrame([(*x, 1, "a") for x in docs], "doc_id long, text string, span int, Digest string").repartition(3)
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, hash int").repartition(2)
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r) for r in decontaminate.report(decontaminate.decontaminate(d, b)).collect()), key=key)
    assert got == sorted(plain_overlaps(docs, items), key=key)
    long_items = [x for x in items if len(same_words(x[1])) >= 10]
    b = spark.createDataFrame(long_items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.report(decontaminate.decontaminate(d, b)).collect()), key=key)
    assert got == sorted(plain_overlaps(docs, long_items), key=key)
    assert decontaminate.decontaminate(d.limit(0), b).count() == 0
    none = decontaminate.decontaminate(d, b.limit(0)).collect()
    assert len(none) == len(docs) and not any(r["n_hit"] or r["item_ids"] for r in none)


def test_no_long_shared_span_is_missed(spark):
    r = np.random.default_rng(6)
    # few words, so that hashes tie within a window
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in r.integers(0, 2, 60))) for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(f"w{x}" for x in r.integers(0, 2, 40))) for i in range(8)], "item_id long, text string")
    got = sorted(tuple(x) for x in decontaminate.report(decontaminate.decontaminate(docs, items)).collect())
    assert got == sorted(plain_overlaps([tuple(x) for x in docs.collect()], [tuple(x) for x in items.collect()]))


def plain_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)  # the smallest period of the stretch comes first
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_report(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if w and (found := repeated_tail(doc, len(w))):
        a, p = found
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc, len(runs), *four, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone))


def periodic():
    r = np.random.default_rng(0)
    texts = [*ODD[:5], "x" * 5000, "z " * 3000, "a b " * 700 + "c " * 40]
    for i in range(500):
        w = [f"w{x}" for x in r.integers(0, int(r.integers(1, 5)), int(r.integers(0, 90)))]
        for _ in range(int(r.integers(0, 3))):
            if w:
                a, p = int(r.integers(0, len(w))), int(r.integers(1, 12))
                w = w[:a] + w[a : a + p] * int(r.integers(1, 9)) + w[a + p :]
        texts.append("\v".join(w) if i % 3 else "  ".join(w))
    fib = ["a", "ab"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    return texts + [" ".join(fib[-1]), " ".join(bin(i).count("1") % 2 and "a" or "b" for i in range(900)), texts[40], texts[40]]


def test_runs(spark):
    texts = periodic()
    rows = [(i if i != 30 else None, t, "x", 1) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, Runs string, n_words int").repartition(3)
    got = {r["doc_id"]: tuple(r) for r in periods.report(periods.find_runs(d, rewrite=repeated_tail)).collect()}
    assert len(got) == len(texts)
    for i, text, *_ in rows:
        assert got[i] == plain_report(i, text), i
    assert repeated_tail(None, 5) is None and zlib.crc32(b"30") >= 0
    plain = periods.find_runs(d).where("doc_id = 6").first()
    assert plain["runs"] == [(0, 3000, 1)] and plain["collapsed"] == "z"
    assert periods.find_runs(d.limit(0)).count() == 0


def test_runs_of_long_texts():
    same = np.zeros(200_000, np.int64)
    assert periods.runs_of([same, np.tile(np.arange(40_000), 4), np.tile(np.arange(40_000), 3)]) == [[(0, 200_000, 1)], [(0, 160_000, 40_000)], []]
    assert periods.runs_of([]) == []


def plain_audit(rows, min_docs=3, top=200, scale=10**9):
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))) for a, b, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        in_docs = Counter(t for _, _, w in own for t in set(w))
        kept = sorted(t for t, n in in_docs.items() if n >= min_docs)
        counts = {s: Counter(t for _, x, w in own if x == s for t in w if in_docs[t] >= min_docs) for s in {d[1] for d in own}}
        whole = sum(counts.values(), Counter())

        def p(c):
            n = sum(c.values())
            return {t: 1 + scale * (c[t] + 1) // (n + len(kept)) for t in kept}

        of, q = {s: p(c) for s, c in counts.items()}, p(whole)
        f = lambda x, y: (x - y) * (x - y) // y
        for s in counts:
            pairs = [(sum(f(of[s][t], of[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(f(of[s][t], q[t]), t) for t in kept if counts[s][t] and of[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found[: top if part == "term" else None])]
    return sorted(out)


def spoken():
    r = np.random.default_rng(8)
    vocabulary = [f"{a}{b}" for a in "abcdefghiÄé漢" for b in "xyzXYZñß"]
    rows = [(None, "s", None), ("en", None, ""), ("en", "empty", "12 34"), ("de", "alone", "nur hier"), ("zz", "one", "a"), ("zz", "two", "b")]
    for i in range(300):
        lang = ["en", "fr", None][i % 3]
        source = ["big", "S2", "s3", "ü", None][int(r.integers(0, 5)) if i % 2 else 0]
        low = 20 if source == "s3" else 0
        rows.append((lang, source, " ".join(vocabulary[low + int(x)] for x in r.zipf(1.6, int(r.integers(0, 60))) % (len(vocabulary) - low)) + f" only{i}"))
    return rows + [rows[-1]] * 3


@pytest.mark.parametrize("sources", [256, 2])
def test_divergence(spark, monkeypatch, sources):
    monkeypatch.setattr(divergence, "SOURCES", sources)
    rows = spoken()
    d = spark.createDataFrame([(*x, 1, 2) for x in rows], "lang string, source string, text string, term int, V int").repartition(4)
    got = sorted(tuple(r) for r in divergence.audit(d, top=40).collect())
    assert got == plain_audit(rows, top=40)
    assert divergence.audit(d.limit(0)).count() == 0


def test_divergence_sql(spark):
    rows = spoken()
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    con = duckdb.connect()
    con.register("documents", frame.toArrow())
    assert sorted(con.execute(divergence.ORACLE_SQL).fetchall()) == plain_audit(rows)


def test_divergence_counts_long_texts_in_pieces(spark, monkeypatch):
    rows = [("en", f"s{i % 3}", "long Word " * 60_000 + f"t{i % 2}") for i in range(12)]
    d = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)
    assert sorted(tuple(r) for r in divergence.audit(d).collect()) == plain_audit(rows)
    assert d.select(F.max(F.length("text"))).first()[0] > 500_000
