"""Personal data: base patterns, and terms that give protected entities away.

Base kinds are e-mail addresses, IP addresses, payment cards and phone numbers.  Every
value found is a protected entity, and so is what values share that tells of their owner:
the domain of an address, the first half of an IP, the issuer of a card, the area of a
phone.  Information-theoretic sanitisation then asks of each term in the documents of an
entity how much of the entity it reveals: the pointwise mutual information
log2 p(t, e) / (p(t) p(e)), estimated over all documents of the corpus, against the
entity's own information -log2 p(e).  A term that reveals at least the disclosure
threshold of it is a span too (kind `term`) wherever it stands in a document that holds
the entity.  `sanitised` generalises such a term to its longest leading part that so many
documents share that it reveals less than the threshold of any of the document's
entities, or removes it where no part of PARTS letters or more is that common.

All counts are of distinct documents: documents with the same text, as copies have,
count once.  Terms are the words that no base span touches.  A term must occur with the
entity in MIN_SUPPORT distinct documents, since a single joint occurrence is no
evidence; so an entity in fewer documents has no terms.

Plan: one pass finds base spans and entities, and keeps the texts of rows with entities.
Terms are counted in a second pass, each row with the weight 1 / (its number of copies),
summed inside each task before they are shuffled by term.  Pairs of entity and term are
made only for entities in enough documents, and summed inside each task as well; no list
of an entity's documents is gathered.  Texts are shuffled only where the table they meet
- the digests of texts with copies, or the rows with such entities - is over Spark's
broadcast threshold.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT = 3
DISCLOSURE = 0.8
#: Fewest letters of a generalised term, and most.
PARTS = (2, 8)
#: What stands for each kind of entity.
GENERAL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\w+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain.

    A local part runs back from its @ over all characters that it may hold, so only the
    places of @ are looked at; that keeps long runs of such characters linear.
    """
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
            at = text.find("@", end)
        else:
            end = max(end, at)
            at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _terms(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(word in lower case, start, end) of the words that no span touches."""
    covered = sorted((a, b) for _, a, b in spans)
    ends = [*accumulate((b for _, b in covered), max)]
    out = []
    for m in _WORD.finditer(text):
        x, y = m.span()
        i = bisect_left(covered, (y,)) if covered else 0  # those before i start before y
        if not (i and ends[i - 1] > x):
            out.append((m[0].lower(), x, y))
    return out


def entities(text: str, spans: list[tuple[str, int, int]]) -> set[str]:
    """The protected entities of base spans: each value, and what it shares with others of its owner."""
    out = set()
    for kind, a, b in spans:
        value = text[a:b].lower()
        digits = "".join(c for c in value if c.isdigit())
        group = {"email": value.rpartition("@")[2], "ip": ".".join(value.split(".")[:2]), "card": digits[:6], "phone": digits[:-7]}[kind]
        out |= {f"{kind}:{value}", f"{kind} of:{group}"}
    return out


_SPANS = "array<struct<kind:string,start:int,end:int>>"
FOUND = f"doc_id long, row long, digest long, base {_SPANS}, entities array<bigint>, text string"


def _rows(text: str) -> list:
    """The text, null as empty, and the digest that copies share."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("digest"), whole.alias("text")]


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, digest, base, entities, text): base spans and distinct entities of every row; the text only where there are any."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            base, held, texts = [], [], []
            for value in batch.column(3):
                t = value.as_py()
                spans = base_spans(t)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                held.append(sorted(map(_digest, entities(t, spans))))
                texts.append(t if spans else None)
            columns = [pa.array(base, kind), pa.array(held, pa.list_(pa.int64())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["doc_id", "row", "digest", "base", "entities", "text"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), *_rows(text)).mapInArrow(run, FOUND)


def term_counts(docs: DataFrame, copies: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): in how many distinct documents each word stands; `copies` has (digest, n) of texts with more than one row."""

    def run(batches):
        # summed over a batch of rows before anything is shuffled
        for batch in batches:
            counts: defaultdict = defaultdict(float)
            for value, share in zip(batch.column(0), batch.column(1).to_pylist()):
                t = value.as_py()
                for w in {w for w, _, _ in _terms(t, base_spans(t))}:
                    counts[w] += share
            yield pa.RecordBatch.from_arrays([pa.array([_digest(w) for w in counts], pa.int64()), pa.array([*counts.values()], pa.float64())], ["term", "n"])

    rows = docs.select(*_rows(text)).join(copies, "digest", "left").select("text", (1 / F.coalesce("n", F.lit(1))).alias("share"))
    return rows.mapInArrow(run, "term long, n double").groupBy("term").agg(F.round(F.sum("n")).cast("long").alias("n"))


def _joint(rows: DataFrame) -> DataFrame:
    """(entity, term, n_joint) of rows with text, base and the entities wanted."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            keys = [*counts]
            arrays = [pa.array([k[0] for k in keys], pa.int64()), pa.array([_digest(k[1]) for k in keys], pa.int64()), pa.array([*counts.values()], pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(arrays, ["entity", "term", "n"])

        for batch in batches:
            for r in batch.to_pylist():
                words = {w for w, _, _ in _terms(r["text"], [(s["kind"], s["start"], s["end"]) for s in r["base"]])}
                for e in r["wanted"]:
                    counts.update((e, w) for w in words)
                    if len(counts) > 200_000:
                        yield out()
        yield out()

    return rows.select("text", "base", "wanted").mapInArrow(run, "entity long, term long, n long").groupBy("entity", "term").agg(F.sum("n").alias("n_joint"))


def disclosing(docs: DataFrame, found: DataFrame, text: str = "text", min_support: int = MIN_SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(entity, term, share, common): terms that reveal at least `disclosure` of an entity's information.

    A term in more than `common` documents cannot reveal so much of the entity: its
    information is log2(N / n) at most, N being the number of distinct documents.
    """
    digests = written(docs.select(_rows(text)[0]).groupBy("digest").agg(F.count("*").alias("n")))
    copies = written(digests.where("n > 1"))
    held = found.where(F.size("entities") > 0)
    first = held.groupBy("digest").agg(F.min("row").alias("row")).select("row")
    once = written(held.select("row", "entities").join(first, "row", "left_semi").select("row", F.explode("entities").alias("entity")))
    often = written(once.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= min_support))
    wanted = written(once.join(often.select("entity"), "entity").groupBy("row").agg(F.collect_list("entity").alias("wanted")))
    joint = written(_joint(held.join(wanted, "row")).where(F.col("n_joint") >= min_support))
    counts = term_counts(docs, copies, text).join(joint.select("term").distinct(), "term", "left_semi")
    n_all = F.lit(digests.count())
    bits = F.log2(F.col("n_joint") * n_all / (F.greatest("n", "n_joint") * F.col("n_entity")))
    own = F.log2(n_all / F.col("n_entity"))
    common = F.pow(n_all.cast("double"), 1 - disclosure) * F.pow("n_entity", F.lit(disclosure))
    return joint.join(often, "entity").join(counts, "term").withColumn("share", bits / own).where(F.col("share") >= disclosure).select("entity", "term", "share", common.alias("common"))


def _marked(rows: DataFrame) -> DataFrame:
    """(row, terms): spans of the wanted terms, wherever they stand in the row's text."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                wanted = set(r["wanted"])
                words = _terms(r["text"], [(s["kind"], s["start"], s["end"]) for s in r["base"]])
                chosen = {w for w in {w for w, _, _ in words} if _digest(w) in wanted}
                out.append([{"kind": "term", "start": x, "end": y} for w, x, y in words if w in chosen])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["row", "terms"])

    return rows.select("row", "text", "base", "wanted").mapInArrow(run, f"row long, terms {_SPANS}")


def _found(docs: DataFrame, doc_id: str, text: str, min_support: int, disclosure: float) -> tuple[DataFrame, DataFrame]:
    """Rows of `find`, and (row, terms, common) of those with disclosing terms."""
    found = written(find(docs, doc_id, text))
    revealing = written(disclosing(docs, found, text, min_support, disclosure))
    of = revealing.groupBy("entity").agg(F.collect_set("term").alias("terms"), F.max("common").alias("common"))
    held = found.where(F.size("entities") > 0)
    wanted = held.select("row", F.explode("entities").alias("entity")).join(of, "entity").groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("wanted"), F.max("common").alias("common"))
    return found, _marked(held.join(wanted, "row")).join(wanted.select("row", "common"), "row")


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_support: int = MIN_SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """One row for each row of `docs`: (doc_id, base, terms), spans in code points.

    A null text counts as empty and has no spans, a null id stays null; repeated rows are
    found each, and as copies add nothing to the evidence; texts of any length count
    whole.  Other columns are ignored; an empty table gives no rows.
    """
    found, terms = _found(docs, doc_id, text, min_support, disclosure)
    return found.select("doc_id", "row", "base").join(terms, "row", "left").select("doc_id", "base", F.coalesce("terms", F.array().cast(_SPANS)).alias("terms"))


def _parts(word: str) -> list[str]:
    """Leading parts of a word that may stand for it, longest first."""
    return [word[:k] for k in range(min(PARTS[1], len(word) - 1), PARTS[0] - 1, -1)]


def _part_counts(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(part, n): in how many distinct documents some word begins with each of the wanted parts."""

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for value in batch.column(0):
                t = value.as_py()
                counts.update({part for w in {w for w, _, _ in _terms(t, base_spans(t))} for part in [*_parts(w), w]})
            yield pa.RecordBatch.from_arrays([pa.array([_digest(w) for w in counts], pa.int64()), pa.array([*counts.values()], pa.int64())], ["part", "n"])

    once = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    return once.mapInArrow(run, "part long, n long").join(wanted, "part", "left_semi").groupBy("part").agg(F.sum("n").alias("n"))


def sanitised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_support: int = MIN_SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """Every row and column of `docs`, with a general word for each base value and each disclosing term generalised or removed.

    A null text stays null, an empty one empty; repeated rows are changed alike; an
    empty table gives none.
    """
    found, terms = _found(docs, doc_id, text, min_support, disclosure)
    terms, key, new = written(terms), fresh(docs, "text_key"), fresh(docs, "sanitised")
    parts_of = F.udf(lambda t, spans: sorted({_digest(p) for s in spans for p in _parts(t[s["start"] : s["end"]].lower())}), "array<bigint>")
    held = found.where("text IS NOT NULL").join(terms, "row", "left").select("text", "base", "terms", "common", "row")
    parts = written(held.where(F.size("terms") > 0).select("row", "common", F.explode(parts_of("text", "terms")).alias("part")))
    counts = written(_part_counts(docs, parts.select("part").distinct(), text))
    safe = parts.join(counts, "part").where("n > common").groupBy("row").agg(F.collect_list("part").alias("safe"))

    def change(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                t, good = r["text"], set(r["safe"] or ())
                word = lambda a, b: next((p + "…" for p in _parts(t[a:b]) if _digest(p.lower()) in good), "")
                swaps = [(s["start"], s["end"], GENERAL.get(s["kind"]) or word(s["start"], s["end"])) for s in [*r["base"], *(r["terms"] or ())]]
                out.append(sanitise(t, swaps))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, new])

    changed = held.join(safe, "row", "left").dropDuplicates(["text"]).select(F.md5("text").alias("key"), "text", "base", "terms", "safe").mapInArrow(change, f"{key} string, {new} string")
    joined = docs.join(written(changed), F.md5(F.col(text)) == F.col(key), "left")
    return joined.select(*[F.coalesce(new, docs[c]).alias(c) if c == text else docs[c] for c in docs.columns])


def sanitise(text: str | None, swaps: list[tuple[int, int, str]]) -> str | None:
    """The text with a word for every (start, end, word); overlapping spans are taken as one."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, word in sorted(swaps, key=lambda s: (s[0], -s[1])):
        if start >= at:
            out += [text[at:start], word]
        at = max(at, end)
    return "".join(out) + text[at:]


def report(found: DataFrame) -> DataFrame:
    """Counts by kind and digests of the spans of `spans`."""
    each = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform("base", each), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(F.concat("base", "terms"), each), ",").alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )
