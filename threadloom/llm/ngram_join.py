"""Exact n-gram Jaccard join by a token-block matrix.

Two documents link when |A n B| / |A u B| of their sets of five-word shingles is at
least NUM / DEN.  The join works in four steps, none of which emits the pairs of a group.

1. Postings.  Documents are hashed in chunks; a chunk's tokens go, sorted and
   delta-coded, to token ranges, whose tasks count in how many chunks' documents a token
   is and send only those seen more than once back to the chunk.  Copies inside a chunk
   send their tokens once, and a token that is in HOT documents of a chunk goes as one
   count, so a token or text that a third of the corpus holds stays small.  Documents
   with equal sets become one class.  A class whose tokens are to over a quarter its own
   can link with nothing and is done.
2. Leaders.  Classes with the same min-hash are compared with the most central one of
   them; the links found make components, which become the groups.  In rounds, classes
   are then compared with one class of another group on each of their probe tokens, and
   groups joined, until a round joins few.
3. Token-block matrix.  Classes are dealt to blocks of about BLOCK: those of a large group
   to blocks of its own, those of small groups that share their most common token to
   blocks of many groups, so that groups which share tokens but do not link meet as
   blocks.  The matrix holds which blocks have which tokens in the members' index
   prefixes (rarest tokens first).  A block looks up its members' probe prefixes within
   the bounds that sizes and own tokens set; a pair of blocks of one group is left out.
4. Of a pair of blocks, classes that share enough with the other block's union are
   compared exactly, until each two groups have a link.  Links join with those of step 2
   to components.

Any grouping gives the same components; a poor one only opens more blocks.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, give_back, mapped, written
from .components import components

WORDS = 5
NUM, DEN = 3, 4
HOT = 64
BLOCK = 16
#: Star rounds end when one joins no more than a FEWth of the groups that the rounds before it joined.
FEW = 8
CHUNK_TOKENS, CHUNK_DOCS = 600_000, 60_000
BUCKET_TOKENS = 1_000_000
BITS = 48
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.random.default_rng(5).integers(1, 2**63, 256, np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.random.default_rng(6).integers(1, 2**63, WORDS + 1, np.uint64) * _U(2) + _U(1)
_SEEDS = np.random.default_rng(7).integers(1, 2**63, 2, np.uint64)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    while len(_powers[0]) < n:
        k = len(_powers[0])
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            _powers[i] = np.concatenate([_powers[i], _powers[i] * _U(pow(base, k, 2**64))])
    return _powers[0], _powers[1]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    a = np.frombuffer((text or "").encode().lower(), np.uint8)
    solid = np.concatenate(([False], ~_SPACE[a], [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    if not len(edges):
        return np.empty(0, _U)
    up, down = _power(len(a))
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(_VALUE[a] * up[: len(a)])))
    start, end = edges[::2], edges[1::2]
    words = _mix((sums[end] - sums[start]) * down[start])
    k = min(len(words), WORDS)
    m = len(words) - k + 1
    total = np.full(m, k if k < WORDS else 0, _U) * _PLACE[WORDS]
    for i in range(k):
        total = total + words[i : i + m] * _PLACE[i]
    return np.unique(_mix(total))


def links(inter: int, a: int, b: int) -> bool:
    """inter / (a + b - inter) >= NUM / DEN, in integers."""
    return (NUM + DEN) * inter >= NUM * (a + b)


def _squeeze(x: np.ndarray) -> bytes:
    """Sorted integers as byte planes of their differences; the planes of zeroes pack well."""
    return np.diff(x, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unsqueeze(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(_U).ravel(), dtype=_U)


ROW = "bucket long, chunk long, listed boolean, a binary, b binary, c binary, d binary"
_ROW = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("listed", pa.bool_()), *((c, pa.binary()) for c in "abcd")])
FOUND = "row long, doc_id long, n long, digest binary, tokens binary, counts binary"
_FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("tokens", pa.binary()), ("counts", pa.binary())])


def _postings(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of postings for each token range, and a row that lists the chunk's documents; `buckets` is a power of two."""
    shift = BITS - (buckets - 1).bit_length()
    context = TaskContext.get()
    chunk = (context.partitionId() if context else 0) << 20
    ids, sizes, digests, packed, seen, held = [], [], [], [], set(), 0

    def flush() -> pa.RecordBatch:
        nonlocal chunk, held
        x = np.concatenate([np.empty(0, _U), *packed])
        packed.clear()
        x.sort()
        token = x >> _U(64 - BITS)
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(x) else np.empty(0, np.int64)
        count = np.diff(np.append(first, len(x)))
        hot = np.repeat(count >= HOT, count)
        cold, cold_token = x[~hot], token[~hot]
        hot_token, hot_count = token[first][count >= HOT], count[count >= HOT].astype(np.uint32)
        some = np.unique(np.concatenate([cold_token, hot_token]) >> _U(shift))
        low, high = some << _U(shift), (some + _U(1)) << _U(shift)
        cuts = [np.searchsorted(t, at).tolist() for t in (cold_token, hot_token) for at in (low, high)]
        rows = [
            (b, chunk, False, _squeeze(cold_token[i:j]), (cold[i:j] & _U(0xFFFF)).astype("<u2").tobytes(), hot_token[k:m].tobytes(), hot_count[k:m].tobytes())
            for b, i, j, k, m in zip(some.tolist(), *cuts)
        ]
        listed = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "n", "digest"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, listed.schema) as writer:
            writer.write_batch(listed)
        rows.append(((chunk + (chunk >> 20)) % buckets, chunk, True, sink.getvalue().to_pybytes(), x[hot].tobytes(), b"", b""))
        chunk += 1
        held = 0
        for y in (ids, sizes, digests, packed, seen):
            y.clear()
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), _ROW)], schema=_ROW)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            full = shingles(text.as_py())
            digest = hashlib.blake2b(full.tobytes(), digest_size=16).digest()
            if len(full) and digest not in seen:
                seen.add(digest)
                packed.append(np.unique(full >> _U(64 - BITS)) << _U(64 - BITS) | _U(len(ids)))
                held += len(full)
            ids.append(doc)
            sizes.append(len(full))
            digests.append(digest)
            if held >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                yield flush()
    if ids:
        yield flush()


def _shared(table: pa.Table) -> pa.Table:
    """Of a token range: to each chunk its tokens that are elsewhere too, with their counts up to HOT."""
    give_back()
    rows = table.to_pylist()
    own = [(r["chunk"], _unsqueeze(r["a"]), np.frombuffer(r["b"], "<u2"), np.frombuffer(r["c"], _U), np.frombuffer(r["d"], np.uint32)) for r in rows if not r["listed"]]
    every = np.sort(np.concatenate([np.empty(0, _U), *(t for _, t, *_ in own)]))
    hot = np.unique(np.concatenate([np.empty(0, _U), *(h for *_, h, _ in own)]))
    twice = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], hot]))
    count = np.searchsorted(every, twice, "right") - np.searchsorted(every, twice)
    count[np.searchsorted(twice, hot)] = HOT
    count = np.minimum(count, HOT).astype(np.uint8)
    out = [(r["bucket"], r["chunk"], True, r["a"], r["b"], b"", b"") for r in rows if r["listed"]]
    for chunk, token, doc, *_ in own:
        if len(twice):
            at = np.minimum(np.searchsorted(twice, token), len(twice) - 1)
            some = twice[at] == token
            if some.any():
                out.append((0, chunk, False, _squeeze(token[some] << _U(64 - BITS) | doc[some].astype(_U)), count[at[some]].tobytes(), b"", b""))
    return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), _ROW)] if out else [pa.array([], f.type) for f in _ROW], schema=_ROW)


def _own(n: int) -> int:
    """A document with so many tokens of its own has no link."""
    return n - -(-NUM * n // DEN) + 1


def _documents(table: pa.Table) -> pa.Table:
    """Of a chunk: its documents, with their shared tokens where a link is possible."""
    give_back()
    rows = table.to_pylist()
    head = next(r for r in rows if r["listed"])
    listed = pa.ipc.open_stream(head["a"]).read_all()
    hot = np.frombuffer(head["b"], _U)
    packed = np.concatenate([hot, *(_unsqueeze(r["a"]) for r in rows if not r["listed"])])
    count = np.concatenate([np.full(len(hot), HOT, np.uint8), *(np.frombuffer(r["b"], np.uint8) for r in rows if not r["listed"])])
    doc = packed & _U(0xFFFF)
    order = np.argsort((doc << _U(BITS)) | (packed >> _U(64 - BITS)))
    token, count = (packed >> _U(64 - BITS))[order], count[order]
    cut = np.searchsorted(doc[order], np.arange(listed.num_rows + 1, dtype=_U))
    tokens, counts = [], []
    for i, n in enumerate(listed.column("n").to_pylist()):
        a, b = cut[i], cut[i + 1]
        some = b > a and n - int(b - a) < _own(n)
        tokens.append(token[a:b].tobytes() if some else None)
        counts.append(count[a:b].tobytes() if some else None)
    at = (head["chunk"] << 16) + np.arange(listed.num_rows)
    return pa.Table.from_arrays([pa.array(at, pa.int64()), listed.column("doc_id"), listed.column("n"), listed.column("digest"), pa.array(tokens, pa.binary()), pa.array(counts, pa.binary())], schema=_FOUND)


CLASS = "node long, n long, own long, central double, common long, keys array<long>, probe array<long>, index array<long>, tokens binary"


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes that may have links: tokens shared with other classes, prefixes, min-hashes."""
    types = [pa.int64()] * 3 + [pa.float64(), pa.int64()] + [pa.list_(pa.int64())] * 3 + [pa.binary()]
    names = [x.split()[0] for x in CLASS.split(", ")]
    for batch in batches:
        rows = []
        for node, n, copies, tokens, counts in zip(*(batch.column(c) for c in ("node", "n", "copies", "tokens", "counts"))):
            token, count, n, copies = np.frombuffer(tokens.as_buffer(), _U), np.frombuffer(counts.as_buffer(), np.uint8), n.as_py(), copies.as_py()
            if copies < HOT:
                token, count = token[count > copies], count[count > copies]
            own = n - len(token)
            if own >= _own(n) or not len(token):
                continue
            order = np.lexsort((token, count))
            at = token[order].astype(np.int64)
            # the smaller of two linked documents shares 2 NUM / (NUM + DEN) of its tokens at least
            least = -(-2 * NUM * n // (NUM + DEN))
            keys = [int(_mix(token ^ s).min().astype(np.int64)) for s in _SEEDS]
            rows.append((node.as_py(), n, own, float(count.sum()) / n, int(at[-1]), keys, at[: _own(n) - own].tolist(), at[: max(0, n - least + 1 - own)].tolist(), token.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = zip(*(batch.column(c) for c in ("a", "b", "na", "nb", "ta", "tb")))
        rows = [(a.as_py(), b.as_py()) for a, b, na, nb, ta, tb in sides if links(_overlap(np.frombuffer(ta.as_buffer(), _U), np.frombuffer(tb.as_buffer(), _U)), na.as_py(), nb.as_py())]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.int64())], ["a", "b"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the members of two blocks, one for each two groups that have any.

    One is enough, as all members of a group are of one component.  Only members are
    compared that share enough with the union of the other block.
    """

    def near(members: list[dict], others: list[dict]) -> list[dict]:
        union, least = np.unique(np.concatenate([m["tokens"] for m in others])), min(m["n"] for m in others)
        return [m for m in members if links(_overlap(m["tokens"], union), m["n"], least)]

    for batch in batches:
        rows = []
        for sides in zip(batch.column("x"), batch.column("y")):
            x, y = ([m | {"tokens": np.frombuffer(m["tokens"], _U)} for m in side.as_py()] for side in sides)
            x = near(x, y)
            y = near(y, x) if x else []
            done = set()
            for p, q in itertools.product(x, y):
                pair = min(p["component"], q["component"]), max(p["component"], q["component"])
                if pair[0] < pair[1] and pair not in done and min(p["n"], q["n"]) * DEN >= max(p["n"], q["n"]) * NUM and links(_overlap(p["tokens"], q["tokens"]), p["n"], q["n"]):
                    done.add(pair)
                    rows.append((p["node"], q["node"]))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.int64())], ["a", "b"])


def _compared(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of classes that link."""
    x, y = (classes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("tokens").alias(f"t{s}")) for s in "ab")
    sides = pairs.join(x, "a").join(y, "b").where(f"least(na, nb) * {DEN} >= greatest(na, nb) * {NUM}").select("a", "b", "na", "nb", "ta", "tb")
    return mapped(sides, _linked, "a long, b long")


def _by_leaders(classes: DataFrame) -> DataFrame:
    """Links between classes and the most central class with the same min-hash."""
    keyed = classes.select("node", "central", F.explode("keys").alias("key"))
    leaders = keyed.groupBy("key").agg(F.max(F.struct("central", "node")).alias("top"), F.count("*").alias("k")).where("k > 1").select("key", F.col("top.node").alias("b"))
    return _compared(keyed.join(leaders, "key").select(F.col("node").alias("a"), "b").where("a <> b").distinct(), classes)


def _prefix(grouped: DataFrame, prefix: str, *columns: str) -> DataFrame:
    """A row for each token of a prefix, with `most`: how large a linked document can be whose first common token it is.

    What comes before that token is not shared, which leaves n - place for the overlap,
    and (NUM + DEN) * overlap >= NUM * (sum of sizes).
    """
    rows = grouped.select(F.posexplode(prefix).alias("place", "token"), "own", "n", "component", *columns)
    return rows.withColumn("most", F.expr(f"({NUM + DEN} * (n - own - place)) div {NUM} - n"))


def _dealt(grouped: DataFrame) -> DataFrame:
    """The classes with a bucket and one of its blocks: a large group's own, or that of small groups with the same most common token."""
    sizes = grouped.groupBy("component").agg(F.count("*").alias("k"), F.max(F.struct("central", "common")).alias("top"))
    buckets = sizes.select("component", F.when(F.col("k") >= BLOCK, F.xxhash64("component", F.lit(0))).otherwise(F.xxhash64("top.common")).alias("bucket"))
    dealt = written(grouped.join(buckets, "component"))
    blocks = dealt.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    return written(dealt.join(blocks, "bucket").withColumn("block", F.xxhash64("bucket", F.pmod(F.xxhash64("node"), "blocks"))))


#: Bounds of the sizes and of the groups of the classes in a bucket or block that hold a token.
BOUNDS = {"lo": F.min, "hi": F.max, "most": F.max, "first": F.min, "last": F.max}


def _bounded(rows: DataFrame, *level: str) -> DataFrame:
    return rows.groupBy(*level).agg(*(least_or_most(name).alias(name) for name, least_or_most in BOUNDS.items()))


def _matrix(dealt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(column, bucket, block and bounds) twice: which blocks hold which columns in probe and in index prefixes.

    A column stands for all tokens that the same blocks hold, as those of a passage that
    classes share, so that two blocks do not meet on each of them.
    """
    as_bounds = ("token", "bucket", "block", F.col("n").alias("lo"), F.col("n").alias("hi"), "most", F.col("component").alias("first"), F.col("component").alias("last"))
    x, y = (written(_bounded(_prefix(dealt, prefix, "bucket", "block").select(*as_bounds), "token", "bucket", "block")) for prefix in ("probe", "index"))
    holders = x.select("token", "block", F.lit(0).alias("side")).unionByName(y.select("token", "block", F.lit(1).alias("side")))
    marks = (F.bit_xor(F.xxhash64("block", "side", F.lit(k))) for k in range(2))
    columns = written(holders.groupBy("token").agg(F.xxhash64(*marks, F.count("*")).alias("column")))
    x, y = (written(_bounded(side.join(columns, "token"), "column", "bucket", "block")) for side in (x, y))
    return x, y


#: Whether a member of x can link, as the larger one, with a member of y of another group.
MAY_LINK = f"x.hi >= y.lo AND x.lo * {NUM} <= y.hi * {DEN} AND y.lo <= x.most AND x.lo <= y.most AND least(x.first, y.first) < greatest(x.last, y.last)"


def _meeting(dealt: DataFrame) -> DataFrame:
    """(a, b) for each column on which blocks meet; buckets are paired first, so that the blocks of a large group never are with each other."""
    probe, index = _matrix(dealt)
    x, y = (_bounded(side, "column", "bucket").alias(name) for name, side in (("x", probe), ("y", index)))
    meet = written(x.join(y, F.expr(f"x.column = y.column AND {MAY_LINK}")).select("x.column", F.col("x.bucket").alias("own"), F.col("y.bucket").alias("other")))
    found = probe.alias("x").join(meet.alias("m"), F.expr("x.column = m.column AND x.bucket = m.own")).join(index.alias("y"), F.expr(f"y.column = m.column AND y.bucket = m.other AND {MAY_LINK}"))
    return found.select(F.least("x.block", "y.block").alias("a"), F.greatest("x.block", "y.block").alias("b"))


def _by_stars(classes: DataFrame, led: DataFrame) -> DataFrame:
    """(node, component) of the classes, after groups that meet on a token have been joined by stars.

    On each token of a probe prefix, one class that holds it is the leader, and every
    class of another group that holds it is compared with the leader: one row a posting,
    never a pair of groups.  The leader is the most central class in the first round and
    one by hash, another for each token and round, later on.  What links becomes one
    group, tokens that only one group holds are put aside, and rounds follow until one
    joins no more than a part in FEW of the groups that those before it joined: so their
    number grows with the logarithm of the groups, where a round for each last straggler
    of a large group would send the group's postings each time.  A pair is compared once.
    Links that no star sees are left to the matrix, which finds all of them.
    """
    labels = written(classes.select("node").join(components(led), "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    # exploded twice rather than written: most tokens are of one group and go with the leaders
    held = _prefix(classes.drop("keys", "index", "tokens").join(labels, "node"), "probe", "node", "central")
    tried, before = None, 0
    for turn in itertools.count():
        lead = F.xxhash64("token", "node", F.lit(turn)) if turn else F.col("central")
        top = F.max(F.struct(lead.alias("lead"), "node", "n", "component")).alias("top")
        leaders = held.groupBy("token").agg(top, F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
        leaders = written(leaders.select("token", F.col("top.node").alias("b"), F.col("top.n").alias("nb"), F.col("top.component").alias("of")))
        held = written(held.join(leaders, "token"))
        stars = held.where(f"component <> of AND nb <= most AND least(n, nb) * {DEN} >= greatest(n, nb) * {NUM}").groupBy(F.col("node").alias("a"), "b").agg(F.first("component").alias("ca"), F.first("of").alias("cb"))
        stars = written(stars.join(tried, ["a", "b"], "left_anti") if tried else stars)
        found = written(stars.join(_compared(stars.select("a", "b"), classes), ["a", "b"]).select("ca", "cb"))
        moved = written(components(found, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("to")))
        labels = written(labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        joined = moved.where("component <> to").count()
        if turn and joined * FEW <= before:
            return labels
        before += joined
        tried = stars.select("a", "b") if tried is None else tried.unionByName(stars.select("a", "b"))
        held = written(held.drop("b", "nb", "of").join(moved, "component", "left").withColumn("component", F.coalesce("to", "component")).drop("to"))


def _by_matrix(grouped: DataFrame) -> DataFrame:
    """Links between classes of different groups, by the token-block matrix."""
    dealt = _dealt(grouped)
    pairs = written(_meeting(dealt).distinct())
    used = dealt.join(pairs.select(F.explode(F.array("a", "b")).alias("block")).distinct(), "block", "left_semi")
    blocks = written(used.groupBy("block").agg(F.collect_list(F.struct("node", "component", "n", "tokens")).alias("members")))
    x, y = (blocks.select(F.col("block").alias(side), F.col("members").alias(name)) for side, name in (("a", "x"), ("b", "y")))
    return mapped(pairs.join(x, "a").join(y, "b").select("x", "y"), _opened, "a long, b long")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs`.

    component_id is the smallest doc_id reachable by links, the row's own included.  A
    null or empty text has no shingles, links with nothing and is its own component.
    Repeated rows and equal sets are of one component; null ids stay null and count for
    no component.  Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(6, (size // 6 // BUCKET_TOKENS).bit_length())
    postings = mapped(rows, lambda x: _postings(x, buckets), ROW)
    shared = postings.groupBy("bucket").applyInArrow(_shared, ROW)
    found = written(shared.groupBy("chunk").applyInArrow(_documents, FOUND))
    sets = found.where("tokens IS NOT NULL").groupBy("digest").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("counts").alias("counts"))
    classes = written(mapped(sets.select("node", "n", "copies", "tokens", "counts"), _classes, CLASS))
    grouped = _by_stars(classes, written(_by_leaders(classes)))
    more = written(_by_matrix(classes.join(grouped, "node")).join(grouped.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(grouped.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b"))
    moved = components(more, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("to"))
    of = written(grouped.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
    ids = found.groupBy("digest").agg(F.min("row").alias("least"), F.min(F.when(F.col("tokens").isNotNull(), F.col("row"))).alias("node"), F.min("doc_id").alias("doc_id"))
    ids = written(ids.join(of, "node", "left").select("digest", "doc_id", F.coalesce("component", "least").alias("component")))
    smallest = written(ids.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    ids = written(ids.join(smallest, "component").select("digest", "component_id"))
    out = found.select("doc_id", "n", "digest").join(ids, "digest")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of their component, columns as they were.

    Rows that share a doc_id stay together; rows without one stay.
    """
    gone = fresh(docs, "gone")
    others = written(join(docs, doc_id, text).where("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct())
    return docs.join(others, docs[doc_id] == others[gone], "left_anti")
