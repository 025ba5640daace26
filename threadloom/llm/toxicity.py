"""Toxicity by a counterfactual-regularised linear classifier.

Inputs of a score are the distinct words of the whole text and their leading parts, each
part as often as distinct words begin with it, so that inflected forms share evidence;
nothing else.  The loss is the logistic loss, an
L1 penalty that keeps the many words of long texts from adding up, and a counterfactual
term: in labelled sentences that name a group or a person, the name is swapped for others
of its kind, and the squared change of the score is penalised.  So a name itself earns
no weight, and neutral mentions stay neutral.  Kinds are the rows of IDENTITY_TERMS and
the names learned from the labelled rows: words that stand inside sentences with a
capital, seldom without, in texts of both labels.

The classifier is fitted on a bounded sample of labelled rows: at most SAMPLE rows of
each label, those with the lowest hash of doc_id, and of them only texts of at most
MAX_CHARS characters.  The sample is written once; features are counted and chosen on the
executors, and the driver gets the chosen ones of each row, at most FEATURES different
ones.  Scoring moves no rows; every text is scored as a whole.
"""

from __future__ import annotations

import re
import zlib
from math import asinh

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, mapped, written

SAMPLE = 3000
MAX_CHARS = 20_000
DIMENSIONS = 1 << 22
#: Most features with a weight, names learned from the sample, and swaps of a name.
FEATURES, NAMES, SWAPS = 30_000, 200, 6
THRESHOLD = 0.7
#: Names of groups by kind; a name is swapped only for others of its row.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "ladies", "gentlemen"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "turkish"),
    ("deaf", "blind", "disabled", "autistic"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "atheisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "athées"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "ateos"),
)
_KNOWN = {t: tuple(x for x in row if x != t) for row in IDENTITY_TERMS for t in row}
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_INSIDE = re.compile(r"(?<=[^\W_] )[^\W\d_]{3,}")
_PARTS = (4, 5, 6, 7)


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def word_features(word: str) -> list[int]:
    """Numbers of a word: itself and its leading parts."""
    return [zlib.crc32(word.encode("utf-8", "surrogatepass")) % DIMENSIONS] + [zlib.crc32(b"\0" + word[:k].encode("utf-8", "surrogatepass")) % DIMENSIONS for k in _PARTS if len(word) >= k]


def features(found: set[str]) -> list[int]:
    """Numbers of all words; a part that several words begin with counts for each."""
    return [f for w in found for f in word_features(w)]


def counterfactuals(text: str, swaps: dict[str, tuple[str, ...]] = _KNOWN) -> list[tuple[list[int], list[int]]]:
    """For every sentence with a name, and every swap: features that the sentence loses and gains.

    What is not swapped is the same on both sides; a swap for a word that the sentence
    has already only loses.
    """
    out = []
    for m in _SENTENCE.finditer(text.lower()):
        found = words(m[0])
        for name in sorted(found & swaps.keys()):
            out += [(word_features(name), [] if other in found else word_features(other)) for other in swaps[name]]
    return out


def learned_names(rows: DataFrame, at_most: int = NAMES, least: int = 3) -> list[str]:
    """Names in the labelled rows, most frequent first: words inside sentences with a capital in `least` texts of each label, and four times as often as without."""

    def run(batches):
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for label, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen = {w for m in _SENTENCE.finditer(v.as_py()) for w in _INSIDE.findall(m[0])}
                for w in seen:
                    if w[1:].islower():
                        counts.setdefault(w.lower(), [0, 0, 0])[2 if w[0].islower() else label] += 1
            columns = [pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array([*counts], pa.string()), *columns], ["word", "n0", "n1", "plain"])

    counted = mapped(rows.select("label", "text"), run, "word string, n0 long, n1 long, plain long").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "plain")])
    good = counted.where((F.col("n0") >= least) & (F.col("n1") >= least) & (F.expr("n0 + n1 >= 4 * plain")))
    return [r["word"] for r in good.orderBy(F.expr("n0 + n1").desc(), "word").limit(at_most).collect()]


def swaps_of(names: list[str], at_most: int = SWAPS) -> dict[str, tuple[str, ...]]:
    """What each name is swapped for: the others of its row of IDENTITY_TERMS, or the names nearest in frequency."""
    own = [n for n in names if n not in _KNOWN]
    near = {n: tuple(own[j] for j in range(max(0, i - at_most // 2), min(len(own), i + at_most // 2 + 1)) if j != i) for i, n in enumerate(own)}
    return near | _KNOWN


def chosen_features(rows: DataFrame, least: int = 3, keep: int = FEATURES, z: float = 2.5) -> list[int]:
    """The features whose share among label 1 differs most, against chance; counted on the executors over the rows that train."""

    def run(batches):
        for batch in batches:
            got = [np.unique(np.array(features(words(v.as_py())), np.int64)) for v in batch.column(1)]
            every = np.concatenate([np.empty(0, np.int64), *got])
            label = np.repeat(batch.column(0).to_numpy().astype(np.int64), [len(g) for g in got])
            numbers, inverse = np.unique(every, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(np.bincount(inverse, label, len(numbers)).astype(np.int64)), pa.array(np.bincount(inverse, minlength=len(numbers)).astype(np.int64))], ["feature", "pos", "n"])

    train = rows.where("not held")
    ones, n = train.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    if not 0 < ones < n:
        return []
    counted = mapped(train.select("label", "text"), run, "feature long, pos long, n long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).where(F.col("n") >= least)
    expect = F.col("n") * (ones / n)
    scored = counted.select("feature", F.abs((F.col("pos") - expect) / F.sqrt(expect * (1 - ones / n) + 1e-9)).alias("z")).where(F.col("z") >= z)
    return [r["feature"] for r in scored.orderBy(F.desc("z"), "feature").limit(keep).collect()]


class Rows:
    """Sparse 0/1 rows."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.width, self.n = width, len(rows)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.at = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
        self.row = np.repeat(np.arange(self.n), self.lengths)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, g[self.row], self.width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """A weight for each feature number that has one; the score of a text is a calibrated sigmoid of their sum.

    The sum enters by its inverse hyperbolic sine: long texts with much evidence have
    sums far out, which would flatten a calibration that is straight in the sum.
    """

    def __init__(self, weights: dict[int, float], bias: float, scale: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.scale, self.shift = weights, bias, scale, shift
        #: How many counterfactual pairs the sample holds, and how many of them have a feature that may have a weight.
        self.pairs = self.live = 0

    def word(self, word: str) -> tuple[int, ...]:
        return tuple(f for f in word_features(word) if f in self.weights)

    def logit(self, text: str, kept: dict[str, tuple[int, ...]] | None = None) -> float:
        """The sum over the features of every distinct word, as in training; in order, so that equal texts give equal sums."""
        kept = {} if kept is None else kept
        found = [f for w in words(text) for f in (kept[w] if w in kept else kept.setdefault(w, self.word(w)))]
        return self.scale * asinh(self.bias + sum(self.weights[f] for f in sorted(found))) + self.shift

    def score(self, text: str, kept: dict[str, tuple[int, ...]] | None = None) -> float:
        return float(_sigmoid(np.array(self.logit(text, kept))))


def fit(rows: list[list[int]], labels: list[int], held: list[bool], pairs: list[tuple[list[int], list[int]]], sparsity: float = 2e-4, fairness: float = 1.0, steps: int = 400) -> Model:
    """Proximal gradient descent on the features that the rows hold; rows with `held` only calibrate.

    With one label only, or no rows, the model gives every text the share of label 1
    (1/2 without rows).
    """
    y = np.array(labels, float)
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return Model({}, float(np.log(share / (1 - share))))
    held = np.array(held, bool)
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    train = np.flatnonzero(~held)
    each = [np.array(r, np.int64) for r in rows]
    place = {int(f): i for i, f in enumerate(np.unique(np.concatenate(each)))}
    d = len(place)
    to = lambda r: np.array([place[int(f)] for f in r if int(f) in place], np.int64)
    x = Rows([to(each[i]) for i in train], d)
    a, b = Rows([to(p) for p, _ in pairs], d), Rows([to(q) for _, q in pairs], d)
    yt = y[train]
    weight = np.where(yt == 1, 0.5 / max(1, yt.sum()), 0.5 / max(1, (1 - yt).sum()))
    w, bias, v, vb, t = np.zeros(d), 0.0, np.zeros(d), 0.0, 1.0
    # the largest curvature, by power iteration
    u = np.ones(d + 1) / np.sqrt(d + 1)
    top = 1.0
    for _ in range(20):
        r = weight * (x.times(u[:-1]) + u[-1]) / 4
        g = x.back(r)
        if len(pairs):
            c = (a.times(u[:-1]) - b.times(u[:-1])) * fairness / len(pairs)
            g += a.back(c) - b.back(c)
        g = np.append(g, r.sum())
        top = max(float(np.linalg.norm(g)), 1e-9)
        u = g / top
    rate = 1 / (1.1 * top)
    for _ in range(steps):
        r = weight * (_sigmoid(x.times(v) + vb) - yt)
        g = x.back(r)
        if len(pairs):
            c = (a.times(v) - b.times(v)) * fairness / len(pairs)
            g += a.back(c) - b.back(c)
        new = v - rate * g
        new = np.sign(new) * np.maximum(np.abs(new) - rate * sparsity, 0)
        nb = vb - rate * r.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - bias)
        w, bias, t = new, nb, nt
    weights = {int(f): float(w[i]) for f, i in place.items() if w[i]}
    model = Model(weights, float(bias))
    if held.any():
        zs = np.arcsinh([bias + sum(weights.get(int(f), 0.0) for f in each[i]) for i in np.flatnonzero(held)])
        model.scale, model.shift = calibration(zs, y[held])
    return model


def calibration(z: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Scale and shift of Platt's method, with his smoothed targets; a step is halved until the loss falls."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(at: np.ndarray) -> float:
        s = at[0] * z + at[1]
        return float((np.logaddexp(0, s) - target * s).sum() + 5e-3 * (at[0] - 1) ** 2)

    at = np.array([1.0, 0.0])
    for _ in range(steps):
        p = _sigmoid(at[0] * z + at[1])
        h = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - target) * z).sum() + 1e-2 * (at[0] - 1), (p - target).sum()])
        H = np.array([[(h * z * z).sum() + 1e-2, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step, now = np.linalg.solve(H, g), loss(at)
        while loss(at - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        at = at - step
        if np.abs(step).max() < 1e-7:
            break
    return float(max(at[0], 1e-3)), float(at[1])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, max_chars: int = MAX_CHARS) -> Model:
    """Fit on at most `sample` rows of each label that are not held out.

    A document with both labels counts as label 1; null ids and labels other than 0 and
    1 are left out; a null text counts as empty.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.max(label).cast("int").alias("label"))
    order = [F.xxhash64("id"), F.col("id")]
    picked = known.where("label = 1").orderBy(*order).limit(sample).unionByName(known.where("label = 0").orderBy(*order).limit(sample))
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.length("text") <= max_chars)
    # at most 2 * sample ids of 8 bytes and a label: a proven bound
    fold = F.floor(F.crc32(F.col("id").cast("string").cast("binary")) / 3) % 5 == 4
    rows = written(texts.join(F.broadcast(picked), "id").select("id", "label", fold.alias("held"), "text"))
    swaps = swaps_of(learned_names(rows))
    chosen = {*chosen_features(rows)}
    numbers = pa.list_(pa.int32())

    def run(batches):
        cut = lambda r: sorted(f for f in r if f in chosen)
        for batch in batches:
            texts = [v.as_py() for v in batch.column(3)]
            # a swap without a feature that has a weight changes no score
            every = [counterfactuals(t, swaps) for t in texts]
            changed = [[(p, q) for p, q in ((cut(p), cut(q)) for p, q in s) if p or q] for s in every]
            columns = [pa.array([len(s) for s in every], pa.int64()), pa.array([cut(features(words(t))) for t in texts], numbers), pa.array([[p for p, _ in s] for s in changed], pa.list_(numbers)), pa.array([[q for _, q in s] for s in changed], pa.list_(numbers))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["id", "label", "held", "pairs", "features", "here", "there"])

    got = mapped(rows, run, "id long, label int, held boolean, pairs long, features array<int>, here array<array<int>>, there array<array<int>>").collect()
    got = [*{r["id"]: r for r in sorted(got, key=lambda r: (r["id"], sorted(r["features"])))}.values()]
    pairs = [p for r in got for p in zip(r["here"], r["there"])]
    model = fit([r["features"] for r in got], [r["label"] for r in got], [r["held"] for r in got], pairs)
    model.pairs, model.live = sum(r["pairs"] for r in got), len(pairs)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """Every row and column of `docs` with a score from 0 to 1.

    A null text is scored as empty, a text of any length as a whole; repeated rows are
    scored each; an empty table gives none.  A column of `docs` with the name of the
    score, in either case, is replaced.
    """
    rows = docs.select(*[c for c in docs.columns if c.lower() != column.lower()])
    at = rows.columns.index(text)

    def run(batches):
        kept: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            scores = []
            for v in batch.column(at):
                if len(kept) > 50_000:
                    kept.clear()
                scores.append(model.score(v.as_py() or "", kept))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, column])

    return mapped(rows, run, T.StructType([*rows.schema.fields, T.StructField(column, T.DoubleType())]))


def reject(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose score is under the threshold, columns as they were, whatever their names.

    Rows with a null id or text are scored like others; repeated rows share their fate.
    """
    model = train(docs, labels, doc_id, text)
    name = fresh(docs, "score")
    return score(docs, model, text, name).where(F.col(name) < threshold).drop(name)
