"""Secret scans: base patterns, and a character convolutional network for the rest.

Base kinds are assignments to secret-like names, access key ids and long hexadecimal
runs.  Every candidate is scored from its characters and those around it by a small
convolutional network in numpy: character embedding, one convolution, maximum over
positions, a hidden layer.  Candidates are the base matches, all runs of LONG or more
token characters, and those of SHORT or more that are no plain word: with a digit, a
sign inside, or capitals and small letters mixed.  A run longer than the network is wide
has the highest score of all windows of that width in it, one character apart.  Base
spans stay whatever their score, which says whether the network confirms them; another
run is a span (kind `model`) from the threshold on.

The network is trained on labelled findings, made by rule with a fixed seed: secrets of
several forms, base matches and short ones included, in the contexts that hold them, and
the look-alikes that are none (hashes of commits and files, identifiers,
words with numbers, versions, dates, paths, card and phone numbers, rules, long words).
Scores are calibrated on held-out findings; the thresholds, one each for short runs, long
ones and those longer than the network is wide, are the highest that meet the recall
asked for on yet other findings, scanned as texts are, or CERTAIN where that is lower.

The network is trained once on the driver from the fixed findings, whose number is a
parameter, and is a few kilobytes of weights; scanning moves no rows.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

KINDS = ("assign", "access", "hex")
FINDINGS = 10_000
RECALL = 0.97
CERTAIN = 0.995
WIDTH, AROUND = 48, 24
SHORT, LONG = 8, 16

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORT},}}+")
#: What stands for a secret.
MASK = "[SECRET]"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed; code points, end exclusive."""
    out = []
    for m in _ASSIGN.finditer(text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                out.append((m.start(), 1, m.end()))
    for m in _HEX.finditer(text):
        out.append((m.start(), 2, m.end()))
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of token characters, but for plain words shorter than LONG."""
    out = []
    for m in _CANDIDATE.finditer(text):
        run = m[0]
        if len(run) >= LONG or not (run.isalpha() and (run[1:].islower() or run.isupper())):
            out.append(m.span())
    return out


def _whole(text: str, start: int, end: int) -> np.ndarray:
    """Codes of a candidate between marks, and of what stands before and after it; 0 pads to WIDTH at least."""
    before = text[max(0, start - AROUND) : start].rjust(AROUND, "\0")
    after = text[end : end + AROUND].ljust(AROUND, "\0")
    codes = np.frombuffer((before + "\1" + text[start:end].ljust(WIDTH, "\0") + "\2" + after).encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes < 128, codes, 127).astype(np.int64)


def _window(whole: np.ndarray, at: int = 0) -> np.ndarray:
    """The codes of one window of WIDTH characters, `at` characters into the candidate, with what stands around the candidate."""
    side = AROUND - 2
    return np.concatenate([whole[:side], whole[side + at : side + at + WIDTH + 6], whole[-side:]])


def _codes(text: str, start: int, end: int) -> np.ndarray:
    """Codes of a candidate's first window."""
    return _window(_whole(text, start, end))


class CharCnn:
    """Embedding, convolution, maximum over positions, hidden layer, one score."""

    def __init__(self, seed: int = 7, size: int = 12, filters: int = 48, span: int = 5, hidden: int = 24):
        r = np.random.default_rng(seed)
        self.span = span
        self.w = {
            "e": r.normal(0, 0.3, (128, size)),
            "c": r.normal(0, 1 / np.sqrt(span * size), (span * size, filters)),
            "cb": np.zeros(filters),
            "h": r.normal(0, 1 / np.sqrt(3 * filters), (3 * filters, hidden)),
            "hb": np.zeros(hidden),
            "o": r.normal(0, 1 / np.sqrt(hidden), hidden),
            "ob": np.zeros(1),
        }
        self.scale, self.shift = 1.0, 0.0

    #: The maximum is taken over the text before, the candidate, and the text after, each for itself.
    PARTS = ((0, AROUND - 2), (AROUND - 2, AROUND + WIDTH), (AROUND + WIDTH, 2 * AROUND + WIDTH - 2))

    def _forward(self, x: np.ndarray) -> tuple:
        w = self.w
        emb = w["e"][x]
        win = np.lib.stride_tricks.sliding_window_view(emb, self.span, axis=1).transpose(0, 1, 3, 2)
        win = win.reshape(len(x), win.shape[1], -1)
        conv = np.maximum(win @ w["c"] + w["cb"], 0)
        at = [a + conv[:, a:b].argmax(1) for a, b in self.PARTS]
        rows = np.arange(len(x))[:, None]
        pooled = np.concatenate([conv[rows, p, np.arange(conv.shape[2])] for p in at], 1)
        mean = pooled
        hid = np.maximum(mean @ w["h"] + w["hb"], 0)
        return win, conv, at, mean, hid, hid @ w["o"] + w["ob"][0]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 256])[-1] for i in range(0, len(x), 256)]) if len(x) else np.empty(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logit(x) + self.shift, -40, 40)))

    def highest(self, whole: np.ndarray, step: int = 4096) -> float:
        """The highest probability of all windows of a candidate that `_whole` gives; each place is convolved once."""
        w, side, width = self.w, self.PARTS[0][1], self.PARTS[1][1] - self.PARTS[1][0]
        more = self.span - 1

        def conv(codes: np.ndarray) -> np.ndarray:
            win = np.lib.stride_tricks.sliding_window_view(w["e"][codes], self.span, axis=0).transpose(0, 2, 1)
            return np.maximum(win.reshape(len(win), -1) @ w["c"] + w["cb"], 0)

        before, after = conv(whole[: side + more]).max(0), conv(whole[-side - more :]).max(0)
        own, best = whole[side:-side], -np.inf
        windows = len(own) - more - width + 1
        for a in range(0, windows, step):
            count = min(step, windows - a)
            top, reach = conv(own[a : a + count + width - 1 + more]), 1
            while reach < width:  # maxima over `reach` places, doubled up to `width`
                by = min(reach, width - reach)
                top, reach = np.maximum(top[:-by], top[by:]), reach + by
            pooled = np.concatenate([np.broadcast_to(before, top.shape), top, np.broadcast_to(after, top.shape)], 1)
            best = max(best, float((np.maximum(pooled @ w["h"] + w["hb"], 0) @ w["o"]).max()))
        return float(1 / (1 + np.exp(-np.clip(self.scale * (best + w["ob"][0]) + self.shift, -40, 40))))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 9, rate: float = 0.004, batch: int = 64, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        self.w, y = {k: v.astype(np.float32) for k, v in self.w.items()}, y.astype(np.float32)
        m1 = {k: np.zeros_like(v) for k, v in self.w.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                g = self._gradient(x[order[i : i + batch]], y[order[i : i + batch]])
                t += 1
                for k, v in g.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.999 * m2[k] + 0.001 * v * v
                    self.w[k] -= rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
        self.w = {k: v.astype(float) for k, v in self.w.items()}

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict:
        w, n = self.w, len(x)
        win, conv, at, mean, hid, z = self._forward(x)
        dz = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        dh = np.outer(dz, w["o"]) * (hid > 0)
        dp = dh @ w["h"].T
        g = {"o": hid.T @ dz, "ob": np.array([dz.sum()]), "h": mean.T @ dh, "hb": dh.sum(0)}
        gc, gcb, ge = np.zeros_like(w["c"]), np.zeros_like(w["cb"]), np.zeros_like(w["e"])
        f, size = w["c"].shape[1], w["e"].shape[1]
        rows, cols = np.arange(n)[:, None], np.arange(f)
        for k, p in enumerate(at):
            d = dp[:, k * f : (k + 1) * f] * (conv[rows, p, cols] > 0)
            gc += np.einsum("nfs,nf->sf", win[rows, p], d)
            gcb += d.sum(0)
            back = (d[:, :, None] * w["c"].T[None]).reshape(n, f, self.span, size)
            for j in range(self.span):
                np.add.at(ge, x[rows, p + j], back[:, :, j])
        return g | {"c": gc, "cb": gcb, "e": ge}

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> None:
        """Platt scaling on findings that training has not seen; a step is halved until the loss falls."""
        z = self.logit(x)
        loss = lambda at: float((np.logaddexp(0, at[0] * z + at[1]) - y * (at[0] * z + at[1])).sum() + 5e-4 * ((at[0] - 1) ** 2 + at[1] ** 2))
        at = np.array([1.0, 0.0])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(at[0] * z + at[1], -40, 40)))
            d, h = p - y, np.maximum(p * (1 - p), 1e-6)
            H = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
            step, now = np.linalg.solve(H, [(d * z).sum() + 1e-3 * (at[0] - 1), d.sum() + 1e-3 * at[1]]), loss(at)
            while loss(at - step) > now and np.abs(step).max() > 1e-9:
                step = step / 2
            at = at - step
            if np.abs(step).max() < 1e-8:
                break
        self.scale, self.shift = float(at[0]), float(at[1])


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_VOWELS, _CONSONANTS = "aeiou", "bcdfghlmnprstvw"
#: Parts of syllables of the languages of European script.
_ONSETS = "b bl br c ch cl cr d dr f fl fr g gl gr h j k kl kn l m n p pf pl pr qu r s sch schl sh sp st str t th tr v w wh z zw".split() + [""] * 8
_NUCLEI = "a a a e e e e i i i o o u u y ai au ea ee ei eu ie io oa oo ou ue eau iou".split()
_CODAS = "b ch cht ck ct d f ft g gt h hl ht k l ld ll ls lt m mp n nd ng nn ns nt nts p r rd rk rn rs rt s sch ss st t ths ts tz tzt x".split() + [""] * 16


def labelled_findings(n: int = FINDINGS, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): half secrets, half look-alikes, made by rule."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda k=3: "".join(r.choice(_CONSONANTS) + r.choice(_VOWELS) + (r.choice(_CONSONANTS) if r.random() < 0.4 else "") for _ in range(r.randint(1, k)))
    prose = lambda: " ".join(word() for _ in range(r.randint(0, 6)))

    def joined() -> str:
        """A long word of letters only, in one case or with a capital at its start."""
        own = ""
        while len(own) < 16:
            own += r.choice(_ONSETS) + r.choice(_NUCLEI) + r.choice(_CODAS)
        return r.choice([str.lower, str.lower, str.capitalize, str.upper])(own)

    def secret() -> tuple[str, str, str]:
        kind = r.randrange(15)
        kind = 6 if kind >= 12 else kind
        if kind >= 9:
            # what base patterns find as well, and short ones
            name = r.choice(["token", "password", "secret", "api_key", "apikey", "Passwd", "TOKEN"])
            lead = r.choice([f"{name} = \"", f"{name}: ", f"{name}='", f"\"{name}\": \"", f"{name} := "])
            if kind == 9:
                return prose() + " " + lead, pick("0123456789abcdef", r.choice([32, 40, 64])), r.choice(['"', "'", "", "\n"]) + " " + prose()
            if kind == 10:
                return prose() + " " + r.choice([lead, "aws ", "key id "]), "AKIA" + pick(_UPPER + _DIGITS, 16), r.choice(['"', "", "\n"]) + " " + prose()
            lead = r.choice([lead, lead, "pwd ", "pwd: ", "passphrase ", "my password is ", "passwort: ", "log in with "])
            own = pick(_LOWER + _UPPER, 3) + pick(_DIGITS, 2) + pick(_LOWER + _UPPER + _DIGITS, r.randint(3, 10))
            return prose() + " " + lead, own, r.choice(['"', "'", "", "\n", " "]) + " " + prose()
        if kind == 0:
            own = r.choice(["ghp_", "sk-", "xoxb-", "pk_live_", "glpat-", "npm_"]) + pick(_UPPER + _LOWER + _DIGITS, r.randint(20, 40))
        elif kind == 1:
            own = pick(_UPPER + _LOWER + _DIGITS + "+/", r.randint(24, 64)) + r.choice(["", "=", "=="])
        elif kind == 2:
            own = "eyJ" + pick(_UPPER + _LOWER + _DIGITS + "_-", r.randint(30, 80))
        elif kind == 3:
            own = pick(_UPPER + _DIGITS, r.randint(20, 40))
        elif kind == 4:
            own = pick(_UPPER + _LOWER, r.randint(16, 48))
        elif kind == 5:
            own = pick(_UPPER + _LOWER + _DIGITS, r.randint(16, 20))
        elif kind == 6:
            # in the middle of a path or joined run
            joint = r.choice("/=-_")
            own = joint.join([*(word() for _ in range(r.randint(2, 8))), pick(_UPPER + _LOWER + r.choice(["", "", _DIGITS]), r.randint(20, 40)), *(word() for _ in range(r.randint(2, 8)))])
        else:
            own = pick(_UPPER + _LOWER + _DIGITS, r.randint(20, 48))
        lead = r.choice(["key: ", "Authorization: Bearer ", "private ", "export KEY=", "credential ", "auth = '", '"', "", "use ", "pwd "])
        return prose() + " " + lead, own, r.choice(["", "'", '"', ".", "\n"]) + " " + prose()

    def plain() -> tuple[str, str, str]:
        kind = r.randrange(34)
        kind = (10, 10, 10, 9, 9, 13, 13, 14)[kind - 26] if kind >= 26 else kind
        if kind >= 19:
            hexes = lambda k: pick("0123456789abcdef", k)
            lead, own = [
                lambda: (r.choice(["commit ", "revision ", "merge ", "cherry-picked from ", "parent "]), hexes(40)),
                lambda: (r.choice(["sha1 ", "sha256: ", "md5: ", "checksum ", "digest ", "etag: ", "hash "]), hexes(r.choice([32, 40, 64]))),
                lambda: (r.choice(["id ", "uuid ", "guid: ", "request "]), "-".join(map(hexes, (8, 4, 4, 4, 12)))),
                lambda: (r.choice(["page ", "", "etag "]), word(2) + "-" + pick(_DIGITS, r.randint(5, 12))),
                lambda: (r.choice(["call ", "phone ", "tel: ", "", "fax ", f"+{r.randint(1, 99)} ({pick(_DIGITS, 3)}) "]), "-".join(pick(_DIGITS, k) for k in r.choice([(3, 4), (3, 3, 4), (4, 5), (2, 4, 4)])) + r.choice(["", pick(_DIGITS, 2)])),
                lambda: (r.choice(["version ", "see ", "", "part ", "model "]), r.choice([f"v{r.randint(1, 9)}-{word()}{r.randint(1, 99)}-{word()}", f"{pick(_UPPER, 2)}-{pick(_DIGITS, 4)}-{pick(_DIGITS, 2)}", word(3).capitalize() + word(2).capitalize() + word(1), word(3) + word(2) + pick(_DIGITS, 2), f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}"])),
                lambda: (r.choice(["the ", "", "on ", "by "]), r.choice([pick(_UPPER, 2) + word(4), word(3) + "-" + word(2) + "-" + word(2), f"{r.randint(1900, 2030)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", pick(_DIGITS, r.randint(8, 15)), word(3) + "/" + word(3), word(3) + "_" + word(3)])),
            ][kind - 19]()
            return prose() + " " + lead, own, r.choice(["", "'", ".", ",", "\n"]) + " " + prose()
        if kind == 0:
            own = "_".join(word() for _ in range(r.randint(3, 6))) + "_" + pick(_DIGITS, r.randint(2, 4))
        elif kind == 1:
            own = word(6) + word(6) + pick(_DIGITS, r.randint(2, 6))
        elif kind == 2:
            own = "/".join(word() for _ in range(r.randint(3, 6))) + "/" + pick(_DIGITS, r.randint(2, 6))
        elif kind == 3:
            own = f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{pick(_DIGITS, 6)}Z"
        elif kind == 4:
            own = "-".join([word(), f"{r.randint(1, 9)}", f"{r.randint(10, 99)}", word(), word()])
        elif kind == 5:
            own = pick(_DIGITS, r.randint(13, 19)) + word()
        elif kind == 6:
            own = "".join(word(2).capitalize() for _ in range(r.randint(3, 6))) + pick(_DIGITS, r.randint(2, 3))
        elif kind == 7:
            own = word(4).upper() + "_" + word(4).upper() + "_" + pick(_DIGITS, r.randint(2, 4))
        elif kind == 8:
            own = r.choice("-=_/+") * r.randint(16, 100)
        elif kind == 9:
            own = pick(_DIGITS, r.randint(16, 24))
        elif kind in (10, 11, 15, 16, 17):
            own = joined()
        elif kind == 12:
            own = "".join(word(2).capitalize() for _ in range(r.randint(4, 9)))
        elif kind == 13:
            own = r.choice("/-_").join(r.choice([str.lower, str.capitalize])(word()) for _ in range(r.randint(5, 16)))
        elif kind == 14:
            own = "/".join(r.choice([word(), word().capitalize(), pick(_DIGITS, r.randint(1, 6))]) for _ in range(r.randint(8, 20)))
        else:
            own = word(3) + pick(_DIGITS, 2) + word(4) + pick(_DIGITS, 2) + word(5)
        lead = r.choice(["key: ", "see ", "http://" + word() + ".com/", "file ", "", "id ", "version ", "'", '"', "the "])
        return prose() + " " + lead, own, r.choice(["", "'", '"', ".", ",", "\n"]) + " " + prose()

    out = []
    for i in range(n):
        before, own, after = secret() if i % 2 else plain()
        out.append((before + own + after, len(before), len(before) + len(own), i % 2))
    return out


def _own(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The candidates of a text that a finding is in."""
    return [(a, b) for a, b in candidates(text) if a < end and b > start]


def _probabilities(net: CharCnn, text: str, some: list[tuple[int, int]]) -> list[float]:
    """A probability for each candidate; those of one window are scored together."""
    short = [(a, b) for a, b in some if b - a <= WIDTH]
    p = iter(net.probability(np.stack([_codes(text, a, b) for a, b in short])) if short else ())
    return [float(next(p)) if b - a <= WIDTH else net.highest(_whole(text, a, b)) for a, b in some]


def _windows(rows: list[tuple[str, int, int, int]], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """One window of each candidate of findings, and labels; of a long secret one that has most letters in other than lower case."""
    r, x, y = random.Random(seed), [], []
    for text, start, end, label in rows:
        for a, b in _own(text, start, end):
            places = range(max(0, b - a - WIDTH) + 1)
            odd = [*accumulate((not c.islower() for c in text[a:b]), initial=0)]
            at = max(places, key=lambda i: odd[min(i + WIDTH, b - a)] - odd[i]) if label else r.choice(places)
            x.append(_window(_whole(text, a, b), at))
            y.append(label)
    return np.stack(x), np.array(y, float)


@lru_cache(maxsize=4)
def trained(findings: int = FINDINGS, recall: float = RECALL) -> tuple[CharCnn, tuple[float, ...]]:
    """The network and its thresholds by `size_class`: fitted on 60 %, calibrated on 20 %, thresholds set on 20 % of the findings.

    The thresholds are set on findings scanned as texts are: one that has no candidate
    counts as missed.
    """
    rows = labelled_findings(findings)
    a, b = int(0.6 * len(rows)) // 2 * 2, int(0.8 * len(rows)) // 2 * 2
    net = CharCnn()
    net.fit(*_windows(rows[:a]))
    net.calibrate(*_windows(rows[a:b]))
    scores: list[list[float]] = [[], [], []]
    for row in rows[b:]:
        if row[3]:
            own = _own(*row[:3])
            scores[size_class(max((y - x for x, y in own), default=0))].append(finding_score(net, *row[:3]))
    return net, tuple(min(CERTAIN, sorted(p)[int((1 - recall) * len(p))]) if p else CERTAIN for p in scores)


def size_class(length: int) -> int:
    """0 for short runs, 1 for long ones, 2 for those longer than the network is wide."""
    return (length >= LONG) + (length > WIDTH)


def finding_score(net: CharCnn, text: str, start: int, end: int) -> float:
    """The highest probability that a scan of the text gives a finding; 0 without a candidate."""
    return max(_probabilities(net, text, _own(text, start, end)), default=0.0)


def find_secrets(text: str, net: CharCnn, thresholds: tuple[float, ...]) -> tuple[list, list, int, int]:
    """Base spans, spans of the network beyond them, how many candidates were scored, and how many base spans the network confirms.

    A run that lies in a base span is scored for that span; a base span without such a
    run is scored as it stands.
    """
    base = base_spans(text)
    some = candidates(text)
    if not base and not some:
        return [], [], 0, 0
    spans_of: list[list[tuple[int, int]]] = [[] for _ in base]
    inside, ends, i = set(), sorted((a, b, k) for k, (_, a, b) in enumerate(base)), 0
    longest = max((b - a for _, a, b in base), default=0)
    for at, (a, b) in enumerate(some):
        while i < len(ends) and ends[i][0] + longest <= a:
            i += 1
        for x, y, k in ends[i:]:
            if x >= b:
                break
            if y > a:
                spans_of[k].append((a, b))
                if x <= a and b <= y:
                    inside.add(at)
    extra = sorted({(a, b) for (_, a, b), own in zip(base, spans_of) if not own})
    found = dict(zip(some + extra, _probabilities(net, text, some + extra)))
    good = {s for s, p in found.items() if p >= thresholds[size_class(s[1] - s[0])]}
    confirmed = sum(any(s in good for s in own or [(a, b)]) for (_, a, b), own in zip(base, spans_of))
    return base, [("model", a, b) for at, (a, b) in enumerate(some) if (a, b) in good and at not in inside], len(found), confirmed


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", findings: int = FINDINGS, recall: float = RECALL) -> DataFrame:
    """(doc_id, base, model, scored, confirmed) for every row: spans as structs, in code points, and counts of `find_secrets`.

    A null text counts as empty, a null id stays null; repeated rows are scanned each,
    texts of any length as a whole; other columns are ignored, and an empty table gives
    no rows.
    """
    net, thresholds = trained(findings, recall)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    rows = lambda s: [{"kind": k, "start": a, "end": b} for k, a, b in s]

    def run(batches):
        for batch in batches:
            found = [find_secrets(v.as_py() or "", net, thresholds) for v in batch.column(1)]
            counts = [pa.array([f[i] for f in found], pa.int64()) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([rows(f[0]) for f in found], kind), pa.array([rows(f[1]) for f in found], kind), *counts], ["doc_id", "base", "model", "scored", "confirmed"])

    struct = "array<struct<kind:string,start:int,end:int>>"
    return mapped(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, f"doc_id long, base {struct}, model {struct}, scored long, confirmed long")


def mask(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    """The text with MASK for every span; spans that overlap are masked as one."""
    if text is None:
        return None
    out, at = [], 0
    for _, start, end in sorted(found, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", findings: int = FINDINGS, recall: float = RECALL) -> DataFrame:
    """Every row and column of `docs`, with MASK for each secret in `text`.

    A null text stays null, an empty one empty; repeated rows are masked each; an empty
    table gives none.
    """
    net, thresholds = trained(findings, recall)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            masked = [None if (t := v.as_py()) is None else mask(t, sum(find_secrets(t, net, thresholds)[:2], [])) for v in batch.column(at)]
            columns = batch.columns
            columns[at] = pa.array(masked, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return mapped(docs, run, docs.schema)


def report(found: DataFrame) -> DataFrame:
    """Counts by kind and digests of the spans of `spans`, by start, then kind (`model` last)."""
    each = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    order = F.array(*map(F.lit, (*KINDS, "model")))
    every = F.sort_array(F.transform(F.concat("base", "model"), lambda s: F.struct(s["start"].alias("at"), F.array_position(order, s["kind"]).alias("k"), each(s).alias("span"))))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform("base", each), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(every, lambda s: s["span"]), ",").alias("spans"),
        F.size("model").cast("long").alias("n_model"),
        F.col("scored").alias("n_scored"),
        F.col("confirmed").alias("n_confirmed"),
    )
