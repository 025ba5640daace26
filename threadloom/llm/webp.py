"""Lossless WebP: encoder and decoder for single images, in numpy.

The decoder handles all of the lossless format: prefix codes and meta prefix codes,
back-references, colour cache, and the predictor, cross-colour, subtract-green and
palette transforms.  Where a picture has one group of prefix codes and no colour cache,
it finds the code lengths at every bit position at once and then only follows the chain
of pixels; otherwise it goes pixel by pixel.

The encoder writes canonical prefix codes, back-references to repeated pixels, a palette
where there are few colours, and on request the other transforms and a colour cache.
Pixels are unsigned 32-bit numbers, alpha in the highest byte.
"""

from __future__ import annotations

import struct
from functools import lru_cache
from math import ceil, log2

import numpy as np

MAX_SIDE = 1 << 14
#: Fixed values of the format: order of the lengths of the code-length code; near distances by code, as (x, y).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTH_CODES, DISTANCE_CODES = 24, 40


class Broken(ValueError):
    """The bytes are not a lossless WebP image."""


@lru_cache(maxsize=None)
def _reversed(bits: int) -> np.ndarray:
    """Every number of so many bits with its bits in reverse."""
    out = np.zeros(1 << bits, np.int64)
    for i in range(bits):
        out |= ((np.arange(1 << bits) >> i) & 1) << (bits - 1 - i)
    return out


class Code:
    """A prefix code by its lengths; canonical, read from the lowest bit."""

    __slots__ = ("bits", "size", "symbol", "mask", "sizes", "symbols")

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        """The symbols in rising order, with their lengths (a single symbol takes no bits)."""
        self.sizes = self.symbols = None
        if len(symbols) == 1:
            self.bits, self.size, self.symbol = 0, np.zeros(1, np.uint8), np.array(symbols, np.int64)
        else:
            order = np.argsort(lengths, kind="stable")
            bits = int(lengths[order[-1]]) if len(order) else 0
            span = 1 << (bits - lengths[order])
            if not len(order) or int(span.sum()) != 1 << bits:
                raise Broken("a prefix code is not complete")
            back = _reversed(bits)
            self.bits = bits
            self.size = np.repeat(lengths[order], span)[back].astype(np.uint8)
            self.symbol = np.repeat(symbols[order], span)[back]
        self.mask = (1 << self.bits) - 1

    def lists(self) -> tuple[bytes, list]:
        if self.sizes is None:
            self.sizes, self.symbols = self.size.tobytes(), self.symbol.tolist()
        return self.sizes, self.symbols


class Bits:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at, 8 * len(data)
        self.explicit = False  # whether the code read last says how many lengths it has

    def peek(self, n: int) -> int:
        a = self.at
        return (int.from_bytes(self.data[a >> 3 : (a + n + 7) >> 3], "little") >> (a & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise Broken("the data end early")
        return out

    def symbol(self, code: Code) -> int:
        sizes, symbols = code.lists()
        i = self.peek(code.bits)
        self.at += sizes[i]
        if self.at > self.end:
            raise Broken("the data end early")
        return symbols[i]

    def number(self, prefix: int) -> int:
        """A length or distance, 1 at least."""
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.read(extra) + 1


def _read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):  # one or two symbols, spelt out
        two, wide = bits.read(1), bits.read(1)
        found = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        found = sorted(set(found))
        if found[-1] >= alphabet:
            raise Broken("a symbol is outside its alphabet")
        return Code(np.array(found), np.ones(len(found), np.int64))
    n = 4 + bits.read(4)
    lengths = np.zeros(19, np.int64)
    for k in LENGTH_ORDER[:n]:
        lengths[k] = bits.read(3)
    used = np.flatnonzero(lengths)
    if not len(used):
        raise Broken("a code has no lengths")
    sizes, symbols = Code(used, lengths[used]).lists()
    mask = len(sizes) - 1
    bits.explicit = bool(bits.read(1))
    tokens = 2 + bits.read(2 + 2 * bits.read(3)) if bits.explicit else alphabet
    at, data = bits.at, bits.data
    # what all the lengths can take at most
    stream = int.from_bytes(data[at >> 3 : (at >> 3) + 2 * alphabet + 8], "little") >> (at & 7)
    out, before, i, took = [0] * alphabet, 8, 0, 0
    while i < alphabet and tokens:
        tokens -= 1
        k = stream & mask
        size, token = sizes[k], symbols[k]
        stream >>= size
        took += size
        if token < 16:
            out[i] = token
            i += 1
            if token:
                before = token
            continue
        if token == 16:
            extra, least, what = 2, 3, before
        elif token == 17:
            extra, least, what = 3, 3, 0
        else:
            extra, least, what = 7, 11, 0
        count = least + (stream & ((1 << extra) - 1))
        stream >>= extra
        took += extra
        if i + count > alphabet:
            raise Broken("too many lengths")
        if what:
            out[i : i + count] = [what] * count
        i += count
    bits.at += took
    if bits.at > bits.end:
        raise Broken("the data end early")
    lengths = np.array(out)
    used = np.flatnonzero(lengths)
    return Code(used, lengths[used])


def _read_group(bits: Bits, cache: int) -> list[Code]:
    out: list[Code] = []
    known: list[tuple[int, int, Code]] = []  # descriptions end by themselves, so equal bits are equal codes
    for alphabet in (256 + LENGTH_CODES + cache, 256, 256, 256, DISTANCE_CODES):
        for size, value, code in known:
            if bits.peek(size) == value and int(code.symbol.max()) < alphabet:
                bits.at += size
                break
        else:
            start = bits.at
            code = _read_code(bits, alphabet)
            size = bits.at - start
            bits.at = start
            if bits.peek(1) or bits.explicit:
                known.append((size, bits.peek(size), code))
            bits.at = start + size
        out.append(code)
    return out


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _pixels_in_bulk(bits: Bits, width: int, count: int, group: list[Code]) -> np.ndarray:
    """Pixels of an image with one group of codes and no colour cache."""
    data = np.frombuffer(bits.data, np.uint8)[bits.at >> 3 :]
    lead = bits.at & 7
    padded = np.zeros(len(data) + 12, np.int64)
    padded[: len(data)] = data
    words = padded[:-2] | padded[1:-1] << 8 | padded[2:] << 16
    window = (words[:, None] >> np.arange(8)).ravel()
    n = len(window)
    most = sum(c.bits for c in group[:4])
    limit = max(n - most - 1, 1)
    first = group[0]
    green = window & first.mask
    sizes = {id(first): first.size[green]}
    total = sizes[id(first)][:limit].astype(np.int64)
    place = np.arange(limit)
    for code in group[1:4]:
        if code.bits:
            own = sizes.get(id(code))
            if own is None:
                own = sizes[id(code)] = code.size[window & code.mask]
            total += own[place + total]
    # 255 stands for a pixel that is not spelt out
    special = first.symbol >= 256
    some = bool(special.any())
    if some:
        total[special[green[:limit]]] = 255
    step = total.astype(np.uint8).tobytes()
    starts: list[int] = []
    copies: list[tuple[int, int, int]] = []
    at, made, base = lead, 0, (bits.at >> 3) * 8
    if most == 0 and not some:
        starts = [at] * count
        made = count
    else:
        add = starts.append
        while made < count:
            if at >= limit:
                raise Broken("the data end early")
            s = step[at]
            if s != 255:
                add(at)
                at += s
                made += 1
                continue
            bits.at = base + at
            length = bits.number(bits.symbol(first) - 256)
            distance = _distance(bits.number(bits.symbol(group[4])), width)
            at = bits.at - base
            if distance > made or made + length > count:
                raise Broken("a copy reaches outside the image")
            copies.append((made, length, distance))
            made += length
    bits.at = base + at
    if bits.at > bits.end:
        raise Broken("the data end early")
    p = np.array(starts, np.int64)
    parts = []
    for code in group[:4]:
        k = window[p] & code.mask
        parts.append(code.symbol[k].astype(np.uint32))
        p = p + code.size[k]
    spelt = parts[3] << 24 | parts[1] << 16 | parts[0] << 8 | parts[2]
    if not copies:
        return spelt
    out, done, used = np.zeros(count, np.uint32), 0, 0
    for start, length, distance in copies:
        out[done:start] = spelt[used : used + start - done]
        used += start - done
        while length:  # a copy that overlaps itself repeats what it has just made
            some = min(length, distance)
            out[start : start + some] = out[start - distance : start - distance + some]
            start, length = start + some, length - some
            distance += some if length else 0
        done = start
    out[done:] = spelt[used:]
    return out


def _pixels(bits: Bits, width: int, count: int, cache_bits: int, groups: list[list[Code]], which: list[int] | None, shift: int) -> np.ndarray:
    """Pixels one by one. which: by block, the group of codes; None if there is one."""
    out = [0] * count
    cache = [0] * (1 << cache_bits) if cache_bits else []
    across = -(-width >> shift) if which else 0
    group, at, seen = groups[0], 0, 0
    while at < count:
        if which:
            group = groups[which[(at // width >> shift) * across + (at % width >> shift)]]
        s = bits.symbol(group[0])
        if s < 256:
            red, blue, alpha = bits.symbol(group[1]), bits.symbol(group[2]), bits.symbol(group[3])
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 256 + LENGTH_CODES:
            length = bits.number(s - 256)
            distance = _distance(bits.number(bits.symbol(group[4])), width)
            if distance > at or at + length > count:
                raise Broken("a copy reaches outside the image")
            for _ in range(length):
                out[at] = out[at - distance]
                at += 1
        else:
            out[at] = cache[s - 256 - LENGTH_CODES]
            at += 1
        if cache_bits:
            for p in out[seen:at]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            seen = at
    return np.array(out, np.uint32)


def _read_image(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Broken("the colour cache is too large")
    which, shift, n = None, 0, 1
    if main and bits.read(1):
        shift = bits.read(3) + 2
        blocks = _read_image(bits, -(-width >> shift), -(-height >> shift))
        which = ((blocks >> 8) & 0xFFFF).astype(int).ravel().tolist()
        n = max(which) + 1
    groups = [_read_group(bits, 1 << cache_bits if cache_bits else 0) for _ in range(n)]
    if which is None and not cache_bits and width * height >= 16 and all(c.bits for c in groups[0][:1]):
        flat = _pixels_in_bulk(bits, width, width * height, groups[0])
    else:
        flat = _pixels(bits, width, width * height, cache_bits, groups, which, shift)
    return flat.reshape(height, width)


def _channels(image: np.ndarray) -> np.ndarray:
    """(..., 4) of alpha, red, green, blue."""
    return np.stack([(image >> s & 0xFF).astype(np.int64) for s in (24, 16, 8, 0)], -1)


def _joined(c: np.ndarray) -> np.ndarray:
    c = (c & 0xFF).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predicted(mode: int, left, top, top_right, top_left):
    """A pixel's prediction; on channel arrays of one pixel or of many."""
    half = lambda a, b: (a + b) >> 1
    clamp = lambda x: np.clip(x, 0, 255)
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return half(half(left, top_right), top)
    if mode == 6:
        return half(left, top_left)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(top_left, top)
    if mode == 9:
        return half(top, top_right)
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        to_left, to_top = np.abs(top - top_left).sum(-1, keepdims=True), np.abs(left - top_left).sum(-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return clamp(left + top - top_left)
    if mode == 13:
        a = half(left, top)
        d = a - top_left
        return clamp(a + np.where(d < 0, -(-d >> 1), d >> 1))
    return np.broadcast_to(np.array([255, 0, 0, 0]), np.shape(left))


def _unpredict(image: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    rest, (h, w) = _channels(image), image.shape
    out = np.zeros_like(rest)
    out[0, 0] = (rest[0, 0] + [255, 0, 0, 0]) & 0xFF
    if w > 1:
        out[0, 1:] = rest[0, 1:]
        out[0] = np.cumsum(out[0], 0) & 0xFF
    for y in range(1, h):
        row, above = out[y], out[y - 1]
        row[0] = (rest[y, 0] + above[0]) & 0xFF
        for x in range(1, w):
            right = above[x + 1] if x + 1 < w else row[0]
            row[x] = (rest[y, x] + _predicted(int(modes[y >> shift, x >> shift]), row[x - 1], above[x], right, above[x - 1])) & 0xFF
    return _joined(out)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x ^ 0x80) - 0x80


def _cross(image: np.ndarray, elements: np.ndarray, shift: int, inverse: bool) -> np.ndarray:
    h, w = image.shape
    c = _channels(image)
    e = _channels(np.repeat(np.repeat(elements, 1 << shift, 0), 1 << shift, 1)[:h, :w])
    delta = lambda t, x: (_signed(t) * _signed(x)) >> 5
    red, green, blue = c[..., 1].copy(), c[..., 2], c[..., 3].copy()
    sign = 1 if inverse else -1
    new_red = (red + sign * delta(e[..., 3], green)) & 0xFF
    blue = blue + sign * delta(e[..., 2], green)
    blue = blue + sign * delta(e[..., 1], new_red if inverse else red)
    c[..., 1], c[..., 3] = new_red, blue & 0xFF
    return _joined(c)


def _add_green(image: np.ndarray, sign: int) -> np.ndarray:
    c = _channels(image)
    c[..., 1] += sign * c[..., 2]
    c[..., 3] += sign * c[..., 2]
    return _joined(c)


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """Pixels of a WebP file with a lossless image; Broken if the bytes hold none."""
    if len(data) < 21 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Broken("no WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise Broken("no lossless image")
        at += 8 + (struct.unpack("<I", data[at + 4 : at + 8])[0] + 1) // 2 * 2
    size = struct.unpack("<I", data[at + 4 : at + 8])[0]
    bits = Bits(data[at + 8 : at + 8 + size])
    if bits.read(8) != 0x2F:
        raise Broken("no lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise Broken("an unknown version")
    undo, w = [], width
    while bits.read(1):
        kind = bits.read(2)
        if any(k == kind for k, *_ in undo):
            raise Broken("a transform comes twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            undo.append((kind, _read_image(bits, -(-w >> shift), -(-height >> shift)), shift))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = _joined(np.cumsum(_channels(_read_image(bits, n, 1))[0], 0))
            undo.append((kind, table, w))
            w = -(-w >> _bundle(n))
        else:
            undo.append((kind, None, 0))
    image = _read_image(bits, w, height, True)
    for kind, what, k in reversed(undo):
        if kind == PREDICTOR:
            image = _unpredict(image, what >> 8 & 15, k)
        elif kind == CROSS_COLOUR:
            image = _cross(image, what, k, True)
        elif kind == SUBTRACT_GREEN:
            image = _add_green(image, 1)
        else:
            b = _bundle(len(what))
            index = (image >> 8 & 0xFF).astype(np.int64)
            each = 8 >> b
            index = (index[..., None] >> (np.arange(1 << b) * each) & ((1 << each) - 1)).reshape(height, -1)[:, :k]
            image = np.append(what, np.zeros(256, np.uint32))[index]
    return image


def code_lengths(counts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that occur and the lengths of a complete prefix code for them, of `limit` at most."""
    used = np.flatnonzero(counts)
    n = counts[used]
    if len(used) < 2:
        return used, np.ones(len(used), np.int64)
    lengths = np.ceil(np.log2(n.sum() / n)).clip(1, limit).astype(np.int64).tolist()
    order = np.argsort(-n, kind="stable").tolist()
    free = (1 << limit) - sum(1 << (limit - x) for x in lengths)
    for i in reversed(order):  # too full: longer codes for the rarest
        while free < 0 and lengths[i] < limit:
            lengths[i] += 1
            free += 1 << (limit - lengths[i])
        if free >= 0:
            break
    while free:  # room left: shorter codes, the most frequent first
        for i in order:
            own = 1 << (limit - lengths[i])
            if own <= free and lengths[i] > 1:
                lengths[i] -= 1
                free -= own
                if not free:
                    break
    return used, np.array(lengths)


class _Out:
    """Bits, lowest first."""

    def __init__(self):
        self.value, self.n, self.done = 0, 0, bytearray()

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n > 2048:
            k = self.n >> 3
            self.done += (self.value & ((1 << 8 * k) - 1)).to_bytes(k, "little")
            self.value >>= 8 * k
            self.n -= 8 * k

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Values of at most 63 bits each."""
        at = self.n + np.cumsum(sizes) - sizes
        total = int(at[-1] + sizes[-1])
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        starts = np.searchsorted(word, np.arange(word[-1] + 1))
        out = np.zeros(int(word[-1]) + 3, np.uint64)
        out[: len(starts)] = np.bitwise_or.reduceat(values << shift, starts)
        ends = np.append(starts[1:], len(word)) - 1
        over = np.where(shift[ends] > 0, values[ends] >> (np.uint64(64) - np.maximum(shift[ends], np.uint64(1))), np.uint64(0))
        out[1 : len(starts) + 1] |= over
        first = int(out[0]) | self.value & ((1 << 64) - 1)
        # what stood before may be longer than a word
        data = first.to_bytes(8, "little") + out[1:].tobytes()
        k = total >> 3
        self.done += data[:k]
        self.n = total & 7
        self.value = data[k] & ((1 << self.n) - 1) if self.n else 0

    def settle(self) -> None:
        k = self.n >> 3
        self.done += (self.value & ((1 << 8 * k) - 1)).to_bytes(k, "little")
        self.value >>= 8 * k
        self.n &= 7

    def bytes(self) -> bytes:
        return bytes(self.done) + self.value.to_bytes((self.n + 7) >> 3, "little")


def _codes(symbols: np.ndarray, lengths: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """By symbol: its code, to be written from the lowest bit, and the code's length."""
    code, size = np.zeros(alphabet, np.uint64), np.zeros(alphabet, np.int64)
    if len(symbols) > 1:
        order = np.argsort(lengths, kind="stable")
        bits = int(lengths[order[-1]])
        span = 1 << (bits - lengths[order])
        code[symbols[order]] = _reversed(bits)[np.cumsum(span) - span].astype(np.uint64)
        size[symbols] = lengths
    return code, size


def _put_code(out: _Out, symbols: np.ndarray, lengths: np.ndarray, alphabet: int) -> None:
    if len(symbols) <= 2 and (not len(symbols) or symbols[-1] < 256):
        found = symbols.tolist() or [0]
        out.put(1 | (len(found) - 1) << 1 | 1 << 2, 3)
        for s in found:
            out.put(s, 8)
        return
    last = int(symbols[-1])
    full = np.zeros(last + 1, np.int64)
    full[symbols] = lengths
    edges = np.flatnonzero(np.diff(full)) + 1
    tokens: list[tuple[int, int, int]] = []  # token, extra value, extra bits
    before = 8
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), last + 1]):
        what, run = int(full[a]), b - a
        if what:
            if what != before:
                tokens.append((what, 0, 0))
                before, run = what, run - 1
            while run >= 3:
                k = min(run, 6)
                tokens.append((16, k - 3, 2))
                run -= k
            tokens += [(what, 0, 0)] * run
        else:
            while run >= 11:
                k = min(run, 138)
                tokens.append((18, k - 11, 7))
                run -= k
            if run >= 3:
                tokens.append((17, run - 3, 3))
                run = 0
            tokens += [(0, 0, 0)] * run
    counts = np.bincount([t for t, _, _ in tokens], minlength=19)
    if (counts > 0).sum() < 2:
        counts[17 if not counts[17] else 0] += 1
    used, sizes = code_lengths(counts, 7)
    code, size = _codes(used, sizes, 19)
    n = max(i for i, k in enumerate(LENGTH_ORDER) if size[k]) + 1
    n = max(n, 4)
    out.put((n - 4) << 1, 5)
    for k in LENGTH_ORDER[:n]:
        out.put(int(size[k]), 3)
    # tokens that are written, as the rest of the alphabet has no codes
    extra = max(0, ceil((max(1, (len(tokens) - 2).bit_length()) - 2) / 2))
    out.put(1 | extra << 1, 4)
    out.put(len(tokens) - 2, 2 + 2 * extra)
    code, size = code.tolist(), size.tolist()
    value = at = 0
    for t, x, n in tokens:
        value |= (code[t] | x << size[t]) << at
        at += size[t] + n
    out.put(value, at)


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix code, extra value and extra bits of a length or distance."""
    u = value - 1
    if u < 4:
        return u, 0, 0
    top = u.bit_length() - 1
    extra = top - 1
    return 2 * top + (u >> extra & 1), u & ((1 << extra) - 1), extra


def _matches(flat: np.ndarray, least: int = 4, most: int = 4096) -> list[tuple[int, int, int]]:
    """(start, length, distance) of runs that occurred before, without overlap, from the left."""
    n = len(flat) - 3  # keys of four pixels
    if n < 2:
        return []
    x = flat.astype(np.uint64)
    key = x[:n] * np.uint64(0x9E3779B97F4A7C15) ^ x[1 : n + 1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ x[2 : n + 2] * np.uint64(0x165667B19E3779F9) ^ x[3 : n + 3] * np.uint64(0x27D4EB2F165667C5)
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(same):
        return []
    at, before = order[same + 1], order[same]
    sort = np.argsort(at, kind="stable")
    out, end = [], 0
    for i, j in zip(at[sort].tolist(), before[sort].tolist()):
        if i < end:
            continue
        stop = min(most, len(flat) - i)
        length, step = 0, 16
        while length < stop:
            k = min(step, stop - length)
            differ = np.flatnonzero(flat[i + length : i + length + k] != flat[j + length : j + length + k])
            if len(differ):
                length += int(differ[0])
                break
            length += k
            step *= 4
        if length >= least:
            out.append((i, length, i - j))
            end = i + length
    return out


def _put_image(out: _Out, image: np.ndarray, main: bool = False, cache_bits: int = 0, copies: int = 4, shared: bool = False) -> None:
    width, flat = image.shape[1], np.ascontiguousarray(image).ravel()
    found = _matches(flat, copies) if copies and len(flat) >= 16 else []
    out.put(1 | cache_bits << 1, 5) if cache_bits else out.put(0, 1)
    if main:
        out.put(0, 1)  # one group of prefix codes
    if found:
        covered = np.zeros(len(flat), bool)
        for start, length, _ in found:
            covered[start : start + length] = True
        spelt = np.flatnonzero(~covered)
    else:
        covered, spelt = np.zeros(len(flat) if cache_bits else 0, bool), np.arange(len(flat))
    cached: dict[int, int] = {}
    if cache_bits:
        cache, known = [0] * (1 << cache_bits), covered.tolist()
        for i, p in enumerate(flat.tolist()):
            k = (CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)
            if not known[i] and cache[k] == p:
                cached[i] = k
            cache[k] = p
        spelt = np.array([i for i in spelt.tolist() if i not in cached], np.int64)
    p = flat[spelt]
    parts = [(p >> s & 0xFF).astype(np.int64) for s in (8, 16, 0, 24)]  # green, red, blue, alpha
    alphabet = 256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0)
    shared = shared and not cache_bits and len(p) > 0
    if shared:  # one code for all channels, but that green has the copies as well
        counts = [np.bincount(np.ascontiguousarray(p).view(np.uint8), minlength=alphabet)]
        counts = [counts[0].copy(), counts[0][:256], np.zeros(0), np.zeros(0), np.zeros(DISTANCE_CODES, np.int64)]
    else:
        counts = [np.bincount(x, minlength=n) for x, n in zip(parts, (alphabet, 256, 256, 256))] + [np.zeros(DISTANCE_CODES, np.int64)]
    near: dict[int, int] = {}
    if found:
        for i, (x, y) in enumerate(NEAR, 1):
            if x + y * width >= 1:
                near.setdefault(x + y * width, i)
    coded = [(start, _prefix(length), _prefix(near.get(d, d + len(NEAR)))) for start, length, d in found]
    for _, a, b in coded:
        counts[0][256 + a[0]] += 1
        counts[4][b[0]] += 1
    for k in cached.values():
        counts[0][256 + LENGTH_CODES + k] += 1
    tables: list = []
    for k, c in enumerate(counts):
        if shared and (k in (2, 3) or k == 1 and not found):
            out.put(*written)
            tables.append(tables[-1])
            continue
        symbols, lengths = code_lengths(c, 12)
        if len(symbols) == 1 and symbols[0] >= 256:  # cannot be spelt out alone
            symbols, lengths = np.append(0, symbols), np.ones(2, np.int64)
        own = _Out()
        _put_code(own, symbols, lengths, len(c))
        written = int.from_bytes(own.bytes(), "little"), own.n + 8 * len(own.done)
        out.put(*written)
        tables.append(_codes(symbols, lengths, len(c)))
    out.settle()
    values, sizes = np.zeros(len(p), np.uint64), np.zeros(len(p), np.int64)
    for x, (code, size) in zip(parts, tables):
        values |= code[x] << sizes.astype(np.uint64)
        sizes += size[x]
    if coded or cached:
        more = []
        (green, green_size), (far, far_size) = tables[0], tables[4]
        for start, (a, x, n), (b, y, m) in coded:
            value, size = int(green[256 + a]), int(green_size[256 + a])
            value |= x << size
            size += n
            value |= int(far[b]) << size
            size += int(far_size[b])
            more.append((start, value | y << size, size + m))
        more += [(i, int(green[256 + LENGTH_CODES + k]), int(green_size[256 + LENGTH_CODES + k])) for i, k in cached.items()]
        where = np.concatenate([spelt, [m[0] for m in more]]).astype(np.int64)
        order = np.argsort(where, kind="stable")
        values = np.concatenate([values, np.array([m[1] for m in more], np.uint64)])[order]
        sizes = np.concatenate([sizes, np.array([m[2] for m in more], np.int64)])[order]
    if len(values):
        out.many(values, sizes)


def _predict(image: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """What is left after prediction, and the mode of each block."""
    c, (h, w) = _channels(image), image.shape
    left, top = np.roll(c, 1, 1), np.roll(c, 1, 0)
    top_left, top_right = np.roll(top, 1, 1), np.roll(top, -1, 1)
    top_right[:, -1] = c[:, 0]
    modes = np.zeros((-(-h >> shift), -(-w >> shift)), np.int64)
    least = np.full(modes.shape, np.iinfo(np.int64).max)
    rest = [(c - _predicted(m, left, top, top_right, top_left)) & 0xFF for m in range(14)]
    for m, r in enumerate(rest):
        cost = np.pad(np.abs(_signed(r)).sum(-1), ((0, (modes.shape[0] << shift) - h), (0, (modes.shape[1] << shift) - w)))
        cost = cost.reshape(modes.shape[0], 1 << shift, modes.shape[1], 1 << shift).sum((1, 3))
        modes[cost < least], least = m, np.minimum(cost, least)
    full = np.repeat(np.repeat(modes, 1 << shift, 0), 1 << shift, 1)[:h, :w]
    out = np.take_along_axis(np.stack(rest), full[None, ..., None], 0)[0]
    out[0] = (c[0] - left[0]) & 0xFF
    out[:, 0] = (c[:, 0] - top[:, 0]) & 0xFF
    out[0, 0] = (c[0, 0] - [255, 0, 0, 0]) & 0xFF
    return _joined(out), modes


def encode(image: np.ndarray, predictor: bool = False, cross_colour: bool = False, subtract_green: bool = False, palette: bool | None = None, cache_bits: int = 0, copies: int = 4, shared: bool = False, shift: int = 4) -> bytes:
    """A WebP file of the pixels. palette None: where there are at most 16 colours; copies: pixels of
    the shortest copy, 0 for none; shared: one prefix code for all channels."""
    height, width = image.shape
    out = _Out()
    out.put(0x2F | (width - 1) << 8 | (height - 1) << 22 | 1 << 36, 40)
    colours = None
    if palette or palette is None and image.size >= 16 and len(np.unique(image.ravel()[:64])) <= 16:
        colours = np.unique(image)
        if len(colours) > (256 if palette else 16):
            colours = None
    if colours is not None:
        out.put(1 | PALETTE << 1 | (len(colours) - 1) << 3, 11)
        c = _channels(colours)
        c[1:] -= c[:-1].copy()
        _put_image(out, _joined(c)[None])
        b = _bundle(len(colours))
        index = np.searchsorted(colours, image)
        index = np.pad(index, ((0, 0), (0, -width % (1 << b)))).reshape(height, -1, 1 << b)
        image = ((index << (np.arange(1 << b) * (8 >> b))).sum(-1) << 8).astype(np.uint32)
    if subtract_green:
        out.put(1 | SUBTRACT_GREEN << 1, 3)
        image = _add_green(image, -1)
    if predictor:
        image, modes = _predict(image, shift)
        out.put(1 | PREDICTOR << 1 | (shift - 2) << 3, 6)
        _put_image(out, (modes << 8).astype(np.uint32) | np.uint32(0xFF000000))
    if cross_colour:
        c = _signed(_channels(image)).astype(float)
        rows, cols = -(-image.shape[0] >> shift), -(-image.shape[1] >> shift)
        e = np.zeros((rows, cols, 4), np.int64)
        e[..., 0] = 255
        for y in range(rows):
            for x in range(cols):
                b = c[y << shift : (y + 1) << shift, x << shift : (x + 1) << shift].reshape(-1, 4)
                fit = lambda s, t: int(np.clip(round(32 * float(s @ t) / max(1.0, float(s @ s))), -128, 127)) & 0xFF
                e[y, x, 1:] = fit(b[:, 1], b[:, 3]) // 2, fit(b[:, 2], b[:, 3]), fit(b[:, 2], b[:, 1])
        elements = _joined(e)
        image = _cross(image, elements, shift, False)
        out.put(1 | CROSS_COLOUR << 1 | (shift - 2) << 3, 6)
        _put_image(out, elements)
    out.put(0, 1)
    _put_image(out, image, True, cache_bits, copies, shared)
    data = out.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
