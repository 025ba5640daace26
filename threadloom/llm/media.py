"""Media columns: payloads kept as lossless WebP images, and pixel arrays read from them.

A payload is the text's UTF-8 with zero bytes up to a positive multiple of 64.  Four
samples make a pixel, 16 pixels a row; every ROWS rows are an image of their own, so a
long payload takes bounded memory.  Rows of the table never move; each is coded and
decoded where it lies.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import webp

UNIT, WIDTH, ROWS = 64, 16, 4096
#: Ways to write an image, and how much smaller than plain an estimate must be for one: a
#: table of transforms costs bytes of its own, and a cache is slow to read.
WAYS: dict[str, tuple[dict, float]] = {
    "plain": ({}, 1.0),
    "green": ({"subtract_green": True}, 0.97),
    "predicted": ({"predictor": True}, 0.9),
    "crossed": ({"cross_colour": True}, 0.9),
    "both": ({"predictor": True, "cross_colour": True}, 0.85),
    "cached": ({"cache_bits": 6}, 0.7),
}
MEDIA = "doc_id long, n_bytes long, media array<binary>"
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and those with the padding; null counts as empty."""
    data = (text or "").encode()
    return len(data), data + b"\0" * (-len(data) % UNIT if data else UNIT)


def _bits(channels: np.ndarray) -> float:
    """Entropy of the samples, with one code for all channels."""
    counts = np.bincount(channels.ravel() & 0xFF, minlength=256)
    counts = counts[counts > 0]
    return float((counts * np.log2(counts.sum() / counts)).sum())


def _less_green(c: np.ndarray) -> np.ndarray:
    """Channels (blue, green, red, alpha) less the multiple of green that fits the image best."""
    signed = ((c + 128) & 0xFF) - 128
    out, green = c.copy(), signed[..., 1].astype(float)
    for k in (0, 2):
        times = round(32 * float((green * signed[..., k]).sum()) / max(1.0, float((green * green).sum())))
        out[..., k] -= (int(np.clip(times, -128, 127)) * signed[..., 1]) >> 5
    return out


def way(pixels: np.ndarray) -> str:
    """How an image of any size is best written, by the entropy of what each way would leave.

    Estimated are the transforms of the whole image (each pixel against the one to its
    left, or above in the first column) and the pixels that a cache would hold.
    """
    c = np.ascontiguousarray(pixels).view(np.uint8).reshape(*pixels.shape, 4).astype(np.int32)
    near = c.copy()
    near[:, 1:] -= c[:, :-1]
    near[1:, 0] -= c[:-1, 0]
    green = c.copy()
    green[..., 0] -= c[..., 1]
    green[..., 2] -= c[..., 1]
    flat = pixels.ravel()
    slot = (flat * np.uint32(0x1E35A7BD)) >> np.uint32(32 - WAYS["cached"][0]["cache_bits"])
    order = np.argsort(slot, kind="stable")
    hits = int(((slot[order][1:] == slot[order][:-1]) & (flat[order][1:] == flat[order][:-1])).sum())
    plain = _bits(c)
    each = {"plain": plain, "green": _bits(green), "predicted": _bits(near), "crossed": _bits(_less_green(c)), "both": _bits(_less_green(near)), "cached": plain * (1 - hits / flat.size) + hits * WAYS["cached"][0]["cache_bits"]}
    fit = {name: bits / WAYS[name][1] for name, bits in each.items()}
    return min(fit, key=fit.get)


def images(data: bytes) -> list[bytes]:
    """Lossless WebP files of a payload, each written once, in the way that `way` estimates best."""
    pixels = np.frombuffer(data, "<u4").reshape(-1, WIDTH)
    parts = [pixels[i : i + ROWS] for i in range(0, len(pixels), ROWS)]
    return [webp.encode(part, shared=True, **WAYS[way(part)][0]) for part in parts]


def samples(media: list[bytes]) -> list[np.ndarray]:
    """Arrays (rows, 16, 4) of 8-bit samples: blue, green, red and alpha of every pixel."""
    return [np.ascontiguousarray(webp.decode(m).astype("<u4")).view(np.uint8).reshape(-1, WIDTH, 4) for m in media]


def feature(parts: list[np.ndarray]) -> str:
    """Size, mean of the samples in thousandths, and how many fall in each sixteenth of their range."""
    counts = sum(np.bincount(p.ravel() >> 4, minlength=16) for p in parts)
    total, n = sum(int(p.sum(dtype=np.int64)) for p in parts), sum(p.size for p in parts)
    rows = sum(len(p) for p in parts)
    return f"{WIDTH}x{rows};{total * 1000 // n};" + ",".join(map(str, counts.tolist()))


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every row's payload as WebP files.

    A null text counts as empty, a null id stays null; repeated rows are stored each; a
    long text takes several files; other columns are ignored; an empty table gives none.
    """

    def run(batches):
        for batch in batches:
            got = [payload(v.as_py()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([images(p) for _, p in got], pa.list_(pa.binary()))], ["doc_id", "n_bytes", "media"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, MEDIA)


def load(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, height, width, samples): pixel arrays of what `store` gives, samples row by row.

    Null media give null samples; bytes that are no lossless WebP are an error.
    """

    def run(batches):
        for batch in batches:
            out = [None if m is None else samples(m) for m in batch.column("media").to_pylist()]
            height = [None if o is None else sum(map(len, o)) for o in out]
            flat = [None if o is None else b"".join(p.tobytes() for p in o) for o in out]
            columns = [pa.array(height, pa.int32()), pa.array([None if o is None else WIDTH for o in out], pa.int32()), pa.array(flat, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], ["doc_id", "n_bytes", "height", "width", "samples"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, height int, width int, samples binary")


def report(stored: DataFrame) -> DataFrame:
    """Digests of the media, and of the payload and features read back from them."""

    def run(batches):
        for batch in batches:
            rows = []
            for n, media in zip(batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist()):
                parts = samples(media)
                back = b"".join(p.tobytes() for p in parts)
                files = b"".join(media)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(files), hashlib.sha256(files).hexdigest(), feature(parts)))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], [x.split()[0] for x in SCHEMA.split(", ")])

    return stored.mapInArrow(run, SCHEMA)
