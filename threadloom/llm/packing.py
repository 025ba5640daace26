"""Sum-of-squares online packing of documents into windows of fixed length.

Each partition packs the stream of its rows.  `counts[h]` is the number of open
windows filled to level h.  A document goes to the level that makes the sum of
squared counts smallest (ties: the fullest level), or opens a window where that is
smaller.  Documents longer than a window first fill whole windows of their own.

While few windows are open, many levels are empty and the rule opens new ones, so of a
short stream most windows that hold several documents are closed at its end.
At the end of its stream a partition tops its fullest open windows up with pieces cut
from its emptiest ones, so at most one of its windows stays part filled.  State is the
level array plus the open windows; no rows move between partitions, a retried task
gives the same windows, and ids are unique because they carry the partition's number.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import mapped

WINDOW = 1024
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: White space that is too long for tiktoken's pattern, with room to spare.
LONG_BLANK = re.compile(r"\s{100000}")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_encoders: dict[str, object] = {}


def default_vocabulary() -> str:
    """Ranks of the same vocabulary as byte_bpe_50k.json: the same ids, encoded several times as fast."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """text -> ids (uint32 array), as the tokenizers library gives for the JSON file of the vocabulary.

    That library takes the end-of-text string in a text for its special token.  The ranks
    at `path` are read by tiktoken, whose pattern gives up on runs of white space of about
    a megabyte; texts with such a run go to the tokenizers library and the JSON file of
    the same name.
    """
    if path not in _encoders:
        import public_tokenizers
        import tiktoken
        import tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        bpe = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})

        slower: list[tokenizers.Tokenizer] = []

        def encode(text: str) -> np.ndarray:
            if not LONG_BLANK.search(text):
                return bpe.encode_to_numpy(text, allowed_special="all")
            if not slower:
                slower.append(tokenizers.Tokenizer.from_file(path.removesuffix(".tiktoken") + ".json"))
            return np.array(slower[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

        _encoders[path] = encode
    return _encoders[path]


class SumOfSquares:
    """Online packer. add() and finish() return closed windows: (fill, [(doc, start, ids, doc_tokens)])."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1)
        self.open: list[list] = [[] for _ in range(window + 1)]

    def add(self, doc, ids: np.ndarray) -> list:
        w, total, out, start = self.window, len(ids), [], 0
        while total - start >= w:
            out.append((w, [(doc, start, ids[start : start + w], total)]))
            start += w
        size = total - start
        if not size:
            return out
        # a copy: a view would keep all ids of the document as long as the window is open
        piece, counts = (doc, start, ids[start:].copy(), total), self.counts
        # half of the change in the sum of squares, by the level h that the piece goes to
        change = counts[size:] - counts[: w + 1 - size] + 1
        change[-1] -= 0.5
        change[counts[: w + 1 - size] == 0] = np.inf
        change[0] = counts[size] + 0.5
        h = len(change) - 1 - int(np.argmin(change[::-1]))
        held = self.open[h].pop() if h else []
        if h:
            counts[h] -= 1
        held.append(piece)
        if h + size == w:
            out.append((w, held))
        else:
            self.open[h + size].append(held)
            counts[h + size] += 1
        return out

    def finish(self) -> list:
        rest = [[h, held] for h in range(self.window, 0, -1) for held in self.open[h]]
        out, i, j = [], 0, len(rest) - 1
        while i < j:
            fill, held = rest[i]
            doc, start, ids, total = rest[j][1].pop()
            cut = min(self.window - fill, len(ids))
            if cut < len(ids):
                rest[j][1].append((doc, start, ids[:-cut], total))
            held.append((doc, start + len(ids) - cut, ids[-cut:], total))
            rest[i][0] += cut
            rest[j][0] -= cut
            if rest[i][0] == self.window:
                out.append((self.window, held))
                i += 1
            if not rest[j][0]:
                j -= 1
        out += [(fill, held) for fill, held in rest[i : j + 1] if fill]
        self.open, self.counts = [[] for _ in range(self.window + 1)], np.zeros(self.window + 1)
        return out


def _pack(batches: Iterator[pa.RecordBatch], vocabulary: str, window: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    sequence = (context.partitionId() if context else 0) << 40
    encode, packer, rows = encoder(vocabulary), SumOfSquares(window), []
    types = [pa.int64()] * 7
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def emit(closed: list) -> None:
        nonlocal sequence
        for _, held in closed:
            offset = 0
            for doc, start, ids, total in held:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset))
                offset += len(ids)
            sequence += 1

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)
        rows.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = encode(text.as_py() or "")
            emit(packer.add(doc, np.append(ids, np.uint32(0))))
        yield flush()
    emit(packer.finish())
    yield flush()


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """One row for each piece of each document: where it lies in which sequence.

    A document's tokens are those of its whole text and then id 0; a null or empty text
    is the id 0 alone.  A null doc_id stays null; repeated rows are packed each.  Other
    columns are ignored.  An empty table gives no rows.
    """
    vocabulary = vocabulary or default_vocabulary()
    return mapped(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")), lambda x: _pack(x, vocabulary, window), SCHEMA)
