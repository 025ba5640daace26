"""Byte-level BPE by a lazily determinised transducer, and a streaming decoder.

A sequence of tokens is the BPE encoding of its bytes exactly if every two neighbours
are the encoding of their own two-token text.  So each prefix of a text has one last
token, and reading bytes from the left needs only the open possibilities: positions
from which a longer token may still run.  A state of the machine is that set, each
possibility with its place in the token trie and the token before it; what all of them
agree on is emitted.  No possibility is older than the longest token, which bounds the
lookahead.  States and transitions are made
when first needed and kept, within a bound, by each worker.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_STATES = 300_000
MAX_PIECES = 600_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars long"
START = -1

_codecs: dict[str, Codec] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """What the ranks say about pairs of tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.text = {i: b for b, i in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.known: dict[tuple[int, int], bool] = {}

    def merge(self, text: bytes, top: int | None = None) -> list[int]:
        """Tokens of a short text by the merges themselves, without any merge that makes `top`."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1], 1 << 40)) != top), default=(1 << 40, 0))
            if best[0] == 1 << 40:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte and for a token that no merges reach."""
        if token not in self.halves:
            found = None
            if len(text := self.text[token]) > 1:
                parts = self.merge(text, token)
                found = (parts[0], parts[1]) if len(parts) == 2 else None
            self.halves[token] = found
        return self.halves[token]

    def reached(self, token: int) -> bool:
        return len(self.text[token]) == 1 or self.split(token) is not None

    def stable(self, left: int, right: int) -> bool:
        """Whether the text of the two tokens is encoded as just these two."""
        key = (left, right)
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 2_000_000:
                self.known.clear()
            found = self.known[key] = self._stable(left, right)
        return found

    def _stable(self, left: int, right: int) -> bool:
        """No merge across the border ever comes before the merges that build both tokens.

        Undo the later of the two last merges again and again; at each step the tokens
        that meet at the border must not merge earlier than what was undone.
        """
        text, ranks = self.text, self.ranks
        last = 1 << 40  # rank of the merge undone last
        strict = True  # whether a merge of that very rank across the border would have come first
        while True:
            r = ranks.get(text[left] + text[right])
            if r is not None and (r < last or not strict and r == last):
                return False
            a, b = self.split(left), self.split(right)
            if a is None and b is None:
                return True
            # equal ranks merge from the left, so the left token's merge is the earlier one
            if b is None or a is not None and left > right:
                last, left, strict = left, a[1], True
            else:
                last, right, strict = right, b[0], False


class Transducer:
    """Bytes in, tokens out.

    A state is the set of tokens that may still run: (trie node, token before it).  A
    transition also names the token that ends at its byte, so the tokens are found by
    going back from any settled byte.  `encode` settles what all open tokens agree on
    every SETTLE bytes, and the rest at the end.
    """

    SETTLE = 512
    BITS = 20

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.merges = Merges(ranks)
        self.max_states = max_states
        self.size = {i: len(b) for b, i in ranks.items()}
        self.depth: dict[int, int] = {}
        self.root: dict = {}
        self.depth[id(self.root)] = 0
        for text, token in ranks.items():
            if not self.merges.reached(token):
                continue
            node = self.root
            for n, b in enumerate(text, 1):
                node = node.setdefault(b, {})
                self.depth[id(node)] = n
            node[-1] = token
        self._reset()

    def _reset(self) -> None:
        self.states = [((self.root, START),)]
        self.number = {((id(self.root), START),): 0}
        #: state << 8 | byte -> next state << BITS | token that ends here
        self.moves: dict[int, int] = {}

    def _move(self, state: int, byte: int) -> int:
        alive, ended, stable = [], None, self.merges.stable
        for node, before in self.states[state]:
            child = node.get(byte)
            if child is None:
                continue
            token = child.get(-1)
            if token is None or len(child) > 1:
                alive.append((child, before))
            if token is not None and ended is None and (before == START or stable(before, token)):
                ended = token
        alive.append((self.root, ended))
        key = tuple([(id(node), before) for node, before in alive])
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(tuple(alive))
        found = self.moves[state << 8 | byte] = to << self.BITS | ended
        return found

    def _back(self, last: list[int], end: int) -> list[int]:
        out = []
        while end:
            token = last[end - 1]
            out.append(token)
            end -= self.size[token]
        out.reverse()
        return out

    def _agreed(self, last: list[int], state: int) -> int:
        """Up to where the tokens are the same for every token that is still open."""
        ends = {len(last) - self.depth[id(node)] for node, _ in self.states[state]}
        while len(ends) > 1:
            end = max(ends)
            ends.remove(end)
            ends.add(end - self.size[last[end - 1]])
        return ends.pop()

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > self.max_states:
            self._reset()
        get, bits, mask, state, out = self.moves.get, self.BITS, (1 << self.BITS) - 1, 0, []
        last: list[int] = []
        for start in range(0, len(piece), self.SETTLE):
            for byte in piece[start : start + self.SETTLE]:
                found = get(state << 8 | byte)
                if found is None:
                    found = self._move(state, byte)
                state = found >> bits
                last.append(found & mask)
            end = self._agreed(last, state) if start + self.SETTLE < len(piece) else len(last)
            out += self._back(last, end)
            del last[:end]
        return out


class Utf8Stream:
    """Incremental UTF-8: feed() gives the text that is certain so far, close() the rest.

    A state machine over the bytes tells whether the end of what came is part of a
    sequence that later bytes may complete; such an end, three bytes at most, waits.
    Bytes that no valid sequence holds become U+FFFD.
    """

    #: lead byte range -> (allowed second bytes, continuation bytes after the second)
    LEADS = [(0xC2, 0xDF, 0x80, 0xBF, 0), (0xE0, 0xE0, 0xA0, 0xBF, 1), (0xE1, 0xEC, 0x80, 0xBF, 1), (0xED, 0xED, 0x80, 0x9F, 1), (0xEE, 0xEF, 0x80, 0xBF, 1), (0xF0, 0xF0, 0x90, 0xBF, 2), (0xF1, 0xF3, 0x80, 0xBF, 2), (0xF4, 0xF4, 0x80, 0x8F, 2)]

    def __init__(self):
        self.waiting = b""

    @classmethod
    def step(cls, state: tuple, byte: int) -> tuple | None:
        """state: () between characters, else (lowest, highest next byte, more after it); None: not valid."""
        if state:
            low, high, more = state
            if not low <= byte <= high:
                return None
            return (0x80, 0xBF, more - 1) if more else ()
        if byte < 0x80:
            return ()
        return next(((low, high, more) for a, b, low, high, more in cls.LEADS if a <= byte <= b), None)

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        keep = len(data)
        for i in range(len(data) - 1, max(-1, len(data) - 4), -1):
            if data[i] & 0xC0 != 0x80:
                state: tuple | None = ()
                for b in data[i:]:
                    state = self.step(state, b)
                    if state is None:
                        break
                if state:
                    keep = i
                break
        self.waiting = data[keep:]
        return data[:keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Whole texts to ids, each match of the pattern separately, and ids back to text."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = read_ranks(path)
        self.transducer = Transducer(self.ranks)
        self.pieces = regex.compile(pattern).findall
        self.text = [b""] * (max(self.ranks.values()) + 1)
        for b, i in self.ranks.items():
            self.text[i] = b
        self.kept: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else self.transducer.encode(data)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) < 64:
            if len(self.kept) > MAX_PIECES:
                self.kept.clear()
            self.kept[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        kept = self.kept.get
        return b"".join([kept(p) or self._piece(p) for p in self.pieces(text)])

    def raw(self, ids: Iterable[int], at_once: int = 4096) -> Iterator[bytes]:
        """The bytes of the ids, some ids at once; a character may be cut between two yields."""
        ids = list(ids)
        for i in range(0, len(ids), at_once):
            yield b"".join([self.text[t] for t in ids[i : i + at_once]])

    def decode(self, ids: Iterable[int], at_once: int = 4096) -> Iterator[str]:
        stream = Utf8Stream()
        for some in self.raw(ids, at_once):
            yield stream.feed(some)
        yield stream.close()


def codec(path: str, pattern: str) -> Codec:
    key = f"{path}\0{pattern}"
    if key not in _codecs:
        _codecs[key] = Codec(path, pattern)
    return _codecs[key]


def _settings(vocabulary: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return vocabulary or default_vocabulary(), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) for every row; a null or empty text has no ids.

    A null id stays null; repeated rows give repeated results; a text of any length is
    encoded whole; other columns are ignored; an empty table gives none.
    """
    path, pattern = _settings(vocabulary, pattern)

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            ids = [[x for (x,) in struct.iter_unpack("<I", c.encode(t or ""))] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, text) of rows of ids.

    Null ids give a null text and none an empty one; an id that the vocabulary lacks is an
    error; repeated rows are decoded each; an empty table gives none.
    """
    path, pattern = _settings(vocabulary, pattern)

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            texts = [None if x is None else "".join(c.decode(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(encoded[doc_id].alias("doc_id"), encoded[ids].alias("ids")).mapInArrow(run, f"doc_id {encoded.schema[doc_id].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Counts and digests of each text's ids, and of the bytes that the ids decode to, with the code points of their text.

    A null text counts as empty, a null id stays null; repeated rows count each; texts are
    taken whole; an empty table gives none.  No rows move; each task works through its own.
    """
    path, pattern = _settings(vocabulary, pattern)

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            n, coded, decoded, chars = [], [], [], []
            for value in batch.column(1):
                ids = c.encode(value.as_py() or "")
                back, stream, length = hashlib.sha256(), Utf8Stream(), 0
                for some in c.raw(memoryview(ids).cast("I") if ids else ()):
                    back.update(some)
                    length += len(stream.feed(some))
                chars.append(length + len(stream.close()))
                n.append(len(ids) // 4)
                coded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string()), pa.array(chars, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chars"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, SCHEMA)
