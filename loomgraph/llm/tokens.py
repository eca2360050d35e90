"""Token ids of a public byte-level BPE, by backtracking over longest matches.

An Aho-Corasick automaton over the reversed vocabulary gives, in one pass over a piece of
text, all tokens that start at each byte, longest first.  The encoder takes the longest, and
keeps it if it may follow the token before: a pair is compatible if merging the bytes of both
in order of rank would not join across their border, which a table of merges and of each
token's two halves tells.  Otherwise it takes the next shorter token or, where none is left,
takes back the last one.  A position is given up at most once, so the work is linear in the
text for a bounded token length.  Decoding copies byte stretches from one blob by an offset
table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies on every worker.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's text is split before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers, each of at most CACHE_BYTES bytes.
CACHE_PIECES, CACHE_BYTES = 200_000, 64


class Encoder:
    """Encoder and decoder of one vocabulary file (lines of base64 bytes and rank)."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.tokens = [b""] * len(pairs)
        for word, rank in pairs:
            self.tokens[int(rank)] = base64.b64decode(word)
        self.id_of = {w: i for i, w in enumerate(self.tokens)}
        lengths = np.array([len(w) for w in self.tokens])
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self._automaton = ahocorasick.Automaton()
        for i, w in enumerate(self.tokens):
            self._automaton.add_word(w[::-1].decode("latin-1"), i)
        self._automaton.make_automaton()
        self._merged: dict[tuple[int, int], int] = {}
        self._halves: list[tuple[int, int]] = []
        for i, w in enumerate(self.tokens):
            self._halves.append(self._split(i, w))
        self._pieces: dict[str, list[int]] = {}
        self._words = regex.compile(PATTERN)

    def _split(self, token: int, word: bytes) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``; itself twice for a single byte."""
        for at in range(len(word) - 1, 0, -1):
            left, right = self.id_of.get(word[:at]), self.id_of.get(word[at:])
            if left is not None and right is not None and left < token and right < token and self.compatible(left, right):
                self._merged[left, right] = token
                return left, right
        return token, token

    def compatible(self, left: int, right: int) -> bool:
        """Whether encoding the bytes of both tokens gives just these two tokens."""
        merged, halves = self._merged, self._halves
        limit = len(self.tokens) + 1
        while True:
            if merged.get((left, right), limit) < limit:
                return False
            # Undo the later of the two merges and look across the border again.
            if left > right:
                limit, inner = left, halves[left][1]
                if inner != left:
                    left = inner
                    continue
                limit, inner = right + 1, halves[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                limit, inner = right + 1, halves[right][0]
                if inner != right:
                    right = inner
                    continue
                limit, inner = left, halves[left][1]
                if inner == left:
                    return True
                left = inner

    def _piece(self, data: bytes) -> list[int]:
        whole = self.id_of.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        starting: list[list[int]] = [[] for _ in range(n)]
        for end, token in self._automaton.iter(data[::-1].decode("latin-1")):
            starting[n - 1 - end].append(token)  # longest first
        lengths, out, at, dead = self.tokens, [], 0, bytearray(n + 1)
        tried = [0] * n  # how many of the tokens that start here were tried already
        while at < n:
            options, k = starting[at], tried[at]
            while k < len(options):
                token = options[k]
                k += 1
                end = at + len(lengths[token])
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    break
            else:
                dead[at], tried[at] = 1, 0
                at -= len(lengths[out.pop()])
                continue
            tried[at] = k
            out.append(token)
            at = end
            if at < n:
                tried[at] = 0
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; null and empty text give the empty list, and nothing is a special token."""
        if not text:
            return []
        known, out = self._pieces, []
        for piece in self._words.findall(text):
            ids = known.get(piece)
            if ids is None:
                data = piece.encode("utf-8", "surrogatepass")
                ids = self._piece(data)
                if len(data) <= CACHE_BYTES:
                    if len(known) >= CACHE_PIECES:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ``ids``."""
        if not len(ids):
            return b""
        a = np.asarray(ids)
        starts, sizes = self.offsets[a], self.offsets[a + 1] - self.offsets[a]
        shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        return self.blob[np.arange(sizes.sum()) + shift].tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    """One encoder a process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(``key``, ``ids`` array<int>) of every row of ``df``.

    Defined cases: null and empty text give the empty list; text that looks like a special
    token is ordinary text; repeated rows and null keys are kept; an empty table gives no
    rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            # A few texts at a time: ids take up to four bytes for each byte of text.
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [np.array(enc.encode(t), dtype=np.int32) for t in part.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["k", "ids"])

    slim = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = df.schema[key].dataType.simpleString()
    return slim.mapInArrow(run, f"k {kind}, ids array<int>").select(F.col("k").alias(key), "ids")


def count_tokens(df: DataFrame, text: str = "text", path: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """``df`` without its text, and the number of tokens of the text in ``name`` (0 for null)."""
    others = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others) + f", `{name}` long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            counts = pa.array([len(enc.encode(t)) for t in b.column(len(others)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], counts], names=[*others, name])

    return df.select(*others, text).mapInArrow(run, schema)


def p8_ids(spark, sf_dir):
    from loomgraph.session import table

    return encode_texts(table(spark, sf_dir, "documents"))


QUERIES = {"p8_ids": p8_ids}
ORACLES: dict[str, str] = {}
