"""Encoding of texts with a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern; each distinct piece is
encoded once per worker by the backtracking encoder: take the longest token at
the current byte (an Aho-Corasick automaton over all tokens gives the matches
of a piece in one pass), accept it if it may stand beside the token before it,
else try its next shorter prefix token, else step back.  Whether two tokens may
stand side by side is decided from the merge table alone, so the result equals
applying the merges in rank order, in linear time.  Decoding gathers bytes
through one table of token offsets.

Defined results: an empty and a null text both give the empty list of ids.
Lone surrogates can't occur in Spark strings.  Rows are passed through one by
one, repeated rows and ids included; very long pieces are encoded in linear
time and are not kept in the cache.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces kept per worker; the cache starts anew when it is full.
CACHE_PIECES = 1_000_000

# Fixed value: the public pattern that cuts a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for ``re``; equal unless the text holds one of ``_UNLIKE``.
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

_ASCII_UNLIKE = re.compile("[\x1c-\x1f]")


@lru_cache(maxsize=1)
def _unlike() -> re.Pattern[str]:
    """Characters the two regex engines class differently: numbers that are no
    decimal digits, and the separators that only ``re`` takes for space."""
    ranges: list[list[int]] = [[0x1C, 0x1F]]
    for c in range(0x80, sys.maxunicode + 1):
        if unicodedata.category(chr(c)) in ("Nl", "No"):
            if ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    low = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges if b < 0x10000)
    high = "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges if a >= 0x10000)
    return re.compile(f"[{low}]|(?=[\U00010000-\U0010ffff])[{high}]")


@lru_cache(maxsize=1)
def _exact():
    import regex

    return regex.compile(PATTERN)


def pieces(text: str) -> list[str]:
    if text.isascii():
        return _exact().findall(text) if _ASCII_UNLIKE.search(text) else _FAST.findall(text)
    return _exact().findall(text) if _unlike().search(text) else _FAST.findall(text)


class Vocabulary:
    """Tables of one vocabulary file (base64 token, rank per line)."""

    def __init__(self, data: bytes) -> None:
        import ahocorasick

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.rank = ranks
        self.size = max(ranks.values()) + 1
        self.token = [b""] * self.size
        for t, r in ranks.items():
            self.token[r] = t
        lengths = np.array([len(t) for t in self.token])
        self.offsets = np.r_[0, np.cumsum(lengths)]
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.automaton = ahocorasick.Automaton()
        for t, r in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        #: next shorter token that is a prefix, or -1
        self.prefix = [-1] * self.size
        for r, t in enumerate(self.token):
            for k in range(len(t) - 1, 0, -1):
                p = ranks.get(t[:k])
                if p is not None:
                    self.prefix[r] = p
                    break
        #: the two tokens each token is merged from (itself twice for a byte)
        self.left = list(range(self.size))
        self.right = list(range(self.size))
        self.merge: dict[tuple[int, int], int] = {}
        for r, t in enumerate(self.token):
            a = self.prefix[r]
            while a >= 0:
                b = ranks.get(t[len(self.token[a]) :])
                if b is not None and a < r and b < r and self.compatible(a, b):
                    self.left[r], self.right[r] = a, b
                    self.merge[a, b] = r
                    break
                a = self.prefix[a]

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` is what the merges leave of their bytes: no
        merge across the border may come before the merges that made them."""
        merge, left, right = self.merge, self.left, self.right
        limit = sys.maxsize
        while True:
            over = merge.get((a, b))
            if over is not None and over < limit:
                return False
            if a > b:
                limit, inner = a, right[a]
                if inner == a:
                    limit = b + 1
                    b, was = left[b], b
                    if b == was:
                        return True
                else:
                    a = inner
            else:
                limit, inner = b + 1, left[b]
                if inner == b:
                    limit = a
                    a, was = right[a], a
                    if a == was:
                        return True
                else:
                    b = inner

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.rank.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        longest = [-1] * n
        size = [0] * n
        token = self.token
        for end, r in self.automaton.iter(piece.decode("latin-1")):
            k = len(token[r])
            at = end - k + 1
            if k > size[at]:
                longest[at], size[at] = r, k
        open_ = [True] * (n + 1)
        out: list[int] = []
        pos, t = 0, longest[0]
        compatible, prefix = self.compatible, self.prefix
        while pos < n:
            while True:
                end = pos + len(token[t])
                if open_[end] and (not out or compatible(out[-1], t)):
                    out.append(t)
                    pos = end
                    if pos < n:
                        t = longest[pos]
                    break
                t = prefix[t]
                if t < 0:
                    open_[pos] = False
                    t = out.pop()
                    pos -= len(token[t])
                    # the token that led here is tried again, one shorter
                    break
        return tuple(out)

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        length = self.offsets[ids + 1] - self.offsets[ids]
        start = np.repeat(self.offsets[ids] - np.r_[0, np.cumsum(length)[:-1]], length)
        return self.bytes[start + np.arange(length.sum())].tobytes().decode("utf-8", "replace")


class Encoder(dict):
    """piece -> ids, filled on demand."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.vocabulary.encode_piece(piece.encode())
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, pieces(text)))) if text else []


@lru_cache(maxsize=4)
def _encoder(data: bytes) -> Encoder:
    return Encoder(Vocabulary(data))


def load_vocabulary(path: str = DEFAULT_VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_texts(df: DataFrame, ident: str, text: str, vocabulary: str = DEFAULT_VOCABULARY, ids: str = "ids") -> DataFrame:
    """``(ident, ids)`` of every row.  One narrow pass; the vocabulary file
    (under 1 MB, fixed) is read on the driver and sent with the tasks."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary))
    schema = T.StructType([T.StructField(ident, df.schema[ident].dataType), T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        get = encoder.__getitem__
        for batch in batches:
            if len(encoder) > CACHE_PIECES:
                encoder.clear()
            column = batch.column(1)
            step = 512
            for at in range(0, batch.num_rows, step):
                flat, counts = [], []
                for s in column.slice(at, step).to_pylist():
                    got = list(chain.from_iterable(map(get, pieces(s)))) if s else []
                    counts.append(len(got))
                    flat.append(np.array(got, np.int32))
                offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, step), lists], [ident, ids])

    return df.select(ident, text).mapInArrow(run, schema)


def decode_ids(df: DataFrame, ident: str, ids: str, vocabulary: str = DEFAULT_VOCABULARY, text: str = "text") -> DataFrame:
    """``(ident, text)``; a null list gives null, the empty list the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    schema = T.StructType([T.StructField(ident, df.schema[ident].dataType), T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _encoder(shared.value).vocabulary.decode
        for batch in batches:
            texts = [None if x is None else decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [ident, text])

    return df.select(ident, ids).mapInArrow(run, schema)
