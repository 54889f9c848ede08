"""Passages of evaluation items inside a large corpus.

A passage leaks if a window of ``window`` consecutive words of an item stands
in a document in the same order, up to ``max_edits`` word edits (0: exactly).
Words are runs of letters and digits, lower-cased.

Every window is embedded by a CGK random walk: at step *j* it emits the word it
stands on and moves on if a random bit of (word, *j*) says so, so that few
edits between windows become few differing steps.  Each repetition samples some
steps of the walk into one key; windows that share a key are candidates, which
an edit distance on the words then proves.  The number of repetitions follows
from ``max_edits`` and ``recall``; equal windows walk alike, so passages without
edits are found in any case.  ``report`` gives only pairs proven with so many
edits or fewer.

Before that, a window is dropped if it holds more words unknown to all items
than ``max_edits`` (each costs an edit, so nothing is lost).  The items' words
and windows are broadcast if they are counted below ``broadcast_bytes``.
Beyond that, a blocked Bloom filter of the items' keys (``filter_bytes`` at
most) is broadcast instead, windows it doesn't hold are dropped before any
shuffle, and the rest is joined with the items' windows on the key, words
against words; AQE splits hot keys.  With items too many even for the filter,
the join takes all windows.

Defined results: null, empty and short texts (below ``window`` words) give no
row; of repeated documents each is reported; of items that share a passage each
is reported; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.session import fits_broadcast

WORD = re.compile(r"[^\W_]+")
BROADCAST_BYTES = 64 << 20
FILTER_BYTES = 128 << 20
#: Bits of a key in the filter, and of a block of it.
_BITS, _BLOCK = 12, 1 << 19


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Walk:
    """Shared randomness of the embedding and of the samples."""

    def __init__(self, window: int, max_edits: int, recall: float = 0.95, samples: int = 6, seed: int = 20) -> None:
        self.window, self.max_edits = window, max_edits
        self.steps = 2 * window
        rnd = np.random.default_rng(seed)
        # each edit leaves two walks in step with a chance of about one half,
        # and costs them about two differing steps then
        hit = 0.5**max_edits * max(0.1, 1 - 2 * max_edits / self.steps) ** samples
        self.repetitions = max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit))) if max_edits else 1
        self.salt = rnd.integers(1, 2**63, (self.repetitions, self.steps), np.int64).astype(np.uint64)
        self.samples = [np.sort(rnd.choice(self.steps, samples, replace=False)) for _ in range(self.repetitions)]

    def embed(self, windows: np.ndarray, repetition: int = 0) -> np.ndarray:
        """(n, window) word hashes -> (n, steps) emitted words."""
        n = len(windows)
        padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1)
        out = np.empty((n, self.steps), np.uint64)
        at, rows = np.zeros(n, np.int64), np.arange(n)
        for j in range(self.steps):
            word = padded[rows, at]
            out[:, j] = word
            at = np.minimum(at + (_mix(word ^ self.salt[repetition, j]) & np.uint64(1)).astype(np.int64), self.window)
        return out

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """(repetitions, n) keys."""
        out = np.empty((self.repetitions, len(windows)), np.uint64)
        for r, steps in enumerate(self.samples):
            walked = self.embed(windows, r)
            key = np.full(len(windows), r + 1, np.uint64)
            for j in steps:
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + walked[:, j])
            out[r] = key
        return out


def edit_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Word edit distance of rows of two (n, w) arrays."""
    n, w = a.shape
    row = np.tile(np.arange(w + 1), (n, 1))
    for i in range(w):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        for j in range(w):
            new[:, j + 1] = np.minimum(np.minimum(row[:, j + 1], new[:, j]) + 1, row[:, j] + (a[:, i] != b[:, j]))
        row = new
    return row[:, w]


def _edits(a: np.ndarray, b: np.ndarray, max_edits: int) -> np.ndarray:
    """Edits between rows; the distance is worked out only where rows differ."""
    out = (a != b).any(axis=1).astype(np.int64)
    if max_edits and out.any():
        at = np.flatnonzero(out)
        out[at] = edit_distance(a[at], b[at])
    return out


def _windows(ids: np.ndarray, doc: np.ndarray, window: int, max_edits: int) -> np.ndarray:
    """Starts of the windows that stay in one document and may match; an id of
    -1 is a word no item has."""
    n = len(ids) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    unknown = np.r_[0, np.cumsum(ids < 0)]
    return np.flatnonzero((doc[:n] == doc[window - 1 :]) & (unknown[window:] - unknown[:n] <= max_edits))


class ItemIndex:
    """All distinct windows of all items, ready for lookup."""

    def __init__(self, items: list[tuple[int, str]], walk: Walk, report: int) -> None:
        self.walk, self.report = walk, report
        self.vocabulary: dict[str, int] = {}
        w, owners = walk.window, {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(x, len(self.vocabulary)) for x in words(text or "")]
            for i in range(len(ids) - w + 1):
                owners.setdefault(tuple(ids[i : i + w]), {})[item] = None
        self.hash = np.array([xxhash.xxh64_intdigest(x) for x in self.vocabulary] + [0], np.uint64)
        self.rows = np.array(list(owners), np.int32).reshape(-1, w)
        self.owners = [list(x) for x in owners.values()]
        keys = walk.keys(self.hash[self.rows])
        self.order = [np.argsort(k, kind="stable") for k in keys]
        self.keys = [k[o] for k, o in zip(keys, self.order)]

    def search(self, ids: np.ndarray, doc: np.ndarray, step: int = 200_000) -> set[tuple[int, int]]:
        """(document number, item) of every proven window; at most ``step``
        candidate pairs are held at a time."""
        walk = self.walk
        starts = _windows(ids, doc, walk.window, walk.max_edits)
        proven: set[tuple[int, int]] = set()  # (document, item window)
        for at in range(0, len(starts), 50_000):
            s = starts[at : at + 50_000]
            mine = ids[s[:, None] + np.arange(walk.window)]
            for r, key in enumerate(walk.keys(self.hash[mine])):
                lo, hi = np.searchsorted(self.keys[r], key), np.searchsorted(self.keys[r], key, side="right")
                some = np.flatnonzero(hi > lo)
                ends = np.cumsum(hi[some] - lo[some])
                for b in range(0, int(ends[-1]) if len(ends) else 0, step):
                    pair = np.arange(b, min(b + step, int(ends[-1])))
                    k = np.searchsorted(ends, pair, side="right")
                    x = some[k]
                    y = self.order[r][hi[x] - (ends[k] - pair)]
                    ok = _edits(mine[x], self.rows[y], walk.max_edits) <= self.report
                    proven.update(zip(doc[s[x[ok]]].tolist(), y[ok].tolist()))
        return {(d, item) for d, y in proven for item in self.owners[y]}


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 12,
    max_edits: int = 0,
    recall: float = 0.95,
    report: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """Distinct ``(doc_id, item_id)`` pairs."""
    report = max_edits if report is None else report
    walk = Walk(window, max_edits, recall)
    items = items.select(item_id, item_text).where(F.col(item_text).isNotNull())
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField(item_id, items.schema[item_id].dataType)])
    docs = docs.select(doc_id, doc_text).where(F.col(doc_text).isNotNull())
    if not fits_broadcast(items, broadcast_bytes // 16):
        return _joined(docs, items, doc_id, item_id, walk, report, filter_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(ItemIndex([tuple(r) for r in items.collect()], walk, report))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        get = index.vocabulary.get
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, counts = [], []
                for text in part.column(1).to_pylist():
                    got = [get(x, -1) for x in WORD.findall(text.lower())]
                    ids += got
                    counts.append(len(got))
                pairs = sorted(index.search(np.array(ids, np.int32), np.repeat(np.arange(len(counts)), counts)), key=str)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array([d for d, _ in pairs], pa.int64())), pa.array([i for _, i in pairs], _arrow(schema[1].dataType))], [doc_id, item_id]
                )

    return docs.mapInArrow(run, schema).distinct()


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _bits(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A key's block and its places within."""
    h = _mix(keys.view(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    block = (h % np.uint64(blocks)).astype(np.int64)
    places = []
    for _ in range(6):
        h = _mix(h + np.uint64(0x9E3779B97F4A7C15))
        places.append((h & np.uint64(_BLOCK - 1)).astype(np.int64))
    return block, places


def _bloom(keys: DataFrame, filter_bytes: int) -> np.ndarray | None:
    """A blocked Bloom filter of all keys, (blocks, bytes), or None if it would
    exceed ``filter_bytes``.  Blocks are built where their keys are."""
    n = keys.count()
    blocks = max(1, -(-n * _BITS // _BLOCK))
    if blocks * _BLOCK // 8 > filter_bytes:
        return None

    @F.pandas_udf("int")
    def block_of(k):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(_bits(k.to_numpy(np.int64), blocks)[0], dtype="int32")

    def build(group):  # noqa: ANN001, ANN202
        import pandas as pd

        bits = np.zeros(_BLOCK, np.uint8)
        for p in _bits(group["key"].to_numpy(np.int64), blocks)[1]:
            bits[p] = 1
        return pd.DataFrame({"block": [group["block"].iloc[0]], "bits": [np.packbits(bits).tobytes()]})

    out = np.zeros((blocks, _BLOCK // 8), np.uint8)
    # keys are distinct and hashed to blocks, so groups are of about equal size
    for r in keys.withColumn("block", block_of("key")).groupBy("block").applyInPandas(build, "block int, bits binary").toLocalIterator():
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return out


def _held(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    block, places = _bits(keys, len(bloom))
    ok = np.ones(len(keys), bool)
    for p in places:
        ok &= (bloom[block, p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
    return ok


def _joined(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, walk: Walk, report: int, filter_bytes: int) -> DataFrame:
    """Both sides as (key, window) rows, joined on the key: for items without a
    proven size.  The exact check follows in the same narrow stage."""
    w, edits = walk.window, walk.max_edits

    def rows_of(df: DataFrame, ident: str, prefix: str, bloom=None) -> DataFrame:  # noqa: ANN001
        schema = T.StructType([T.StructField(f"{prefix}_id", df.schema[ident].dataType), T.StructField("key", T.LongType()), T.StructField(f"{prefix}_window", T.ArrayType(T.StringType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    part = batch.slice(at, 200)
                    flat: list[str] = []
                    counts = []
                    for text in part.column(1).to_pylist():
                        got = words(text)
                        flat += got
                        counts.append(len(got))
                    hashes = np.array([xxhash.xxh64_intdigest(x) for x in flat], np.uint64)
                    doc = np.repeat(np.arange(len(counts)), counts)
                    s = _windows(np.zeros(len(flat), np.int8), doc, w, edits)
                    texts = pa.array(flat, pa.string())
                    for key in walk.keys(hashes[s[:, None] + np.arange(w)]):
                        key = key.view(np.int64)
                        hit = np.flatnonzero(_held(bloom.value, key)) if bloom is not None else np.arange(len(s))
                        window = texts.take(pa.array((s[hit][:, None] + np.arange(w)).reshape(-1)))
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(hit) + 1, dtype=np.int32) * w), window)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc[s[hit]])), pa.array(key[hit]), lists], schema.names)

        return df.mapInArrow(run, schema)

    # equal windows of one item are one row; a window many items share stays one row a item
    right = rows_of(items, item_id, "item").distinct().persist()
    bloom = _bloom(right.select("key").distinct(), filter_bytes)
    left = rows_of(docs, doc_id, "doc", docs.sparkSession.sparkContext.broadcast(bloom) if bloom is not None else None)
    pairs = left.join(right, "key")
    if report == 0:
        near = pairs.where(F.col("doc_window") == F.col("item_window"))
    else:

        @F.pandas_udf("boolean")
        def close(a, b):  # noqa: ANN001, ANN202
            import pandas as pd

            return pd.Series(_edits(np.stack(a.to_numpy()).astype(str), np.stack(b.to_numpy()).astype(str), edits) <= report if len(a) else [], dtype=bool)

        near = pairs.where(close("doc_window", "item_window"))
    return near.select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id)).distinct()
