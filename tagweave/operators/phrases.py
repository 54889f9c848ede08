"""Longest lexicon phrases in token sequences.

A lexicon counted below a bound is broadcast and looked up in one narrow pass
over the documents.  Beyond, n-grams of the lengths the lexicon has are built
with array expressions and meet it in an equi-join.  Overlaps are resolved
greedily, longest first, ties by earliest start.

Defined results: an empty lexicon matches nothing; a phrase longer than the
document can't match; tokens are compared as they are (lower-case both sides
for case-insensitive search).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.session import fits_broadcast

BROADCAST_BYTES = 32 << 20


def sequences(tokens: DataFrame, token: str = "token") -> DataFrame:
    """``(doc_id, tokens)``: a document's tokens in order."""
    return tokens.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(token).alias("t")))), lambda s: s["t"]).alias("tokens"))


def lexicon_lengths(lexicon: DataFrame, name: str = "name") -> list[int]:
    """Numbers of words that occur in the lexicon (a few values)."""
    rows = lexicon.where(F.col(name).isNotNull()).select(F.size(F.split(F.col(name), " ")).alias("n")).distinct().collect()
    return sorted(r.n for r in rows)


def find_matches(seqs: DataFrame, lexicon: DataFrame, name: str = "name", lengths: list[int] | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(doc_id, start, end, phrase)``: at each start the longest phrase that
    is in the lexicon; ``end`` is exclusive."""
    lengths = lexicon_lengths(lexicon, name) if lengths is None else lengths
    if not lengths:
        return seqs.select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("phrase")).where(F.lit(False))
    n = F.size("tokens")
    none = F.array().cast("array<struct<start:int,end:int,phrase:string>>")

    def of_length(k: int) -> Column:
        gram = lambda i: F.struct(i.alias("start"), (i + k).alias("end"), F.array_join(F.slice("tokens", i + 1, k), " ").alias("phrase"))
        return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), gram)).otherwise(none)

    grams = [of_length(k) for k in lengths]
    spans = seqs.select("doc_id", F.inline(F.concat(*grams)))
    words = lexicon.select(F.col(name).alias("phrase")).where(F.col("phrase").isNotNull()).distinct()
    hits = spans.join(F.broadcast(words) if fits_broadcast(words, broadcast_bytes) else words, "phrase", "left_semi")
    longest = hits.groupBy("doc_id", "start").agg(F.max(F.struct("end", "phrase")).alias("m"))
    return longest.select("doc_id", "start", F.col("m.end").alias("end"), F.col("m.phrase").alias("phrase"))


#: Sorts ``(start, end, phrase)``; the first in order is preferred.
Order = Callable[[tuple[int, int, str]], object]


def longest_first(m: tuple[int, int, str]) -> object:
    return m[0] - m[1], m[0]


def without_overlaps(found: list[tuple[int, int, str]], order: Order = longest_first) -> list[tuple[int, int, str]]:
    """Ranges in order of preference, each kept if it touches none kept before."""
    kept: list[tuple[int, int, str]] = []
    taken = bytearray(max((m[1] for m in found), default=0))
    for a, b, phrase in sorted(found, key=order):
        # with the longest first both ends suffice: what is kept is never shorter
        if not (taken[a] or taken[b - 1] or order is not longest_first and any(taken[a:b])):
            taken[a:b] = b"\1" * (b - a)
            kept.append((a, b, phrase))
    return kept


def best_ranges(matches: DataFrame, order: Order = longest_first) -> DataFrame:
    """``(doc_id, start, end, phrase)`` without overlaps, by :func:`without_overlaps`."""
    lists = matches.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "phrase")).alias("m"))
    schema = T.StructType([matches.schema["doc_id"], T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("phrase", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *m) for i, found in enumerate(batch.column(1).to_pylist()) for m in without_overlaps([(x["start"], x["end"], x["phrase"]) for x in found], order)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *[pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.string()))]], schema.names)

    return lists.mapInArrow(run, schema)


def scan(tokens: list[str], starts: dict[str, list[tuple[int, str]]], order: Order = longest_first) -> list[tuple[int, int, str]]:
    """``(start, end, phrase)`` of one document: at each start the longest
    phrase, overlaps resolved by ``order``."""
    found = []
    for i, t in enumerate(tokens):
        for n, phrase in starts.get(t, ()):
            if n == 1 or " ".join(tokens[i : i + n]) == phrase:
                found.append((i, i + n, phrase))
                break
    return without_overlaps(found, order)


def longest_matches(tokens: DataFrame, lexicon: DataFrame, name: str = "name", token: str = "token", broadcast_bytes: int = BROADCAST_BYTES, order: Order = longest_first, required: bool = False) -> DataFrame:
    """Best ranges ``(doc_id, start, end, phrase)`` of a token table, or of
    sequences ``(doc_id, tokens)`` as they come from texts.

    A lexicon counted below ``broadcast_bytes`` goes to the documents: one
    narrow pass over sequences, first words deciding where to look.  A larger
    one is joined (:func:`find_matches`).  ``order`` says which of overlapping
    matches is preferred; with ``required`` an empty lexicon is a ValueError,
    else nothing matches."""
    seqs = tokens if "tokens" in tokens.columns else sequences(tokens, token)
    words = lexicon.select(F.col(name).alias("phrase")).where(F.col(name).isNotNull()).distinct()
    if required and words.isEmpty():
        raise ValueError("the lexicon is empty")
    if not fits_broadcast(words, broadcast_bytes):
        return best_ranges(find_matches(seqs, lexicon, name), order)
    starts: dict[str, list[tuple[int, str]]] = {}
    for (phrase,) in words.collect():
        parts = phrase.split(" ")
        starts.setdefault(parts[0], []).append((len(parts), phrase))
    shared = tokens.sparkSession.sparkContext.broadcast({k: sorted(v, reverse=True) for k, v in starts.items()})
    schema = T.StructType([seqs.schema["doc_id"], T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("phrase", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *m) for i, t in enumerate(batch.column(1).to_pylist()) for m in scan(t or [], shared.value, order)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *[pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.string()))]], schema.names)

    return seqs.select("doc_id", "tokens").mapInArrow(run, schema)


def phrase_flags(tokens: DataFrame, lexicon: DataFrame, feature: str, name: str = "name", lower: bool = False) -> DataFrame:
    """Adds ``B-feature``, ``I-feature`` and ``feature`` (true or null)."""
    keyed = tokens.withColumn("__k", F.lower("token") if lower else F.col("token"))
    words = lexicon.select((F.lower(name) if lower else F.col(name)).alias("name"))
    ranges = longest_matches(keyed, words, token="__k")
    marks = ranges.select("doc_id", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"), "start")
    out = tokens.join(marks, ["doc_id", "pos"], "left")
    first, inside = F.col("start") == F.col("pos"), F.col("start").isNotNull()
    true = F.lit(True)
    return out.select(*tokens.columns, F.when(inside & first, true).alias(f"B-{feature}"), F.when(inside & ~first, true).alias(f"I-{feature}"), F.when(inside, true).alias(feature))
