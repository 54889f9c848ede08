"""Token tables: texts and blocks -> one row per token, in document order.

A document's rows are numbered by ``pos`` from 0.  Texts are tokenised by
Catalyst expressions where positions aren't needed; with positions one Arrow
pass yields the tokens of whole batches, which avoids a window over the whole
token table just to sum up lengths.

Defined results: null, empty and blank texts give no rows; repeated documents
give their rows again; a null token in a list is left out and not counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.text import default_tokens, word_tokens

_RULE = r"\s+|“|[\"”]|``|…|\.\.\.|--|,(?=\D|$)|\.(?=\n?\Z|\n\")|[;#$£%&|!?\[\](){}<>]|'(?=\s)|''"
_PLAIN = r"[^\s“\"”`….,\-;#$£%&|!?\[\](){}<>']"
_PIECES = re.compile(rf"(?:{_PLAIN}++|(?!{_RULE})[\s\S])++|{_RULE}")
_NAMES = {"“": "``", "”": "''", "…": "..."}


def segment(text: str, drop: tuple[str, ...] = (",", ";")) -> list[tuple[str, int, int]]:
    """``(chars, position, length)`` of a text's tokens; ``length`` is that of
    the source, as quotes and ellipses are renamed."""
    out, before = [], ""
    for m in _PIECES.finditer(text):
        p = m.group()
        if p == '"':
            chars = "``" if not before or before[-1].isspace() or before[-1] in "([{<" else "''"
        else:
            chars = _NAMES.get(p, p)
        before = p
        if not p.isspace() and chars not in drop:
            out.append((chars, m.start(), len(p)))
    return out


def text_tokens(df: DataFrame, doc_id: str, text: str, keep_commas: bool = False) -> DataFrame:
    """``(doc_id, pos, token)``; JVM only, no shuffle."""
    tokens = (word_tokens if keep_commas else default_tokens)(text)
    return df.select(F.col(doc_id).alias("doc_id"), F.posexplode(tokens).alias("pos", "token"))


def text_sequences(df: DataFrame, doc_id: str, text: str, keep_commas: bool = False) -> DataFrame:
    """``(doc_id, tokens)``: a text's tokens as one array, without a shuffle."""
    return df.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), (word_tokens if keep_commas else default_tokens)(text).alias("tokens"))


def text_tokens_positions(df: DataFrame, doc_id: str, text: str, keep_commas: bool = False) -> DataFrame:
    """``(doc_id, pos, token, position, length)``."""
    drop = () if keep_commas else (",", ";")
    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("pos", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("length", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = [segment(t, drop) if t else [] for t in part.column(1).to_pylist()]
                n = np.array([len(x) for x in lists])
                owner = np.repeat(np.arange(len(lists)), n)
                pos = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
                flat = [t for x in lists for t in x]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner)), pa.array(pos.astype(np.int32)), pa.array([t[0] for t in flat], pa.string()), pa.array([t[1] for t in flat], pa.int32()), pa.array([t[2] for t in flat], pa.int32())],
                    schema.names,
                )

    return df.select(doc_id, text).mapInArrow(run, schema)


def first_blocks(blocks: DataFrame, *keys: str, order: str) -> DataFrame:
    """Of rows delivered several times the one first by ``order``: a partial
    aggregate before the shuffle, no window."""
    rest = [c for c in blocks.columns if c not in keys]
    picked = blocks.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__r"))
    return picked.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def block_tokens(blocks: DataFrame, doc_id: str = "page_id", chunk: str = "chunk_no", tokens: str = "tokens", tags: str | None = "tags", extra: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, chunk_no, pos, index, block_len, token, tag)`` of token lists.

    ``pos`` counts over the document in the order of its blocks: a running sum
    over *blocks*, so the window holds one row a block, not one a token.
    ``tag`` is null for blocks without annotation."""
    clean = F.filter(F.coalesce(F.col(tokens), F.array().cast("array<string>")), lambda t: t.isNotNull())
    size = F.size(clean)
    w = Window.partitionBy(doc_id).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    none = F.array().cast("array<string>")
    pairs = F.arrays_zip(F.col(tokens).alias("t"), (F.coalesce(F.col(tags), none) if tags else none).alias("g"))
    base = blocks.withColumn("__n", F.when(F.col(tokens).isNull(), 0).otherwise(size)).withColumn("__base", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    kept = F.filter(pairs, lambda p: p["t"].isNotNull())
    out = base.where(F.col("__n") > 0).select(F.col(doc_id).alias("doc_id"), F.col(chunk).alias("chunk_no"), *extra, "__base", F.col("__n").alias("block_len"), F.posexplode(kept).alias("index", "__p"))
    return out.select("doc_id", "chunk_no", *extra, (F.col("__base") + F.col("index")).cast("long").alias("pos"), "index", "block_len", F.col("__p.t").alias("token"), F.col("__p.g").alias("tag"))


def split_chunks(df: DataFrame, doc_id: str, text: str, tagset: set[str] | None = None) -> DataFrame:
    """Marked text -> ``(doc_id, pos, token, tag)`` after IOB encoding: tokenise,
    drop markers of other types, encode, renumber without markers."""
    from tagweave.operators.iob import encode, limit_tags

    marked = text_tokens(df, doc_id, text)
    if tagset is not None:
        marked = limit_tags(marked, tagset)
    return encode(marked)


def doc_order(*extra: Column | str) -> Window:
    """The one window spec of all per-document operators, so that Spark sorts
    a document once for all of them."""
    return Window.partitionBy("doc_id").orderBy("pos", *extra)
