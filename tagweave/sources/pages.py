"""Pages -> node, chunk and token tables; tags -> annotated pages.

One Arrow pass parses a page and yields its rows, so a page crosses into
Python once.  Defined results: null or empty HTML gives no tokens and, as a
tree, just ``html`` and ``body``; repeated pages give their rows again; columns
beside the named ones aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tagweave.functions.text import natural_key
from tagweave.html.annotate import Colors, to_annotated
from tagweave.html.compare import tree_difference
from tagweave.html.loaders import load_annotated, load_inline, load_plain
from tagweave.html.tokens import Options, detokenize, tokenize
from tagweave.html.tree import Node, parse, serialize

Loader = Callable[[str], Node]
_LOADERS = {"plain": load_plain, "annotated": load_annotated, "inline": load_inline}


def loader(kind: str = "plain", known_entities: set[str] | None = None, strict: bool = False) -> Loader:
    if kind == "plain":
        return lambda s: load_plain(s, strict=strict)
    if kind == "annotated":
        return lambda s: load_annotated(s, known_entities)
    if known_entities is None:
        raise ValueError("known_entities is required: all entity types of the data")
    return lambda s: load_inline(s, known_entities)


def read_pages(spark: SparkSession, path: str, encoding: str | None = "utf-8") -> DataFrame:
    """Files of a path or glob -> ``(path, html)``; without ``encoding`` the
    bytes stay and the parser takes the page's own statement.  The order of a
    listing is that of :func:`in_order`."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", (F.decode("content", encoding) if encoding else F.col("content")).alias("html"))


def in_order(pages: DataFrame, column: str = "path") -> DataFrame:
    return pages.orderBy(natural_key(column), column)


def _rows(df: DataFrame, doc_id: str, html: str, schema: T.StructType, rows: Callable[[str], list[tuple]], step: int = 50) -> DataFrame:
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out: list[tuple] = []
                for d, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    out += [(d, *r) for r in rows(s or "")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], arrow.field(i).type) for i in range(len(schema))], schema=arrow)

    return df.select(doc_id, html).mapInArrow(run, schema)


def page_nodes(df: DataFrame, doc_id: str, html: str, load: Loader | None = None) -> DataFrame:
    """``nodes`` rows: number, parent, tag, attributes, depth, ancestors, texts."""
    load = load or parse
    schema = T.StructType(
        [T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("node_id", T.IntegerType()), T.StructField("parent_id", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
         T.StructField("depth", T.IntegerType()), T.StructField("ancestors", T.ArrayType(T.StringType())), T.StructField("text", T.StringType()), T.StructField("tail", T.StringType())]
    )

    def rows(s: str) -> list[tuple]:
        number: dict[int, int] = {}
        above: dict[int, list[str]] = {}
        out = []
        for i, n in enumerate(load(s).walk()):
            number[id(n)] = i
            chain = [*above[id(n.parent)], n.tag] if n.parent is not None else [n.tag]
            above[id(n)] = chain
            out.append((i, number[id(n.parent)] if n.parent is not None else None, n.tag, list(n.attrs.items()), len(chain) - 1, chain, n.text, n.tail))
        return out

    return _rows(df, doc_id, html, schema, rows)


TOKEN_FIELDS = [
    T.StructField("pos", T.LongType()), T.StructField("chunk_no", T.IntegerType()), T.StructField("node_id", T.IntegerType()), T.StructField("parent_node_id", T.IntegerType()), T.StructField("is_tail", T.BooleanType()), T.StructField("index", T.IntegerType()),
    T.StructField("block_len", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("elem_tag", T.StringType()), T.StructField("parent_tag", T.StringType()),
    T.StructField("ancestors", T.ArrayType(T.StringType())), T.StructField("tag", T.StringType()),
]


def token_rows(s: str, load: Loader, options: Options) -> list[tuple]:
    root = load(s)
    tokens = tokenize(root, options)
    number = {id(n): i for i, n in enumerate(root.walk())}
    chains: dict[int, list[str]] = {}
    out = []
    for t in tokens:
        key = id(t.node)
        if key not in chains:
            chains[key] = [n.tag for n in t.node.ancestors()][::-1]
        p = t.parent
        out.append((t.pos, t.chunk_no, number[key], number[id(p)] if p is not None else None, t.is_tail, t.index, t.block_len, t.token, t.position, t.length, t.node.tag, p.tag if p is not None else None, chains[key], t.tag))
    return out


def page_tokens(df: DataFrame, doc_id: str, html: str, load: Loader | None = None, options: Options | None = None) -> DataFrame:
    """Token rows of pages, with their place in the tree and IOB tags."""
    load, options = load or load_plain, options or Options()
    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), *TOKEN_FIELDS])
    return _rows(df, doc_id, html, schema, lambda s: token_rows(s, load, options))


def annotate_pages(pages: DataFrame, tags: DataFrame, doc_id: str, html: str, colors: Colors | None = None, url: str | None = None, load: Loader | None = None, options: Options | None = None, markers_only: bool = False) -> DataFrame:
    """``(doc_id, html)`` with the entities of ``tags`` ``(doc_id, pos, tag)``
    written into the page.  Only entity tags travel; pages without any come out
    serialised as they are."""
    load, options = load or load_plain, options or Options()
    found = tags.where("tag <> 'O'").groupBy("doc_id").agg(F.collect_list(F.struct("pos", "tag")).alias("e"))
    address = F.col(url) if url else F.lit(None).cast("string")
    joined = pages.select(F.col(doc_id).alias("doc_id"), F.col(html).alias("html"), address.alias("url")).join(found, "doc_id", "left")
    schema = T.StructType([joined.schema["doc_id"], T.StructField("html", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s, u, e in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                root = load(s or "")
                tokens = tokenize(root, options)
                marks = {x["pos"]: x["tag"] for x in e or []}
                detokenize(root, tokens, [marks.get(t.pos, "O") for t in tokens])
                out.append(serialize(root) if markers_only else to_annotated(root, dict(colors or {}), u))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], schema.names)

    return joined.select("doc_id", "html", "url", "e").mapInArrow(run, schema)


def convert_inline(pages: DataFrame, doc_id: str, html: str, known_entities: set[str], colors: Colors | None = None) -> DataFrame:
    """Inline-tag pages -> span-annotated pages."""
    load = loader("inline", known_entities)
    schema = T.StructType([T.StructField("doc_id", pages.schema[doc_id].dataType), T.StructField("html", T.StringType())])
    return _rows(pages, doc_id, html, schema, lambda s: [(to_annotated(load(s), dict(colors or {})),)])


def clean_pages(pages: DataFrame, doc_id: str, html: str, strict: bool = True) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", pages.schema[doc_id].dataType), T.StructField("html", T.StringType())])
    return _rows(pages, doc_id, html, schema, lambda s: [(serialize(load_plain(s, strict=strict)),)])


def compare_pages(pairs: DataFrame, doc_id: str, left: str, right: str, load_left: Loader | None = None, load_right: Loader | None = None, texts: bool = True) -> DataFrame:
    """``(doc_id, path, difference)`` of the pages whose trees differ."""
    a, b = load_left or load_plain, load_right or load_plain
    schema = T.StructType([T.StructField("doc_id", pairs.schema[doc_id].dataType), T.StructField("path", T.StringType()), T.StructField("difference", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(d, *found) for d, x, y in zip(*(batch.column(i).to_pylist() for i in range(3))) if (found := tree_difference(a(x or ""), b(y or ""), texts))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], arrow.field(i).type) for i in range(3)], schema=arrow)

    return pairs.select(doc_id, left, right).mapInArrow(run, schema)


def compare_tokens(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows ``(doc_id, pos, ...)`` where two token tables differ in token or tag."""
    a = left.select("doc_id", "pos", F.col("token").alias("left_token"), F.col("tag").alias("left_tag"))
    b = right.select("doc_id", "pos", F.col("token").alias("right_token"), F.col("tag").alias("right_tag"))
    both = a.join(b, ["doc_id", "pos"], "full")
    return both.where(~(F.col("left_token").eqNullSafe(F.col("right_token")) & F.col("left_tag").eqNullSafe(F.col("right_tag"))))
