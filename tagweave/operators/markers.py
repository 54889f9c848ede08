"""Annotation markers inside text: from inline tags, into text, and out again.

Defined results: null text stays null; tags with attributes and unknown types
are left alone; edits of one text are applied from right to left, so positions
need no correction.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.operators.iob import number_groups

#: A marker with one blank on each side, as cleaning removes it.
MARKER_IN_TEXT = r"(^|\s)__(START|END)_(\w+?)__(\s|$)"


def inline_tags_to_markers(html: Column, known_entities: list[str] | None) -> Column:
    """``<ORG>`` -> ``` __START_ORG__ ``` and ``</ORG>`` -> ``` __END_ORG__ ```; the
    spelling of the type is kept, tags with attributes aren't touched."""
    if known_entities is None:
        raise ValueError("known_entities is required: the list of all entity types")
    types = "|".join(map(re.escape, known_entities))
    return F.regexp_replace(F.regexp_replace(html, rf"(?i)<({types})>", " __START_$1__ "), rf"(?i)</({types})>", " __END_$1__ ")


def remove_markers(text: Column) -> Column:
    return F.regexp_replace(text, MARKER_IN_TEXT, "")


def find_markers(text: Column) -> Column:
    """Array of (kind, type, position) of the markers of a text.  The markers'
    own positions come from the lengths of the pieces between them."""
    marks = F.regexp_extract_all(text, F.lit(r"__(?:START|END)_\w+?__"), F.lit(0))
    between = F.split(text, r"__(?:START|END)_\w+?__")
    before = lambda i: F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(marks, 1, i), F.lit(0), lambda a, x: a + F.length(x))
    return F.transform(marks, lambda m, i: F.struct(F.regexp_extract(m, r"__(START|END)_", 1).alias("kind"), F.regexp_extract(m, r"__(?:START|END)_(\w+?)__", 1).alias("type"), before(i).cast("int").alias("position")))


def pair_markers(marks: DataFrame) -> DataFrame:
    """``(doc_id, k, type, start, end)`` of markers ``(doc_id, kind, type, at)``:
    the k-th start goes with the k-th end of the document, whatever their types;
    unequal numbers are an error."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "kind").orderBy("at")
    numbered = marks.withColumn("k", F.row_number().over(w))
    starts = numbered.where("kind = 'START'").select("doc_id", "k", "type", F.col("at").alias("start"))
    ends = numbered.where("kind = 'END'").select("doc_id", "k", F.col("at").alias("end"))
    both = starts.join(ends, ["doc_id", "k"], "full")
    whole = F.col("start").isNotNull() & F.col("end").isNotNull()
    return both.withColumn("start", F.when(whole, F.col("start")).otherwise(F.raise_error(F.lit("number of starts and ends differs"))))


def insert_markers(texts: DataFrame, tokens: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text)`` with markers around the entities of ``tokens``
    ``(doc_id, pos, position, length, tag)``; documents without entities keep
    their text."""
    numbered = number_groups(tokens).where("group_type <> 'O'")
    spans = numbered.groupBy("doc_id", "group_no").agg(F.first("group_type").alias("type"), F.min("position").alias("a"), F.max(F.col("position") + F.col("length")).alias("b"))
    edits = spans.select(
        "doc_id",
        F.inline(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("order"), F.format_string(" __START_%s__ ", "type").alias("mark")), F.struct(F.col("b").alias("at"), F.lit(0).alias("order"), F.format_string(" __END_%s__ ", "type").alias("mark")))),
    )
    per_doc = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "order", "mark"))).alias("e"))
    joined = texts.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(per_doc, "doc_id", "left")
    # pieces between edits, each edit once: linear in the text
    piece = lambda e, i: F.concat(F.substring("text", F.when(i == 0, 1).otherwise(F.try_element_at("e", i)["at"] + 1), e["at"] - F.when(i == 0, 0).otherwise(F.try_element_at("e", i)["at"])), e["mark"])
    tail = F.expr("substring(text, element_at(e, -1).at + 1)")
    return joined.select("doc_id", F.when(F.col("e").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.transform("e", piece), ""), tail)).alias("text"))


def replace_tags(tag: Column, renames: dict[str, str]) -> Column:
    """Renamed element tags; others stay."""
    pairs = [F.lit(x) for kv in renames.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), tag), tag) if pairs else tag
