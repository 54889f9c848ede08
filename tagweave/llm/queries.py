"""Queries of the text problems and their SQL, where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.bpe import encode_texts
from tagweave.llm.leak import find_leaks
from tagweave.llm.lookalike import canonical, find_lookalikes
from tagweave.llm.markup import clean_rows, rows_with_markup
from tagweave.llm.mojibake import damaged, verdicts
from tagweave.llm.pii import find_rows, redact_rows, train as train_pii
from tagweave.session import table


def _named(df: DataFrame, name: str, ident: str) -> DataFrame:
    return df.select(F.lit(name).alias("tab_name"), F.col(ident).cast("long").alias("row_id"), *[c for c in df.columns if c != ident])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    a = rows_with_markup(table(spark, sf, "documents"), "doc_id", "text")
    b = rows_with_markup(table(spark, sf, "html_blocks"), "block_id", "tokens", "elem")
    return _named(a, "documents", "doc_id").unionByName(_named(b, "html_blocks", "block_id"))


def p3_clean(spark: SparkSession, sf: str) -> DataFrame:
    a = clean_rows(table(spark, sf, "documents"), "doc_id", "text")
    b = clean_rows(table(spark, sf, "html_blocks"), "block_id", "tokens", elem="elem")
    return _named(a, "documents", "doc_id").unionByName(_named(b, "html_blocks", "block_id"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "place_names")
    a = find_lookalikes(table(spark, sf, "geonames"), "row_id", ["main_name", "asciiname"], names)
    b = find_lookalikes(table(spark, sf, "html_blocks"), "block_id", ["tokens"], names)
    return _named(a, "geonames", "row_id").unionByName(_named(b, "html_blocks", "row_id"))


def p4_canonical(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "place_names")
    places, blocks = table(spark, sf, "geonames"), table(spark, sf, "html_blocks")
    parts = [("geonames", places, "row_id", "main_name"), ("geonames", places, "row_id", "asciiname"), ("html_blocks", blocks, "block_id", "tokens")]
    a, b, c = (_named(canonical(df, ident, field, names), name, ident).withColumn("field_name", F.lit(field)).select("tab_name", "row_id", "field_name", "canonical") for name, df, ident, field in parts)
    return a.unionByName(b).unionByName(c)


def _p5(spark: SparkSession, sf: str, restored: str | None) -> DataFrame:
    places, blocks = table(spark, sf, "geonames"), table(spark, sf, "html_blocks")
    told = verdicts([(places, "main_name", None), (places, "alternatenames", "plain"), (blocks, "tokens", "spoofed")]).persist()
    a = damaged(places, "row_id", "alternatenames", told, "plain", restored)
    b = damaged(blocks, "block_id", "tokens", told, "spoofed", restored)
    return _named(a, "geonames", "row_id").unionByName(_named(b, "html_blocks", "block_id"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p5(spark, sf, None)


def p5_restored(spark: SparkSession, sf: str) -> DataFrame:
    return _p5(spark, sf, "restored")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_texts(table(spark, sf, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Walks, sampled keys and proven edit distance for one edit; reported are
    the windows proven without any."""
    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"), max_edits=1, report=0)


def p7_near(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of twelve words up to two word edits, recall 0.95 by parameter."""
    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"), max_edits=2)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return find_rows(docs, "doc_id", "text", train_pii(docs, "doc_id", "text", table(spark, sf, "html_blocks")))


def p8_redacted(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return redact_rows(docs, "doc_id", "text", train_pii(docs, "doc_id", "text", table(spark, sf, "html_blocks")))


QUERIES = {"p3_found": p3_found, "p3_clean": p3_clean, "p4_found": p4_found, "p4_canonical": p4_canonical, "p5_found": p5_found, "p5_restored": p5_restored, "p6_ids": p6_ids, "p7_found": p7_found, "p7_near": p7_near, "p8_found": p8_found, "p8_redacted": p8_redacted}
_P7 = """
WITH d AS (
  SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL),
dw AS (
  SELECT doc_id, regexp_extract_all(t, '[\\p{L}\\p{N}]+') AS w FROM d),
iw AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
ig AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 11], ' ') AS g FROM iw, unnest(range(1, len(w) - 10)) AS r(i)),
dg AS (
  SELECT doc_id, array_to_string(w[i : i + 11], ' ') AS g FROM dw, unnest(range(1, len(w) - 10)) AS r(i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""
SQL = {"p7_found": _P7}
