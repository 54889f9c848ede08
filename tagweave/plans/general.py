"""Queries of the two general problems: packed fields and failing rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.operators.badrows import failures, parse_lines, valid
from tagweave.operators.packed import explode_packed
from tagweave.schema import GEONAMES
from tagweave.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return explode_packed(table(spark, sf, "geonames"), "alternatenames", "row_id", "pos", "alt_name")


def p1_per_row(spark: SparkSession, sf: str) -> DataFrame:
    """Names per field length bucket: how many fields pack how many names."""
    names = p1_found(spark, sf).groupBy("row_id").agg(F.count("*").alias("n_names"), F.countDistinct("alt_name").alias("n_distinct"))
    return names.groupBy("n_names").agg(F.count("*").alias("n_rows"), F.sum("n_distinct").alias("n_distinct"))


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return parse_lines(table(spark, sf, "geonames_raw"), "raw_line", ["raw_id"])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return failures(_parsed(spark, sf), ["raw_id"])


def p2_loaded(spark: SparkSession, sf: str) -> DataFrame:
    return valid(_parsed(spark, sf))


def p2_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


# One field of a line whose quoting is whole, after the tab before it.
_FIELD = r'\t("(?:[^"]|"")*"|[^"\t][^\t]*|)'
_P2 = rf"""
WITH f AS (
  SELECT raw_id, regexp_full_match(chr(9) || coalesce(raw_line, ''), '(?s)(?:{_FIELD})+') AS whole,
         regexp_extract_all(chr(9) || coalesce(raw_line, ''), '(?s){_FIELD}', 1) AS x
  FROM geonames_raw),
u AS (
  SELECT raw_id, whole, len(x) AS n,
         CASE WHEN x[1] LIKE '"%' THEN replace(substr(x[1], 2, length(x[1]) - 2), '""', '"') ELSE x[1] END AS gid,
         CASE WHEN x[15] LIKE '"%' THEN replace(substr(x[15], 2, length(x[15]) - 2), '""', '"') ELSE x[15] END AS pop,
         x
  FROM f),
j AS (
  SELECT raw_id, x,
    CASE WHEN NOT whole THEN 'quoting'
         WHEN n <> 19 THEN 'columns'
         WHEN NOT regexp_full_match(gid, '[0-9]+') OR coalesce(try_cast(gid AS HUGEINT), 0) NOT BETWEEN 1 AND 9223372036854775807 THEN 'geonameid'
         WHEN pop <> '' AND (NOT regexp_full_match(pop, '[0-9]+') OR coalesce(try_cast(pop AS HUGEINT), -1) NOT BETWEEN 0 AND 9223372036854775807) THEN 'population'
    END AS reason
  FROM u)
"""

def _sql_value(i: int, kind: T.DataType) -> str:
    v = f"CASE WHEN x[{i}] LIKE '\"%' THEN replace(substr(x[{i}], 2, length(x[{i}]) - 2), '\"\"', '\"') ELSE x[{i}] END"
    if isinstance(kind, T.StringType):
        return f"nullif({v}, '')"
    if isinstance(kind, T.DoubleType):
        return f"CASE WHEN regexp_full_match({v}, '[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?') THEN TRY_CAST({v} AS DOUBLE) END"
    return f"CASE WHEN regexp_full_match({v}, '[+-]?[0-9]+') THEN TRY_CAST({v} AS {'INTEGER' if isinstance(kind, T.IntegerType) else 'BIGINT'}) END"


_LOADED = ", ".join(f"{_sql_value(i + 1, f.dataType)} AS {f.name}" for i, f in enumerate(GEONAMES))

QUERIES = {"p1_found": p1_found, "p1_per_row": p1_per_row, "p2_found": p2_found, "p2_loaded": p2_loaded, "p2_reasons": p2_reasons}
SQL = {
    "p2_found": _P2 + "SELECT raw_id, reason FROM j WHERE reason IS NOT NULL",
    "p2_loaded": _P2 + f"SELECT raw_id, {_LOADED} FROM j WHERE reason IS NULL",
    "p2_reasons": _P2 + "SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM j GROUP BY 1",
}
