"""Extension: the stateless part of extraction over a stream of pages.

New files of a folder are read as they arrive; each micro-batch runs the same
plan as a batch job.  Counts over event time use a watermark, so late pages are
taken in up to the given delay and state stays bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.sources.pages import page_tokens

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("host", T.StringType()), T.StructField("fetched_at", T.TimestampType()), T.StructField("loaded_at", T.TimestampType())])


def read_page_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def token_stream(pages: DataFrame) -> DataFrame:
    """Token rows of a stream (or table) of pages."""
    return page_tokens(pages, "page_id", "html")


def pages_per_host(pages: DataFrame, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Pages and characters by host and window of ``fetched_at``."""
    timed = pages.withWatermark("fetched_at", late)
    return timed.groupBy(F.window("fetched_at", window), "host").agg(F.count("*").alias("n_pages"), F.sum(F.length("html")).alias("n_chars"))
