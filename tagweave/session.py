"""Session defaults, tables, and the size check before a broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", app: str = "tagweave", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Tables whose rows cost much more to work on than to move.
HEAVY = {"documents", "html_blocks", "pages", "geonames", "geonames_raw"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in HEAVY else df


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores if the input comes in fewer pieces than half
    of them: a small file of one row group would keep one core busy.  Inputs of
    any size worth the name have more pieces than cores and aren't moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


def fits_broadcast(df: DataFrame, max_bytes: int) -> bool:
    """True if ``df``'s strings and rows, counted exactly, are below ``max_bytes``.

    One aggregate over ``df``; nothing but a single number reaches the driver.
    """
    from pyspark.sql import functions as F

    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    return (df.agg(F.sum(width)).first()[0] or 0) <= max_bytes
