"""Gazetteer files -> tables -> lexicons.

Defined results: the literal ``NA`` stays a country code (it is no null);
quotes are plain characters; a name with a comma breaks apart, as the file
packs names with commas; empty names are no names.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.operators.badrows import parse_fields, parse_lines, valid  # noqa: F401
from tagweave.schema import GEONAMES


def read_geonames(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated dump, split by Spark; files or folders, compressed or not."""
    return spark.read.csv(path, sep="\t", header=False, quote="", schema=GEONAMES, encoding="UTF-8")


def read_geonames_zipped(spark: SparkSession, path: str, inner: str | None = None) -> DataFrame:
    """Zip archives, one task each; the inner file defaults to the archive's
    name with ``.txt``.  Lines stream out of the archive; those that don't parse
    come apart in ``_bad``, see :func:`cut_lines`."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as z, z.open(inner or PurePosixPath(p).stem + ".txt") as f:
                    held: list[str] = []
                    for line in io.TextIOWrapper(f, "utf-8", newline="\n"):
                        held.append(line.rstrip("\n"))
                        if len(held) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["raw_line"])
                            held = []
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["raw_line"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(lines, "raw_line string")
    return cut_lines(raw)


def cut_lines(raw: DataFrame, line: str = "raw_line", carry: tuple[str, ...] = ()) -> DataFrame:
    """Lines of the dump, quotes being plain characters -> typed rows; ``_bad``
    holds a line that hasn't as many fields as columns (null for others)."""
    fields = F.split(line, "\t", -1)
    whole = F.size(fields) == len(GEONAMES)
    cast = [F.when(whole, F.nullif(F.try_element_at(fields, F.lit(i + 1)), F.lit(""))).try_cast(f.dataType).alias(f.name) for i, f in enumerate(GEONAMES)]
    return raw.select(*carry, *cast, F.when(~whole, F.col(line)).alias("_bad"))


def exploded_names(places: DataFrame, *carry: str) -> DataFrame:
    """One row for every distinct name of a place: main, ASCII and alternate."""
    packed = F.concat_ws(",", "main_name", "asciiname", "alternatenames")
    names = F.array_distinct(F.filter(F.split(packed, ","), lambda n: n != ""))
    return places.select(*carry, F.explode(names).alias("name"))


def build_lexicon(places: DataFrame, columns: tuple[str, ...] = (), feature_codes: tuple[str, ...] | None = None, lower: bool = False) -> DataFrame:
    """``(name, n_words, *columns)``: distinct records, ready to be written."""
    kept = places.where(F.col("feature_code").isin(*feature_codes)) if feature_codes else places
    names = exploded_names(kept, *columns)
    name = F.lower("name") if lower else F.col("name")
    return names.select(name.alias("name"), F.size(F.split(name, " ")).alias("n_words"), *columns).distinct()


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    lexicon.write.mode("overwrite").parquet(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def contact_lexicons(places: DataFrame, countries: DataFrame) -> dict[str, DataFrame]:
    """The lexicons of the contact bundle by feature name, from a gazetteer and
    a list of country names (``name``)."""
    towns = places.where("feature_class = 'P'")
    of = lambda df: exploded_names(df).distinct()
    # The least populations and the code of first-level regions.
    return {"COUNTRY": countries.select("name").distinct(), **{f"CITY-{n}": of(towns.where(F.col("population") >= n)) for n in (1000, 5000, 15000)}, "ADM1": of(places.where("feature_code = 'ADM1'"))}


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """One phrase per line -> distinct ``name``."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''").distinct()
