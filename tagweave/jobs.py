"""Batch jobs: ``python -m tagweave.jobs JOB ...`` or through ``spark-submit``.

convert    inline-tag pages -> span-annotated pages
compare    trees and tags of two sets of pages with the same names
clean      strict cleaning of pages
gazetteer  gazetteer dump -> Parquet lexicon
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tagweave.html.loaders import read_colors
from tagweave.html.tree import parse
from tagweave.session import build_session
from tagweave.sources import gazetteer
from tagweave.sources import pages as pg


def convert(spark: SparkSession, a: argparse.Namespace) -> None:
    colors = {}
    if a.sample:
        colors = read_colors(parse(spark.read.format("binaryFile").load(a.sample).first().content))
    out = pg.convert_inline(pg.read_pages(spark, a.source), "path", "html", set(a.entities.split(",")), colors)
    out.write.mode("overwrite").parquet(a.target)


def compare(spark: SparkSession, a: argparse.Namespace) -> None:
    name = F.regexp_extract("path", r"([^/]+)\z", 1).alias("doc_id")
    left = pg.read_pages(spark, a.left).select(name, F.col("html").alias("l"))
    right = pg.read_pages(spark, a.right).select(name, F.col("html").alias("r"))
    pairs = left.join(right, "doc_id")
    inline, annotated = pg.loader("inline", set(a.entities.split(","))), pg.loader("annotated", set(a.entities.split(",")))
    trees = pg.compare_pages(pairs, "doc_id", "l", "r", inline, annotated)
    tags = pg.compare_tokens(pg.page_tokens(pairs, "doc_id", "l", inline), pg.page_tokens(pairs, "doc_id", "r", annotated))
    trees.write.mode("overwrite").json(f"{a.target}/trees")
    tags.write.mode("overwrite").json(f"{a.target}/tags")


def clean(spark: SparkSession, a: argparse.Namespace) -> None:
    pg.clean_pages(pg.read_pages(spark, a.source), "path", "html").write.mode("overwrite").parquet(a.target)


def build_gazetteer(spark: SparkSession, a: argparse.Namespace) -> None:
    read = gazetteer.read_geonames_zipped if a.source.endswith(".zip") else gazetteer.read_geonames
    lexicon = gazetteer.build_lexicon(read(spark, a.source), tuple(c for c in a.columns.split(",") if c), tuple(c for c in a.codes.split(",") if c) or None, a.lower)
    gazetteer.write_lexicon(lexicon, a.target)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = p.add_subparsers(dest="job", required=True)
    for name, f in (("convert", convert), ("compare", compare), ("clean", clean), ("gazetteer", build_gazetteer)):
        j = jobs.add_parser(name)
        j.set_defaults(run=f)
        for field in ("left", "right") if name == "compare" else ("source",):
            j.add_argument(field)
        j.add_argument("target")
        if name in ("convert", "compare"):
            j.add_argument("--entities", required=True)
        if name == "convert":
            j.add_argument("--sample", help="annotated page whose colours are used")
        if name == "gazetteer":
            j.add_argument("--columns", default="")
            j.add_argument("--codes", default="ADM1,ADM2,ADM3,ADM4")
            j.add_argument("--lower", action="store_true")
    a = p.parse_args(args)
    a.run(spark or build_session("local[*]", a.job), a)


if __name__ == "__main__":
    main()
