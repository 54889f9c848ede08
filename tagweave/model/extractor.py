"""Pages in, entities out: a loader, a tokeniser and a fitted pipeline together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.text import smart_join
from tagweave.html.annotate import Colors
from tagweave.html.tokens import Options
from tagweave.model.pipeline import TaggingPipeline
from tagweave.operators import cluster, iob
from tagweave.sources import pages as pg


@dataclass
class EntityExtractor:
    """``build_entity`` makes an entity's text of its token array; entities
    whose text comes out empty are dropped."""

    model: TaggingPipeline
    load: pg.Loader = field(default_factory=lambda: pg.loader("plain"))
    options: Options = field(default_factory=Options)
    colors: Colors = field(default_factory=dict)
    build_entity: Callable[[Column], Column] = smart_join

    def tokens(self, pages: DataFrame, doc_id: str, html: str) -> DataFrame:
        return pg.page_tokens(pages, doc_id, html, self.load, self.options)

    def extract_raw(self, pages: DataFrame, doc_id: str, html: str) -> DataFrame:
        """Token rows with the model's ``tag``."""
        return self.model.predict(self.tokens(pages, doc_id, html))

    def extract(self, pages: DataFrame, doc_id: str, html: str) -> DataFrame:
        """``(doc_id, group_no, entity_type, text)``."""
        found = iob.groups(self.extract_raw(pages, doc_id, html)).where("tag <> 'O'")
        return found.select("doc_id", "group_no", F.col("tag").alias("entity_type"), self.build_entity(F.col("tokens")).alias("text")).where("text <> ''")

    def extract_groups(self, pages: DataFrame, doc_id: str, html: str, dont_penalize: frozenset[str] = frozenset()) -> DataFrame:
        """``(doc_id, cluster_no, ent_no, entity_type, text)``."""
        return cluster.entity_groups(cluster.positions(self.extract_raw(pages, doc_id, html)), dont_penalize)

    def annotate(self, pages: DataFrame, doc_id: str, html: str, url: str | None = None) -> DataFrame:
        """``(doc_id, html)`` with coloured spans around the entities."""
        return pg.annotate_pages(pages, self.extract_raw(pages, doc_id, html), doc_id, html, self.colors, url, self.load, self.options)
