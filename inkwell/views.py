"""Structural queries: DataFrames over the flat tables of inkwell.parse."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell import intervals

HEADINGS = ("atx-heading", "setext-heading")
#: Of a heading; a parse of fewer fields has fewer.
HEADING_COLUMNS = ("pre", "depth", "kind", "level", "text", "fold", "own", "start", "end")
KINDS = (
    "document", "paragraph", *HEADINGS, "indented-code", "fenced-code", "html-block", "block-quote", "list", "list-item", "thematic-break", "link-reference-definition",
    "gfm:table", "github:alert", "frontmatter:block", "description-list", "description-term", "description",
)


class Query:
    """Blocks by kind (any of) and predicates (all of); unknown kinds select nothing."""

    def __init__(self, blocks: DataFrame, kinds: tuple[str, ...] = (), predicates: tuple[Column, ...] = ()):
        self.blocks, self.kinds, self.predicates = blocks, kinds, predicates

    def kind(self, *names: str) -> Query:
        return Query(self.blocks, self.kinds + names, self.predicates)

    def where(self, predicate: Column | str) -> Query:
        return Query(self.blocks, self.kinds, (*self.predicates, F.expr(predicate) if isinstance(predicate, str) else predicate))

    def get(self) -> DataFrame:
        rows = self.blocks.where("depth > 0")
        if self.kinds:
            known = [k for k in self.kinds if k in KINDS]
            rows = rows.where(F.col("kind").isin(known) if known else F.lit(False))
        for predicate in self.predicates:
            rows = rows.where(predicate)
        return rows


def headings(blocks: DataFrame, level: int | None = None) -> DataFrame:
    rows = blocks.where(F.col("kind").isin(*HEADINGS))
    rows = rows if level is None else rows.where(F.col("level") == level)
    return rows.select("doc_id", *(c for c in HEADING_COLUMNS if c in rows.columns))


def titles(blocks: DataFrame) -> DataFrame:
    """(doc_id, title): the first heading of level 1, anywhere."""
    return headings(blocks, 1).groupBy("doc_id").agg(F.min_by("text", "pre").alias("title"))


def sections(blocks: DataFrame, parsed: DataFrame) -> DataFrame:
    """Headings with section_end: where the next heading of the same or a higher level starts, or the document ends."""
    # Backwards, so that frames grow row by row: the last start seen of each level, and the least of those that end a section.
    after = Window.partitionBy("doc_id").orderBy(F.desc("pre")).rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.when(F.col("level") == n, F.last(F.when(F.col("level") <= n, F.col("start")), ignorenulls=True).over(after)) for n in range(1, 7)]
    size = parsed.where("source is not null").select("doc_id", F.octet_length("source").cast("int").alias("n_bytes"))
    return headings(blocks).withColumn("next", F.coalesce(*ends)).join(size, "doc_id").withColumn("section_end", F.coalesce("next", "n_bytes")).drop("next", "n_bytes")


def section_text(sections: DataFrame, parsed: DataFrame) -> DataFrame:
    """sections with their source bytes as text, heading included."""
    own = parsed.select("doc_id", "source")
    return sections.join(own, "doc_id").withColumn("section_source", F.expr("cast(substring(source, start + 1, section_end - start) as string)")).drop("source")


def links(inlines: DataFrame) -> DataFrame:
    return inlines.where("kind = 'link'").select("doc_id", "block_pre", "inline_ord", "text", "destination", "title", "start", "end", "ref_label", "label_end")


def images(inlines: DataFrame) -> DataFrame:
    return inlines.where("kind = 'image'").select("doc_id", "block_pre", "inline_ord", F.col("text").alias("alt"), "destination", "title", "start", "end", "ref_label", "label_end")


def code_blocks(blocks: DataFrame, language: str | None = None) -> DataFrame:
    rows = blocks.where(F.col("kind").isin("fenced-code", "indented-code"))
    rows = rows if language is None else rows.where(F.col("language") == language)
    return rows.select("doc_id", "pre", "depth", "kind", "language", "info", "code", "fence", "fence_closed", "own", "eol", "start", "end")


def front_matter(blocks: DataFrame) -> DataFrame:
    return blocks.where("kind = 'frontmatter:block'").select("doc_id", "fence", "content", "own", "eol", "start", "end")


def decoded_front_matter(front: DataFrame, decoder: Callable[[str], dict] | Column) -> DataFrame:
    """front_matter() with data: a map of strings by a function from content to a dict, or a column such as from_json("content", schema)."""
    if isinstance(decoder, Column):
        return front.withColumn("data", decoder)

    @F.pandas_udf("map<string,string>")
    def decoded(content: pd.Series) -> pd.Series:
        return content.map(lambda c: None if c is None else {str(k): None if v is None else str(v) for k, v in decoder(c).items()})

    return front.withColumn("data", decoded("content"))


def section(sections: DataFrame, title: str) -> DataFrame:
    """The first section of every document whose heading is title, by folded and trimmed text."""
    first = Window.partitionBy("doc_id").orderBy("pre")
    return sections.where(F.col("fold") == title.strip().casefold()).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def node(blocks: DataFrame, pre: int | Column) -> DataFrame:
    """The block of a number in every document; 0 is the root."""
    return blocks.where(F.col("pre") == pre)


def link_targets(inlines: DataFrame, documents: DataFrame) -> DataFrame:
    """Links and images with inline_syntax: whether their target stands in parentheses right after the label."""
    rows = inlines.where("kind in ('link', 'image')").select("doc_id", "block_pre", "inline_ord", "kind", "destination", "title", "start", "end", "label_end")
    return rows.join(documents.select("doc_id", "source"), "doc_id").withColumn("inline_syntax", F.expr("cast(substring(source, label_end + 2, 1) as string) = '('")).drop("source")


def tables(blocks: DataFrame) -> DataFrame:
    return blocks.where("kind = 'gfm:table'").select("doc_id", "pre", "header", "align", "rows", "row_ranges", "start", "end")


def table_rows(blocks: DataFrame) -> DataFrame:
    return tables(blocks).select("doc_id", "pre", "header", F.posexplode("rows").alias("row", "cells"))


def tasks(blocks: DataFrame) -> DataFrame:
    """List items with a task state, and the text of their first paragraph."""
    # One scan of the blocks: an item and its first paragraph meet in a group of the item's number.
    first = (F.col("kind") == "paragraph") & (F.col("sibling") == 0)
    rows = blocks.where(F.col("task_state").isNotNull() | first).select("doc_id", F.when(first, F.col("parent_pre")).otherwise(F.col("pre")).alias("item_pre"), "task_state", F.when(first, F.col("text")).alias("text"))
    return rows.groupBy("doc_id", "item_pre").agg(F.max("task_state").alias("task_state"), F.max("text").alias("text")).where("task_state is not null")


def slugs(blocks: DataFrame) -> DataFrame:
    """(doc_id, pre, slug) of all headings, unique within their document."""
    return blocks.where("slug is not null").select("doc_id", "pre", "slug")


def has_anchor(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchors (doc_id, anchor) with found: whether a heading of the document has it."""
    own = slugs(blocks).select("doc_id", F.col("slug").alias("anchor"), F.lit(True).alias("found"))
    return anchors.join(own, ["doc_id", "anchor"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def unused_references(references: DataFrame) -> DataFrame:
    return references.where("not used").select("doc_id", "label_key", "block_pre")


def smallest_block(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges (doc_id, start, end, …) with the pre and kind of the smallest block that holds each, by one sweep a document."""
    return ranges.join(intervals.innermost(blocks, ranges), ["doc_id", "start", "end"]).select(*ranges.columns, "block_pre", "block_kind")


def document_sections(blocks: DataFrame, inlines: DataFrame) -> DataFrame:
    """inlines with the pre of the last heading at or before them (null before the first)."""
    own = headings(blocks).select("doc_id", F.col("pre").alias("block_pre"), F.lit(0).alias("inline_ord"), F.col("pre").alias("heading_pre"))
    rows = inlines.withColumn("heading_pre", F.lit(None).cast("int"))
    every = rows.unionByName(own, allowMissingColumns=True)
    back = Window.partitionBy("doc_id").orderBy("block_pre", "inline_ord").rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn("section_pre", F.last("heading_pre", ignorenulls=True).over(back)).where("inline_ord > 0").drop("heading_pre")
