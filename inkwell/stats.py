"""Document statistics as grouped aggregates over the flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.views import HEADINGS, document_sections

WORD = r"[\p{L}\p{N}_]+"
WORDS_PER_MINUTE = 200


def word_count(text: Column) -> Column:
    return F.when(F.is_valid_utf8(text), F.regexp_count(text, F.lit(WORD))).otherwise(0)


def counted(inlines: DataFrame) -> DataFrame:
    """inlines that hold words, with words and characters."""
    rows = inlines.where(F.col("kind").isin("text", "code-span", "autolink"))
    return rows.withColumn("words", word_count(F.col("text"))).withColumn("characters", F.when(F.is_valid_utf8("text"), F.char_length("text")).otherwise(F.octet_length("text")))


def histogram(column: Column | str, condition: Column) -> Column:
    """Sorted (key, n) entries of the values of column where condition holds."""
    values = F.collect_list(F.when(condition, column))
    return F.transform(F.array_sort(F.array_distinct(values)), lambda k: F.struct(k.alias("key"), F.size(F.filter(values, lambda v: v == k)).cast("long").alias("n")))


def statistics(documents: DataFrame, blocks: DataFrame, inlines: DataFrame, **metrics: Column) -> DataFrame:
    """One row of statistics for every doc_id of documents; metrics are further aggregates over blocks."""
    heading = F.col("kind").isin(*HEADINGS)
    code = F.col("kind").isin("fenced-code", "indented-code")
    of_blocks = blocks.groupBy("doc_id").agg(
        F.count_if(heading).alias("heading_count"),
        F.coalesce(F.max("level"), F.lit(0)).alias("max_heading_depth"),
        histogram(F.col("level"), heading).alias("headings_by_level"),
        F.transform(F.array_sort(F.collect_list(F.when(heading, F.struct("pre", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text")).alias("line"))))), lambda x: x["line"]).alias("outline"),
        F.count_if(code).alias("code_block_count"),
        histogram(F.coalesce(F.col("language"), F.lit("plain")), code).alias("code_blocks_by_language"),
        F.count_if(F.col("kind") == "gfm:table").alias("table_count"),
        *[c.alias(n) for n, c in metrics.items()],
    )
    link = F.col("kind") == "link"
    internal = link & F.col("destination").startswith("#")
    host = F.try_parse_url("destination", F.lit("HOST"))
    of_inlines = inlines.groupBy("doc_id").agg(
        F.count_if(link).alias("link_count"), F.count_if(internal).alias("internal_link_count"), (F.count_if(link) - F.count_if(internal)).alias("external_link_count"),
        histogram(host, link & host.isNotNull()).alias("links_by_host"), F.count_if(F.col("kind") == "image").alias("image_count"),
    )
    of_words = counted(inlines).groupBy("doc_id").agg(F.sum("words").cast("long").alias("word_count"), F.sum("characters").cast("long").alias("character_count"))
    out = documents.select("doc_id").distinct().join(of_blocks, "doc_id", "left").join(of_inlines, "doc_id", "left").join(of_words, "doc_id", "left")
    counts = [c for c, t in out.dtypes if t in ("bigint", "int") and c != "doc_id"]
    out = out.fillna(0, counts)
    minutes = F.when(F.col("word_count") == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.col("word_count") / WORDS_PER_MINUTE)))
    return out.withColumn("reading_minutes", minutes.cast("long"))


def section_words(blocks: DataFrame, inlines: DataFrame) -> DataFrame:
    """(doc_id, section_pre, words): words since the last heading, its own included; text before the first counts nowhere."""
    rows = document_sections(blocks, counted(inlines)).where("section_pre is not null")
    words = rows.groupBy("doc_id", "section_pre").agg(F.sum("words").cast("long").alias("words"))
    heads = blocks.where(F.col("kind").isin(*HEADINGS)).select("doc_id", F.col("pre").alias("section_pre"), "text")
    return heads.join(words, ["doc_id", "section_pre"], "left").fillna(0, ["words"])
