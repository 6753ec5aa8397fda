"""Corpus pipeline: quality rules, near-duplicates, shared passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns documents with the columns it was given; the last returns packed
pieces.  Stages keep rows with null ids, texts or other columns as their operators define it, and pass other columns on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import packing, private, quality, simhash, substrings
from inkwell.llm.common import cut_table, fresh, named, table


def with_text(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The given columns of docs with another text, and its length where n_chars is among them."""
    new = {"text": named(text), "n_chars": F.length(named(text)).cast("long")}
    return docs.select(*[new[c].alias(c) if c in new else named(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failed lines."""
    return with_text(quality.cleaned(docs), docs.columns, "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies (five-word Jaccard similarity of 0.8 or more), told apart by id and text; rows of null ids stay."""
    return simhash.distinct(docs, simhash.near_firsts(docs))


def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start earlier; those of which nothing is left go."""
    own = fresh(docs.columns, "kept_text")
    found = substrings.deduplicated(docs, out_col=own)
    return with_text(found.where(~((named(own) == "") & (named("text") != "")) | named("text").isNull()), docs.columns, own)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a placeholder for every stretch of personal data."""
    own = fresh(docs.columns, "masked")
    return with_text(private.masked(docs, out_col=own), docs.columns, own)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence and place they are packed at."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("shared passages", shared_passages),
    ("personal data", personal_data),
    ("packing", packed),
]

#: Merging tokens and fingerprints are beyond SQL; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
