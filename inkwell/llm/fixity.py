"""Merkle fixity audit of replicated WARC archives.

Records are hashed where they are read; only digests travel.  An archive is cut into offset ranges of RANGE bytes; a
range's node hashes its records in offset order, FANOUT neighbouring nodes make the next level's node, up to the
archive's root; archive roots meet by the leading hex digits of their hashed names in a tree over the whole collection.
Two replicas are compared from the collection root down: a level only looks at children of nodes that differ, and only
ranges at the very bottom that differ compare records.  Levels follow from the longest archive and the number of
archives, and every node has a bounded number of children, so no task gathers an archive however long it is.

Defined cases: rows with null archive, offset or record take no part; exactly repeated records count once; records of
different content at one offset are compared as the set they are; a record that only one replica has is missing or
extra; very long records are hashed where they are read and travel as digests; ties don't occur, since nodes sort their
rows by all they hold; empty replicas agree with each other; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import cut, cut_table, table

RANGE = 1 << 16
FANOUT_BITS = 4
#: Pages in one archive file of the query.
PAGES_PER_ARCHIVE = 128


def inventory(records: DataFrame, archive: Column, offset: Column, record: Column) -> DataFrame:
    """(archive, offset, length, digest) of every record."""
    rows = records.select(archive.cast("string").alias("archive"), offset.cast("long").alias("offset"), record.cast("binary").alias("record"))
    rows = rows.where("archive is not null and offset is not null and record is not null")
    return rows.select("archive", "offset", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))


def _ordered(*columns: str) -> Column:
    """Hash of the rows of a node in order."""
    return F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct(*columns)))), 256)


def tree(leaves: DataFrame, levels: int, depth: int) -> list[DataFrame]:
    """Nodes (archive, node, digest) of each tier from the bottom: offset ranges, then digits of archive names up to the root."""
    rows = leaves.dropDuplicates(["archive", "offset", "length", "digest"])
    tier = rows.groupBy("archive", F.floor(F.col("offset") / RANGE).alias("node")).agg(_ordered("offset", "length", "digest").alias("digest"))
    out = [cut(tier.select("archive", "node", "digest"))]
    for _ in range(levels):
        tier = out[-1].groupBy("archive", F.shiftright("node", FANOUT_BITS).alias("parent")).agg(_ordered("node", "digest").alias("digest"))
        out.append(cut(tier.select("archive", F.col("parent").alias("node"), "digest")))
    for d in range(depth, -1, -1):
        name = F.sha2("archive", 256) if d == depth else F.col("archive")
        tier = out[-1].groupBy(F.substring(name, 1, d).alias("prefix")).agg(_ordered("archive", "digest").alias("digest"))
        out.append(cut(tier.select(F.col("prefix").alias("archive"), F.lit(0).cast("long").alias("node"), "digest")))
    return out


def parents(nodes: DataFrame, tier: int, levels: int, depth: int) -> DataFrame:
    """nodes of a tier with up_archive and up_node, their parent's key."""
    if tier < levels:
        return nodes.withColumn("up_archive", F.col("archive")).withColumn("up_node", F.shiftright("node", FANOUT_BITS))
    digits = depth - (tier - levels)
    name = F.sha2("archive", 256) if tier == levels else F.col("archive")
    return nodes.withColumn("up_archive", F.substring(name, 1, digits)).withColumn("up_node", F.lit(0).cast("long"))


def differing(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose digests are not the same in both."""
    a, b = left.select(*key, F.col("digest").alias("a")), right.select(*key, F.col("digest").alias("b"))
    return a.join(b, key, "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(*key)


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """(archive, offset, kind, left_length, right_length, left_digest, right_digest) of every record in which two inventories differ.

    kind is changed, missing (only left has it) or extra (only right has it).
    """
    left, right = cut_table(left), cut_table(right)
    size = left.unionByName(right).agg(F.max("offset"), F.approx_count_distinct("archive")).first()
    ranges, archives = (size[0] or 0) // RANGE + 1, max(1, size[1])
    levels = math.ceil(math.log(ranges, 1 << FANOUT_BITS)) if ranges > 1 else 0
    depth = math.ceil(math.log(archives, 16)) if archives > 1 else 0
    ours, theirs = tree(left, levels, depth), tree(right, levels, depth)
    key = ["archive", "node"]
    wrong = cut(differing(ours[-1], theirs[-1], key))
    for tier in range(len(ours) - 2, -1, -1):
        up = wrong.select(F.col("archive").alias("up_archive"), F.col("node").alias("up_node"))
        below = [parents(side[tier], tier, levels, depth).join(up, ["up_archive", "up_node"], "left_semi") for side in (ours, theirs)]
        wrong = cut(differing(*below, key))
    sides = []
    for rows, name in ((left, "left"), (right, "right")):
        near = rows.withColumn("node", F.floor(F.col("offset") / RANGE)).join(wrong, key, "left_semi")
        here = near.groupBy("archive", "offset").agg(F.max("length").alias(f"{name}_length"), F.array_join(F.sort_array(F.collect_set("digest")), "+").alias(f"{name}_digest"))
        sides.append(here)
    both = sides[0].join(sides[1], ["archive", "offset"], "full").where("not left_digest <=> right_digest")
    kind = F.when(F.col("right_digest").isNull(), "missing").when(F.col("left_digest").isNull(), "extra").otherwise("changed")
    return both.select("archive", "offset", kind.alias("kind"), "left_length", "right_length", "left_digest", "right_digest")


def warc_record(url: Column, body: Column) -> Column:
    """A response record of the WARC format around a page."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def archived(pages: DataFrame, record: Column, place: Column) -> DataFrame:
    """The inventory of pages as archives of PAGES_PER_ARCHIVE pages; offsets count the bytes of place, the record as first written."""
    rows = pages.where("page_id is not null").select(
        F.floor(F.col("page_id") / PAGES_PER_ARCHIVE).alias("file"), "page_id", F.octet_length(place).cast("long").alias("size"), F.octet_length(record).cast("long").alias("length"), F.sha2(record.cast("binary"), 256).alias("digest")
    )
    before = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long")
    return rows.select(F.format_string("crawl-%08d.warc", F.col("file")).alias("archive"), offset.alias("offset"), "length", "digest")


def op1_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of all pages against a replica with planted damage: page_id % 97 = 3 has a changed byte, % 89 = 5 lost its end, % 101 = 7 is gone; % 103 = 9 only the replica has."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    good = warc_record(F.col("url"), F.col("html"))
    bad = F.when(F.col("page_id") % 97 == 3, F.concat(good.substr(F.lit(1), F.length(good) - 1), F.lit("!"))).when(F.col("page_id") % 89 == 5, F.left(good, F.lit(40))).otherwise(good)
    without = lambda gone, record: F.when(gone, F.lit(None).cast("string")).otherwise(record)
    ours = archived(pages, without(F.col("page_id") % 103 == 9, good), good).where("digest is not null")
    theirs = archived(pages, without(F.col("page_id") % 101 == 7, bad), good).where("digest is not null")
    lengths = {f"{side}_length": F.coalesce(f"{side}_length", F.lit(0)) for side in ("left", "right")}
    return audit(ours, theirs).withColumns(lengths)


ORACLE = {
    "op1_fixity": f"""
WITH r AS (
  SELECT page_id, page_id // {PAGES_PER_ARCHIVE} AS file,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS good
  FROM pages WHERE page_id IS NOT NULL),
o AS (
  SELECT page_id, printf('crawl-%08d.warc', file) AS archive, good,
    CAST(coalesce(sum(strlen(good)) OVER (PARTITION BY file ORDER BY page_id, sha256(good) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
    CASE WHEN page_id % 103 = 9 THEN NULL ELSE good END AS ours,
    CASE WHEN page_id % 101 = 7 THEN NULL WHEN page_id % 97 = 3 THEN left(good, length(good) - 1) || '!' WHEN page_id % 89 = 5 THEN left(good, 40) ELSE good END AS bad
  FROM r)
SELECT archive, "offset", CASE WHEN bad IS NULL THEN 'missing' WHEN ours IS NULL THEN 'extra' ELSE 'changed' END AS kind, CAST(coalesce(strlen(ours), 0) AS BIGINT) AS left_length,
  CAST(coalesce(strlen(bad), 0) AS BIGINT) AS right_length, sha256(ours) AS left_digest, sha256(bad) AS right_digest
FROM o WHERE bad IS DISTINCT FROM ours
""",
}

QUERIES = {"op1_fixity": op1_fixity}
