"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions only.

A line's key is the line without blanks at its ends and with A-Z in lower case; keys of at least LEAST code points count.
The documents' distinct hashes of 128 bits are written once, in batches of ascending ids.  Each batch brings its own
distinct hashes, meets the sorted runs of the batches before by merge joins, says which lines go (their key is in a run,
or a smaller id of the batch holds it), and adds the hashes that are new as a run.  Runs are tables bucketed and sorted
by hash, so a batch is shuffled once, whatever the number of runs, and runs never.  FAN runs of a level are merged into
one of the next.  `Runs` keeps them for batches that come later.

A hot line meets the runs as one row.  Only rows of keys that lose something are told so, in a join that Spark may split.

Defined cases: null and empty text is one empty line; rows with a null id keep their lines and hold none for others; rows
of one id are one document, so they keep equal lines; a line that its first document repeats stays there each time; very
long texts are split in one row; other columns pass through, but for those of the result's own names, which are replaced;
an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import cut_table, fresh, let, named, shared_folder, table

#: Code points of the shortest key that is looked at.
LEAST = 10
#: Batches that a whole table is dealt in: a fixed number, so that the runs are read a fixed number of times at every size.
BATCHES = 4
#: Runs of a level that are merged into one of the next.
FAN = 2
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h", "g"]


def keyed(text: Column) -> Column:
    """A text of lines as the array of its lines' keys."""
    plain = F.octet_length(text) == F.length(text)  # without other letters lower() changes A-Z alone, and quickly
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.transform(F.split(low, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))


def hashed(key: Column) -> Column:
    """128 bits of a key, as two independent hashes."""
    return F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g"))


class Runs:
    """Levels of sorted runs of hashes; no hash is in two of them."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan: int = FAN):
        self.spark, self.fan, self.levels = spark, fan, {}
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark)}/{name}"
        rows.repartition(self.buckets, *HASH).write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).saveAsTable(name)
        return name

    def all(self) -> list[str]:
        return [name for level in sorted(self.levels) for name in self.levels[level]]

    def met(self, rows: DataFrame) -> DataFrame:
        """rows of distinct hashes with old: whether a run holds them."""
        names = self.all()
        for k, name in enumerate(names):
            rows = rows.join(self.spark.table(name).select(*HASH, F.lit(True).alias(f"in{k}")).hint("merge"), HASH, "left")
        old = reduce(lambda a, b: a | b, (F.col(f"in{k}").isNotNull() for k in range(len(names))), F.lit(False))
        return rows.withColumn("old", old).drop(*[f"in{k}" for k in range(len(names))])

    def add(self, rows: DataFrame) -> None:
        """Add hashes that no run holds; merge a level that is full."""
        level, name = 0, self._write(rows.select(*HASH))
        self.levels.setdefault(0, []).append(name)
        while len(self.levels[level]) >= self.fan:
            full = self.levels.pop(level)
            merged = self._write(reduce(DataFrame.unionByName, [self.spark.table(n) for n in full]))
            self.forget(full)
            level += 1
            self.levels.setdefault(level, []).append(merged)

    def forget(self, names: list[str] | None = None) -> None:
        """Take the names out of the catalogue; the folders are left to the cluster's clean-up."""
        for name in names if names is not None else self.all():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def added(runs: Runs, batch: DataFrame, last: bool = False) -> DataFrame:
    """(id, h, g) of the rows of a batch (id, h, g) that go; all its ids are above those of earlier batches.  Its new hashes join runs."""
    own = batch.groupBy(*HASH).agg(F.min("id").alias("first"), F.max("id").alias("most"))
    told = cut_table(runs.met(own))
    guilty = told.where("old or most > first").select(*HASH, F.when(F.col("old"), F.lit(None)).otherwise(F.col("first")).alias("first"))
    gone = cut_table(batch.join(guilty.hint("merge"), HASH).where("first is null or id > first").select("id", *HASH))
    if not last:
        runs.add(told.where("not old"))
    return gone


def dropped(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST, batches: int = BATCHES) -> DataFrame:
    """(id, gone): the hashes of the keys whose lines a document loses."""
    spark = docs.sparkSession
    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    bounds = docs.select(F.percentile_approx(named(id_col).cast("long"), [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    batch = reduce(lambda a, b: a + b, [(F.col("id") > b).cast("int") for b in sorted(set(bounds))], F.lit(0))
    keys = F.filter(keyed(F.col("text")), lambda k: F.length(k) >= least)
    # The set of a document's hashes, one row each.
    hashes = rows.select("id", batch.alias("batch"), F.explode(F.array_distinct(F.transform(keys, hashed))).alias("k")).select("id", "batch", "k.h", "k.g")
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    hashes.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    written = spark.read.schema("id bigint, h bigint, g bigint, batch int").parquet(path)
    runs = Runs(spark)
    count = len(set(bounds)) + 1
    gone = [added(runs, written.where(F.col("batch") == b).drop("batch"), b + 1 == count) for b in range(count)]
    runs.forget()
    return reduce(DataFrame.unionByName, gone).groupBy("id").agg(F.collect_set(F.struct(*HASH)).alias("gone"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "deduplicated", least: int = LEAST, batches: int = BATCHES) -> DataFrame:
    """docs with out_col, a struct of n_lines, n_dropped and the kept text."""
    own = [c for c in docs.columns if c.lower() != out_col.lower()]
    gone, key = fresh([*own, out_col], "gone"), fresh([*own, out_col], "id_")
    found = dropped(docs, id_col, text_col, least, batches).select(F.col("id").alias(key), F.col("gone").alias(gone))
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))

    def kept(lines: Column) -> Column:
        marked = F.zip_with(lines, keyed(text), lambda line, k: F.struct(line.alias("line"), ((F.length(k) >= least) & F.array_contains(named(gone), hashed(k))).alias("goes")))
        left = let(marked, lambda m: F.transform(F.filter(m, lambda x: ~x["goes"]), lambda x: x["line"]))
        return let(left, lambda x: F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(x)).cast("long").alias("n_dropped"), F.array_join(x, "\n").alias("kept")))

    whole = F.struct(F.size(F.split(text, "\n")).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), text.alias("kept"))
    result = F.when(named(gone).isNull(), whole).otherwise(let(F.split(text, "\n"), kept))
    joined = docs.select(*map(named, own)).join(found, named(id_col).cast("long") == named(key), "left")
    return joined.select(*map(named, own), F.explode(F.array(result)).alias(out_col))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), out_col="d")
    return found.select("doc_id", "d.n_lines", "d.n_dropped", F.sha2("d.kept", 256).alias("kept_sha256"))


ORACLE = {
    "op13_lines": r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, i, lines[i] AS line, translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM t)),
m AS (SELECT *, length(key) >= 10 AND coalesce(doc_id > min(doc_id) OVER (PARTITION BY key), false) AS goes FROM l)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (goes) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
""",
}

QUERIES = {"op13_lines": op13_lines}
