"""Files of marked-up text as a source and a sink."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.parse import dominant_eol, with_eols


def read_files(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(doc_id = path, source binary, sha256, length) of the files below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), F.col("content").alias("source"), F.sha2("content", 256).alias("sha256"), "length")


def read_stream(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """The same as a stream of new files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("doc_id"), F.col("content").alias("source"))


def write_files(documents: DataFrame, root: str, compare: bool = True, preserve_bom: bool = True, eol: str | None = None, follow_symlinks: bool = False, atomic: bool = True, preserve_eol: bool = True) -> DataFrame:
    """Write documents (path relative to root, source, sha256 of the version read or null); (path, state) per document.

    A file is written beside its place and renamed over it; without atomic, in its place.  eol sets all line endings; without
    preserve_eol, and in documents whose endings are mostly not LF, all become the most frequent one.  With compare, a file that changed since it was read is a
    conflict and stays; equal bytes are not written.  root must be a folder that all executors share.
    """
    rows = documents.select("path", F.col("source").cast("binary").alias("source"), F.col("sha256"))
    if eol is None:
        own = dominant_eol(F.col("source"))
        even = with_eols(F.col("source"), own)
        rows = rows.withColumn("source", F.when(F.lit(not preserve_eol) | (own != "\n"), even).otherwise(F.col("source")))
    else:
        rows = rows.withColumn("source", with_eols(F.col("source"), eol))
    if not preserve_bom:
        rows = rows.withColumn("source", F.expr("case when hex(substring(source, 1, 3)) = 'EFBBBF' then substring(source, 4) else source end"))

    def kernel(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            paths, states = batch.column("path").to_pylist(), []
            for path, source, known in zip(paths, batch.column("source").to_pylist(), batch.column("sha256").to_pylist(), strict=True):
                target = os.path.join(root, path)
                if os.path.isabs(path) or ".." in path.split("/") or (os.path.islink(target) and not follow_symlinks):
                    states.append("refused")
                    continue
                target = os.path.realpath(target)
                now = None
                if os.path.exists(target):
                    with open(target, "rb") as f:
                        now = f.read()
                if now == source:
                    states.append("unchanged")
                    continue
                if compare and now is not None and hashlib.sha256(now).hexdigest() != known:
                    states.append("conflict")
                    continue
                os.makedirs(os.path.dirname(target), exist_ok=True)
                if atomic:
                    handle, name = tempfile.mkstemp(dir=os.path.dirname(target))
                    with os.fdopen(handle, "wb") as f:
                        f.write(source)
                    os.replace(name, target)
                else:
                    with open(target, "wb") as f:
                        f.write(source)
                states.append("written")
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(states, pa.string())], ["path", "state"])

    return rows.mapInArrow(kernel, "path string, state string")


def rebased(documents: DataFrame, states: DataFrame) -> DataFrame:
    """documents with the sha256 of what stands in their files now, after write_files() gave states; conflicts keep theirs."""
    done = states.where("state in ('written', 'unchanged')").select("path", F.lit(True).alias("_done"))
    joined = documents.join(done, "path", "left")
    return joined.withColumn("sha256", F.when(F.col("_done"), F.sha2(F.col("source").cast("binary"), 256)).otherwise(F.col("sha256"))).drop("_done")
