"""Shared pieces of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points of text that one pass of a vectorised kernel looks at.  A longer document makes a pass of its own.
PASS_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the reliable checkpoint folder, read it back, and forget its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the cluster names in spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a local master (tests, a laptop); a cluster without it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="inkwell-checkpoint-"))
    return context.getCheckpointDir()


def cut_table(df: DataFrame) -> DataFrame:
    """As cut(), but as a compressed table in the shared folder; for results of many rows."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows, since one row may hold a very long text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def fresh(taken: list[str], stem: str) -> str:
    """A column name that none of taken clashes with, whatever its case."""
    used = {c.lower() for c in taken}
    name = stem
    while name.lower() in used:
        name += "_"
    return name


def named(column: str) -> Column:
    """The column of exactly that name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def in_passes(texts: list[str | None], limit: int = PASS_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit code points each, in order."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, … for each (start, length), one after the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


class PooledIds:
    """Ids of text segments, remembered per segment in one growing pool; long segments are only kept for the one look-up.

    encode gives the flat ids of a list of segments and how many each has.  The pool starts anew after most segments or
    most_ids ids.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 500_000, longest: int = 64, most_ids: int = 8_000_000):
        self.encode, self.most, self.longest, self.most_ids = encode, most, longest, most_ids
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(4096, np.uint32), 0
        self.count = 0

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Append segments; the place of the first."""
        n, first = len(lengths), self.count
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        if first + n > len(self.start):
            more = np.zeros(max(len(self.start), n), np.int64)
            self.start, self.length = np.concatenate([self.start, more]), np.concatenate([self.length, more])
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.length[first : first + n] = lengths
        self.used += len(ids)
        self.count += n
        return first

    def lookup(self, segments: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all segments, and how many each has."""
        coded = segments.dictionary_encode()
        unique = coded.dictionary.to_pylist()
        if self.count + len(unique) > self.most or self.used > self.most_ids:
            self.clear()
        place = np.fromiter(map(self.known.get, unique, repeat(-1)), np.int64, len(unique))
        missing = np.nonzero(place < 0)[0]
        if len(missing):
            new = [unique[i] for i in missing.tolist()]
            first = self._add(*self.encode(new))
            place[missing] = np.arange(first, first + len(new))
            self.known.update((s, first + i) for i, s in enumerate(new) if len(s) <= self.longest)
        at = place[coded.indices.to_numpy(zero_copy_only=False)] if len(segments) else np.zeros(0, np.int64)
        return self.pool[spread(self.start[at], self.length[at])], self.length[at]


def flattened(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids one after the other, and their lengths."""
    return np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists))


def segments_of(text: str, points: np.ndarray, begins: np.ndarray) -> pa.StringArray:
    """The pieces of text that begin at the given code points, without copying."""
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])
    offsets = np.append(at[begins], at[-1]).astype(np.int32)
    return pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(text.encode()))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)
