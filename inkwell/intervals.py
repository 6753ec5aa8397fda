"""Rows and ranges of a document by sorted sweeps: no row is joined with every range of its document.

Ranges are rows (doc_id, a, b), half open.  A sweep orders rows and ranges by place and carries what it has met so far, so
n rows and m ranges of a document cost (n + m) log (n + m), as windows that may spill.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _swept(rows: DataFrame, ranges: DataFrame, at: Column, ranges_first: bool, carried: Column) -> DataFrame:
    """rows with _met: carried over the ranges that begin before at (or there, with ranges_first)."""
    order = F.lit(0 if ranges_first else 1)
    every = rows.withColumn("_at", at).withColumn("_turn", F.lit(1) - order).withColumn("_a", F.lit(None).cast("int")).withColumn("_b", F.lit(None).cast("int"))
    own = ranges.select("doc_id", F.col("a").alias("_at"), order.alias("_turn"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    before = Window.partitionBy("doc_id").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = every.unionByName(own, allowMissingColumns=True).withColumn("_met", carried.over(before))
    return met.where("_a is null").drop("_at", "_turn", "_a", "_b")


def apart(rows: DataFrame, ranges: DataFrame, start: Column, end: Column) -> DataFrame:
    """rows whose stretch start to end meets none of ranges: the furthest end of those that begin before its end lies not beyond its start."""
    met = _swept(rows, ranges, end, False, F.max("_b"))
    return met.where(F.coalesce(F.col("_met") <= start, F.lit(True))).drop("_met")


def beyond(rows: DataFrame, ranges: DataFrame, start: Column, end: Column) -> DataFrame:
    """rows whose stretch start to end lies within none of ranges."""
    met = _swept(rows, ranges, start, True, F.max("_b"))
    return met.where(F.coalesce(F.col("_met") < end, F.lit(True))).drop("_met")


def within(rows: DataFrame, ranges: DataFrame, start: Column, end: Column) -> DataFrame:
    """rows whose stretch lies within the last of disjoint ranges that begins at or before it, with that range's a and b."""
    met = _swept(rows, ranges, start, True, F.last(F.when(F.col("_a").isNotNull(), F.struct("_a", "_b")), ignorenulls=True))
    return met.where(end <= F.col("_met._b")).withColumn("a", F.col("_met._a")).withColumn("b", F.col("_met._b")).drop("_met")


def innermost(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, start, end, block_pre, block_kind): the smallest block around each distinct range of ranges.

    Blocks of a document nest, so one walk over their sorted starts keeps the open ones on a stack; a range asks the stack
    from its top.  Ranges that no block holds are left out.
    """
    own = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "pre", "end", "kind"))).alias("b"))
    asked = ranges.select("doc_id", "start", "end").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("r"))
    schema = f"doc_id {blocks.schema['doc_id'].dataType.simpleString()}, start int, end int, block_pre int, block_kind string"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, (held, wanted) in enumerate(zip(batch.column("b").to_pylist(), batch.column("r").to_pylist(), strict=True)):
                stack: list[dict] = []
                starts, k = [x["start"] for x in held], 0
                for r in wanted:
                    upto = bisect_right(starts, r["start"], k)
                    for x in held[k:upto]:
                        while stack and stack[-1]["end"] <= x["start"] and stack[-1]["end"] < x["end"]:
                            stack.pop()
                        stack.append(x)
                    k = upto
                    found = next((x for x in reversed(stack) if x["end"] >= r["end"]), None)
                    if found:
                        out.append((row, r["start"], r["end"], found["pre"], found["kind"]))
            ids = batch.column("doc_id").take(pa.array([o[0] for o in out], pa.int64()))
            types = (pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([o[i] for o in out], t) for i, t in enumerate(types, 1))], ["doc_id", "start", "end", "block_pre", "block_kind"])

    return own.join(asked, "doc_id").select("doc_id", "b", "r").mapInArrow(kernel, schema)
