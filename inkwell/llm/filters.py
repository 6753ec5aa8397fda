"""Filter interaction audit: what each filter removes, alone and in every order.

Every document gets a mask of the filters it fails.  A table of 32 masks by 120 orders, made once, holds the step at
which an order first meets a failed filter.  Inside tasks masks are counted by part and label, looked up in the table,
and removals per part, order and step are summed with np.bincount; a task yields one small array a part, and the arrays
are added up.

The filters are few words, few distinct words, capitals, symbols, and exact copies of a document of smaller id.  A copy
is told by the SHA-256 of the text.  The first holder of each text comes from a grouped minimum, which combines before
the shuffle, and rows meet it by text and id together, so a text that a third of all rows share is no hot key.

Defined cases: null text is empty, which only few words, or a copy of another empty text, can fail; a null part is the
empty string; rows with a null id have no labels, are no copies and have none; rows of one id and text are no copies of
each other; of several labels of an id the highest holds; very long texts are read whole; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import cut_table, named, small_batches, table

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SYMBOLS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
ORDERS = list(permutations(range(len(FILTERS))))
STEPS, NEVER = len(FILTERS), len(FILTERS)
#: The step, from 0, at which an order first meets a filter that a mask fails; NEVER if it fails none.
FIRST = np.array([[next((s for s, f in enumerate(order) if mask >> f & 1), NEVER) for order in ORDERS] for mask in range(1 << len(FILTERS))])
#: Parts that a task counts before it yields.
PARTS = 1 << 12
MASKED = "id bigint, part string, mask int, key binary"
LABELS = ("all", "good", "toxic")


def failed(text: str | None) -> int:
    """Mask of the filters A to D that a text fails."""
    data = (text or "").encode()
    words = data.split()
    capitals = len(data) - len(data.translate(None, CAPITALS))
    fails = (len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words), 100 * capitals > MOST_CAPITALS * len(text or ""), SYMBOLS.search(data) is not None)
    return sum(1 << i for i, x in enumerate(fails) if x)


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        masks = pa.array([failed(t) for t in texts], pa.int32())
        keys = pa.array([sha256((t or "").encode()).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), masks, keys], ["id", "part", "mask", "key"])


def masked(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask of five filters, good, toxic) per row of docs."""
    small_batches(docs.sparkSession)
    picked = docs.select(named(id_col).cast("long").alias("id"), F.coalesce(named(part_col).cast("string"), F.lit("")).alias("part"), named(text_col).cast("string").alias("text"))
    rows = cut_table(picked.mapInArrow(_masks, MASKED))
    firsts = rows.where("id is not null").groupBy("key").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    told = rows.where("id is not null").join(firsts, ["key", "id"], "left").join(known, "id", "left")
    of = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    copy = F.when(F.col("first").isNull(), F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    nameless = rows.where("id is null").select("id", "part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return told.select("id", "part", F.col("mask").bitwiseOR(copy).alias("mask"), of("good"), of("toxic")).unionByName(nameless)


def tallies(counts: np.ndarray) -> np.ndarray:
    """[labels, orders, steps] removals from [labels, masks] counts."""
    cell = np.arange(len(ORDERS)) * (STEPS + 1) + FIRST
    out = [np.bincount(cell.ravel(), np.repeat(c, len(ORDERS)), len(ORDERS) * (STEPS + 1)) for c in counts.astype(np.float64)]
    return np.array(out).reshape(len(counts), len(ORDERS), STEPS + 1)[:, :, :STEPS].astype(np.int64)


def partial(counts: np.ndarray) -> np.ndarray:
    """One flat array of all sums: removals by label, order and step, then rows, then failures and sole failures by filter."""
    masks = np.arange(counts.shape[1])
    fails = [counts[0, masks >> f & 1 == 1].sum() for f in range(STEPS)]
    alone = [counts[0, 1 << f] for f in range(STEPS)]
    return np.concatenate([tallies(counts).ravel(), [counts[0].sum()], fails, alone])


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, mask, good, toxic) to (part, sums): a row a part and task, or a few where a task meets very many parts."""
    held: dict[str, np.ndarray] = {}

    def sums() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([partial(c) for c in held.values()], pa.list_(pa.int64()))], ["part", "sums"])
        held.clear()
        return out

    for batch in batches:
        coded = batch.column("part").dictionary_encode()
        names, mask = coded.dictionary.to_pylist(), batch.column("mask").to_numpy()
        cell = coded.indices.to_numpy() * len(FIRST) + mask
        size = len(names) * len(FIRST)
        marks = (None, *(batch.column(c).to_numpy(zero_copy_only=False) for c in LABELS[1:]))
        counts = np.stack([np.bincount(cell, m, size) for m in marks]).astype(np.int64).reshape(len(LABELS), len(names), -1)
        for i, name in enumerate(names):
            held[name] = held[name] + counts[:, i] if name in held else counts[:, i]
            if len(held) >= PARTS:
                yield sums()
    if held:
        yield sums()


def audit(rows: DataFrame) -> DataFrame:
    """Per part, order and step of rows (part, mask, good, toxic): what the step removes, keeps, loses, and its filter's sums."""
    each = rows.select("part", "mask", *LABELS[1:]).mapInArrow(_tallied, "part string, sums array<bigint>")
    cells = len(ORDERS) * STEPS
    summed = each.select("part", F.posexplode("sums").alias("place", "n")).groupBy("part", "place").agg(F.sum("n").alias("n"))
    # Places become (label, order, step) for removals; the rest are a part's own sums.
    place = F.col("place")
    removed = summed.where(place < len(LABELS) * cells).groupBy("part", (place % cells).alias("cell"))
    removed = removed.agg(*[F.sum(F.when(F.floor(place / cells) == k, F.col("n"))).alias(c) for k, c in enumerate(LABELS)])
    whole = summed.where(place >= len(LABELS) * cells).groupBy("part").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("s")).select("part", F.col("s.n").alias("whole"))
    names = F.array(*[F.lit("".join(FILTERS[f] for f in order)) for order in ORDERS])
    step = (F.col("cell") % STEPS + 1).cast("int")
    rows = removed.join(whole, "part").select("part", F.get(names, F.floor(F.col("cell") / STEPS).cast("int")).alias("filter_order"), step.alias("step"), *LABELS, "whole")
    rows = rows.withColumn("filter", F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    which = F.instr(F.lit(FILTERS), F.col("filter"))
    until = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "part", "filter_order", "step", "filter",
        (F.get("whole", F.lit(0)) - F.sum("all").over(until)).alias("kept"), F.col("all").alias("removed"), (F.get("whole", which) - F.col("all")).alias("redundant"),
        F.get("whole", which + STEPS).alias("unique_fails"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"),
        F.sum("all").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(masked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))).drop("filter")


ORACLE = {
    "op12_filters": r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
     'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)} AS f
  FROM w LEFT JOIN l USING (doc_id)),
fails AS (SELECT part, good, toxic, concat(CASE WHEN f.A THEN 'A' ELSE '' END, CASE WHEN f.B THEN 'B' ELSE '' END, CASE WHEN f.C THEN 'C' ELSE '' END,
    CASE WHEN f.D THEN 'D' ELSE '' END, CASE WHEN f.E THEN 'E' ELSE '' END) AS fs, count(*) AS n FROM m GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a JOIN letters b ON a.x <> b.x JOIN letters c ON c.x NOT IN (a.x, b.x)
  JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, CAST(s AS INT) AS step, filter_order[s] AS x, filter_order[1:s - 1] AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
sums AS (
  SELECT part, filter_order, step, x, sum(n) AS total,
    coalesce(sum(n) FILTER (contains(fs, x) AND translate(fs, earlier, '') = fs), 0) AS removed,
    coalesce(sum(n) FILTER (contains(fs, x) AND translate(fs, earlier, '') <> fs), 0) AS redundant,
    coalesce(sum(n) FILTER (fs = x), 0) AS unique_fails,
    coalesce(sum(n) FILTER (good AND contains(fs, x) AND translate(fs, earlier, '') = fs), 0) AS good_lost,
    coalesce(sum(n) FILTER (toxic AND contains(fs, x) AND translate(fs, earlier, '') = fs), 0) AS toxic_lost
  FROM fails, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(total - sum(removed) OVER (PARTITION BY part, filter_order ORDER BY step) AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM sums
""",
}

QUERIES = {"op12_filters": op12_filters}
