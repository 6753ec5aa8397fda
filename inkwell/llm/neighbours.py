"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted in a task on a sample of SAMPLE to MOST vectors, a third of all rows in between (those of least hashed
id); every row goes down it to a leaf.  A query visits leaves best bin first: a priority queue holds tree nodes by the
inner product with their centroid, the best is taken out, inner nodes put their children in, leaves are visited.  How many
leaves a query visits is calibrated: PROBES bounded probe queries are searched exactly over all rows, and the visits widen
until the leaves hold RECALL of the true neighbours.  A query whose leaves hold fewer than K other rows so far goes on to
further leaves.

Neighbouring leaves make bins of about CHUNK rows.  A query's vector goes once to each bin it visits, with the names of
the leaves there, and a bin returns the query's K best in one row.  A leaf of more rows is a bin of its own in several
chunks, and the queries of a bin are dealt in chunks too, so a vector shared by a third of all rows makes more chunks, not
a larger task.  Shortlists use matrix products; final scores are summed in one fixed order, so equal vectors tie exactly.

How many rows a query has to visit depends on the data: where vectors have no clusters (equally likely directions in many
dimensions) leaves tell little about neighbours, and the calibration comes out at about half of all rows.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, as query or
candidate; vectors of different lengths don't meet, each length is searched by itself; rows with a null id take no part;
repeated rows (same id and vector) are one candidate and one query; rows of one id with different vectors are queries and
candidates each, but don't meet one another; ties go to the smaller id; with fewer than K candidates all are returned;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import cut, named, table

K = 20
SAMPLE, MOST = 16_384, 131_072
#: Bytes of the sample in double precision, which bound it where vectors are wide.
SAMPLE_BYTES = 256 << 20
BRANCH = 8
LEAF = 64
PROBES = 128
RECALL = 0.97
CHUNK = 4096


class Tree:
    """Centroids by level order; children[i] is empty for leaves, which are numbered in leaf_of."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 7):
        self.centroids: list[np.ndarray] = [sample.mean(axis=0)]
        self.children: list[list[int]] = [[]]
        rng = np.random.default_rng(seed)
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, own = todo.pop()
            if len(own) <= leaf:
                continue
            label = self.grouped(sample[own], branch, rng)
            names = np.unique(label)
            if len(names) < 2:  # equal vectors
                continue
            for name in names:
                part = own[label == name]
                self.children[node].append(len(self.centroids))
                self.centroids.append(sample[part].mean(axis=0))
                self.children.append([])
                todo.append((len(self.centroids) - 1, part))
        self.centres = np.array(self.centroids)
        self.leaf_of = {n: i for i, n in enumerate(n for n, c in enumerate(self.children) if not c)}

    @staticmethod
    def grouped(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
        centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
        label = np.zeros(len(x), np.int64)
        for i in range(rounds):
            new = ((centre * centre).sum(axis=1) / 2 - x @ centre.T).argmin(axis=1)
            if i and (new == label).all():
                break
            label = new
            for j in np.unique(label):
                centre[j] = x[label == j].mean(axis=0)
        return label

    def assigned(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of x."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            kids = self.children[node]
            if not kids:
                out[own] = self.leaf_of[node]
                continue
            centre = self.centres[kids]
            best = ((centre * centre).sum(axis=1) / 2 - x[own] @ centre.T).argmin(axis=1)
            todo += [(kids[j], own[best == j]) for j in np.unique(best)]
        return out

    def visits(self, query: np.ndarray, most: int, filled: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first leaves that best-bin-first comes to, further ones until they hold the least number of rows; filled has the rows a leaf."""
        worth = (self.centres * query).sum(axis=1)
        heap, out, met = [(0.0, 0)], [], 0
        while heap and (len(out) < most or met < least):
            _, node = heapq.heappop(heap)
            if kids := self.children[node]:
                for kid in kids:
                    heapq.heappush(heap, (-float(worth[kid]), kid))
            else:
                out.append(self.leaf_of[node])
                met += filled.get(out[-1], 0) if filled else 0
        return out


def in_order(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with query, each summed from the first component to the last."""
    return np.cumsum(x * query, axis=1)[:, -1]


def best(x: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, rough: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k nearest rows, ties to the smaller id; rough holds the products up to rounding."""
    near = np.nonzero(ids != own)[0]
    if len(near) > k:
        least = np.partition(rough[near], len(near) - k)[len(near) - k]
        near = near[rough[near] >= least - 1e-9 * (1 + abs(least))]
    score = in_order(x[near], query)
    order = np.lexsort((ids[near], -score))[:k]
    return ids[near][order], score[order]


def matrix(column: pa.ListArray) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part; v keeps single precision where vectors have it."""
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    rows = vectors.select(named(id_col).cast("long").alias("id"), named(vector_col).cast("array<float>" if single else "array<double>").alias("v")).where("id is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine)


def fitted(rows: DataFrame, size: int) -> Tree | None:
    """The tree of the size rows of least hashed id, fitted in a task; None without rows."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [matrix(b.column(0)) for b in batches if b.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Tree(np.concatenate(parts)))], pa.binary())], ["tree"])

    found = rows.orderBy(F.xxhash64("id"), "id", "v").limit(size).select("v").coalesce(1).mapInArrow(kernel, "tree binary").collect()  # MOST / LEAF * 2 nodes or so
    return pickle.loads(found[0].tree) if found else None


def exact(rows: DataFrame, queries: list[tuple[int, list[float]]], tree: Tree, k: int = K) -> DataFrame:
    """(query, id, score, leaf) of the k best rows of every task's part of rows, for a bounded list of queries."""
    shared = rows.sparkSession.sparkContext.broadcast((queries, tree))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, tree = shared.value
        owns, ask = [q for q, _ in queries], np.array([v for _, v in queries])
        held_ids, held = np.zeros(0, np.int64), np.zeros((0, ask.shape[1]))
        for batch in batches:
            ids, x = np.concatenate([held_ids, batch.column(0).to_numpy()]), np.concatenate([held, matrix(batch.column(1))])
            rough = x @ ask.T
            keep = np.unique(np.concatenate([np.nonzero(np.isin(ids, best(x, ids, q, own, rough[:, j], k)[0]))[0] for j, (own, q) in enumerate(zip(owns, ask, strict=True))]))
            held_ids, held = ids[keep], x[keep]
        if len(held_ids):
            leaf, rough = tree.assigned(held), held @ ask.T
            for j, (own, q) in enumerate(zip(owns, ask, strict=True)):
                found, score = best(held, held_ids, q, own, rough[:, j], k)
                order = np.argsort(held_ids, kind="stable")
                own_leaf = leaf[order[np.searchsorted(held_ids[order], found)]]
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(found), pa.int64()), pa.array(found), pa.array(score), pa.array(own_leaf)], ["query", "id", "score", "leaf"])

    return rows.mapInArrow(kernel, "query long, id long, score double, leaf int")


def calibrated(tree: Tree, rows: DataFrame, probes: list[tuple[int, list[float]]], recall: float = RECALL, k: int = K) -> int:
    """Leaves to visit so that the probes' true neighbours are found with the recall asked for."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    near = exact(rows, probes, tree, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "leaf").collect()  # PROBES * K rows
    place = {q: {leaf: i for i, leaf in enumerate(tree.visits(np.array(v), len(tree.leaf_of)))} for q, v in probes}
    needed = sorted(place[r.query][r.leaf] + 1 for r in near) or [1]
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]


def bins(tree: Tree, filled: dict[int, int], chunk: int = CHUNK) -> list[tuple[int, int, int]]:
    """(leaf, bin, chunks of the bin): leaves that neighbour in the tree share a bin of about chunk rows."""
    order, todo = [], [0]
    while todo:
        node = todo.pop()
        if node in tree.leaf_of:
            order.append(tree.leaf_of[node])
        todo += reversed(tree.children[node])
    out, number, held = [], 0, 0
    for leaf in order:
        rows = filled.get(leaf, 0)
        if held and held + rows > chunk:
            number, held = number + 1, 0
        out.append((leaf, number, max(1, -(-rows // chunk))))
        held += rows
    return out


def compared(own: pa.Table, queries: pa.Table, k: int = K, run: int = 256) -> pa.Table:
    """The k best rows of own (id, leaf, v) for each of queries (query_id, q_key, q, leaves), among the leaves it visits."""
    ids, x = own.column("id").to_numpy(), matrix(own.column("v").combine_chunks())
    names, leaf = np.unique(own.column("leaf").to_numpy(), return_inverse=True)
    asks, q = queries.column("query_id").to_numpy(), matrix(queries.column("q").combine_chunks())
    lists = queries.column("leaves").combine_chunks()
    flat = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(asks)), np.diff(lists.offsets.to_numpy()))
    at = np.minimum(np.searchsorted(names, flat), max(0, len(names) - 1))
    visited = np.zeros((len(asks), max(1, len(names))), bool)
    if len(names):
        met = names[at] == flat
        visited[row[met], at[met]] = True
    out_ids, out_scores = [], []
    for i in range(0, len(asks) if len(ids) else 0, run):
        rough = q[i : i + run] @ x.T
        rough[~visited[i : i + run][:, leaf] | (ids == asks[i : i + run, None])] = -np.inf
        for j, worth in enumerate(rough):
            found, score = best(x[near], ids[near], q[i + j], asks[i + j], worth[near], k) if len(near := np.nonzero(worth > -np.inf)[0] if len(worth) <= k else shortlist(worth, k)) else (ids[:0], np.zeros(0))
            out_ids.append(found)
            out_scores.append(score)
    n = len(out_ids)
    return pa.table({"query_id": pa.array(asks[:n]), "q_key": queries.column("q_key")[:n], "ids": pa.array(out_ids, pa.list_(pa.int64())), "scores": pa.array(out_scores, pa.list_(pa.float64()))})


def shortlist(worth: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values, and of those that rounding can't tell from them; never those at minus infinity."""
    least = np.partition(worth, len(worth) - k)[len(worth) - k]
    return np.nonzero((worth > -np.inf) & (worth >= (least - 1e-9 * (1 + abs(least)) if least > -np.inf else least)))[0]


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, id_col, score) of the k nearest rows found for every row where is_query holds for id."""
    rows = usable(vectors, id_col, vector_col).dropDuplicates(["id", "v"])
    counts = rows.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()  # a row a vector length
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    for n, count in counts:
        part = found_of_length(rows.where(F.size("v") == n), n, count, is_query, k, recall)
        found = found.unionByName(part) if part is not None and len(counts) > 1 else found if part is None else part
    return found.withColumnRenamed("id", id_col)


def sample_size(count: int, width: int) -> int:
    """Rows to fit the tree on: a third of all, within SAMPLE to MOST and SAMPLE_BYTES."""
    return max(1, min(MOST, max(SAMPLE, count // 3), SAMPLE_BYTES // (8 * width)))


def found_of_length(rows: DataFrame, width: int, count: int, is_query, k: int, recall: float) -> DataFrame | None:
    """nearest() for rows (id, v) of one vector length; None without queries."""
    spark = rows.sparkSession
    probes = [(r.id, r.v) for r in rows.where(is_query).orderBy(F.xxhash64("id", F.lit(1)), "id", "v").limit(PROBES).collect()]
    tree = fitted(rows, sample_size(count, width)) if probes else None
    if tree is None:
        return None
    most = calibrated(tree, rows, probes, recall, k)
    vector = rows.schema["v"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(tree)

    def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.assigned(matrix(batch.column(1)))), *batch.columns], ["leaf", "id", "v"])

    kept = cut(rows.mapInArrow(to_leaf, f"leaf int, id long, v {vector}"))
    filled = {r.leaf: r["count"] for r in kept.groupBy("leaf").count().collect()}  # a row a leaf
    placed = bins(tree, filled, CHUNK)
    bin_of = spark.sparkContext.broadcast(dict((leaf, number) for leaf, number, _ in placed))

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2).to_pylist()  # rows of the query's id, no candidates
            number, leaves, at = [], [], []
            for i, (q, n) in enumerate(zip(matrix(batch.column(1)), own, strict=True)):
                by_bin: dict[int, list[int]] = {}
                for leaf in shared.value.visits(q, most, filled, k + n):
                    by_bin.setdefault(bin_of.value[leaf], []).append(leaf)
                number += by_bin
                leaves += by_bin.values()
                at += [i] * len(by_bin)
            place = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(leaves, pa.list_(pa.int32())), batch.column(0).take(place), batch.column(1).take(place)], ["bin", "leaves", "query_id", "q"])

    asked = rows.where(is_query).withColumn("own", F.count(F.lit(1)).over(Window.partitionBy("id")))
    visits = cut(asked.mapInArrow(to_bins, f"bin int, leaves array<int>, query_id long, q {vector}")).withColumn("q_key", F.xxhash64("q"))
    query_parts = visits.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("int").alias("query_parts"))
    local = spark.createDataFrame(placed, "leaf int, bin int, row_parts int")  # a row a leaf
    sizes = F.broadcast(cut(local.join(query_parts, "bin")))
    by_bin = F.broadcast(sizes.select("bin", "row_parts", "query_parts").groupBy("bin").agg(F.max("row_parts").alias("row_parts"), F.max("query_parts").alias("query_parts")))
    piece = lambda key, n: F.pmod(F.xxhash64(key), F.col(n).cast("long")).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["bin", "a", "b"]
    left = kept.join(sizes, "leaf").withColumn("a", piece("id", "row_parts")).withColumn("b", all_of("query_parts")).select(*keys, "leaf", "id", "v")
    right = visits.join(by_bin, "bin").withColumn("b", piece("query_id", "query_parts")).withColumn("a", all_of("row_parts")).select(*keys, "query_id", "q_key", "q", "leaves")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda own, queries: compared(own, queries, k), "query_id long, q_key long, ids array<long>, scores array<double>")
    pairs = F.transform(F.arrays_zip("ids", "scores"), lambda p: F.struct((-p["scores"]).alias("s"), p["ids"].alias("id")))
    ranked = found.select("query_id", "q_key", pairs.alias("p")).groupBy("query_id", "q_key").agg(F.slice(F.sort_array(F.flatten(F.collect_list("p"))), 1, k).alias("p"))
    each = ranked.select("query_id", F.posexplode("p").alias("at", "p"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("p.id").alias("id"), (-F.col("p.s")).alias("score"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


QUERIES = {"op8_neighbours": op8_neighbours}
