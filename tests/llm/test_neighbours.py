import numpy as np
from inkwell.llm import neighbours
from pyspark.sql import functions as F


def brute(ids, x, k=20):
    out = {}
    for i in range(len(ids)):
        if ids[i] % 20 == 0:
            score = np.cumsum(x * x[i], axis=1)[:, -1]
            order = np.lexsort((ids, -score))
            out[ids[i]] = [(int(ids[j]), score[j]) for j in order if j != i][:k]
    return out


def test_recall_and_scores(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    want = brute(ids, x)
    got = {}
    for r in neighbours.op8_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert sorted(got) == sorted(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    for q, own in got.items():
        assert own == sorted(own, key=lambda p: (-p[1], p[0]))
        assert np.allclose([s for _, s in own], [x[ids == i][0] @ x[ids == q][0] for i, _ in own], rtol=0, atol=1e-12)


def test_hot_vector_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 8))
    x[:400] = x[0]
    data = [(i, [float(v) for v in x[i]], i) for i in range(900)]
    odd = [(920, None, 0), (940, [0.0] * 8, 0), (960, [float("nan")] + [1.0] * 7, 0), (980, [float("inf")] * 8, 0), (1000, [None] + [1.0] * 7, 0), (None, [1.0] * 8, 0), (1020, [1.0], 0), (1040, [], 0)]
    df = spark.createDataFrame(data + odd + data[:5], "vec_id long, embedding array<float>, id int").repartition(3)
    chunk, neighbours.CHUNK = neighbours.CHUNK, 50
    try:
        got = {}
        for r in neighbours.nearest(df, F.col("id") % 20 == 0, recall=1.0).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
    finally:
        neighbours.CHUNK = chunk
    x = x.astype(np.float32).astype(np.float64)
    want = brute(np.arange(900), x)
    assert sorted(got) == sorted(want)
    same = sum(got[q] == [i for i, _ in want[q]] for q in want)
    assert same >= 0.95 * len(want)
    assert got[0] == [i for i, _ in want[0]]


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0]), (20, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, neighbours.nearest(df, F.col("id") % 20 == 0).collect()))
    assert got == [(0, 1, 1, 5.0), (0, 2, 20, 1.5), (20, 1, 1, 2.0), (20, 2, 0, 1.5)]
    assert neighbours.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert neighbours.nearest(df.where("vec_id = 1"), F.col("id") % 20 == 0).count() == 0


def test_visits_cover_all_leaves():
    x = np.random.default_rng(1).normal(size=(2000, 6))
    tree = neighbours.Tree(x)
    leaves = tree.visits(x[0], 10**6)
    assert sorted(leaves) == list(range(len(tree.leaf_of)))
    assert set(tree.assigned(x)) <= set(leaves)


def test_sparse_leaves_and_ids_of_several_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    x[::20] *= 1000  # far from all others, alone in their leaves
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(400)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("id") % 20 == 0, recall=0.01).groupBy("query_id").count().collect()
    assert len(got) == 20 and all(r["count"] == neighbours.K for r in got)
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [1.0, 1.0]), (20, [0.5, 0.5]), (20, [2.0, 2.0]), (1, [1.0, 1.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, df.schema), F.col("id") % 20 == 0).collect()
    want = [(0, 1, 20, 6.0), (0, 2, 1, 5.0), (0, 3, 1, 3.0), (0, 4, 20, 1.5), (20, 1, 1, 2.0), (20, 1, 1, 8.0), (20, 2, 0, 1.5), (20, 2, 0, 6.0), (20, 3, 1, 1.0), (20, 3, 1, 4.0)]
    assert sorted(map(tuple, got)) == want


def test_lengths_are_searched_apart(spark):
    rng = np.random.default_rng(5)
    long, short = rng.normal(size=(300, 6)), rng.normal(size=(300, 3))
    rows = [(i, [float(v) for v in (long if i % 2 else short)[i // 2]], "x") for i in range(600)] + [(1000, [float(v) for v in long[0]], "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string")
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 20 == 0, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(np.arange(0, 600, 2), short) | {1000: [i for i, _ in brute(np.append(np.arange(1, 600, 2), 1000), np.vstack([long, long[:1]]))[1000]]}
    want = {q: [i[0] if isinstance(i, tuple) else i for i in own] for q, own in want.items()}
    assert sorted(got) == sorted(want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.95 * sum(map(len, want.values()))


def test_bins_hold_whole_leaves_in_tree_order():
    tree = neighbours.Tree(np.random.default_rng(1).normal(size=(3000, 6)))
    filled = {leaf: 10 + leaf % 50 for leaf in tree.leaf_of.values()} | {0: 900}
    placed = neighbours.bins(tree, filled, 200)
    assert sorted(leaf for leaf, _, _ in placed) == sorted(tree.leaf_of.values())
    held = {}
    for leaf, number, chunks in placed:
        held.setdefault(number, []).append(leaf)
        assert chunks == (5 if leaf == 0 else 1)
    assert all(sum(filled[x] for x in own) <= 200 or own == [0] for own in held.values())


def test_the_sample_is_bounded_by_rows_and_bytes():
    assert neighbours.sample_size(100, 64) == neighbours.SAMPLE and neighbours.sample_size(10**9, 64) == neighbours.MOST
    assert neighbours.sample_size(90_000, 64) == 30_000
    assert neighbours.sample_size(10**9, 4096) * 4096 * 8 <= neighbours.SAMPLE_BYTES and neighbours.sample_size(10, 10**9) == 1
