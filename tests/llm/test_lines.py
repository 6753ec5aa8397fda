import hashlib
import random

import duckdb
import pytest
from inkwell.llm import lines
from inkwell.llm.common import cut_table

LOW = str.maketrans(lines.UPPER, lines.LOWER)


def plain(docs, least=10):
    first = {}
    keys = lambda t: [x.strip(lines.BLANKS).translate(LOW) for x in (t or "").split("\n")]
    for i, t in docs:
        for k in keys(t) if i is not None else ():
            first[k] = min(i, first.get(k, i))
    out = []
    for i, t in docs:
        own = (t or "").split("\n")
        kept = [x for x, k in zip(own, keys(t), strict=True) if len(k) < least or i is None or first[k] >= i]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def some_docs():
    rng = random.Random(8)
    pool = [f"{rng.choice(['Line', 'LINE ', 'ünïcode ÄÖ', '日本語のとても長い行です'])} number {rng.randrange(60)}" for _ in range(80)] + ["short", "", "  ", "exactly 10", "nine char"]
    blank = ["", " ", "\t", "\x0b", "\x0c", "\r", "\xa0"]
    line = lambda: rng.choice(blank) + rng.choice([str.upper, str.lower, str])(rng.choice(pool)) + rng.choice(blank)
    docs = [(rng.randrange(300), "\n".join(line() for _ in range(rng.choice([0, 1, 3, 20])))) for _ in range(150)]
    docs += [(400 + i, "A line that a third of all documents hold\nown line %d of its document" % i) for i in range(80)]
    return [*docs, docs[3], (None, docs[0][1]), (None, docs[0][1]), (7, None), (8, ""), (9, "\n\n"), (999, "the long line repeats here\n" * 4000), (1000, "x" * 300_000)]


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_equals_a_plain_version(spark, batches):
    df = spark.createDataFrame(some_docs(), "doc_id long, text string").repartition(3)
    got = lines.deduplicated(df, out_col="d", batches=batches).select("doc_id", "d.n_lines", "d.n_dropped", lines.F.sha2("d.kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == plain(some_docs())


def test_sql_says_the_same(spark, tmp_path):
    spark.createDataFrame(some_docs(), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = plain(some_docs())
    assert sorted(con.sql(lines.ORACLE["op13_lines"]).fetchall(), key=str) == want
    got = lines.op13_lines(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert "Python" not in got._jdf.queryExecution().toString()


def test_runs_are_disjoint_and_merged(spark):
    rng = random.Random(1)
    runs, seen = lines.Runs(spark, buckets=3, fan=2), set()
    for b in range(5):
        hashes = {(rng.randrange(40), 0) for _ in range(25)}
        batch = spark.createDataFrame([(100 * b + i, *x) for i, x in enumerate(hashes)], "id long, h long, g long")
        gone = {(r.h, r.g) for r in lines.added(runs, batch).collect()}
        assert gone == hashes & seen
        seen |= hashes
        held = [(r.h, r.g) for name in runs.all() for r in spark.table(name).collect()]
        assert len(held) == len(set(held)) and set(held) == seen
        assert [len(v) for _, v in sorted(runs.levels.items())] == [1] * (b + 1).bit_count()
    plan = runs.met(cut_table(batch.select("h", "g")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 + plan.count("BroadcastExchange"), "runs are not shuffled"
    names = runs.all()
    runs.forget()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_clashing_columns_and_empty_tables(spark):
    text = "a line of some length\nown line"
    df = spark.createDataFrame([(1, text, "c1"), (2, text, "c2")], "doc_id long, text string, gone string").withColumn("a.b", lines.F.lit(1))
    got = lines.deduplicated(df).orderBy("doc_id").collect()
    assert [(r.gone, r["a.b"], r.deduplicated.kept) for r in got] == [("c1", 1, text), ("c2", 1, "own line")]
    assert lines.deduplicated(df.limit(0)).count() == 0
