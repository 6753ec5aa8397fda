import random
import re
from itertools import permutations

import duckdb
import pytest
from inkwell.llm import filters


def plain(docs, labels):
    """Every order applied filter by filter to the documents that are left."""
    marks = {}
    for i, q, t in labels:
        good, toxic = marks.get(i, (False, False))
        marks[i] = (good or q == 1, toxic or t == 1)
    rows = []
    for doc_id, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = ""
        fails += "A" * (len(words) < 200)
        fails += "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text))
        fails += "D" * bool(re.search(r"[#$%&*|]", text))
        fails += "E" * any((t or "") == text and i is not None and doc_id is not None and i < doc_id for i, t, _ in docs)
        rows.append((source or "", fails, *(marks.get(doc_id, (False, False)) if doc_id is not None else (False, False))))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                failing = sum(f in r[1] for r in own)
                out[part, "".join(order), k] = [len(left), len(gone), failing - len(gone), sum(r[1] == f for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, k), values in out.items():
            if p == part:
                values.append(shapley[order[k - 1]])
    return sorted((*k, *v) for k, v in out.items())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, base = random.Random(3), tmp_path_factory.mktemp("filters")
    words = ["a", "B", "cc", "Dé", "e#", "日本", "ff", "g", "HHH"]
    texts = [" ".join(f"{rng.choice(words)}{rng.randrange(300) if rng.random() < 0.7 else ''}" for _ in range(rng.choice([3, 150, 260]))) for _ in range(60)]
    texts = [rng.choice([t, t.replace("#", ""), t.lower(), "x " * 250, None, ""]) for t in texts]
    docs = [(i, t, rng.choice(["s", "s", "t", None, ""])) for i, t in enumerate(texts + texts[:20])]
    docs += [docs[4], (5, "another text of 5", "s"), (None, texts[0], "t"), (None, texts[0], "t"), (9000, "long " * 50000, "t")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 70, 2)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1), (4444, 1, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base), docs, labels


def test_query_equals_every_order_applied(spark, folder):
    base, docs, labels = folder
    got = filters.op12_filters(spark, base)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == plain(docs, labels)


def test_sql_says_the_same(spark, folder):
    base, docs, labels = folder
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"create view {name} as select * from '{base}/{name}.parquet/*.parquet'")
    assert sorted(con.sql(filters.ORACLE["op12_filters"]).fetchall()) == plain(docs, labels)


def test_first_failures_and_partial_sums():
    assert filters.FIRST.shape == (32, 120)
    for mask in range(32):
        for o, order in enumerate(filters.ORDERS):
            steps = [s for s, f in enumerate(order) if mask >> f & 1]
            assert filters.FIRST[mask, o] == (steps[0] if steps else filters.NEVER)
    counts = filters.np.arange(96).reshape(3, 32)
    assert (filters.partial(counts) + filters.partial(counts * 2) == filters.partial(counts * 3)).all()


def test_many_parts_clashing_columns_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(filters, "PARTS", 3)
    docs = spark.createDataFrame([(i, "one text", f"p{i % 10}", "x", 1) for i in range(40)], "doc_id long, text string, source string, mask string, part int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filters.audit(filters.masked(docs, labels))
    assert got.count() == 6000
    first = got.where("part = 'p0' and filter_order = 'EABCD' and step = 1").first()
    assert (first.kept, first.removed, first.redundant, first.unique_fails, first.shapley) == (1, 3, 0, 0, 180)
    assert filters.audit(filters.masked(docs.limit(0), labels)).count() == 0
