import hashlib
import random
import zlib

import pytest
from inkwell.llm import periodic


def plain_runs(w, least=24, exponent=3):
    """All runs by trying every period at every place."""
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            if i > s and length >= max(least, exponent * q) and not any(all(w[k] == w[k + p] for k in range(s, s + length - p)) for p in range(1, q)):
                out.append((s, length, q))
            i = max(i, s + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def hostile(n):
    fib, b = [0], [0, 1]
    while len(b) < n:
        fib, b = b, b + fib
    grow, k = [], 1
    while len(grow) < n:
        grow += [0] * k + [1]
        k += 1
    double, c = [0], 1
    while len(double) < n:
        double, c = double * 3 + [c], (c + 1) % 3
    morse = [i.bit_count() & 1 for i in range(n)]
    return {"one": [0] * n, "fibonacci": b[:n], "growing": grow[:n], "tripled": double[:n], "morse": morse, "down": list(range(n, 0, -1)), "two": [0] * (n // 2) + [1] * (n // 2), "nested": (([0] * 9 + [1]) * 9 + [2]) * (n // 91)}


def some_words(rng):
    w = [rng.randrange(rng.choice([1, 2, 3, 4])) for _ in range(rng.randint(0, 40))]
    if rng.random() < 0.6 and len(w) > 5:
        w = w[: rng.randint(0, 10)] + w[: rng.randint(1, 6)] * rng.randint(3, 7) + w[: rng.randint(0, 9)]
    return w * rng.randint(2, 4) if rng.random() < 0.2 else w


def test_runs_equal_a_plain_search():
    rng = random.Random(4)
    for _ in range(4000):
        w, least = some_words(rng), rng.choice([3, 6, 10])
        want = plain_runs(w, least)
        assert periodic.runs_of(w, least) == want
        assert periodic.text_runs([b"w%d" % x for x in w], least) == want
    for w in hostile(900).values():
        assert periodic.runs_of(w) == plain_runs(w)


def test_next_smaller_suffix_and_match():
    rng = random.Random(9)
    for _ in range(500):
        w = some_words(rng)
        n = len(w)
        after, match, _ = periodic.next_smaller(w)
        for i in range(n):
            j = next((j for j in range(i + 1, n) if w[j:] < w[i:]), n)
            assert after[i] == j
            if j < n:
                assert match[i] == next((k for k in range(n - j) if w[i + k] != w[j + k]), n - j)


@pytest.mark.parametrize("name", hostile(10))
def test_comparisons_grow_with_the_words(name):
    for n in (3000, 30000):
        w = hostile(n)[name]
        assert periodic.next_smaller(w)[2] <= 4 * len(w)
        assert periodic.next_smaller([-x for x in w])[2] <= 4 * len(w)


def expected(doc_id, text):
    """The query's row by the contract, with plain Python and the plain search."""
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_the_contract(spark, tmp_path):
    rng = random.Random(2)
    texts = [" ".join(f"w{x}" for x in some_words(rng) * rng.choice([1, 2])) for _ in range(150)]
    texts += [None, "", " \n\t", "a " * 23, "a " * 24, "x\xa0y " * 30, "é日本 b\x0bc\x0c" * 40, "b a\n" * 3000, " ".join(f"u{i % 700}" for i in range(2500))]
    data = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame([*data, data[3]], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(expected(*d) for d in [*data, data[3]])
    assert any(r.n_runs > 1 for r in got)


def test_ties_clashing_columns_and_empty_tables(spark):
    text = "a b " * 12 + "x " + "c d " * 12
    df = spark.createDataFrame([(1, text, "old", "a"), (None, None, "old", None)], "doc_id long, text string, runs string, `a.b` string")
    got = {r.doc_id: r for r in periodic.periodic(df).withColumn("best", periodic.strongest(periodic.F.col("runs"))).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 24, 2), (25, 24, 2)] and tuple(got[1].best) == (0, 24, 2)
    assert got[1].collapsed == "a b x c d" and got[1]["a.b"] == "a" and got[1].text == text
    assert got[None].runs == [] and got[None].collapsed == "" and got[None].best is None
    assert periodic.periodic(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic(df, exponent=2)
