import random
import re

import numpy as np
import pytest
import xxhash
from inkwell.llm import simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(prints):
    ids = sorted(prints)
    comp = {i: i for i in ids}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in ids:
        for j in ids:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_matches_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}É" for i in range(60)] + ["The", "of", "AND"]
    texts = [" ".join(rng.choices(vocab, k=rng.choice([1, 2, 3, 5, 40, 300]))) for _ in range(120)]
    texts += [t + " extra" for t in texts[:60]] + texts[:20] + [None, "", " \n\t", "a\x0bb\nc"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "again"), (None, texts[5], "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    prints = {i: plain(t) for i, t in enumerate(texts)}
    want = reach(prints)
    for row in got:
        if row.doc_id is None:
            assert row.component_id is None
            continue
        assert row.fp & 0xFFFFFFFFFFFFFFFF == prints[row.doc_id]
        assert row.component_id == want[row.doc_id]


def test_chunked_bucket_keeps_every_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 12)
    values = {int(b) for b in base}
    for b in base:
        values |= {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for i, j in rng.integers(0, 62, (40, 2))}
    values = sorted(values)
    df = spark.createDataFrame(list(zip(values, range(len(values)), strict=True)), "fp long, id long")
    found = {r.node: r.component for r in simhash.components(simhash.links(df, bucket=8)).collect()}
    want = reach(dict(enumerate(values)))
    assert all(found.get(i, i) == want[i] for i in want)


def test_planes_counters_and_abandoning():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    values[1::3] = values[::3] ^ np.uint64(0b10100100)
    values[2::3] = values[::3] ^ np.uint64(0b1111)
    sizes = np.array([1, 65, 84])
    item, other = simhash.linked(values, sizes)
    for i, j in zip(item, other, strict=True):
        assert i > j
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    for i in range(150):
        near = [j for j in range(starts[i], i) if bin(int(values[i] ^ values[j])).count("1") <= 3]
        assert bool(near) == (i in item)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def sets_of(texts):
    out = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}
    return out


def near_groups(texts):
    """Components under a five-word Jaccard similarity of 0.8, by all pairs."""
    sets = sets_of(texts)
    comp = {i: i for i in texts}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in texts:
        for j in texts:
            if j < i and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    return {i: root(i) for i in texts}


def edited(rng, text, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("bucket", [5, 40])
def test_near_copies_match_brute_force(spark, monkeypatch, bucket):
    """Planted copies at 0.75 to 0.99, a chain, a large group of near copies over several chunks, odd rows."""
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(vocab, k=rng.choice([6, 60, 300]))) for _ in range(60)]
    texts = base + [edited(rng, t, k) for t in base if len(t.split()) > 50 for k in (1, 2, 4)]
    texts += [edited(rng, base[0] + " " + " ".join(vocab[:250]), k % 3) for k in range(150)]
    texts += [base[3].upper(), base[4] + "  ", "", " \n", "one two", "One Two", "x " * 4000]
    texts = dict(enumerate(texts))
    want = near_groups(texts)
    assert 20 < len(set(want.values())) < len(texts) - 100
    monkeypatch.setattr(simhash, "NEAR_BUCKET", bucket)
    rows = [(i, t, 1, 2, 3) for i, t in texts.items()]
    df = spark.createDataFrame([*rows, (7, texts[7], 9, 9, 9), (7, "another text under the id of seven", 1, 1, 1), (None, texts[2], 1, 1, 1), (None, None, 1, 1, 1)], "doc_id long, text string, `a.b` int, tag int, nth int")
    got = simhash.distinct(df, simhash.near_firsts(df))
    assert got.columns == df.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted((i, t) for i, t in kept if i is not None) == sorted([*((i, texts[i]) for i in set(want.values())), (7, "another text under the id of seven")])
    assert sum(i is None for i, _ in kept) == 2
    assert simhash.distinct(df.limit(0), simhash.near_firsts(df.limit(0))).count() == 0


def test_rows_of_one_id_are_told_apart(spark):
    """A unique text stays though another row of its id is a copy."""
    df = spark.createDataFrame([(1, "some text a b c"), (5, "quite another one d e f"), (5, "some text a b c"), (5, "quite another one d e f")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in simhash.distinct(df, simhash.print_firsts(df)).collect())
    assert got == [(1, "some text a b c"), (5, "quite another one d e f")]


def test_counters_hold_any_radius():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 63, 70, dtype=np.uint64)
    values = np.concatenate([values, values ^ (np.uint64(1) << rng.integers(0, 64, 70).astype(np.uint64))])
    for radius in (0, 1, 2, 3, 6, 24, 31):
        got = {(int(q), int(o)) for a, b in simhash.near_pairs(values, np.array([len(values)]), radius) for q, o in zip(a, b, strict=True)}
        assert got == {(i, j) for i in range(len(values)) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= radius}


def test_hot_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 10)
    rows = [(i, "") for i in range(40)] + [(i, f"words of text number {i} and {i * 7}") for i in range(40, 60)] + [(70, "words of text number 41 and 287"), (None, "")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = reach({i: plain(t) for i, t in rows if i is not None})
    assert got == want | {None: None}


def test_rows_apart_from_their_leader_meet_in_the_second_turn(spark, monkeypatch):
    """In one bucket: most rows join the leader, one pair is alike only to each other, a third lies in another chunk."""
    monkeypatch.setattr(simhash, "NEAR_BUCKET", 2)
    shared = spark.createDataFrame([(n, 7, 1, 6) for n in range(1, 12)], "node long, bucket long, leader long, chunks int")
    component = {n: 1 for n in range(1, 12)} | {4: 4, 5: 4, 9: 9}
    found = spark.createDataFrame([(n, c) for n, c in component.items() if n not in (4, 9)], "node long, component long")
    groups = {}
    for r in simhash.second_places(shared, found).collect():
        groups.setdefault((r.bucket, r.a, r.b), set()).add(r.node)
    met = {(x, y) for g in groups.values() for x in g for y in g}
    assert {(x, y) for x in component for y in component if component[x] != component[y]} <= met
    first = {}
    for r in simhash.first_places(shared).collect():
        first.setdefault(r.a, set()).add(r.node)
    assert set().union(*first.values()) == set(component) and all(1 in g for g in first.values())
