import hashlib
import random
import re

import numpy as np
from inkwell.llm import substrings


def brute(rows):
    """rows: (doc_id, text) → doc_id → (n_words, n_removed, sha)."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    first = {}
    order = sorted(words, key=lambda d: (d is None, d))
    for d in order:
        w = words[d]
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (d, s))
    out = {}
    for d, w in words.items():
        gone = set()
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] != (d, s):
                gone.update(range(s, s + 20))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def corpus(rng, n=150):
    vocab = [f"w{i}" for i in range(400)]
    passages = [rng.choices(vocab, k=k) for k in (19, 20, 21, 25, 40, 80)]
    rows = []
    for i in range(n):
        w = rng.choices(vocab, k=rng.choice([0, 5, 19, 20, 30, 120]))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            p = rng.choice(passages)
            a = rng.randrange(3)
            w[at:at] = p[a : len(p) - rng.randrange(3)]
        if rng.random() < 0.2:
            w += ["x"] * rng.choice([19, 20, 21, 45])
        rows.append((i * 3, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(1000 + i, rows[rng.randrange(n)][1]) for i in range(20)]
    return rows


def test_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [*corpus(rng), (5001, None), (5002, ""), (None, corpus(rng)[7][1])]
    data = [(d, t, "a") for d, t in rows] + [(0, rows[0][1], "twice"), (6, rows[2][1], "twice")]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "doc_id long, text string, marks string").repartition(5)
    got = substrings.with_removals(df, substrings._digest, "doc_id long, n_words long, n_removed long, kept_sha256 string").collect()
    assert len(got) == len(data)
    want = brute(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id], r


def test_stage_text(spark):
    long = " ".join(f"p{i}" for i in range(30))
    df = spark.createDataFrame([(1, f"a\nb {long}\nc", "s"), (2, f"x \n{long} y\n\nz", "s"), (3, long, None)], "doc_id long, text string, row string")
    got = {r.doc_id: (r.kept_text, r.row) for r in substrings.deduplicated(df).collect()}
    assert got == {1: (f"a\nb {long}\nc", "s"), 2: ("x \ny\n\nz", "s"), 3: ("", None)}


def test_anchor_follows_from_the_window_alone():
    rng = np.random.default_rng(0)
    low = rng.integers(0, 9, 400).astype(np.uint64)
    starts, best = substrings.picked(low, np.array([180, 7, 213]))
    assert len(starts) == 161 + 194
    for s, b in zip(starts[::7], best[::7], strict=True):
        alone, own = substrings.picked(low[s : s + 20], np.array([20]))
        assert own[0] == b - s


def test_empty_table(spark):
    assert substrings.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_only_short_documents(spark):
    df = spark.createDataFrame([(1, "a few words"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.kept_text for r in substrings.deduplicated(df).collect()} == {1: "a few words", 2: None}


def test_hot_anchors_are_dealt_in_parts(spark, monkeypatch):
    """A phrase in every document with other words around it; the answer is the same however its anchors are dealt."""
    rng = random.Random(6)
    phrase = " ".join(f"p{i}" for i in range(9))
    passage = " ".join(f"q{i}" for i in range(30))
    texts = []
    for i in range(150):
        words = [f"w{rng.randrange(40)}" for _ in range(60)]
        words.insert(rng.randrange(50), phrase)
        if i % 3 == 0:
            words.insert(rng.randrange(50), passage)
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    digest = lambda: {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.with_removals(df, substrings._digest, "doc_id long, n_words long, n_removed long, kept_sha256 string").collect()}
    plain = digest()
    assert {i: v[:2] for i, v in plain.items()} == {i: v[:2] for i, v in want.items()} and any(v[1] for v in want.values())
    monkeypatch.setattr(substrings, "HOT_SAMPLE", 1)
    monkeypatch.setattr(substrings, "HOT_ROWS", 20)
    assert digest() == plain
