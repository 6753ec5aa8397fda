import bisect
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from inkwell.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


HARD = [
    "", " ", "  ", "\n", "a", " a", "it's  they're we'll I'd 'tis ''s x's' 's", "don'tt can't've \t'm", "a\n\n b \n\tc  ", "x  y　 z", "  'll 5's 50% é'd",
    "naïve Größe 12³ ½日本語 \U0001f600\U0001f468‍\U0001f469", "<|endoftext|> x", "a'", "'", "'s", "' s", "a 's' b", "\x1c\x1f \x85", "x'll  y", "x'll y", "é'ree'vee",
]


def test_ids_equal_the_library():
    rng = random.Random(0)
    alphabet = "aB é1.'sdtmrevl  \n\t-'日"
    texts = HARD + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(3000)]
    got = [x.tolist() for x in packing.encode_documents(texts, PATH)]
    assert got == library(texts)


def filled(counts, runs, used):
    """Checks that a plan places every document once, gapless, within the capacity."""
    placed = np.zeros(2049, np.int64)
    spans = defaultdict(list)
    for length, rank, count, first, offset in runs:
        assert rank == placed[length]
        placed[length] += count
        for s in range(first, first + count):
            spans[s].append((offset, length))
    assert (placed == counts).all() and sorted(spans) == list(range(used))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def plain_best_fit(lengths):
    """Sequences that best fit needs, one document at a time."""
    rooms, used = [], 0
    for x in sorted(lengths.tolist(), reverse=True):
        at = bisect.bisect_left(rooms, x)
        if at == len(rooms):
            used += 1
            room = 2048
        else:
            room = rooms.pop(at)
        if room > x:
            bisect.insort(rooms, room - x)
    return used


def real_lengths():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    return np.array([n for ids in packing.encode_documents(texts, PATH) for _, n in packing.pieces_of(np.append(ids, 0))])


SHAPES = {
    "one": (lambda r: r.integers(1, 2049, 1), 0),
    "seven": (lambda r: r.integers(1, 2049, 7), 0),
    "uniform": (lambda r: r.integers(1, 2049, 20000), 0.5),
    "narrow": (lambda r: r.integers(600, 1101, 20000), 0.5),
    "normal": (lambda r: np.clip(r.normal(900, 150, 20000).astype(int), 1, 2048), 0.5),
    "third": (lambda r: np.clip(r.normal(700, 100, 20000).astype(int), 1, 2048), 0.5),
    "lognormal": (lambda r: np.minimum(2048, r.lognormal(6, 1, 20000).astype(int) + 1), 0),
    "mixture": (lambda r: np.concatenate([r.integers(1, 2049, 400), np.minimum(2048, r.lognormal(5, 1, 400).astype(int) + 1)]), 0),
    "equal": (lambda r: np.full(1000, 682), 0),
    "real": (lambda r: real_lengths(), 0.5),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_plan_beats_best_fit(shape):
    make, least = SHAPES[shape]
    lengths = make(np.random.default_rng(3))
    counts = np.bincount(lengths, minlength=2049)
    runs, used, share = packing.plan(counts)
    filled(counts, runs, used)
    assert used <= plain_best_fit(lengths) and used >= -(-lengths.sum() // 2048)
    assert share >= least  # of the large documents, placed by configurations


@pytest.mark.parametrize("sizes", [(3, 5, 7), (4, 9, 11, 6), (10, 2)])
def test_configurations_reach_the_linear_bound(sizes):
    """Against all configurations of a small capacity: no fractional cover by them is smaller."""
    capacity = 20
    sizes, demand = np.array(sizes), np.arange(len(sizes)) * 7.0 + 5
    found = packing.configurations(sizes, demand, capacity)
    cover = sum(c * level for c, level in found)
    assert all((c * sizes).sum() <= capacity for c, _ in found) and (np.abs(cover - demand) < 1e-6).all()
    worth = [level for _, level in found]
    every = [c for c in itertools.product(*(range(capacity // x + 1) for x in sizes)) if sum(a * b for a, b in zip(c, sizes, strict=True)) <= capacity]
    basis = np.array([c for c, _ in found], float)
    dual = np.linalg.lstsq(basis, np.ones(len(basis)), rcond=None)[0]  # prices at which every used configuration is worth 1
    if len(found) == len(sizes):
        assert max(float(np.dot(dual, c)) for c in every) <= 1 + 1e-3
    assert sum(worth) >= (sizes * demand).sum() / capacity - 1e-9


def test_plan_ends_after_a_session_started(spark):
    """The planner runs in the driver, next to a started JVM."""
    spark.range(3).count()
    lengths = np.random.default_rng(1).integers(1, 2049, 3000)
    counts = np.bincount(lengths, minlength=2049)
    runs, used, _ = packing.plan(counts)
    filled(counts, runs, used)


def test_pack(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["alpha", "beta's", "γάμμα", "\n", "delta"], k=k)) for k in (0, 1, 5, 500, 3000, 9000)] + [None, "", *["same copy"] * 40]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(3, texts[3], "again", 2)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length string, _salt int"), PATH).collect()
    ids = {i: [*x, 0] for i, x in enumerate(library([t or "" for t in texts]))}
    spans, covered = defaultdict(list), defaultdict(list)
    for r in got:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(own.tobytes()) and len(own) == r.length
        assert r.piece == 0 or r.length == 2048
        spans[r.sequence_id].append((r.offset, r.length))
        covered[r.doc_id].append((r.start, r.length))
    for i, own in ids.items():
        assert sorted(covered[i]) == sorted(packing.pieces_of(own) * (2 if i == 3 else 1))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def fewest(lengths, capacity):
    """The least sequences that hold all lengths, by trying every place."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(lengths):
            best = len(free)
            return
        for room in {f for f in free if f >= lengths[k]}:
            rest = list(free)
            rest.remove(room)
            place(k + 1, [*rest, room - lengths[k]])
        place(k + 1, [*free, capacity - lengths[k]])

    place(0, [])
    return best


def test_tiny_plans_are_close_to_the_fewest():
    """Against an exhaustive search: never below it, never above best fit, and nearly always equal."""
    rng = random.Random(6)
    equal = total = 0
    for _ in range(150):
        capacity = rng.choice([10, 12, 20])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = np.bincount(lengths, minlength=capacity + 1)
        runs, used, _ = packing.plan(counts, capacity)
        least = fewest(lengths, capacity)
        assert least <= used <= least + 1
        equal += used == least
        total += 1
    assert equal >= 0.95 * total
