"""Best-fit packing of tokenised documents by linear grouping.

Only lengths matter to a packing, and no piece is longer than one sequence, so the planner sees a histogram of at most
CAPACITY counts whatever the corpus size.  It

1. splits the lengths into small ones and large ones, and the large ones, longest first, into groups of equal
   cardinality; every member counts as its group's longest,
2. finds configurations (how many of each group share a sequence) by column generation on the few-size problem, run to
   its end, and takes each configuration a whole number of times,
3. substitutes actual documents: a slot takes the longest waiting document that its group's rounded length allows, the
   last slot the longest that still fits, and the sequence stands if few enough ids stay empty; what doesn't stand is
   grouped anew in the next round, which lets more stay empty; runs of equal actual lengths are one entry, so the plan's
   size depends on the lengths, not on the documents,
4. best-fits the documents left over, then the small ones, longest first, into the fullest sequences that take them.

Several schemes (what is small, how many groups, what may stay empty) are planned and the tightest is taken.

The plan is a bounded table of runs: the documents of one length whose ranks lie in a range go to consecutive sequences
at one offset.  Ranks come from (length, salt) windows plus prefix sums over salts, so one length that holds a third of
the corpus is ranked by many tasks.

Defined cases: null text is an empty document (one end id); repeated rows are packed as often as they occur; an empty
table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import PooledIds, code_points, cut, flattened, in_passes, segments_of, small_batches, spread, table

CAPACITY = 2048
#: Schemes to plan by: lengths of at most this share of a sequence are small; groups of equal cardinality that the large
#: ones are rounded up within; ids that a configuration's sequence may leave empty, for small documents, in each round.
SCHEMES = ((1 / 3, 64, (0, 0, 300)), (1 / 4, 64, (0, 0, 256)), (1 / 2, 64, (0, 512)), (1 / 16, 128, (0, 8, 128)), (1 / 8, 64, (0, 0, 128)), (1, 1, ()))
#: Parts that the documents of one length are ranked in.
SALTS = 512
END_ID = 0

# White space of the Unicode standard.
SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, SPACE, OTHER = range(4)


# ---- tokens ------------------------------------------------------------------------------------------------------


@cache
def point_classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        major = unicodedata.category(chr(point))[0]
        if major == "L":
            kinds[point] = LETTER
        elif major == "N":
            kinds[point] = NUMBER
    kinds[SPACES] = SPACE
    return kinds


def pretoken_begins(points: np.ndarray, doc_begins: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-tokens of documents laid end to end begin.

    They are contractions, then an optional blank with letters, numbers or other signs, then white space, whose last
    sign stays apart when something follows.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = point_classes()[points]
    new_doc = np.zeros(n + 1, bool)
    new_doc[doc_begins[doc_begins < n]] = True
    new_doc[n] = True
    begin = np.empty(n, bool)
    begin[0] = True
    begin[1:] = (kind[1:] != kind[:-1]) | new_doc[1:n]
    after_space = np.zeros(n, bool)  # text right after white space of its own document
    after_space[1:] = (kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~new_doc[1:n]
    follows = np.nonzero(after_space)[0]
    begin[follows - 1] = True
    blank = points[follows - 1] == 32
    begin[follows[blank]] = False
    marks = np.nonzero((points == 39) & begin)[0]
    marks = marks[marks + 1 < n]
    for p in marks[~new_doc[marks + 1]].tolist():
        one = chr(points[p + 1])
        two = one + chr(points[p + 2]) if p + 2 < n and not new_doc[p + 2] else ""
        size = 2 if one in "stmd" else 3 if two in ("re", "ve", "ll") else 0
        if size:
            begin[p + 1 : min(p + size, n)] = False
            if p + size < n:
                begin[p + size] = True
                if blank_joins(points, kind, new_doc, p + size, n):
                    begin[p + size + 1] = False
    return np.nonzero(begin)[0]


def blank_joins(points: np.ndarray, kind: np.ndarray, new_doc: np.ndarray, p: int, n: int) -> bool:
    """Whether a single blank at p goes with what follows it."""
    return points[p] == 32 and not new_doc[p] and p + 1 < n and not new_doc[p + 1] and kind[p + 1] != SPACE


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Merge ranks by token bytes of a byte-level tokenizer file; None where its ids don't follow the order of its merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file; others follow from 256 on
    sign = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get("".join(m), -1) for m in pairs]
    if made != sorted(set(made)) or min(made, default=0) < 0 or any(c not in sign for token in model["vocab"] for c in token):
        return None
    return {bytes(sign[c] for c in token): i for token, i in model["vocab"].items()}


@cache
def byte_bpe(path: str) -> PooledIds:
    """Remembered ids of pre-tokens under the tokenizer file at path; strings of special tokens are ordinary text.

    New pre-tokens go, as lines of one text, to a merger that takes a line for a pre-token; no other token holds a line
    end, so the ids fall apart at its id.  Those with a line end inside go one by one.
    """
    ranks = byte_ranks(path)
    if ranks is None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return PooledIds(lambda parts: flattened([x.ids for x in tokenizer.encode_batch(parts, add_special_tokens=False)]))
    import tiktoken

    by_line = tiktoken.Encoding("lines", pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={})
    whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    line_end = ranks[b"\n"]

    def encode(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        inside = np.fromiter(("\n" in p for p in parts), bool, len(parts))
        others, lines = np.nonzero(inside)[0], np.nonzero(~inside)[0]
        ids, lengths = flattened([whole.encode_ordinary(parts[i]) for i in others.tolist()])
        joined = np.array(by_line.encode_ordinary("\n".join([parts[i] for i in lines.tolist()])), np.uint32)
        ends = np.append(np.nonzero(joined == line_end)[0], len(joined)) if len(lines) else np.zeros(0, np.int64)
        size, start = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        size[others], size[lines] = lengths, np.diff(ends, prepend=-1) - 1
        start[others], start[lines] = np.cumsum(lengths) - lengths, len(ids) + ends - size[lines]
        return np.concatenate([ids, joined])[spread(start, size)], size

    return PooledIds(encode)


def encode_documents(texts: list[str | None], path: str) -> Iterator[np.ndarray]:
    """Ids of each text, without the end id."""
    pool = byte_bpe(path)
    for start, stop in in_passes(texts):
        part = [t or "" for t in texts[start:stop]]
        joined = "".join(part)
        points = code_points(joined)
        doc_ends = np.cumsum([len(t) for t in part])
        begins = pretoken_begins(points, doc_ends - [len(t) for t in part])
        ids, counts = pool.lookup(segments_of(joined, points, begins))
        total = np.concatenate([[0], np.cumsum(counts)])
        bounds = total[np.searchsorted(begins, doc_ends)]
        yield from np.split(ids, bounds[:-1])


def pieces_of(ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than a sequence."""
    n = len(ids)
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenised(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32) for every piece of every document with its end id."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            keys = batch.column(0).to_pylist()
            for key, ids in zip(keys, encode_documents(batch.column(1).to_pylist(), path), strict=True):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for piece, (start, length) in enumerate(pieces_of(ids, capacity)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    for column, value in zip(out, (key, piece, start, length, crc), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], ["id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(kernel, "id long, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


# ---- plan --------------------------------------------------------------------------------------------------------


def linear_groups(counts: np.ndarray, small: int, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(rounded size, [(length, count) longest first]) of groups of equal cardinality of the lengths above small."""
    lengths = [x for x in range(len(counts) - 1, small, -1) if counts[x]]
    total = int(sum(int(counts[x]) for x in lengths))
    most = -(-total // groups) if total else 1
    if len(lengths) <= groups:
        return [(x, [(x, int(counts[x]))]) for x in lengths]
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for x in lengths:
        left = int(counts[x])
        while left:
            if not room:
                out.append((x, []))
                room = most
            take = min(left, room)
            out[-1][1].append((x, take))
            room -= take
            left -= take
    return out


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within capacity of the greatest worth (unbounded knapsack).

    Rooms that differ by less than the smallest size don't depend on each other, so they are settled together.
    """
    low = int(sizes.min())
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for block in range(low, capacity + 1, low):
        rooms = np.arange(block, min(block + low, capacity + 1))
        rest = rooms[:, None] - sizes[None, :]
        gain = np.where(rest >= 0, value[np.maximum(rest, 0)] + worth, -1.0)
        best = gain.argmax(axis=1)
        got = gain[np.arange(len(rooms)), best]
        so_far = np.maximum.accumulate(np.concatenate([[value[block - 1]], got]))
        value[rooms] = so_far[1:]
        choice[rooms] = np.where(got > so_far[:-1], best, -1)
    used = np.zeros(len(sizes), np.int64)
    room = capacity
    while room >= low:
        if choice[room] >= 0:
            used[choice[room]] += 1
            room -= int(sizes[choice[room]])
        else:
            room -= 1
    return float(value[capacity]), used


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int = 20_000) -> list[tuple[np.ndarray, float]]:
    """Configurations with their (fractional) counts: Gilmore and Gomory's columns for the cutting-stock problem.

    Sums are element-wise throughout: this runs in the driver, where threads of a matrix library may not survive the
    start of the JVM.  The steps end by themselves; their number is only a guard against a cycle.
    """
    if not len(sizes):
        return []
    most = np.maximum(capacity // sizes, 1)
    columns, inverse, level = np.diag(most), np.diag(1 / most), demand / most
    for _ in range(steps):
        worth, used = best_configuration(sizes, np.maximum(inverse.sum(axis=0), 0), capacity)
        if worth < 1 + 1e-4:
            break
        at = np.nonzero(used)[0]
        direction = (inverse[:, at] * used[at]).sum(axis=1)
        ratio = np.where(direction > 1e-9, level / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        row, taken = inverse[out] / direction[out], ratio[out]
        inverse -= direction[:, None] * row
        inverse[out] = row
        level = np.maximum(level - taken * direction, 0)
        level[out], columns[:, out] = taken, used
    return [(columns[:, j], float(level[j])) for j in range(len(sizes)) if level[j] > 1e-9]


class Open:
    """Sequences that still have room, as runs of consecutive sequence ids with the same room."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)

    def add(self, room: int, first: int, count: int, offset: int) -> None:
        if count and room:
            if not self.runs[room]:
                bisect.insort(self.rooms, room)
            self.runs[room].append((first, count, offset))

    def take(self, size: int, count: int) -> tuple[int, int, int, int] | None:
        """Up to count sequences of the least room that holds size: (first, taken, offset, room)."""
        at = bisect.bisect_left(self.rooms, size)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        first, has, offset = self.runs[room].pop()
        taken = min(has, count)
        if taken < has:
            self.runs[room].append((first + taken, has - taken, offset))
        if not self.runs[room]:
            self.rooms.pop(at)
        return first, taken, offset, room


Run = tuple[int, int, int, int, int]


class Plan:
    """Runs (length, first rank, count, first sequence, offset) that place counts[length] documents of each length."""

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY):
        self.capacity, self.left = capacity, np.array(counts[: capacity + 1], np.int64)
        self.runs: list[Run] = []
        self.ranks = np.zeros(capacity + 1, np.int64)
        self.used = self.configured = 0
        self.free = Open()

    def place(self, length: int, count: int, first: int, offset: int) -> None:
        self.runs.append((length, int(self.ranks[length]), count, first, offset))
        self.ranks[length] += count
        self.left[length] -= count

    def configure(self, small: int, groups: int, spare: int) -> None:
        """One round: group the large lengths that are left, find configurations, substitute actual documents.

        A slot takes the longest document that its group's rounded length allows, the last one the longest that fits;
        the choice is the same for a run of sequences, until one of its lengths has no more documents.
        """
        grouped = linear_groups(self.left, small, groups)
        sizes = np.array([g[0] for g in grouped], np.int64)
        demand = np.array([sum(c for _, c in g[1]) for g in grouped], float)
        waiting = [x for x in range(small + 1, self.capacity + 1) if self.left[x]]
        found = [([int(sizes[g]) for g in np.nonzero(c)[0] for _ in range(int(c[g]))], level) for c, level in configurations(sizes, demand, self.capacity)]
        for slots, level in sorted(found, reverse=True):
            times = int(level + 1e-6)
            while times > 0 and waiting:
                room, taken, chosen = self.capacity, defaultdict(int), []
                for i, size in enumerate(slots):
                    at = bisect.bisect_right(waiting, room if i == len(slots) - 1 else min(size, room)) - 1
                    while at >= 0 and self.left[waiting[at]] <= taken.get(waiting[at], 0):
                        at -= 1
                    if at >= 0:
                        taken[waiting[at]] += 1
                        chosen.append(waiting[at])
                        room -= waiting[at]
                if room > spare:
                    break  # this configuration's documents are for a later round, or for best fit
                run = min([times, *(int(self.left[x]) // n for x, n in taken.items())])
                offset = 0
                for length in chosen:
                    self.place(length, run, self.used, offset)
                    offset += length
                waiting = [x for x in waiting if self.left[x]] if any(not self.left[x] for x in taken) else waiting
                self.free.add(room, self.used, run, offset)
                self.used += run
                self.configured += run * len(chosen)
                times -= run

    def best_fit(self) -> None:
        """All that is left, longest first, into the fullest sequences that take it."""
        for length in np.nonzero(self.left)[0][::-1].tolist():
            count = int(self.left[length])
            while count:
                if got := self.free.take(length, count):
                    first, taken, offset, room = got
                    self.place(length, taken, first, offset)
                    self.free.add(room - length, first, taken, offset + length)
                    count -= taken
                    continue
                each = self.capacity // length
                whole = count // each or 1
                each = min(each, count)
                for i in range(each):
                    self.place(length, whole, self.used, i * length)
                self.free.add(self.capacity - each * length, self.used, whole, each * length)
                self.used += whole
                count -= whole * each


def plan(counts: np.ndarray, capacity: int = CAPACITY, schemes: tuple = SCHEMES) -> tuple[list[Run], int, float]:
    """The runs and the number of sequences of the tightest scheme, and the share of large documents that configurations place.

    Best fit alone is the last scheme, so no plan is worse than that; of schemes with equal counts the first stands.
    """
    best = None
    tightest = -(-int((np.asarray(counts, np.int64)[: capacity + 1] * np.arange(min(len(counts), capacity + 1))).sum()) // capacity)
    for small, groups, spares in schemes:
        if best and best[1] == tightest:
            break
        least = int(capacity * small)
        made = Plan(counts, capacity)
        large = int(made.left[least + 1 :].sum())
        for spare in spares:
            made.configure(least, groups, spare)
        made.best_fit()
        if best is None or made.used < best[1]:
            best = made.runs, made.used, made.configured / large if large else 0.0
    return best


# ---- placing -----------------------------------------------------------------------------------------------------


def pack_lengths(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """pieces (with a length column, 1 to capacity) plus sequence_id and offset.

    pieces should be cheap to read twice.  Rank order within a length is by the order columns inside a salt.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(parts.select("length", "_salt", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in parts.groupBy("length").agg(F.sum("_n")).collect():  # at most capacity rows
        counts[length] = n
    runs, _, _ = plan(counts, capacity)
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for length in {r[0] for r in runs}:
        own = np.array([r[1:] for r in runs if r[0] == length] if len(runs) < 1000 else [], np.int64).reshape(-1, 4)
        by_length[length] = (own[:, 0], own[:, 2], own[:, 3])
    if len(runs) >= 1000:
        every = np.array(sorted(runs), np.int64)
        at = np.searchsorted(every[:, 0], sorted(by_length))
        for length, own in zip(sorted(by_length), np.split(every, at[1:]), strict=True):
            by_length[length] = (own[:, 1], own[:, 3], own[:, 4])
    shared = spark.sparkContext.broadcast(by_length)  # bounded by the plan

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            by = np.argsort(lengths, kind="stable")
            for own in np.split(by, np.nonzero(np.diff(lengths[by]))[0] + 1):
                if len(own):
                    firsts, sequences, offsets = shared.value[int(lengths[own[0]])]
                    run = np.searchsorted(firsts, ranks[own], "right") - 1
                    sequence[own] = sequences[run] + ranks[own] - firsts[run]
                    offset[own] = offsets[run]
            kept = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1
    ranked = salted.withColumn("_within", within).join(parts.drop("_n"), ["length", "_salt"])
    ranked = ranked.select(*pieces.columns, (F.col("_within") + F.col("_base")).cast("long").alias("_rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(kernel, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset) for all documents."""
    return pack_lengths(cut(tokenised(docs, path, id_col, text_col, capacity)), [id_col, "piece", "start"], capacity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op2_packing": op2_packing}
