"""Substring deduplication by seed and extend.

Every window of WINDOW words picks one of its K-word grams, the leftmost of least hash, as its anchor (winnowing), so
two equal windows pick the same anchor at the same place.  One row leaves a document per anchor, not per window: the
anchor's hash and a hash of its context, the words of all windows that picked it.

* Anchors that occur once are done.  Occurrences with equal context are equal in all their windows: all but the first
  are removed as they stand (the seed extended to its whole context).
* Where one anchor has several contexts, the first occurrence of each is taken back to its text and extended window by
  window; every window whose words also start earlier is removed.

Extending every pair of occurrences would grow with the square of a passage's copies; the window hashes of the extended
contexts find the same maximal repeats in proportion to the text.  Adjacent and overlapping removals join into them.  Repeats inside one map task are settled there, so that a
passage in a third of all documents reaches the exchange once per task; an anchor that many documents share in ever other
contexts is dealt over several tasks by its context, each of which extends the first of each context.  Hashes that decide removals have 128 bits.

Defined cases: null text has no words; documents under WINDOW words keep everything; "earlier" is the smaller id, then
the smaller start; very long texts are read in one pass; a null id is later than any other; repeated rows (same id, same text) are one document and both keep
what the document keeps; rows of one id with different texts are told apart by a tag of the text; columns other than id and text are ignored by the digest and kept by the stage.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from inkwell.llm.common import cut_table, in_passes, named, small_batches, spread, table

WINDOW = 20
#: Words of an anchor; a window has WINDOW - K + 1 of them to pick from.
K = 6
LAST = (1 << 63) - 1
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

#: A row per anchor.  place packs, highest bits first: position (31), tag of the text (23), position - first window (4),
#: position - last window (4).  Ranges settled before the exchange have a negative place (first window, tag), their last
#: window as context, and a hash of the document as anchor, so that they don't meet at a hot anchor.
#: part is 0, or for hot anchors 1 and more, by the context: such an anchor is dealt over HOT_PARTS parts.
DEALT = "doc long, place long, anchor long, context long, part int"
#: An anchor is hot that a sample of one document in HOT_SAMPLE puts at more than HOT_ROWS rows; at most HOT_MOST are.
#: Which anchors are hot changes only where rows go, never what is removed.
HOT_SAMPLE, HOT_ROWS, HOT_MOST, HOT_PARTS = 64, 1 << 20, 100_000, 64
TAG = (1 << 23) - 1


def word_hashes(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every word of texts (with lower, of its A-Z in lower case), and how many words each text has."""
    lists = [(t.encode().lower() if lower else t.encode()).split() for t in texts]
    counts = np.array([len(x) for x in lists], np.int64)
    words = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
    unique = words.dictionary.to_pylist()
    a = np.array([xxhash.xxh3_128_intdigest(w) for w in unique], object)
    low = np.array([x & 0xFFFFFFFFFFFFFFFF for x in a], np.uint64)
    high = np.array([x >> 64 for x in a], np.uint64)
    at = words.indices.to_numpy(zero_copy_only=False)
    return low[at], high[at], counts


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any word range, from prefix sums of w[i] * base**i."""

    def __init__(self, words: np.ndarray, base: np.uint64):
        n = len(words)
        power = np.ones(n + 1, np.uint64)
        if n:
            np.cumprod(np.full(n, base, np.uint64), out=power[1:])
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(words * power[:n], out=self.prefix[1:])
        inverse = pow(int(base), -1, 1 << 64)
        self.back = np.ones(n + 1, np.uint64)
        if n:
            np.cumprod(np.full(n, inverse, np.uint64), out=self.back[1:])

    def of(self, starts: np.ndarray, lengths) -> np.ndarray:
        return mixed((self.prefix[starts + lengths] - self.prefix[starts]) * self.back[starts] + np.asarray(lengths).astype(np.uint64))


def picked(low: np.ndarray, counts: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all whole windows of documents laid end to end, and the anchor that each picks."""
    n = len(low)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = Rolling(low, BASE[0]).of(np.arange(n - k + 1), k)
    span = window - k + 1
    best = np.arange(n - window + 1)
    least = grams[: n - window + 1].copy()
    for j in range(1, span):
        other = grams[j : j + n - window + 1]
        better = other < least
        least = np.where(better, other, least)
        best = np.where(better, np.arange(j, j + n - window + 1), best)
    ends = np.cumsum(counts)
    whole = np.zeros(n + 1, np.int64)
    for a, b in zip((ends - counts)[counts >= window].tolist(), (ends - window + 1)[counts >= window].tolist(), strict=True):
        whole[a] += 1
        whole[b] -= 1
    starts = np.nonzero(np.cumsum(whole)[: n - window + 1])[0]
    return starts, best[starts]


def anchors(low: np.ndarray, high: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, position, first window, last window, anchor hash, context hash) per anchor; places are within the document."""
    starts, anchor = picked(low, counts)
    ends = np.cumsum(counts)
    doc = np.searchsorted(ends, starts, "right")
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(starts))[: len(first)] - 1
    a, b, at, doc = starts[first], starts[last], anchor[first], doc[first]
    seed = Rolling(low, BASE[0]).of(at, K)
    context = Rolling(high, BASE[1]).of(a, b + WINDOW - a) ^ mixed((at - a).astype(np.uint64))
    base = (ends - counts)[doc]
    return doc, at - base, a - base, b - base, seed, context


def _seeds(batches: Iterator[pa.RecordBatch], hot: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (doc, tag, text) to anchors; what repeats a context of the same pass is settled here.  hot is sorted."""
    for batch in batches:
        ids, tags = batch.column("doc").to_numpy(), batch.column("tag").to_numpy().astype(np.int64)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for i, j in in_passes(texts, 8_000_000):
            low, high, counts = word_hashes(texts[i:j])
            doc, pos, first, last, seed, context = anchors(low, high, counts)
            own, tag = ids[i:j][doc], tags[i:j][doc]
            order = np.lexsort((pos, own, context, seed))
            s, c = seed[order], context[order]
            same = np.zeros(len(order), bool)
            same[1:] = (s[1:] == s[:-1]) & (c[1:] == c[:-1])
            # A repeated row holds the very same places; such a pair is one occurrence, not a repeat.
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            twin = same & (own[order] == own[order][head]) & (pos[order] == pos[order][head])
            keep, out = np.sort(order[~same]), order[same & ~twin]
            place = pos << 31 | tag << 8 | (pos - first) << 4 | (pos - last)
            columns = [(own[keep], place[keep], seed[keep].view(np.int64), context[keep].view(np.int64))]
            if len(out):  # their ranges, joined where they touch
                out = out[np.lexsort((first[out], doc[out]))]
                fresh = np.ones(len(out), bool)
                fresh[1:] = (doc[out][1:] != doc[out][:-1]) | (first[out][1:] > last[out][:-1] + 1)
                begin = np.nonzero(fresh)[0]
                end = np.append(begin[1:], len(out)) - 1
                at = out[begin]
                columns.append((own[at], -1 - (first[at] << 23 | tag[at]), mixed((own[at] + first[at]).astype(np.uint64)).view(np.int64), last[out][end]))
            for values in columns:
                part = np.zeros(len(values[0]), np.int32)
                if hot is not None and len(hot):
                    at = np.minimum(np.searchsorted(hot, values[2]), len(hot) - 1)
                    warm = (hot[at] == values[2]) & (values[1] >= 0)
                    part[warm] = 1 + (values[3][warm] & (HOT_PARTS - 1))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*values, part)], ["doc", "place", "anchor", "context", "part"])


CLASSES = "doc long, tag int, low int, high int, open boolean"


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors in order to ranges of windows: repeats of a context, and open ones, the first of each context of an anchor that has several."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
        anchor, part = rows.column("anchor").to_numpy(), rows.column("part").to_numpy()
        change = np.nonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]))[0]
        whole = int(change[-1]) + 1 if len(change) else 0  # the last group may go on
        if whole:
            yield _resolved(rows.slice(0, whole))
        held = rows.slice(whole)
    if held is not None and held.num_rows:
        yield _resolved(held)


def _resolved(rows: pa.Table) -> pa.RecordBatch:
    doc, place, seed, context, part = (rows.column(c).to_numpy() for c in ("doc", "place", "anchor", "context", "part"))
    done = np.nonzero(place < 0)[0]
    settled = -1 - place[done]
    live = np.nonzero(place >= 0)[0]
    seed, own, at, of, part = seed[live], context[live], place[live], doc[live], part[live]
    n = len(live)
    new_seed, new_context = np.ones(n, bool), np.ones(n, bool)
    new_seed[1:] = (seed[1:] != seed[:-1]) | (part[1:] != part[:-1])
    new_context[1:] = new_seed[1:] | (own[1:] != own[:-1])
    group = np.cumsum(new_seed) - 1
    several = (np.bincount(group, new_context)[group] > 1) | (part > 0) if n else np.zeros(0, bool)  # a hot anchor's other contexts are elsewhere
    head = np.maximum.accumulate(np.where(new_context, np.arange(n), 0))
    pos = at >> 31
    first = (of == of[head]) & (pos == pos[head])
    out = np.nonzero(~first | several)[0]
    at, pos = at[out], pos[out]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([of[out], doc[done]])),
            pa.array(np.concatenate([at >> 8 & TAG, settled & TAG]).astype(np.int32)),
            pa.array(np.concatenate([pos - (at >> 4 & 15), settled >> 23]).astype(np.int32)),
            pa.array(np.concatenate([pos - (at & 15), context[done]]).astype(np.int32)),
            pa.array(np.concatenate([first[out], np.zeros(len(done), bool)])),
        ],
        [x.split(" ")[0] for x in CLASSES.split(", ")],
    )


def _together(rows: DataFrame) -> DataFrame:
    """Ranges (low, high) of each document as one sorted array of packed longs."""
    packed = F.shiftleft(F.col("low").cast("long"), 32).bitwiseOR(F.col("high").cast("long"))
    return rows.groupBy("doc", "tag").agg(F.sort_array(F.collect_set(packed)).alias("marks"))


def mark_ranges(column: pa.ListArray) -> list[np.ndarray | None]:
    """Per row the ranges [n, 2] of first and last windows, None without marks."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.array([0 if n is None else n for n in pc.list_value_length(column).to_pylist()], np.int64))
    return [np.stack([x >> 32, x & 0xFFFFFFFF], axis=1) if len(x) else None for x in np.split(values, ends[:-1])] if len(ends) else []


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tag, text, own, marks) to the hashes of the windows that the marks name."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, tags = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
        texts, marks = batch.column("text").to_pylist(), mark_ranges(batch.column("marks"))
        for i, j in in_passes(texts, 8_000_000):
            low, high, counts = word_hashes([t or "" for t in texts[i:j]])
            base = np.cumsum(counts) - counts
            first, second = Rolling(low, BASE[0]), Rolling(high, BASE[1])
            own = [np.unique(spread(m[:, 0], m[:, 1] - m[:, 0] + 1)) for m in marks[i:j]]
            x = np.repeat(np.arange(j - i), [len(w) for w in own])
            start = np.concatenate(own)
            at = start + base[x]
            hashes = (first.of(at, WINDOW).view(np.int64), second.of(at, WINDOW).view(np.int64))
            yield pa.RecordBatch.from_arrays([*map(pa.array, hashes), pa.array(ids[i + x]), pa.array(tags[i + x]), pa.array(start.astype(np.int32))], ["h1", "h2", "doc", "tag", "start"])


def removals(keyed: DataFrame) -> DataFrame:
    """(doc, tag, low, high): first and last of runs of windows to remove, for rows (doc, tag, text, own) of documents."""
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed.select("doc", "tag", "text")
    counts = texts.where(F.pmod(F.xxhash64("doc", F.lit(7)), F.lit(HOT_SAMPLE)) == 0).mapInArrow(_seeds, DEALT).where("place >= 0").groupBy("anchor").count()
    found = counts.where(F.col("count") * HOT_SAMPLE > HOT_ROWS).orderBy(F.desc("count"), "anchor").limit(HOT_MOST).collect()
    hot = keyed.sparkSession.sparkContext.broadcast(np.array(sorted(r.anchor for r in found), np.int64))
    seeds = texts.mapInArrow(lambda batches: _seeds(batches, hot.value), DEALT)
    seeds = seeds.repartition(n, "anchor", "part").sortWithinPartitions("anchor", "part", "context", "doc", "place")
    classes = cut_table(seeds.mapInArrow(_classes, CLASSES))
    settled = classes.where("not open").drop("open")
    # The texts meet these marks, and in the end the removals, over one and the same exchange.
    marked = keyed.join(_together(classes.where("open")).hint("shuffle_hash"), ["doc", "tag"])
    windows = marked.mapInArrow(_windows, "h1 long, h2 long, doc long, tag int, start int")
    firsts = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    later = windows.join(firsts, ["h1", "h2"]).where("doc <> first.doc or start <> first.start")
    return settled.unionByName(later.select("doc", "tag", F.col("start").alias("low"), F.col("start").alias("high")))


def covered(n_words: int, marks: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of a document's words some removed window covers."""
    change = np.bincount(marks[:, 0], minlength=n_words + 1) - np.bincount(marks[:, 1] + window, minlength=n_words + 1)
    return np.cumsum(change)[:n_words] > 0


def with_removals(docs: DataFrame, finish: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Run finish over rows of docs with the columns doc, tag, text, own (the other columns of docs) and marks."""
    small_batches(docs.sparkSession)
    keyed = docs.select(
        F.coalesce(named(id_col).cast("long"), F.lit(LAST)).alias("doc"),
        F.xxhash64(named(text_col)).bitwiseAND(TAG).cast("int").alias("tag"),
        named(text_col).cast("string").alias("text"),
        F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]).alias("own"),
    )
    return keyed.join(_together(removals(keyed)).hint("shuffle_hash"), ["doc", "tag"], "left").mapInArrow(finish, schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pc.struct_field(batch.column("own"), 0)
        total, removed, sums = [], [], []
        for text, marks in zip(batch.column("text").to_pylist(), mark_ranges(batch.column("marks")), strict=True):
            words = (text or "").encode().split()
            gone = 0
            if marks is not None:
                out = covered(len(words), marks)
                gone = int(out.sum())
                kept = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
            else:
                kept = words
            total.append(len(words))
            removed.append(gone)
            sums.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([keys, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def kept_text(text: str | None, marks: np.ndarray | None) -> str | None:
    """text without its removed words; white space between kept words stays as it is."""
    if not text or marks is None:
        return text
    spans = [m.span() for m in WORD.finditer(text)]
    out = covered(len(spans), marks).tolist()
    if all(out):
        return ""
    parts, at = [], 0
    for i, gone in enumerate(out):
        if gone:
            parts.append(text[at : spans[i][0]])
            at = spans[i + 1][0] if i + 1 < len(spans) else spans[i][1]
    parts.append(text[at:])
    return "".join(parts)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "kept_text") -> DataFrame:
    """docs with out_col, the text without its later repeats of WINDOW words and more."""
    from pyspark.sql.pandas.types import to_arrow_type

    others = [f for f in docs.schema.fields if f.name != text_col]
    back = [f.name for f in docs.schema.fields if f.name.lower() != out_col.lower()]
    types = [to_arrow_type(f.dataType) for f in others]
    schema = StructType([*(StructField(f"c{i}", f.dataType) for i, f in enumerate(others)), StructField("text", StringType()), StructField("kept", StringType())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("own")
            kept = [kept_text(t, m) for t, m in zip(batch.column("text").to_pylist(), mark_ranges(batch.column("marks")), strict=True)]
            columns = [pc.struct_field(own, i).cast(t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("text"), pa.array(kept, pa.string())], [*(f"c{i}" for i in range(len(others))), "text", "kept"])

    place = {f.name: f"c{i}" for i, f in enumerate(others)} | {text_col: "text"}
    found = with_removals(docs, finish, schema, id_col, text_col)
    return found.select(*[F.col(place[c]).alias(c) for c in back], F.col("kept").alias(out_col))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_removals(docs, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


QUERIES = {"op7_substrings": op7_substrings}
