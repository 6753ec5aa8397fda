"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are majority votes over 64-bit shingle hashes.  Distinct fingerprints (copies collapse first) are dealt to
ten tables keyed by two of five bit blocks: two values within three differing bits agree on at least two blocks, so
every link shows in some table.  Inside a bucket the values are stored as vertical bit planes, 64 lanes a word; the
distances of a query to 64 lanes grow at once in carry-save counters and a word is dropped as soon as all its lanes
are past the radius.  A bucket above BUCKET rows is dealt as pairs of chunks, so no task holds more than two chunks and
every pair still meets once.  A group returns a spanning forest, never all its pairs; components come from alternating
star contractions over checkpointed edges.

`distinct` keeps one row of each group, of linked fingerprints (`print_firsts`) or of near copies (`near_firsts`).  Near
copies take shingles of five words and a Jaccard similarity of 0.8 or more.  Two such texts differ in about ten bits, out
of reach of tables of bit blocks, so tables are keyed by bands of least hashes; inside them the same bit-sliced
comparison, with wider counters, leaves few pairs for the exact similarity.

Defined cases: null or empty text, or text without words, has fingerprint zero and links like any other; rows with a
null id get a fingerprint but a null component and link nothing; very long texts are hashed in parts; ties of a bit's
votes are 0; repeated rows are kept, each with the same component; other columns are ignored; an empty table gives no
rows.  Of a group of near copies the row of the smallest id stays, of equal ids that of the smallest hash of its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import cut, cut_table, in_passes, named, small_batches, table
from inkwell.llm.substrings import BASE, Rolling, mixed, word_hashes

BITS = 64
#: Five bit blocks as (shift, width).
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Rows of a bucket that one group may compare; larger buckets are dealt in chunk pairs.
BUCKET = 1024
#: Rows of one fingerprint above which they meet their component by a broadcast.
HOT_ROWS = 1 << 20
#: Near copies: words of a shingle, least Jaccard similarity, and the SimHash radius that such pairs lie within.
NEAR_WORDS, NEAR, RADIUS = 5, 0.8, 24
#: Bands of least hashes, and hashes of a band: a pair at 0.8 shares one with a chance of 1 - (1 - 0.8 ** 3) ** 12, over 0.9998.
BANDS, ROWS = 12, 3
#: Bytes of the nodes to compare, 32 each, up to which they are broadcast to the texts.
BROADCAST_BYTES = 16 << 20
#: Rows, with their shingles, of a bucket of near copies that one group may compare.
NEAR_BUCKET = 512


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: len(tokens) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(begins, ends[words - 1 :].tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fp long) per row of docs."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["id", "fp"])

    small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(kernel, "id long, fp long").withColumnRenamed("id", id_col)


def bit_planes(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertical planes [64, words] of groups of values, each group padded to whole words; the first word of each group; used lanes a word."""
    words = -(-sizes // 64)
    first = np.cumsum(words) - words
    lanes = np.zeros(int(words.sum()) * 64, np.uint64)
    used = np.zeros(len(lanes), np.uint8)
    own = np.arange(len(values)) - np.repeat(starts, sizes)
    slot = np.repeat(first * 64, sizes) + own
    lanes[slot], used[slot] = values, 1
    bits = np.unpackbits(lanes.view(np.uint8), bitorder="little").reshape(-1, BITS)
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
    return planes, first, np.packbits(used, bitorder="little").view(np.uint64)


def near_lanes(planes: np.ndarray, word: np.ndarray, query: np.ndarray, lanes: np.ndarray, radius: int = 3, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Per (query value, word of 64 lanes): the lanes within radius, for the combinations that have any.

    The counters of all lanes are bit planes as well.  They start so far below a power of two that one difference more
    than radius carries out of the highest plane, into "past", where it stays; after every step planes the combinations
    whose lanes are all past the radius are abandoned.
    """
    alive = np.arange(len(word))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    width = radius.bit_length()
    start = (1 << width) - 1 - radius
    counter = [np.full(len(word), full if start >> k & 1 else np.uint64(0)) for k in range(width)]
    past = ~lanes
    for b in range(BITS):
        carry = planes[b][word] ^ ((query >> np.uint64(b) & np.uint64(1)) * full)
        for k in range(width):
            low = counter[k]
            counter[k], carry = low ^ carry, low & carry
        past = past | carry
        if b % step == step - 1:
            keep = past != full
            if not keep.all():
                alive, word, query, past = (x[keep] for x in (alive, word, query, past))
                counter = [x[keep] for x in counter]
    keep = past != full
    return alive[keep], ~past[keep]


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index linked with each of n items."""
    label = np.arange(n)
    while len(left):
        small = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, small)
        np.minimum.at(label, right, small)
        label = label[label]
        if (label == before).all():
            break
    return label


def near_pairs(values: np.ndarray, sizes: np.ndarray, radius: int = 3, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (item, earlier item of its group) within radius, in runs of bounded size, for groups laid one after the other."""
    starts = np.cumsum(sizes) - sizes
    planes, first, lanes = bit_planes(values, starts, sizes)
    words = -(-sizes // 64)
    each = np.repeat(words, sizes)
    group_first, group_start = np.repeat(first, sizes), np.repeat(starts, sizes)
    at = 0
    ends = np.cumsum(each)
    while at < len(values):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        own = each[at:upto]
        query = np.repeat(np.arange(at, upto), own)
        word = spread_words(group_first[at:upto], own)
        hit, mask = near_lanes(planes, word, values[query], lanes[word], radius)
        bits = np.unpackbits(np.ascontiguousarray(mask).view(np.uint8), bitorder="little").reshape(-1, 64)
        row, lane = np.nonzero(bits)
        q = query[hit[row]]
        other = group_start[q] + (word[hit[row]] - group_first[q]) * 64 + lane
        keep = other < q
        yield q[keep], other[keep]
        at = upto


def linked(values: np.ndarray, sizes: np.ndarray, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Item indices (item, smallest linked item of its group)."""
    pairs = list(near_pairs(values, sizes, radius))
    label = forest(len(values), np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])) if pairs else np.arange(0)
    moved = np.nonzero(label != np.arange(len(label)))[0]
    return moved, label[moved]


def spread_words(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


def by_groups(batches: Iterator[pa.RecordBatch], run: Callable[[pa.Table, np.ndarray], pa.RecordBatch], keys: tuple[str, ...] = ("bucket", "a", "b"), rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """run(table, sizes of its groups) over rows sorted by keys, in tables of whole groups and about the given rows."""

    def changes(part: pa.Table) -> np.ndarray:
        columns = [part.column(c).to_numpy() for c in keys]
        return np.nonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0))[0] + 1

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        part = pa.Table.from_batches(held).combine_chunks()
        change = changes(part)
        whole = int(change[-1]) if len(change) else 0
        if whole:
            yield run(part.slice(0, whole), np.diff(np.concatenate([[0], change])))
        held = part.slice(whole).to_batches()
    part = pa.Table.from_batches(held).combine_chunks() if held else None
    if part is not None and part.num_rows:
        yield run(part, np.diff(np.concatenate([[0], changes(part), [part.num_rows]])))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, a, b, fp, id) sorted by group; out come forest edges (src, dst)."""

    def run(rows: pa.Table, sizes: np.ndarray) -> pa.RecordBatch:
        item, other = linked(rows.column("fp").to_numpy().astype(np.int64).view(np.uint64), sizes)
        ids = rows.column("id").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(ids[item]), pa.array(ids[other])], ["src", "dst"])

    return by_groups(batches, run)


def sized(rows: DataFrame, bucket: int) -> DataFrame:
    """rows of buckets that have several, with chunks, the number of chunks that their bucket is dealt in."""
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return rows.join(sizes.select("bucket", F.ceil(F.col("size") / F.lit(bucket)).cast("int").alias("chunks")), "bucket")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows (bucket, chunks, …) to every pair (a, b) of chunks that theirs is in, sorted by group; key deals rows to chunks."""
    own = F.pmod(F.xxhash64(key), F.col("chunks").cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    out = rows.withColumn("own", own).withColumn("other", other)
    out = out.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")).drop("own", "other", "chunks")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(n, "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", key)


def links(unique: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Forest edges (src, dst) of rows (fp, id) whose fp differ in at most 3 bits; fp and id are unique."""
    keys = []
    for t, ((sa, wa), (sb, wb)) in enumerate(combinations(BLOCKS, 2)):
        a = F.shiftrightunsigned("fp", sa).bitwiseAND((1 << wa) - 1)
        b = F.shiftrightunsigned("fp", sb).bitwiseAND((1 << wb) - 1)
        keys.append(F.lit(t << 26).cast("long") + F.shiftleft(a, 13) + b)
    rows = unique.select("fp", "id", F.explode(F.array(*keys)).alias("bucket"))
    return dealt(sized(rows, bucket), "id").mapInArrow(_compare, "src long, dst long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component = smallest node reachable) for every node on an edge, by alternating star contractions."""
    edges = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = None
    while True:  # each round shortens every path that is no star yet, so it settles
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        state = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fp long, component_id) per row; a component holds all ids reachable over links of at most 3 bits."""
    prints = cut(fingerprints(docs, id_col, text_col, words))
    unique = cut(prints.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("rows")))
    found = components(links(unique.select("fp", "id")))
    own = unique.join(found, unique["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"), "rows")
    own = cut(own)
    # Rows of a hot fingerprint, such as that of all empty texts, don't travel: there are at most all rows / HOT_ROWS of them.
    hot = F.broadcast(own.where(F.col("rows") > HOT_ROWS).drop("rows"))
    rest = prints.join(hot.select("fp"), "fp", "left_anti").join(own.where(F.col("rows") <= HOT_ROWS).drop("rows"), "fp", "left")
    joined = prints.join(hot, "fp").unionByName(rest)
    return joined.select(id_col, "fp", F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))


# ---- near copies by five-word shingles ---------------------------------------------------------------------------

def shingles(texts: list[str | None], words: int = NEAR_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct word shingles of texts, sorted; a text of fewer words is one shingle, one without words has none."""
    low, _, counts = word_hashes([t or "" for t in texts], lower=True)
    sizes = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(texts)), sizes)
    starts = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(np.cumsum(counts) - counts, sizes)
    found = Rolling(low, BASE[0]).of(starts, np.minimum(counts, words)[doc])
    order = np.lexsort((found, doc))
    doc, found = doc[order], found[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
    return doc[new], found[new]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tag, text) to (id, tag, node, fp, bands): a hash of the shingle set, its SimHash, and keys of its least permuted hashes."""
    rng = np.random.default_rng(11)
    spread = rng.integers(0, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, j in in_passes(texts, 4_000_000):
            doc, found = shingles(texts[i:j])
            n = j - i
            begin = np.searchsorted(doc, np.arange(n))
            sizes = np.diff(np.append(begin, len(doc)))
            has = np.nonzero(sizes)[0]
            fp, node = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            bands = np.zeros((n, BANDS), np.uint64)
            if len(has):
                least = np.stack([np.minimum.reduceat((found ^ a) * b, begin[has]) for a, b in spread], axis=1).reshape(len(has), BANDS, ROWS)
                key = np.arange(BANDS, dtype=np.uint64)
                for r in range(ROWS):
                    key = mixed((key * np.uint64(0x9E3779B97F4A7C15)) ^ least[:, :, r])
                bands[has] = key
                for x in has.tolist():
                    own = found[begin[x] : begin[x] + sizes[x]]
                    ones = np.zeros(BITS, np.int64)
                    for k in range(0, len(own), 1 << 16):
                        ones += np.unpackbits(own[k : k + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
                    fp[x] = np.packbits(2 * ones > len(own), bitorder="little").view(np.uint64)[0]
                    node[x] = xxhash.xxh3_64_intdigest(own.tobytes())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, n) for c in ("id", "tag")), pa.array(node.view(np.int64)), pa.array(fp.view(np.int64)), lists], ["id", "tag", "node", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, fp, text) to (node, fp, shingles as bytes)."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, j in in_passes(texts, 4_000_000):
            doc, found = shingles(texts[i:j])
            own = [x.tobytes() for x in np.split(found, np.searchsorted(doc, np.arange(1, j - i)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("node", "fp")), pa.array(own, pa.binary())], ["node", "fp", "shingles"])


def alike(a: np.ndarray, b: np.ndarray, least: float = NEAR) -> bool:
    """Whether two sorted sets have at least that Jaccard similarity."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both >= least * (len(a) + len(b) - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, a, b, node, fp, shingles) sorted by group to forest edges: pairs within RADIUS whose sets are alike.

    A pair that verified links already join is not looked at, so a group of copies costs one comparison a member.
    """

    def run(rows: pa.Table, sizes: np.ndarray) -> pa.RecordBatch:
        nodes, packed = rows.column("node").to_numpy(), rows.column("shingles")
        sets: dict[int, np.ndarray] = {}
        own = lambda i: sets[i] if i in sets else sets.setdefault(i, np.frombuffer(packed[i].as_py(), np.uint64))
        root = list(range(len(nodes)))
        edges: list[tuple[int, int]] = []

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for item, other in near_pairs(rows.column("fp").to_numpy().view(np.uint64), sizes, RADIUS):
            for q, o in zip(item.tolist(), other.tolist(), strict=True):
                x, y = top(q), top(o)
                if x != y and alike(own(q), own(o)):
                    root[max(x, y)] = min(x, y)
                    edges.append((q, o))
        at = np.array(edges, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(nodes[at[:, 0]]), pa.array(nodes[at[:, 1]])], ["src", "dst"])

    return by_groups(batches, run, rows=1 << 13)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tag, text) of the rows with an id; tag is the XXHASH64 of the text."""
    small_batches(docs.sparkSession)
    return docs.select(named(id_col).cast("long").alias("id"), F.xxhash64(named(text_col)).alias("tag"), named(text_col).cast("string").alias("text")).where("id is not null")


def firsts(unique: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, tag): the least row of every component of rows (node, first) under edges between nodes."""
    found = components(edges)
    return unique.join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first")).select("first.id", "first.tag")


def print_firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag): the first row, by id and then tag, of every group of fingerprints linked at 3 or fewer bits."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), pa.array(values.view(np.int64))], ["id", "tag", "fp"])

    prints = keyed(docs, id_col, text_col).mapInArrow(kernel, "id long, tag long, fp long")
    unique = cut(prints.groupBy("fp").agg(F.min(F.struct("id", "tag")).alias("first")).select("fp", F.col("fp").alias("node"), "first"))
    return firsts(unique, links(unique.select("fp", F.col("node").alias("id"))))


def near_sets(rows: DataFrame, unique: DataFrame, shared: DataFrame) -> DataFrame:
    """(node, fp, shingles) of the nodes of shared, one row each, as a table; few nodes are broadcast to the texts."""
    wanted = cut(shared.select("node").distinct().join(unique, "node").select("first.id", "first.tag", "node", "fp"))
    few = wanted.count() * 32 <= BROADCAST_BYTES
    sets = rows.join(F.broadcast(wanted) if few else wanted, ["id", "tag"]).select("node", "fp", "text").mapInArrow(_sets, "node long, fp long, shingles binary")
    return cut_table(sets.dropDuplicates(["node"]))


def near_edges(sets: DataFrame, places: DataFrame) -> DataFrame:
    """Forest edges (src, dst) of alike nodes that share a group (bucket, a, b) of places (node, bucket, a, b)."""
    each = sets.join(places, "node")
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt_rows = each.select("node", "fp", "shingles", "bucket", "a", "b").repartition(n, "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "node")
    return dealt_rows.mapInArrow(_verified, "src long, dst long")


def chunk_of(count: Column) -> Column:
    return F.pmod(F.xxhash64("node"), count.cast("long")).cast("int")


def chunks_for(rows: Column) -> Column:
    return F.ceil(rows / F.lit(NEAR_BUCKET)).cast("int")


def first_places(shared: DataFrame) -> DataFrame:
    """Each row of a bucket in its chunk, and the bucket's leader in all chunks: as many places as rows, and a few."""
    own = chunk_of(F.col("chunks"))
    at = F.when(F.col("node") == F.col("leader"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own))
    return shared.select("node", "bucket", F.explode(at).alias("a")).select("node", "bucket", "a", F.lit(0).alias("b"))


def second_places(shared: DataFrame, found: DataFrame) -> DataFrame:
    """Groups in which every two rows of a bucket of several chunks meet that the first links left in different components.

    Rows outside their leader's component meet all others; the rows inside don't meet each other again, so a group of
    copies costs its rows once more only where a row stands apart from it.
    """
    rows = shared.where("chunks > 1").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    homes = rows.groupBy("bucket").agg(F.max(F.when(F.col("node") == F.col("leader"), F.col("component"))).alias("home"), F.count(F.lit(1)).alias("size"))
    apart = rows.join(homes, "bucket").withColumn("apart", F.col("component") != F.col("home"))
    counts = apart.groupBy("bucket").agg(F.sum(F.col("apart").cast("long")).alias("outside")).where("outside > 0")
    dealt_rows = apart.join(counts, "bucket").withColumn("out", chunks_for(F.col("outside"))).withColumn("in", chunks_for(F.col("size") - F.col("outside")))
    a, b = F.col("in"), F.col("out")
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    inside = F.transform(F.sequence(F.lit(0), b - 1), lambda k: pair(chunk_of(a), k))
    across = F.transform(F.sequence(F.lit(0), a - 1), lambda k: pair(k, chunk_of(b)))
    among = F.transform(F.sequence(F.lit(0), b - 1), lambda k: pair(-1 - F.least(k, chunk_of(b)), F.greatest(k, chunk_of(b))))
    return dealt_rows.select("node", "bucket", F.inline(F.when(F.col("apart"), F.concat(across, among)).otherwise(inside)))


def near_firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag): the first row, by id and then tag, of every group linked by a five-word Jaccard similarity of NEAR or more.

    Equal shingle sets collapse first.  Sets that share a band of least hashes are compared bit-sliced by SimHash within
    RADIUS, then exactly.  A bucket is compared by chunks, each with the bucket's leader; what these links leave apart in
    it is compared in a second turn.
    """
    rows = keyed(docs, id_col, text_col)
    prints = rows.mapInArrow(_sketches, "id long, tag long, node long, fp long, bands array<long>")
    unique = cut(prints.groupBy("node").agg(F.min(F.struct("id", "tag")).alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    each = unique.select("node", F.explode("bands").alias("bucket"))
    members = F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64(F.lit(1), "node"))
    sizes = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("leader"), members[0].alias("x"), members[1].alias("y")).where("size > 1")
    # Of buckets with the same rows, as the bands of near copies mostly are, one is enough.
    sizes = sizes.groupBy("size", "leader", "x", "y").agg(F.min("bucket").alias("bucket"))
    shared = cut(each.join(sizes.select("bucket", "leader", chunks_for(F.col("size")).alias("chunks")), "bucket"))
    sets = near_sets(rows, unique, shared)
    edges = cut(near_edges(sets, first_places(shared)))
    if not shared.where("chunks > 1").isEmpty():
        edges = edges.unionByName(near_edges(sets, second_places(shared, components(edges))))
    return firsts(unique, edges)


def distinct(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that kept (print_firsts or near_firsts of docs) names, once each, and all rows with a null id."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[named(c).alias(o) for c, o in zip(docs.columns, own, strict=True)], named(id_col).cast("long").alias("id"), F.xxhash64(named(text_col)).alias("tag"))
    met = rows.join(kept, ["id", "tag"]).withColumn("nth", F.row_number().over(Window.partitionBy("id", "tag").orderBy("id"))).where("nth = 1")  # of repeated rows any one
    return met.select(*own).unionByName(rows.where("id is null").select(*own)).toDF(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
