"""Runs: maximal stretches of words that repeat with a period, found by Lyndon arrays over ordered words.

Every run of exponent three or more holds a Lyndon root, of an order of the words or of its reverse, that ends where the
next smaller suffix begins.  For both orders one pass from left to right keeps the chain of previous smaller suffixes and,
for every suffix compared, how far it matched.  Matches are not made again: a pair of suffixes inside the stretch that
was matched last takes the extension of its copy, a pair along the chain takes the lesser of two known extensions, and
only words beyond what is matched are compared.  Words are compared by order only; there are no suffix arrays or trees
and no hashes of stretches.

A word of a run stands in it three times or more.  So a text is first cut at words that it holds less than three times,
and pieces again while that shortens them; the passes run over what is left, which in prose is a few per cent.

Defined cases: null and empty text, and text without words, has no runs; very long texts are read whole, in one row, in
memory in proportion to their length; runs may overlap and nest, each counts; of runs of equal exponent the first by
start and then by period comes first; repeated rows are answered each; other columns pass through, but for those of the
result's own names, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import let, named, small_batches, table
from inkwell.llm.quality import words_of

#: Words that a run has at least, and times its period.
LEAST, EXPONENT = 24, 3


def next_smaller(w: list[int]) -> tuple[list[int], list[int], int]:
    """For each suffix of w the place of the next smaller one (the end, if none) and how far both match; words compared beyond the first."""
    n = len(w)
    after, match = [n] * n, [0] * n  # the next smaller suffix, and the match with it
    before, prior = [-1] * n, [0] * n  # the previous smaller suffix, and the match with it
    start = end = shift = compared = 0  # w[start:end] is known to equal the stretch shift before it
    for r in range(1, n):
        c, j, from_, length = w[r], r - 1, -1, 0
        while j >= 0:
            v = w[j]
            if v != c:
                length = 0
                if v < c:
                    break
            else:
                known, settled = 1, False
                if from_ >= 0:
                    m = prior[from_]
                    settled = m != length
                    known = min(m, length) if settled else max(m, 1)
                if not settled and r < end:
                    if j == r - shift:
                        known = max(known, end - r)
                    elif j >= start:
                        i, k = j - shift, r - shift
                        copy = match[i] if after[i] == k else prior[k] if before[k] == i else 0
                        settled = 0 < copy < end - r
                        known = copy if settled else max(known, min(copy, end - r))
                length = known
                if not settled:
                    a, b = j + length, r + length
                    while b < n and w[a] == w[b]:
                        a += 1
                        b += 1
                    compared += b - r - length + 1
                    length = b - r
                    if b > end:
                        start, end, shift = r, b, r - j
                if r + length < n and w[j + length] < w[r + length]:
                    break
            after[j], match[j] = r, length
            from_, j = j, before[j]
        before[r], prior[r] = j, length if j >= 0 else 0
    return after, match, compared


def runs_of(w: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of w with at least that length and exponent (three or more), sorted by start and period."""
    n, found = len(w), {}
    for order in (w, [-x for x in w]):
        after, match, _ = next_smaller(order)
        for i in range(n):
            q = after[i] - i
            if match[i] >= q and (key := (q, after[i] + match[i])) not in found:
                found[key] = i  # of the run's roots the leftmost, so its start is less than a period before
    out = set()
    for (q, end), i in found.items():
        start = i
        while start and w[start - 1] == w[start - 1 + q]:
            start -= 1
        if end - start >= max(least, exponent * q):
            out.add((start, end - start, q))
    return sorted(out, key=lambda x: (x[0], x[2]))


def stretches(words: list[bytes], least: int = LEAST, times: int = EXPONENT) -> list[tuple[int, int]]:
    """(begin, end) of the pieces of words that may hold runs; a neighbour of a piece never extends a run in it."""
    out, held = [], [(0, len(words))]
    common = re.compile(b"\x01{%d,}" % least)
    while held:
        begin, end = held.pop()
        piece = words[begin:end]
        counts = Counter(piece)
        often = {x for x, c in counts.items() if c >= times}
        found = [m.span() for m in common.finditer(bytes(map(often.__contains__, piece)))]
        left = sum(b - a for a, b in found)
        settled = 8 * left > 7 * len(piece)  # cut again only while it pays, so that all cuts cost time in proportion
        (out if settled else held).extend((begin + a, begin + b) for a, b in found)
    return sorted(out)


def text_runs(words: list[bytes], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of words, by start and then period."""
    out = []
    for begin, end in stretches(words, least, exponent):
        piece = words[begin:end]
        rank = {x: i for i, x in enumerate(dict.fromkeys(piece))}
        out += [(begin + s, length, q) for s, length, q in runs_of([rank[x] for x in piece], least, exponent)]
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside runs and in the first period of theirs, joined by one space."""
    kept, at = [], 0
    for begin, end in sorted((s + q, s + length) for s, length, q in runs):
        if begin > at:
            kept += words[at:begin]
        at = max(at, end)
    return b" ".join(kept + words[at:])


RUN = "struct<start: bigint, length: bigint, period: bigint>"


def periodic(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", out_col: str = "collapsed", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """docs with the runs of a text, an array of (start, length, period) in words, and the text in which each run keeps its first period."""
    if least < 1 or exponent < 3:
        raise ValueError("runs need a length of one or more and an exponent of three or more")
    own = [c for c in docs.columns if c.lower() not in (runs_col.lower(), out_col.lower())]
    fields = [docs.schema[c].dataType.simpleString() for c in own]
    schema = ", ".join(f"c{i} {kind}" for i, kind in enumerate(fields)) + f", r array<{RUN}>, t string"
    names = [f"c{i}" for i in range(len(own))] + ["r", "t"]
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for text in batch.column(batch.num_columns - 1):
                words = (text.as_py() or "").encode().split()
                runs = text_runs(words, least, exponent) if len(words) >= least else []
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                texts.append(collapse(words, runs).decode())
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(kind)), pa.array(texts, pa.string())], names)

    small_batches(docs.sparkSession)
    picked = docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(own)], named(text_col).cast("string").alias("t"))
    return picked.mapInArrow(kernel, schema).toDF(*own, runs_col, out_col)


def strongest(runs: Column) -> Column:
    """The run of greatest exact exponent, the first of several; null if there is none."""
    more = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, F.get(runs, 0), lambda best, r: F.when(more(best, r), r).otherwise(best))


def with_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by the CRC of its id, gets a periodic tail of its own words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def tailed(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10).cast("long")

        def repeated(x: Column) -> Column:
            a, p = x["a"], F.lit(1) + F.floor((n - x["a"]) / (F.lit(3) + g % 8)).cast("long")
            return let(p, lambda p: F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))))

        return let(F.struct((g % n).alias("a")), lambda x: F.array_join(repeated(x), " "))

    planted = let(words_of(F.col("text")), lambda words: F.when(F.size(words) > 0, tailed(words)).otherwise(F.lit("")))
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic(with_tails(table(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# Runs are beyond SQL over whole texts; tests/llm/test_periodic.py holds them against a plain search over all periods.
QUERIES = {"op11_periodic_runs": op11_periodic_runs}
