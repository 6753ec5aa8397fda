"""Language identification as a mixture over languages.

A language is a distribution over hashed letter trigrams, counted over all labelled training rows.  A document's
trigrams are taken as drawn from an unknown mixture of languages; expectation-maximisation estimates the proportions,
and the set of languages is the one of the nested sets (largest proportions first) with the best likelihood less a
penalty per language (BIC).  All documents of a batch go through the iterations together as flat arrays.

The model is LANGUAGES x BUCKETS numbers, whatever the corpus size; it is counted with map-side sums and broadcast.

Defined cases: null text or text without letters is "und" with score 0; rows with null language or null text teach
nothing; repeated rows are predicted each (and counted each in training); without training rows all is "und"; very long
texts are read whole, each in a pass of its own; of equally likely languages the first by name is taken; an empty table
gives no rows; columns other than id, text and language are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import code_points, cut, in_passes, small_batches, table
from inkwell.llm.packing import LETTER, point_classes

BUCKETS = 1 << 16
#: Added to every count of the model.
SMOOTHING = 0.5
ROUNDS = 12
#: Log-likelihood that each further language must bring, as a multiple of log(trigrams) / 2.
PENALTY = 2.0
UNKNOWN = "und"
#: Code points of a pass, and code points times languages, which bound the arrays of a pass.
PASS_POINTS, PASS_CELLS = 500_000, 8_000_000
#: Languages up to which the model is gathered and broadcast, at half a MB each; more are an error, never left out.
MOST_LANGUAGES = 500


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) of the hashed trigrams around every letter of texts."""
    points = code_points(" " + " ".join((t or "").lower() for t in texts) + " ")
    letter = point_classes()[points] == LETTER
    lengths = np.array([len((t or "").lower()) + 1 for t in texts], np.int64)
    signs = np.where(letter, points, 0).astype(np.uint64)
    middle = np.nonzero(letter)[0]
    mixed = signs[middle - 1] * np.uint64(0x9E3779B97F4A7C15) + signs[middle] * np.uint64(0xC2B2AE3D27D4EB4F) + signs[middle + 1] * np.uint64(0x165667B19E3779F9)
    bucket = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)
    doc = np.searchsorted(np.cumsum(lengths), middle - 1, "right")
    key, count = np.unique(doc * BUCKETS + bucket.astype(np.int64), return_counts=True)
    return key // BUCKETS, key % BUCKETS, count


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all rows that have both a text and a language."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in in_passes(texts):
                doc, bucket, count = trigrams(texts[i:j])
                names, own = np.unique(np.array(langs[i:j], object).astype(str), return_inverse=True)
                for k, name in enumerate(names.tolist()):
                    mine = own[doc] == k
                    sums.setdefault(name, np.zeros(BUCKETS)).__iadd__(np.bincount(bucket[mine], count[mine], BUCKETS))
        for name, total in sums.items():
            used = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used].astype(np.int64))], ["lang", "bucket", "n"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    return rows.mapInArrow(kernel, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def model(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram probabilities [language, bucket]; the table has BUCKETS rows a language at most."""
    counts = cut(counts)
    found = counts.select("lang").distinct().count()
    if found > MOST_LANGUAGES:
        raise ValueError(f"{found} languages are more than {MOST_LANGUAGES}; give the language column fewer values")
    packed = counts.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).orderBy("lang").toArrow()
    names = packed.column("lang").to_pylist()
    out = np.full((len(names), BUCKETS), SMOOTHING)
    for k, (bucket, n) in enumerate(zip(packed.column("bucket").to_pylist(), packed.column("n").to_pylist(), strict=True)):
        out[k, bucket] += n
    return names, out / out.sum(axis=1, keepdims=True) if len(names) else out


def maximised(likely: np.ndarray, count: np.ndarray, begin: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares [document, language] after expectation-maximisation, and the log-likelihoods; zero shares stay zero."""
    sizes = np.diff(np.append(begin, len(count)))
    total = np.add.reduceat(count, begin)[:, None]
    spread = lambda s: np.repeat(s, sizes, axis=0)
    for _ in range(rounds):
        each = spread(share)
        joint = each * likely
        weight = count / np.maximum(joint.sum(axis=1), 1e-300)
        share = np.add.reduceat(joint * weight[:, None], begin, axis=0) / total
    joint = (spread(share) * likely).sum(axis=1)
    return share, np.add.reduceat(count * np.log(np.maximum(joint, 1e-300)), begin)


def proportions(texts: list[str | None], probability: np.ndarray) -> np.ndarray:
    """Shares [document, language] of the chosen language set of every text; a row of zeros where there is no letter."""
    out = np.zeros((len(texts), len(probability)))
    doc, bucket, count = trigrams(texts)
    if not len(doc) or not len(probability):
        return out
    begin = np.nonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))[0]
    has = doc[begin]
    count = count.astype(float)
    likely = probability[:, bucket].T
    total = np.add.reduceat(count, begin)
    full, _ = maximised(likely, count, begin, np.full((len(has), len(probability)), 1 / len(probability)), ROUNDS)
    order = np.argsort(-full, axis=1, kind="stable")
    best, best_share = np.full(len(has), -np.inf), np.zeros_like(full)
    most = np.add.reduceat(count * np.log(np.maximum(likely.max(axis=1), 1e-300)), begin)  # no mixture is likelier
    for k in range(1, len(probability) + 1):
        penalty = PENALTY * (k - 1) * np.log(np.maximum(total, 2)) / 2
        if (most - penalty <= best).all():
            break
        inside = np.zeros(full.shape, bool)
        np.put_along_axis(inside, order[:, :k], True, axis=1)
        start = np.where(inside, full + 1e-6, 0)
        share, fit = maximised(likely, count, begin, start / start.sum(axis=1, keepdims=True), ROUNDS // 3 if k > 1 else 0)
        fit -= penalty
        better = fit > best
        best[better], best_share[better] = fit[better], share[better]
    out[has] = best_share
    return out


def identified(docs: DataFrame, names: list[str], probability: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, languages map<string, double>) per row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((names, probability.astype(np.float64)))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, probability = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            share = [proportions(texts[i:j], probability) for i, j in in_passes(texts, max(1, min(PASS_POINTS, PASS_CELLS // max(1, len(names)))))]
            predicted, score, sets = [], [], []
            for row in np.concatenate(share) if share else ():
                top = int(row.argmax()) if len(row) else 0
                sure = float(row[top]) if len(row) else 0.0
                predicted.append(names[top] if sure > 0 else UNKNOWN)
                score.append(min(1.0, sure))
                sets.append([(names[k], float(row[k])) for k in np.nonzero(row)[0]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(predicted, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))], ["id", "lang_pred", "score", "languages"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(kernel, "id long, lang_pred string, score double, languages map<string, double>").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    names, probability = model(counted(docs.where(~held_out())))
    return identified(docs, names, probability).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_languages": op9_languages}
