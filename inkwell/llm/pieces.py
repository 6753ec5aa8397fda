"""Merge-type (BPE) sentence pieces: exact encoding by backtracking, and decoding.

A merge tokenizer's result is the one sequence of pieces in which every two neighbours are what re-merging their joint
text gives.  So a segment is encoded left to right: take the longest piece that an Aho-Corasick automaton over the
vocabulary found at this place, check it against the piece before by re-merging the pair, fall back to shorter pieces,
and step back when none goes on; a bitfield keeps the places that are known to lead nowhere, so each is tried once.

Pieces never hold a blank mark after another sign, so text splits before runs of blank marks; signs outside the
vocabulary merge with nothing, stand alone, and become byte pieces.  Segments recur, so a worker remembers their ids.

Defined cases: null or empty text has the begin and end ids only; repeated rows are encoded each; columns other than id
and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import PooledIds, code_points, flattened, in_passes, segments_of, small_batches, table

BLANK = "▁"


def merged(text: str, ids: dict[str, int], score: dict[str, float]) -> list[str]:
    """Pieces of text by the merge rule itself: join the best-scored neighbours, the left ones first, until none joins."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            joint = parts[i] + parts[i + 1]
            if joint in ids and (best is None or score[joint] > best):
                best, at = score[joint], i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class MergePieces:
    """The encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end = model.bos_id(), model.eos_id()
        every = range(model.get_piece_size())
        plain = [i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("pieces with a blank mark inside are not supported")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if merged(piece, self.ids, self.score) == [piece]:  # others are never the result of merging
                self.automaton.add_word(piece, (i, piece, len(piece) - 1))
        self.automaton.make_automaton()
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(p) for p in self.ids if len(p) == 1]] = True
        self.pairs: dict[int, bool] = {}
        self.pool = PooledIds(lambda parts: flattened([self.segment(p) for p in parts]), most=800_000)

    def compatible(self, left: tuple[int, str, int], right: tuple[int, str, int]) -> bool:
        """Whether two neighbours come out of merging their joint text again; remembered by their ids."""
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        got = self.pairs[left[0] << 32 | right[0]] = merged(left[1] + right[1], self.ids, self.score) == [left[1], right[1]]
        return got

    def segment(self, text: str) -> list[int]:
        """Ids of a segment: signs of the vocabulary only, or one sign outside it."""
        if len(text) == 1 and text not in self.ids:
            return [self.bytes[b] for b in text.encode()]
        n = len(text)
        found: list[list] = [[] for _ in range(n)]  # pieces by start; matches come by their end, so the shortest first
        for end, value in self.automaton.iter(text):
            found[end - value[2]].append(value)
        open_ = (1 << (n + 1)) - 1 if n < 64 else bytearray(b"\x01" * (n + 1))
        small = n < 64
        out: list[tuple[int, str, int]] = []
        tried: list[int] = []  # how many pieces of each place are still untried
        known = self.pairs.get
        at, own, before = 0, found[0], -1
        left = len(own)
        while at < n:
            while left:
                left -= 1
                value = own[left]
                end = at + value[2] + 1
                if open_ >> end & 1 if small else open_[end]:
                    fits = True
                    if before >= 0:
                        fits = known(before | value[0])
                        if fits is None:
                            fits = self.compatible(out[-1], value)
                    if fits:
                        out.append(value)
                        tried.append(left)
                        at, before = end, value[0] << 32
                        own = found[at] if at < n else own
                        left = len(own)
                        break
            else:
                if small:
                    open_ &= ~(1 << at)
                else:
                    open_[at] = 0
                if not out:
                    raise ValueError(f"no piece sequence for {text[:50]!r}")
                at -= out.pop()[2] + 1
                own, left, before = found[at], tried.pop(), out[-1][0] << 32 if out else -1
        return [v[0] for v in out]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text with begin and end ids."""
        for start, stop in in_passes(texts):
            part = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts[start:stop]]
            joined = "".join(part)
            points = code_points(joined)
            ends = np.cumsum([len(t) for t in part])
            if len(points):
                blank, odd = points == 0x2581, ~self.known[points]
                begin = np.ones(len(points), bool)
                begin[1:] = (blank[1:] & ~blank[:-1]) | odd[1:] | odd[:-1]
                begin[ends[:-1][ends[:-1] < len(points)]] = True
                begins = np.nonzero(begin)[0]
            else:
                begins = np.zeros(0, np.int64)
            ids, counts = self.pool.lookup(segments_of(joined, points, begins))
            total = np.concatenate([[0], np.cumsum(counts)])
            bounds = total[np.searchsorted(begins, ends)]
            for own in np.split(ids, bounds[:-1]):
                yield np.concatenate([[self.begin], own, [self.end]]).astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist())


@cache
def pieces(path: str) -> MergePieces:
    return MergePieces(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>, decoded string) per row of docs."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            ids = list(model.encode(batch.column(1).to_pylist()))
            decoded = [model.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(kernel, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of what encoded() gives, without carrying the ids out of Python."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            count, of_ids, of_text = [], [], []
            for ids in model.encode(batch.column(1).to_pylist()):
                count.append(len(ids))
                of_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
                of_text.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(kernel, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op3_pieces": op3_pieces}
