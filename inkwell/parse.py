"""Documents to flat tables of blocks, inlines, references and lines.

The grammar runs per document in an Arrow-batched kernel; what it gives is one row a document, from which the flat
tables are exploded.  parse() should be written once (kept(), save(), or persist() where it is small) when several tables are read;
filters on documents belong before parse(), since they don't pass a kernel.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from inkwell.kernel.blocks import BlockParser, Options, ParseLimit, code_of, language_of
from inkwell.kernel.inlines import InlineParser, label_key, plain, walk
from inkwell.kernel.slugs import Slugs, slug_base

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


RANGE = _struct(start=_I, end=_I)
BLOCK = _struct(
    pre=_I, last_pre=_I, depth=_I, parent_pre=_I, sibling=_I, kind=_S, start=_I, end=_I, level=_I, ordered=_B, loose=_B, start_number=_I, marker=_S, task_state=_S, info=_S,
    language=_S, code=_S, fence_closed=_B, html=_S, html_type=_I, alert_type=_S, label_key=_S, fence=_S, content=_S, text=_S, fold=_S, slug=_S, own=_S, header=T.ArrayType(_S), align=T.ArrayType(_S),
    rows=T.ArrayType(T.ArrayType(_S)), row_ranges=T.ArrayType(RANGE), content_ranges=T.ArrayType(RANGE),
    ext=T.MapType(_S, _S), lines=_struct(start=_I, text_end=_I, end=_I, cut_start=_I, cut_end=_I), eol=_S,
)
INLINE = _struct(block_pre=_I, inline_ord=_I, depth=_I, kind=_S, start=_I, end=_I, text=_S, destination=_S, title=_S, bracketed=_B, ref_label=_S, label_end=_I)
REFERENCE = _struct(label_key=_S, destination=_S, title=_S, block_pre=_I, used=_B)
ERROR = _struct(kind=_S, limit=_I, attempted=_I, offset=_I)
TEXT_KINDS = ("paragraph", "atx-heading", "setext-heading", "description-term")


HEADINGS = ("atx-heading", "setext-heading")
CODE = ("fenced-code", "indented-code")
LINES = BLOCK["lines"].dataType.names
#: Kinds whose rows carry their source: whole, or the first line of an item, or the first and last line of fenced code.
OWN = frozenset(("frontmatter:block", "atx-heading", "setext-heading", "link-reference-definition", "gfm:table", "list-item", "fenced-code"))


def own_source(text: str, block) -> str:
    if block.kind not in ("list-item", "fenced-code"):
        return text[block.start : block.end]
    stop = min((i for i in (text.find("\n", block.start, block.end), text.find("\r", block.start, block.end)) if i >= 0), default=block.end)
    first = text[block.start : stop]
    if block.kind == "list-item" or stop == block.end:
        return first
    return first + "\n" + text[max(text.rfind("\n", stop, block.end), text.rfind("\r", stop, block.end)) + 1 : block.end]


#: Most documents, and most bytes of sources, whose rows a worker holds at once.
PASS_DOCUMENTS, PASS_BYTES = 200, 1 << 17

REST = re.compile(r"[^\r\n]*")
EOL = re.compile(r"\r\n|\r|\n")


def whole_lines(text: str, block) -> tuple[int, int, int, int, int]:
    """Where the lines of a root block begin, where their text and where they end, and what goes with the block.

    With a block goes its blank line before, or at the start of the text the one after it.
    """
    first = int(text.startswith("\ufeff"))
    start, stop = block.start, block.end
    while start > first and text[start - 1] in " \t":
        start -= 1
    if stop > start and text[stop - 1] in "\r\n":
        end, stop = stop, stop - (2 if text[stop - 2 : stop] == "\r\n" else 1)
    else:
        stop = REST.match(text, stop).end()
        after = EOL.match(text, stop)
        end = after.end() if after else stop

    def eol_before(at: int) -> int:
        return at - 2 if text[max(first, at - 2) : at] == "\r\n" else at - 1 if at > first and text[at - 1] in "\r\n" else -1

    before = eol_before(start)
    if start > first and before >= 0 and eol_before(before) >= 0:
        return start, stop, end, before, end
    after = EOL.match(text, end) if start == first else None
    return start, stop, end, start, after.end() if after else end


class Places:
    """Code points of a text to bytes of its source."""

    def __init__(self, text: str):
        self.of = None
        if not text.isascii():
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            width[(points >= 0xDC80) & (points <= 0xDCFF)] = 1  # a byte that is no UTF-8
            self.of = [0, *np.cumsum(width).tolist()]

    def __call__(self, i: int) -> int:
        return i if self.of is None else self.of[min(i, len(self.of) - 1)]


def _clean(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    return text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


@dataclass(frozen=True)
class Wanted:
    """Which rows and fields a parse gives: fields of blocks and kinds of inlines (None: all), and most blocks a row of the result (None: one row a document)."""

    fields: tuple[str, ...] | None = None
    inline_kinds: tuple[str, ...] | None = None
    part: int | None = None

    def __post_init__(self) -> None:
        if bad := [f for f in self.fields or () if f not in BLOCK.names]:
            raise ValueError(f"unknown fields {bad}")

    def __contains__(self, field: str) -> bool:
        return self.fields is None or field in self.fields

    def block(self) -> T.StructType:
        return T.StructType([f for f in BLOCK if f.name in self])


def document_rows(source: bytes | None, options: Options, with_inlines: bool = True) -> dict:
    """blocks, inlines, refs and parse_error of one document."""
    return next(document_parts(source, options, with_inlines))


def document_parts(source: bytes | None, options: Options, with_inlines: bool = True, wanted: Wanted | None = None) -> Iterator[dict]:
    """blocks, inlines, refs and parse_error of one document, in parts of wanted.part blocks; the last one has the refs."""
    empty = {"blocks": None, "inlines": None, "refs": None, "parse_error": None}
    if source is None:
        yield empty
        return
    original = source.decode("utf-8", "surrogateescape")
    text, place = original.replace("\0", "�"), Places(original)
    try:
        if options.source_bytes is not None and len(source) > options.source_bytes:
            raise ParseLimit("source-bytes", options.source_bytes, len(source), 0)
        parser = BlockParser(text, options)
        root = parser.parse()
        yield from _rows(text, parser, root, place, options, with_inlines, wanted or Wanted())
    except ParseLimit as stop:
        yield empty | {"parse_error": {"kind": stop.kind, "limit": stop.limit, "attempted": stop.attempted, "offset": place(stop.offset)}}


def inline_row(pre: int, i: int, level: int, node, nodes: InlineParser, place: Places) -> dict:
    if node.kind == "text":  # most are, and have a text only
        return {"block_pre": pre, "inline_ord": i, "depth": level, "kind": "text", "start": place(nodes.place(node.start)), "end": place(nodes.place(node.end)), "text": _clean(node.text), "bracketed": node.bracketed}
    return {
        "block_pre": pre, "inline_ord": i, "depth": level, "kind": node.kind, "start": place(nodes.place(node.start)), "end": place(nodes.place(node.end)),
        "text": _clean(plain(node.children) if node.children or node.kind in ("link", "image") else node.text), "destination": _clean(node.destination), "title": _clean(node.title),
        "bracketed": node.bracketed, "ref_label": _clean(node.ref_label), "label_end": None if node.label_end is None else place(nodes.place(node.label_end)),
    }


def _rows(text: str, parser: BlockParser, root, place: Places, options: Options, with_inlines: bool, wanted: Wanted) -> Iterator[dict]:
    # Notes get the text of later blocks, and a document beyond its inlines has no rows at all: both stay whole.
    most = None if options.footnotes or options.inlines is not None else wanted.part
    kinds = wanted.inline_kinds if wanted.inline_kinds is None else frozenset(wanted.inline_kinds)
    blocks, inlines, order = [], [], [(root, 0, -1, 0)]
    pre_of = dict.fromkeys(id(v["block"]) for v in parser.references.values())
    stack = [(iter(enumerate(root.children)), 0)]
    while stack:
        children, parent = stack[-1]
        sibling, block = next(children, (0, None))
        if block is None:
            stack.pop()
            continue
        mine = len(order)
        order.append((block, len(stack), parent, sibling))
        if id(block) in pre_of:
            pre_of[id(block)] = mine
        if block.children:
            stack.append((iter(enumerate(block.children)), mine))
    last = list(range(len(order)))
    for i in range(len(order) - 1, 0, -1):
        last[order[i][2]] = max(last[order[i][2]], last[i])
    total, slugs = 0, Slugs()
    for pre, (block, depth, parent, sibling) in enumerate(order):
        data, kind = block.data, block.kind
        if most and len(blocks) >= most:
            yield {"blocks": blocks, "inlines": inlines if with_inlines else None, "refs": None, "parse_error": None}
            blocks, inlines = [], []
        row = {"pre": pre, "last_pre": last[pre], "depth": depth, "parent_pre": parent, "sibling": sibling, "kind": kind, "start": place(block.start), "end": place(block.end), "level": block.level}
        if kind in OWN and "own" in wanted:
            row["own"] = _clean(own_source(text, block))
        if depth == 1 and "lines" in wanted:
            row["lines"] = dict(zip(LINES, map(place, whole_lines(text, block)), strict=True))
        if (depth == 1 or kind in CODE) and "eol" in wanted:
            found = EOL.search(text, block.start, min(len(text), block.end + 2))
            row["eol"] = found[0] if found else "\n"
        if kind == "footnote:definition":
            row["label_key"] = label_key(data["state"]["label"])
        if "state" in data:
            row["ext"] = [(k, str(v)) for k, v in data["state"].items()]
        elif "ext" in data:
            row["ext"] = list(data["ext"].items())
        if block.pieces and "content_ranges" in wanted:
            row["content_ranges"] = [{"start": place(a), "end": place(b)} for a, b, _ in block.pieces]
        if kind == "list":
            row |= {"ordered": data["ordered"], "loose": data["loose"], "start_number": data["start"], "marker": data["signature"]}
        elif kind == "list-item":
            row["task_state"] = data.get("task")
        elif kind in CODE:
            row["code"] = _clean(code_of(text, block))
            if kind == "fenced-code":
                row |= {"info": _clean(data["info"]), "language": _clean(language_of(data["info"])), "fence_closed": data["closed"], "fence": data["mark"]}
        elif kind == "html-block":
            row |= {"html": _clean(code_of(text, block)[:-1]), "html_type": data["type"]}
        elif kind == "github:alert":
            row["alert_type"] = data["alert"]
        elif kind == "link-reference-definition":
            row["label_key"] = _clean(data["key"])
        elif kind == "frontmatter:block":
            row |= {"fence": data["fence"], "content": _clean(data["content"])}
        elif kind == "gfm:table":
            cells = lambda spans: [_clean(text[a:b]).replace("\\|", "|") for a, b in spans]
            row |= {"header": cells(data["header"]), "align": data["align"], "rows": [cells(r) for r in data["rows"]]}
            if options.footnotes and with_inlines:  # uses of notes count wherever they stand
                spans = [x for r in (data["header"], *data["rows"]) for x in r]
                noted = [(p, node) for p in (InlineParser(text, [(a, b, 0)], parser.references, options) for a, b in spans) for node, _ in walk(p.parse()) if node.kind == "footnote:reference"]
                inlines += [inline_row(pre, i, 0, node, p, place) for i, (p, node) in enumerate(noted, 1) if kinds is None or node.kind in kinds]
            row["row_ranges"] = [{"start": place(r[0][0]) if r else place(block.start), "end": place(r[-1][1]) if r else place(block.start)} for r in data["rows"]]
        elif kind in TEXT_KINDS and with_inlines:
            nodes = InlineParser(text, block.pieces, parser.references, options)
            found = nodes.parse()
            row["text"] = _clean(found[0].text if len(found) == 1 and found[0].kind == "text" else plain(found))
            if kind in HEADINGS:
                row["fold"] = row["text"].strip().casefold()
                row["slug"] = slugs.next(slug_base(row["fold"]))
            for i, (node, level) in enumerate(walk(found), 1):
                total += 1
                if options.inlines is not None and total > options.inlines:
                    raise ParseLimit("inline-count", options.inlines, total, block.start)
                if kinds is None or node.kind in kinds:
                    inlines.append(inline_row(pre, i, level, node, nodes, place))
        blocks.append(row)
    for row in blocks:
        if row["kind"] == "footnote:definition":  # a note's text is that of its blocks
            row["text"] = "\n\n".join(x["text"] for x in blocks[row["pre"] + 1 : row["last_pre"] + 1] if x.get("text"))
    refs = [{"label_key": _clean(k), "destination": _clean(v["destination"]), "title": _clean(v["title"]), "block_pre": pre_of.get(id(v["block"])), "used": v["used"]} for k, v in parser.references.items()]
    yield {"blocks": blocks, "inlines": inlines if with_inlines else None, "refs": refs, "parse_error": None}


def _small_batches(spark: SparkSession, rows: int = 1000, size: int = 1 << 22) -> None:
    """Arrow batches of few rows and bytes on their way to the kernel, since a row is a whole document."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        held = re.fullmatch("([0-9]+)b?", spark.conf.get(key))
        if not held or not 0 < int(held[1]) <= most:
            spark.conf.set(key, str(most))


def _passes(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of documents of these bytes that are worked on together."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > PASS_BYTES or i - start >= PASS_DOCUMENTS):
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def parse(
    docs: DataFrame, profile: str = "github", id_col: str = "doc_id", source_col: str = "source", with_inlines: bool = True, mode: str = "PERMISSIVE",
    fields: tuple[str, ...] | None = None, inline_kinds: tuple[str, ...] | None = None, part: int | None = None, **limits,
) -> DataFrame:
    """(doc_id, source binary, blocks, inlines, refs, parse_error), one row a document.

    limits: nesting, blocks, inlines, references, source_bytes; footnotes=True makes [^labels] notes and their uses;
    block_rules and inline_parsers are further syntax.  A document beyond one has null children and a
    parse_error; mode FAILFAST raises instead.  with_inlines=False skips all inline work.

    Columns can't be pruned through a kernel, so fields names the fields of blocks and inline_kinds the kinds of inlines
    that are wanted.  With part, a document of more blocks than that takes several rows, of which one has the source:
    the flat tables are the same, and no row holds all of a very long document.
    """
    options, wanted = Options.profile(profile, **limits), Wanted(fields, inline_kinds, part)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("source", T.BinaryType()), T.StructField("blocks", T.ArrayType(wanted.block())), T.StructField("inlines", T.ArrayType(INLINE)), T.StructField("refs", T.ArrayType(REFERENCE)), T.StructField("parse_error", ERROR)])
    arrow = to_arrow_schema(schema)
    children = ("blocks", "inlines", "refs", "parse_error")
    _small_batches(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(ids: pa.Array, sources: pa.Array, rows: list[dict]) -> pa.RecordBatch:
            if mode == "FAILFAST" and (bad := next((r["parse_error"] for r in rows if r["parse_error"]), None)):
                raise ValueError(f"parse limit: {bad}")
            return pa.RecordBatch.from_arrays([ids, sources, *(pa.array([r[c] for r in rows], arrow.field(c).type) for c in children)], schema=arrow)

        for batch in batches:
            for start, stop in _passes(pc.binary_length(batch.column(1)).fill_null(0).to_pylist()):
                ids, sources = batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start)
                if part is None:
                    yield made(ids, sources, [next(document_parts(s, options, with_inlines, wanted)) for s in sources.to_pylist()])
                    continue
                for i, source in enumerate(sources.to_pylist()):
                    own = sources.slice(i, 1)
                    for rows in document_parts(source, options, with_inlines, wanted):
                        yield made(ids.slice(i, 1), own, [rows])
                        own = pa.nulls(1, own.type)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("binary").alias("source")).mapInArrow(kernel, schema)


def kept(parsed: DataFrame) -> DataFrame:
    """parsed, written once as a compressed table into the folder that driver and executors share.

    Tables read of it load only their own columns; as a cache, rows of whole documents fill the executors' memory, travel
    between them, and are made anew where two stages begin at once.  Row groups are small, since few rows hold much.
    """
    spark = parsed.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="inkwell-checkpoint-"))
    path = f"{context.getCheckpointDir()}/parsed-{uuid.uuid4().hex}"
    parsed.write.option("compression", "zstd").option("parquet.block.size", 1 << 24).parquet(path)
    return spark.read.schema(parsed.schema).parquet(path)


def blocks(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.inline("blocks"))


def inlines(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.inline("inlines"))


def references(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.inline("refs"))


def save(parsed: DataFrame, path: str) -> None:
    """Flat Parquet tables under path, sorted by document so that its row groups prune."""
    for name, flat in (("blocks", blocks(parsed)), ("inlines", inlines(parsed)), ("refs", references(parsed))):
        flat.sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/{name}")


def lines(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(doc_id, line_no, start, content_end, line_end, eol, text): lines of sources with byte offsets, as native expressions."""
    from pyspark.sql.window import Window

    text = F.col(source_col).cast("string")
    bom = text.startswith("﻿")
    body = F.when(bom, F.expr(f"substring(cast({source_col} as string), 2)")).otherwise(text)
    pieces = F.split(body, "\r\n|\r|\n", -1)
    ends = F.concat(F.regexp_extract_all(body, F.lit("\r\n|\r|\n"), F.lit(0)), F.array(F.lit("")))
    each = docs.select(F.col(id_col).alias("doc_id"), F.when(bom, 3).otherwise(0).alias("bom"), F.posexplode(F.arrays_zip(pieces.alias("t"), ends.alias("e"))).alias("line_no", "l"))
    each = each.select("doc_id", "bom", "line_no", F.col("l.t").alias("text"), F.col("l.e").alias("eol")).where("text <> '' or eol <> ''")
    width = F.octet_length("text") + F.octet_length("eol")
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("bom") + F.coalesce(F.sum(width).over(before), F.lit(0))
    out = each.withColumn("start", start.cast("int"))
    return out.select("doc_id", "line_no", "start", (F.col("start") + F.octet_length("text")).cast("int").alias("content_end"), (F.col("start") + width).cast("int").alias("line_end"), "eol", "text")


def latin(data: Column) -> Column:
    """Bytes as text of a code point each, whatever they encode, for string functions that must not lose any."""
    return F.decode(data.cast("binary"), "ISO-8859-1")


def raw(text: Column) -> Column:
    """The bytes of latin() again."""
    return F.encode(text, "ISO-8859-1")


def with_eols(data: Column, eol: Column | str) -> Column:
    """Bytes with all line endings made eol."""
    return raw(F.regexp_replace(latin(data), F.lit("\r\n|\r|\n"), F.lit(eol) if isinstance(eol, str) else eol))


def dominant_eol(source: Column) -> Column:
    """The most frequent line ending; ties go to LF, then CRLF, then CR."""
    text = latin(source)
    crlf = F.regexp_count(text, F.lit("\r\n"))
    lf, cr = F.regexp_count(text, F.lit("\n")) - crlf, F.regexp_count(text, F.lit("\r")) - crlf
    return F.when((lf >= crlf) & (lf >= cr), "\n").when(crlf >= cr, "\r\n").otherwise("\r")
