"""Byte patches: conflicts, application, overlapping edits, unified diffs, and the edits that give patches.

A patch is a row (doc_id, start, end, replacement binary, description); offsets are bytes of the source, and every edit
keeps the bytes it doesn't replace, whatever they encode.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from functools import reduce
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.parse import dominant_eol, latin, raw

COLUMNS = ("doc_id", "start", "end", "replacement", "description")


def patch(rows: DataFrame, start: Column, end: Column, replacement: Column, description: str) -> DataFrame:
    return rows.select("doc_id", start.cast("int").alias("start"), end.cast("int").alias("end"), replacement.cast("binary").alias("replacement"), F.lit(description).alias("description"))


def conflicts(patches: DataFrame) -> DataFrame:
    """Patches that overlap an earlier one, or insert at the place where an earlier one inserts."""
    own = patches.dropDuplicates(["doc_id", "start", "end", "replacement"])
    before = Window.partitionBy("doc_id").orderBy("start", "end", "replacement").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end").over(before)
    twice = F.max(F.when(F.col("start") == F.col("end"), F.col("start"))).over(before)
    return own.withColumn("_reach", reach).withColumn("_twice", twice).where("start < _reach or (start = end and start = _twice)").drop("_reach", "_twice")


def apply(documents: DataFrame, patches: DataFrame, on_conflict: str = "error", source_col: str = "source") -> DataFrame:
    """(doc_id, source, changed): sources with their patches.

    on_conflict: "error" fails the job, "skip" leaves documents with conflicting patches as they are.
    """
    sorted_patches = patches.groupBy("doc_id").agg(F.array_distinct(F.sort_array(F.collect_list(F.struct("start", "end", F.col("replacement").cast("binary").alias("r"))))).alias("p"))
    # Bad when a patch begins before the last one's end, or two insertions share a place.
    clash = F.exists(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda i: F.coalesce(
        (F.get("p", i)["start"] < F.get("p", i - 1)["end"]) | ((F.get("p", i)["start"] == F.get("p", i)["end"]) & (F.get("p", i - 1)["start"] == F.get("p", i - 1)["end"]) & (F.get("p", i)["start"] == F.get("p", i - 1)["start"])), F.lit(False)))
    joined = documents.select("doc_id", F.col(source_col).cast("binary").alias("source")).join(sorted_patches, "doc_id", "left").withColumn("clash", F.coalesce(clash, F.lit(False)))
    piece = "substring(source, {0} + 1, {1} - {0})"
    parts = F.expr(f"transform(p, (x, i) -> concat({piece.format('coalesce(get(p, i - 1).end, 0)', 'x.start')}, x.r))")
    tail = F.expr(piece.format("get(p, size(p) - 1).end", "octet_length(source)"))
    patched = F.concat(F.array_join(F.transform(parts, lambda x: x.cast("string")), "").cast("binary"), tail)  # bytes, whatever they encode
    failed = F.raise_error(F.concat(F.lit("conflicting patches in document "), F.col("doc_id").cast("string"))).cast("boolean")
    good = F.col("p").isNotNull() & F.when(~F.col("clash"), F.lit(True)).otherwise(failed if on_conflict == "error" else F.lit(False))
    out = joined.withColumn("new", F.when(good, patched).otherwise(F.col("source")))
    return out.select("doc_id", F.col("new").alias("source"), (~F.col("new").eqNullSafe(F.col("source"))).alias("changed"))


def lower(documents: DataFrame, patches: DataFrame, profile: str = "github", on_stale: str = "error", source_col: str = "source", **options) -> DataFrame:
    """(doc_id, source, changed, rewritten): sources with patches that may overlap, in the order of their column seq if they have one.

    Documents whose patches are apart take apply().  Where patches overlap, a later one takes the place of those it
    covers, and the smallest block around them is written anew in the common style; rewritten lists what was, as
    (kind, start, end) in bytes of the old source.  A patch of a part of what an earlier one has replaced is stale: it fails
    the job, or with "skip" its document stays as it is, with kind "stale".
    """
    rows = patches if "seq" in patches.columns else patches.withColumn("seq", F.lit(0))
    meeting = conflicts(patches).select("doc_id").distinct()
    apart = apply(documents.join(meeting, "doc_id", "left_anti"), rows.join(meeting, "doc_id", "left_anti"), source_col=source_col)
    kind = "array<struct<kind: string, start: int, end: int>>"
    listed = rows.join(meeting, "doc_id", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "end", F.col("replacement").cast("binary").alias("r")))).alias("p"))
    joined = documents.select("doc_id", F.col(source_col).cast("binary").alias("source")).join(listed, "doc_id")

    def kernel(batches):
        from inkwell.kernel.blocks import Options
        from inkwell.kernel.lowering import Stale, lowered

        own = Options.profile(profile, **options)
        for batch in batches:
            sources, out, notes = batch.column("source").to_pylist(), [], []
            for doc_id, source, found in zip(batch.column("doc_id").to_pylist(), sources, batch.column("p").to_pylist(), strict=True):
                try:
                    text, rewritten = lowered(source, [(x["start"], x["end"], x["r"]) for x in found], own)
                except Stale as stale:
                    if on_stale == "error":
                        raise ValueError(f"document {doc_id}: {stale}") from None
                    text, rewritten = source, [("stale", 0, len(source))]
                out.append(text)
                notes.append([{"kind": k, "start": a, "end": b} for k, a, b in rewritten])
            changed = [a != b for a, b in zip(out, sources, strict=True)]
            noted = pa.array(notes, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary()), pa.array(changed), noted], ["doc_id", "source", "changed", "rewritten"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    done = joined.where("source is not null").mapInArrow(kernel, f"doc_id {id_type}, source binary, changed boolean, rewritten {kind}")
    return apart.withColumn("rewritten", F.array().cast(kind)).unionByName(done)


# ---- edits -------------------------------------------------------------------------------------------------------
#
# Edits take rows of inkwell.views; those that look at what stands around a place also take the documents (doc_id, source).

EOL = "\r\n|\r|\n"


def _near(rows: DataFrame, documents: DataFrame) -> DataFrame:
    return rows.join(documents.select("doc_id", F.col("source").cast("binary").alias("source")), "doc_id")


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit("\r\n"))


def _eols(edge: Column, pattern: str) -> Column:
    """How many line endings, of two at most, stand at an edge of a few bytes."""
    return F.regexp_count(F.regexp_extract(latin(edge), pattern, 0), F.lit(EOL))


def insertion(at: Column, text: Column, source: Column | None = None) -> Column:
    """What to insert at a place of source (a column of that name) so that a blank line stands on either side of text."""
    source = F.col("source") if source is None else source
    eol = dominant_eol(source)
    own = F.trim(F.regexp_replace(latin(text), EOL, eol), F.lit("\r\n"))
    first = F.when(F.hex(F.substring(source, 1, 3)) == "EFBBBF", 3).otherwise(0)
    before = _eols(source.substr(F.greatest(at - 3, F.lit(1)), F.least(at, F.lit(4))), f"(?:{EOL}){{0,2}}$")
    after = _eols(source.substr(at + 1, F.lit(4)), f"^(?:{EOL}){{0,2}}")
    prefix = F.when(at == first, "").otherwise(F.repeat(eol, 2 - before))
    suffix = F.when(at == F.octet_length(source), eol).otherwise(F.repeat(eol, 2 - after))
    return raw(F.concat(prefix, own, suffix))


def rename_headings(headings: DataFrame, new_text: Column) -> DataFrame:
    """headings with a new text; an ATX heading is written anew, a setext heading keeps its underline and line ending."""
    underline = F.regexp_extract("own", rf"({EOL})([^\r\n]*)$", 0)
    written = F.when(F.col("kind") == "setext-heading", F.concat(new_text, underline)).otherwise(F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), new_text))
    return patch(headings, F.col("start"), F.col("end"), written, "rename heading")


def append_to_sections(sections: DataFrame, documents: DataFrame, text: Column) -> DataFrame:
    """Text at the end of sections, apart by a blank line."""
    at = F.col("section_end")
    tail = F.col("source").substr(F.greatest(at - 3, F.lit(1)), F.least(at, F.lit(4))).cast("string")
    gap = F.when(tail.rlike("(?:\n\n|\r\n\r\n)$"), "").otherwise("\n")
    return patch(_near(sections, documents), at, at, F.concat(gap, _trimmed(text), F.lit("\n\n")), "append to section")


def prepend_to_sections(sections: DataFrame, text: Column) -> DataFrame:
    """Text right below the headings of sections."""
    return patch(sections, F.col("end"), F.col("end"), F.concat(F.lit("\n\n"), _trimmed(text)), "prepend to section")


def replace_section_bodies(sections: DataFrame, text: Column) -> DataFrame:
    return patch(sections, F.col("end"), F.col("section_end"), F.concat(F.lit("\n\n"), _trimmed(text), F.lit("\n\n")), "replace section body")


def remove_sections(sections: DataFrame) -> DataFrame:
    return patch(sections, F.col("start"), F.col("section_end"), F.lit(""), "remove section")


def _whole(name: str, plain: str) -> Column:
    """A place of a root block's whole lines, of other blocks their own."""
    return F.coalesce(F.col(f"lines.{name}"), F.col(plain))


def remove_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks taken out, root blocks with their lines and one blank line."""
    return patch(blocks, _whole("cut_start", "start"), _whole("cut_end", "end"), F.lit(""), "remove block")


def replace_blocks(blocks: DataFrame, text: Column) -> DataFrame:
    """Blocks with other text; by empty text they are removed."""
    own = _trimmed(text)
    of = lambda cut, at, plain: F.when(own == "", _whole(cut, plain)).otherwise(_whole(at, plain))
    return patch(blocks, of("cut_start", "start", "start"), of("cut_end", "text_end", "end"), own, "replace block")


def insert_before(blocks: DataFrame, documents: DataFrame, text: Column) -> DataFrame:
    """Text before top-level blocks, apart by blank lines; nothing goes before front matter."""
    at = _whole("start", "start")
    return patch(_near(blocks.where("depth = 1 and kind <> 'frontmatter:block'"), documents), at, at, insertion(at, text), "insert block")


def insert_after(blocks: DataFrame, documents: DataFrame, text: Column) -> DataFrame:
    """Text after top-level blocks, apart by blank lines."""
    at = _whole("end", "end")
    return patch(_near(blocks.where("depth = 1"), documents), at, at, insertion(at, text), "insert block")


def _source_of(end: str) -> Column:
    """The bytes of the whole lines of a row's block in the document beside it."""
    start = _whole("start", "start")
    return F.col("source").substr(start + 1, _whole(end, "end") - start)


def clone_blocks(blocks: DataFrame, documents: DataFrame, to: Column) -> DataFrame:
    """Copies of blocks at the byte to."""
    return patch(_near(blocks, documents), to, to, insertion(to, _source_of("end")), "clone block")


def move_blocks(blocks: DataFrame, documents: DataFrame, to: Column) -> DataFrame:
    """Blocks taken from their place, with one blank line, and put at the byte to, which must lie outside of them.

    A block stays where to is right before or after it.
    """
    inside = (to > F.col("start")) & (to < F.col("end"))
    target = F.when(inside, F.raise_error(F.lit("a block can't move into itself")).cast("int")).otherwise(to)
    moved = _near(blocks, documents).withColumn("_to", target).where(~F.col("_to").between(_whole("cut_start", "start"), _whole("cut_end", "end")))
    at = F.col("_to")
    return remove_blocks(moved).unionByName(patch(moved, at, at, insertion(at, _source_of("end")), "move block"))


def wrapped(text: Column, first: str, rest: str) -> Column:
    """Bytes with first before their first line and rest before all others."""
    return raw(F.concat(F.lit(first), F.regexp_replace(latin(text), rf"({EOL})(?=[\s\S])", "$1" + rest)))


def wrap_blocks(blocks: DataFrame, documents: DataFrame, style: str = "quote", start: int = 1, delimiter: str = ".") -> DataFrame:
    """Blocks inside a block quote ("quote"), a bullet list ("-", "+", "*") or an ordered list ("ordered")."""
    if style not in ("quote", "-", "+", "*", "ordered") or delimiter not in (".", ")") or not 0 <= start <= 999_999_999:
        raise ValueError(f"unknown wrapper {style!r}, {start}, {delimiter!r}")
    mark = "> " if style == "quote" else f"{start}{delimiter} " if style == "ordered" else f"{style} "
    text = wrapped(_source_of("text_end"), mark, mark if style == "quote" else " " * len(mark))
    return patch(_near(blocks, documents), _whole("start", "start"), _whole("text_end", "end"), text, "wrap block")


def _language(language: Column) -> Column:
    bad = F.raise_error(F.lit("a language is one word without backticks")).cast("string")
    return F.when(language.rlike("^[^\\x00-\\x20`]+$"), language).otherwise(bad)


def set_code_languages(code_blocks: DataFrame, language: Column) -> DataFrame:
    """Fenced blocks with another first word of their info string."""
    rows = code_blocks.where("kind = 'fenced-code'")
    opening = F.substring_index("own", "\n", 1)
    at = F.col("start") + F.length(F.regexp_extract(opening, "^(?:`+|~+)[ \t]*", 0))
    return patch(rows, at, at + F.octet_length(F.regexp_extract(opening, "^(?:`+|~+)[ \t]*([^ \t]*)", 1)), _language(language), "set code language")


def replace_code(code_blocks: DataFrame, code: Column, language: Column | None = None) -> DataFrame:
    """Code blocks written anew as fenced blocks, with their own language unless another is given."""
    runs = F.array_max(F.transform(F.regexp_extract_all(code, F.lit("`+"), F.lit(0)), F.length))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(runs, F.lit(0)) + 1))
    named = F.coalesce(F.col("language") if language is None else _language(language), F.lit(""))
    lines = F.concat(fence, named, F.lit("\n"), F.rtrim(code, F.lit("\r\n")), F.lit("\n"), fence)
    return patch(code_blocks, F.col("start"), F.col("end"), F.regexp_replace(lines, F.lit(EOL), F.col("eol")), "replace code")


def replace_front_matter(front: DataFrame, content: Column) -> DataFrame:
    """Front matter with other content; content that would close its fence fails."""
    own = F.concat(_trimmed(content), F.lit("\n"))
    closes = F.exists(F.split(own, EOL), lambda line: F.rtrim(line) == F.col("fence"))
    bad = F.raise_error(F.lit("the content closes the front matter")).cast("string")
    at = F.col("start") + F.octet_length(F.regexp_extract("own", rf"^[^\r\n]*(?:{EOL})", 0))
    last = F.octet_length(F.regexp_extract("own", rf"(?:^|{EOL})([^\r\n]*)(?:{EOL})?$", 1))  # the closing fence, plain ASCII as the opening one
    return patch(front, at, F.col("end") - last, F.when(closes, bad).otherwise(F.regexp_replace(own, F.lit(EOL), F.col("eol"))), "replace front matter")


def link_target(destination: Column, title: Column) -> Column:
    """(destination "title") as inline syntax."""
    escaped = lambda text, signs: F.regexp_replace(text, f"([{signs}])", r"\\$1")
    written = F.when((destination == "") | destination.rlike(r"[\x00-\x20]"), F.concat(F.lit("<"), escaped(destination, r"\\\\<>"), F.lit(">"))).otherwise(escaped(destination, r"\\\\()"))
    named = F.when(F.coalesce(title, F.lit("")) == "", "").otherwise(F.concat(F.lit(' "'), escaped(title, r'\\\\"'), F.lit('"')))
    return F.concat(F.lit("("), F.when(destination == "", "").otherwise(written), named, F.lit(")"))


def set_links(links: DataFrame, destination: Column | None = None, title: Column | None = None) -> DataFrame:
    """Links with another destination or title; a use of a reference becomes an inline link."""
    target = link_target(F.col("destination") if destination is None else destination, F.col("title") if title is None else title)
    return patch(links, F.col("label_end") + 1, F.col("end"), target, "set link")


def set_link_destinations(links: DataFrame, destination: Column) -> DataFrame:
    return set_links(links, destination).withColumn("description", F.lit("set link destination"))


def set_images(images: DataFrame, destination: Column | None = None, alt: Column | None = None, title: Column | None = None) -> DataFrame:
    """Images with another destination, alternative text or title, as inline syntax."""
    from inkwell.functions import md_escape

    target = link_target(F.col("destination") if destination is None else destination, F.col("title") if title is None else title)
    label = F.concat(F.lit("!["), md_escape(F.col("alt") if alt is None else alt), F.lit("]"))
    return patch(images, F.col("start"), F.col("end"), F.concat(label, target), "set image")


def folded(title: Column) -> Column:
    """A title as headings are folded."""

    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else t.strip().casefold())

    return fold(title)


def ensure_sections(documents: DataFrame, headings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Patches that append the sections (doc_id, title, and perhaps level) of which a document has no heading; one patch a document, sections by title."""
    from inkwell.functions import md_heading

    rows = wanted if "level" in wanted.columns else wanted.withColumn("level", F.lit(1))
    rows = rows.withColumn("fold", folded(F.col("title"))).dropDuplicates(["doc_id", "fold"])
    missing = rows.join(headings.select("doc_id", "fold").distinct(), ["doc_id", "fold"], "left_anti")
    parts = missing.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("title", "level"))).alias("parts"))
    sized = _near(parts, documents)
    text = latin(F.col("source"))
    gap = F.when((text == "") | text.rlike(rf"(?:{EOL}){{2}}$"), "").when(text.rlike(rf"(?:{EOL})$"), "\n").otherwise("\n\n")
    lines = F.array_join(F.transform("parts", lambda p: F.concat(md_heading(p["level"], p["title"]), F.lit("\n"))), "\n")
    return patch(sized, F.octet_length("source"), F.octet_length("source"), F.concat(gap, lines), "ensure section")


class Journal:
    """Patches in the order they were recorded; recording gives a new journal."""

    def __init__(self, entries: tuple[DataFrame, ...] = ()):
        self.parts = entries

    def record(self, patches: DataFrame) -> Journal:
        return Journal((*self.parts, self.pending(patches) if self.parts else patches.select(*COLUMNS)))

    def pending(self, patches: DataFrame) -> DataFrame:
        """The patches that aren't recorded yet."""
        key = ["doc_id", "start", "end", "replacement"]
        return patches.select(*COLUMNS).join(self.patches().select(*key), key, "left_anti").select(*COLUMNS) if self.parts else patches.select(*COLUMNS)

    def patches(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)

    def entries(self) -> DataFrame:
        """(seq, doc_id, start, end, replacement, description): seq counts the recordings."""
        return reduce(DataFrame.unionByName, [p.select(F.lit(i).alias("seq"), *COLUMNS) for i, p in enumerate(self.parts, 1)])

    def clear(self) -> Journal:
        return Journal()


def composed(patches: DataFrame) -> DataFrame:
    """Patches with insertions at one place made one: those of most text first, line endings alone last."""
    rows = patches.dropDuplicates(["doc_id", "start", "end", "replacement"])
    at = rows.where("start = end").withColumn("replacement", latin(F.col("replacement"))).withColumn("_bare", F.col("replacement").rlike(r"^[\r\n]*$"))
    joined = at.groupBy("doc_id", "start", "end").agg(F.sort_array(F.collect_list(F.struct("_bare", "description", "replacement"))).alias("p"))
    one = joined.select("doc_id", "start", "end", raw(F.array_join(F.transform("p", lambda x: x["replacement"]), "")).alias("replacement"), F.array_join(F.transform("p", lambda x: x["description"]), "; ").alias("description"))
    kind = patches.schema["replacement"].dataType
    return rows.where("start <> end").select(*COLUMNS).unionByName(one.withColumn("replacement", F.col("replacement").cast(kind)).select(*COLUMNS))


# ---- diffs -------------------------------------------------------------------------------------------------------

LCS_CELLS = 1_000_000
CONTEXT = 3


def longest_common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence, by the whole table."""
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if x[i] == y[j] else max(table[i + 1][j], table[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest part of pairs, sorted by their first numbers, whose second numbers rise."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before.append(ends[at - 1] if at else -1)
        tails[at : at + 1], ends[at : at + 1] = [j], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def common_lines(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal lines, rising in both texts.

    Equal edges go first.  What lies between is a longest common subsequence while its table is small; else lines that
    stand once in both texts are anchors, the most of them that rise, and the gaps between them are taken alike; without
    anchors, lines meet at equal distance from the gap's start.
    """
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        i, m, j, n = gaps.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        if (m - i) * (n - j) <= LCS_CELLS:
            out += [(i + p, j + q) for p, q in longest_common(a[i:m], b[j:n])]
            continue
        once, other = Counter(a[i:m]), Counter(b[j:n])
        where = {line: q for q, line in enumerate(b[j:n], j) if other[line] == 1}
        anchors = rising([(p, where[line]) for p, line in enumerate(a[i:m], i) if once[line] == 1 and line in where])
        if not anchors:
            out += [(i + k, j + k) for k in range(min(m - i, n - j)) if a[i + k] == b[j + k]]
            continue
        out += anchors
        ends = [(i - 1, j - 1), *anchors, (m, n)]
        gaps += [(p + 1, r, q + 1, s) for (p, q), (r, s) in pairwise(ends) if p + 1 < r and q + 1 < s]
    return sorted(out)


def unified(before: str, after: str, context: int = CONTEXT) -> str:
    """The unified diff of two texts; line endings are not shown, equal texts give nothing."""
    import re

    def split(text: str) -> list[str]:
        own = re.split("\r\n|\r|\n", text)
        return own[:-1] if own[-1] == "" else own

    a, b = split(before), split(after)
    ops, i, j = [], 0, 0
    for x, y in [*common_lines(a, b), (len(a), len(b))]:
        ops += [("-", k, j, a[k]) for k in range(i, x)] + [("+", x, k, b[k]) for k in range(j, y)]
        if x < len(a):
            ops.append((" ", x, y, a[x]))
        i, j = x + 1, y + 1
    changed = [k for k, op in enumerate(ops) if op[0] != " "]
    out, k = [], 0
    while k < len(changed):
        first = last = changed[k]
        while k + 1 < len(changed) and changed[k + 1] - last <= 2 * context + 1:
            k += 1
            last = changed[k]
        hunk = ops[max(0, first - context) : last + context + 1]
        olds, news = sum(op[0] != "+" for op in hunk), sum(op[0] != "-" for op in hunk)
        out.append(f"@@ -{hunk[0][1] + (olds > 0)},{olds} +{hunk[0][2] + (news > 0)},{news} @@")
        out += [op[0] + op[3] for op in hunk]
        k += 1
    return "\n".join(["--- a", "+++ b", *out]) + "\n" if out else ""


def diffs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, diff) of the documents that differ."""
    pairs = before.select("doc_id", F.col("source").cast("string").alias("a")).join(after.select("doc_id", F.col("source").cast("string").alias("b")), "doc_id").where("a <> b")

    def kernel(batches):
        for batch in batches:
            own = [unified(x, y) for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own, pa.string())], ["doc_id", "diff"])

    return pairs.mapInArrow(kernel, f"doc_id {before.schema['doc_id'].dataType.simpleString()}, diff string")
