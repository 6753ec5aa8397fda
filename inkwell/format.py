"""Formatter passes: each gives patches, format_documents() applies all of them at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell import intervals, lint, patches
from inkwell.parse import kept, parse

BULLET = "-"
#: What the passes here read of blocks.
FIELDS = (*lint.FIELDS, "parent_pre", "sibling", "ordered", "marker", "align")


def trailing_spaces(t: lint.Tables) -> DataFrame:
    return lint.fixes(lint._trailing_spaces(t, lint.Config()).withColumn("rule_id", F.lit("no-trailing-spaces")))


def final_newline(t: lint.Tables) -> DataFrame:
    return lint.fixes(lint._final_newline(t, lint.Config()).withColumn("rule_id", F.lit("final-newline")))


def fence_info_spacing(t: lint.Tables) -> DataFrame:
    return lint.fixes(lint._info_spacing(t, lint.Config()).withColumn("rule_id", F.lit("fence-info-spacing")))


def heading_spacing(t: lint.Tables) -> DataFrame:
    """One blank between the marks of an ATX heading and its text."""
    rows = t.blocks.where("kind = 'atx-heading'").select("doc_id", "start", "end", "level", "own")
    gap = F.length(F.regexp_extract("own", "^#+([ \t]+)[^ \t]", 1))
    rows = rows.withColumn("gap", gap).where("gap > 0").where(~F.col("own").rlike("^#+ [^ \t]"))
    at = F.col("start") + F.col("level")
    return patches.patch(rows, at, at + F.col("gap"), F.lit(" "), "heading spacing")


def _lists_alone(t: lint.Tables, ordered: bool) -> DataFrame:
    """(doc_id, list_pre, marker) of lists with no list of the same sort right beside them."""
    lists = t.blocks.where("kind = 'list'").select("doc_id", F.col("pre").alias("list_pre"), "parent_pre", "sibling", "ordered", "marker")
    side = Window.partitionBy("doc_id", "parent_pre").orderBy("sibling")
    apart = lambda f, step: F.coalesce(f("sibling").over(side) != F.col("sibling") + step, F.lit(True)) | (f("ordered").over(side) != F.col("ordered"))
    return lists.withColumn("alone", apart(F.lag, -1) & apart(F.lead, 1)).where("alone").where(F.col("ordered") == ordered).select("doc_id", "list_pre", "marker")


def bullet_marker(t: lint.Tables) -> DataFrame:
    """Bullet lists with the same marker, but for lists beside another and lines that would become a break."""
    lists = _lists_alone(t, False).where(f"marker <> '{BULLET}'").drop("marker")
    items = t.blocks.where("kind = 'list-item'").select("doc_id", F.col("parent_pre").alias("list_pre"), "start", "end", "own")
    rows = items.join(lists, ["doc_id", "list_pre"])
    rows = rows.where(~F.col("own").rlike(r"^[*+][ \t]*-[ \t]*-[ \t-]*(?:\r|\n|$)"))
    return patches.patch(rows, F.col("start"), F.col("start") + 1, F.lit(BULLET), "bullet marker")


def ordered_delimiter(t: lint.Tables) -> DataFrame:
    """Ordered lists with a full stop after the number, but for lists beside another."""
    lists = _lists_alone(t, True).where("marker <> '.'").drop("marker")
    items = t.blocks.where("kind = 'list-item'").select("doc_id", F.col("parent_pre").alias("list_pre"), "start", "end", "own")
    rows = items.join(lists, ["doc_id", "list_pre"]).withColumn("digits", F.length(F.regexp_extract("own", "^[0-9]+", 0)))
    at = F.col("start") + F.col("digits")
    return patches.patch(rows, at, at + 1, F.lit("."), "ordered list delimiter")


def fence_marker(t: lint.Tables) -> DataFrame:
    """Fences of backticks, longer than any run inside; an info string with a backtick keeps its fence."""
    rows = t.blocks.where("kind = 'fenced-code' and startswith(fence, '~') and not contains(info, '`')").select("doc_id", "start", "end", "fence", "code", "fence_closed", "own")
    runs = F.array_max(F.transform(F.regexp_extract_all("code", F.lit("`+"), F.lit(0)), F.length))
    rows = rows.withColumn("new", F.repeat(F.lit("`"), F.greatest(F.length("fence"), F.coalesce(runs, F.lit(0)) + 1)))
    begin = patches.patch(rows, F.col("start"), F.col("start") + F.length("fence"), F.col("new"), "fence marker")
    shut = rows.where("fence_closed").withColumn("last", F.regexp_extract("own", "(~+)[ \t]*$", 1)).withColumn("tail", F.length(F.regexp_extract("own", "~+([ \t]*)$", 1)))
    at = F.col("end") - F.col("tail") - F.length("last")
    return begin.unionByName(patches.patch(shut, at, at + F.length("last"), F.col("new"), "fence marker"))


def definition_spacing(t: lint.Tables) -> DataFrame:
    """One blank after the colon of a reference definition on one line."""
    rows = t.blocks.where("kind = 'link-reference-definition'").select("doc_id", "start", "end", "own").where(~F.col("own").rlike("[\r\n]"))
    head = F.regexp_extract("own", r"^(\[(?:[^\\\[\]]|\\.)+\]:)([ \t]*)\S", 1)
    gap = F.regexp_extract("own", r"^(\[(?:[^\\\[\]]|\\.)+\]:)([ \t]*)\S", 2)
    rows = rows.withColumn("head", head).withColumn("gap", gap).where("head <> '' and gap <> ' '")
    at = F.col("start") + F.octet_length("head")
    return patches.patch(rows, at, at + F.length("gap"), F.lit(" "), "definition spacing")


def table_delimiter(t: lint.Tables) -> DataFrame:
    """Delimiter rows of top-level tables as --- with the colons of their alignment."""
    rows = t.blocks.where("kind = 'gfm:table' and depth = 1").select("doc_id", "start", "end", "align", "own")
    line = F.get(F.split("own", "\r\n|\r|\n"), F.lit(1))
    head = F.octet_length(F.regexp_extract("own", "^[^\r\n]*(?:\r\n|\r|\n)", 0))
    mark = F.transform("align", lambda a: F.when(a == "left", ":---").when(a == "right", "---:").when(a == "center", ":---:").otherwise("---"))
    new = F.concat(F.when(F.ltrim(line).startswith("|"), F.lit("| ")).otherwise(F.lit("")), F.array_join(mark, " | "), F.when(F.rtrim(line).endswith("|"), F.lit(" |")).otherwise(F.lit("")))
    rows = rows.withColumn("old", line).withColumn("new", new).withColumn("at", F.col("start") + head).where("old <> new")
    return patches.patch(rows, F.col("at"), F.col("at") + F.octet_length("old"), F.col("new"), "table delimiter")


def blank_lines(t: lint.Tables) -> DataFrame:
    """At most one blank line before every top-level block but the first."""
    tops = t.blocks.where("depth = 1").select("doc_id", "start", F.lag("end").over(Window.partitionBy("doc_id").orderBy("pre")).alias("before")).where("before is not null")
    # Lines that are blank and lie between two blocks, numbered within their gap.
    blank = t.lines.where("trim(both ' \t' from text) = ''").select("doc_id", F.col("start").alias("at"), "line_end")
    gaps = tops.select("doc_id", F.col("before").alias("a"), F.col("start").alias("b"))
    inside = intervals.within(blank, gaps, F.col("at"), F.col("line_end"))
    numbered = inside.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "b").orderBy("at")))
    return patches.patch(numbered.where("n > 1"), F.col("at"), F.col("line_end"), F.lit(""), "blank lines")


PASSES = {
    "no-trailing-spaces": trailing_spaces, "atx-heading-spacing": heading_spacing, "fence-marker": fence_marker, "fence-info-spacing": fence_info_spacing, "bullet-marker": bullet_marker,
    "ordered-list-delimiter": ordered_delimiter, "reference-definition-spacing": definition_spacing,
    "table-delimiter": table_delimiter, "blank-lines": blank_lines, "final-newline": final_newline,
}


def format_patches(parsed: DataFrame, passes: tuple[str, ...] = tuple(PASSES), extra: tuple = ()) -> DataFrame:
    """Patches of the passes; extra are further functions of the tables. Removed blank lines win over their trailing blanks."""
    tables = lint.Tables(parsed)
    runs = {p: PASSES[p](tables).select(*patches.COLUMNS) for p in passes}
    if {"no-trailing-spaces", "blank-lines"} <= runs.keys():
        gone = runs["blank-lines"].select("doc_id", F.col("start").alias("a"), F.col("end").alias("b"))
        runs["no-trailing-spaces"] = intervals.beyond(runs["no-trailing-spaces"], gone, F.col("start"), F.col("end")).select(*patches.COLUMNS)
    every = [*runs.values(), *(run(tables).select(*patches.COLUMNS) for run in extra)]
    return reduce(DataFrame.unionByName, every)


def format_documents(documents: DataFrame, profile: str = "github", source_col: str = "source") -> DataFrame:
    """(doc_id, source, changed) of the documents in the common style."""
    parsed = kept(parse(documents, profile, source_col=source_col, fields=FIELDS, inline_kinds=lint.INLINE_KINDS))
    return patches.apply(documents, format_patches(parsed), source_col=source_col)


__all__ = ["PASSES", "format_documents", "format_patches"]
