"""Extensions as DataFrame transforms over the flat tables: footnotes, contents, permalinks, link policies, directives."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell import patches, views
from inkwell.functions import html_escape, md_escape
from inkwell.kernel.blocks import BlockParser, Options

# Syntax for parse(…, inline_rules=, line_rules=, container_rules=).
HIGHLIGHT = ("highlight", r"==(?=\S)([^=\n]+?)(?<=\S)==", "mark")
TABLE_OF_CONTENTS = ("table-of-contents:block", r"@toc(?:[ \t]*\{(?P<options>[^}]*)\})?")
EMBED = ("embed", r"(?P<url>https://(?P<host>[A-Za-z0-9.-]+)(?:/\S*)?)")
IMPORT = ("import", r"@import[ \t]+\"(?P<path>[^\"]+)\"(?:[ \t]*\{(?P<options>[^}]*)\})?")
SOURCE = ("source", r"@source[ \t]+\"(?P<path>[^\"]+)\"(?:[ \t]*\{(?P<options>[^}]*)\})?")
ATTRIBUTES = ("attributes:block", r"\{:?[ \t]*(?P<attributes>[#.A-Za-z][^{}\n]{0,1023})\}")
INCLUDE = ("include", r"@include[ \t]+\"(?P<path>[^\"]+)\"")


def paired_delimiter(kind: str, sign: str, element: str) -> tuple[str, str, str]:
    """Inline syntax between two equal delimiters on one line."""
    own = re.escape(sign)
    return kind, rf"{own}(?=\S)((?:(?!{own})[^\n])+?)(?<=\S){own}", element


def attribute_list(attributes: Column) -> Column:
    """(id, classes) of an attribute list."""
    parts = F.split(F.trim(attributes), r"\s+")
    return F.struct(F.get(F.transform(F.filter(parts, lambda p: p.startswith("#")), lambda p: p.substr(F.lit(2), F.length(p))), F.lit(0)).alias("id"), F.transform(F.filter(parts, lambda p: p.startswith(".")), lambda p: p.substr(F.lit(2), F.length(p))).alias("classes"))


def attributed(blocks: DataFrame) -> DataFrame:
    """(doc_id, pre, target_pre, attributes) of attribute blocks: the next sibling, or the one before where the list is that one's."""
    side = Window.partitionBy("doc_id", "parent_pre").orderBy("pre")
    after, before = F.lead("pre").over(side), F.lag("pre").over(side)
    target = F.when(F.col("ext")["target"] == "next", after).when(F.col("ext")["target"] == "previous", before).otherwise(F.coalesce(after, before))
    rows = blocks.withColumn("target_pre", target).where("kind = 'attributes:block'")
    return rows.select("doc_id", "pre", "target_pre", attribute_list(F.regexp_replace(F.col("ext")["attributes"], r"(?m)^\{:?|\}$|\n", " ")).alias("attributes"))


def embeds(blocks: DataFrame, hosts: list[str], fallback: str | None = None) -> DataFrame:
    """Embedded URLs of allowed hosts; with a fallback ("link" or "remove") the others too, with html of the fallback."""
    rows = blocks.where("kind = 'embed'").select("doc_id", "pre", F.col("ext")["url"].alias("url"), F.lower(F.col("ext")["host"]).alias("host"))
    allowed = F.col("host").isin([h.lower() for h in hosts])
    if fallback is None:
        return rows.where(allowed)
    link = F.concat(F.lit('<p><a href="'), html_escape(F.col("url")), F.lit('">'), html_escape(F.col("url")), F.lit("</a></p>"))
    return rows.withColumn("allowed", allowed).withColumn("html", F.when(~allowed, link if fallback == "link" else F.lit("")))


def imports(blocks: DataFrame, resources: DataFrame) -> DataFrame:
    """(doc_id, pre, kind, path, code): import and source directives with the lines they ask for."""
    rows = blocks.where("kind in ('import', 'source')").select("doc_id", "pre", "kind", F.col("ext")["path"].alias("path"), F.coalesce(F.col("ext")["options"], F.lit("")).alias("options"))
    rows = rows.where(safe_path(F.col("path"), ("md", "markdown", "txt", "py", "php", "js", "json", "sql", "yaml", "yml", "sh", "c", "java"))).join(resources, "path")
    named = rows.withColumn("o", options(F.col("options"), ("lines", "lang", "indent", "title", "numbers", "highlight"))).where("o is not null")
    span = F.coalesce(F.col("o")["lines"], F.lit(""))
    first, last = (F.regexp_extract(span, "^([0-9]+)(?:-([0-9]+))?$", k) for k in (1, 2))
    code = F.when(first == "", F.col("text")).otherwise(selected_lines(F.col("text"), first.try_cast("int"), F.when(last == "", first).otherwise(last).try_cast("int")))
    pad = F.repeat(F.lit(" "), F.least(F.coalesce(F.col("o")["indent"].try_cast("int"), F.lit(0)), F.lit(32)))
    code = F.regexp_replace(code, "(?m)^(?=.)", pad)
    suffix = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    language = F.coalesce(F.col("o")["lang"], F.lower(suffix))
    begins = F.when(first == "", F.lit(1)).otherwise(first.try_cast("int"))
    marks = F.transform(F.split(F.coalesce(F.col("o")["highlight"], F.lit("")), ","), lambda r: F.struct(F.regexp_extract(r, "^[ ]*([0-9]+)", 1).try_cast("int").alias("first"), F.coalesce(F.nullif(F.regexp_extract(r, "-([0-9]+)[ ]*$", 1), F.lit("")), F.regexp_extract(r, "^[ ]*([0-9]+)", 1)).try_cast("int").alias("last")))
    return named.select(
        "doc_id", "pre", "kind", "path", code.alias("code"), language.alias("language"), F.col("o")["title"].alias("title"),
        F.when(F.lower(F.col("o")["numbers"]) == "true", begins).alias("first_number"), F.filter(marks, lambda m: m["first"].isNotNull()).alias("highlights"),
    )


def code_html(imports: DataFrame) -> DataFrame:
    """imports() with html: escaped code under its title; numbers are those of the file, highlighted lines are marked."""
    lines = F.split(F.rtrim("code", F.lit("\r\n")), "\r\n|\r|\n")
    begins = F.coalesce(F.col("first_number"), F.lit(1))
    shown = lambda line, i: F.when(F.exists("highlights", lambda h: (i + begins).between(h["first"], h["last"])), F.concat(F.lit("<mark>"), html_escape(line), F.lit("</mark>"))).otherwise(html_escape(line))
    number = lambda i: F.when(F.col("first_number").isNotNull(), F.concat(F.lit('<span class="line-number">'), (i + begins).cast("string"), F.lit("</span>"))).otherwise("")
    body = F.array_join(F.transform(lines, lambda line, i: F.concat(number(i), shown(line, i))), "\n")
    code = F.concat(F.lit("<pre><code"), F.when(F.coalesce("language", F.lit("")) == "", "").otherwise(F.concat(F.lit(' class="language-'), html_escape(F.col("language")), F.lit('"'))), F.lit(">"), body, F.lit("\n</code></pre>"))
    titled = F.concat(F.lit('<figure class="code-block has-title"><figcaption class="code-title">'), html_escape(F.col("title")), F.lit("</figcaption>"), code, F.lit("</figure>"))
    return imports.withColumn("html", F.coalesce(titled, code))


def option_values(source: str | None, allowed: tuple[str, ...]) -> dict[str, str] | None:
    """name: value and name: "value" pairs, apart by commas; None where a name is unknown or comes twice, or the syntax is another."""
    if source is None:
        return None
    out: dict[str, str] = {}
    rest = source.strip(" \t")
    while rest:
        found = OPTION.match(rest)
        if not found or found[1] not in allowed or found[1] in out:
            return None
        value = re.sub(r"\\(.)", r"\1", found[2]) if found[2] is not None else found[3].strip(" \t")
        if not value:
            return None
        out[found[1]], more = value, rest[found.end() :]
        if found[4] and not more:
            return None  # a comma with nothing after it
        if more and not found[4]:
            return None
        rest = more
    return out


OPTION = re.compile(r"([a-z0-9-]+)[ \t]*:[ \t]*(?:\"((?:[^\"\\]|\\[\"\\])*)\"|([^ \t\",][^,]*))[ \t]*(?:(,)[ \t]*)?")


def options(text: Column, allowed: tuple[str, ...]) -> Column:
    """The options of a directive as a map; null where they are malformed, and the directive then stays as it is written."""

    @F.pandas_udf("map<string,string>")
    def tokenised(values: pd.Series) -> pd.Series:
        return values.map(lambda v: option_values(v, allowed))

    return tokenised(text)




# ---- footnotes ---------------------------------------------------------------------------------------------------


def footnotes(blocks: DataFrame, inlines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uses, definitions) of the notes of documents parsed with footnotes=True.

    uses: (doc_id, label, number, occurrence, pre, start, end), wherever they stand; definitions: (doc_id, label, number,
    pre, last_pre, text), whose blocks are those between their numbers.  Notes are numbered by their first use; unused
    definitions go, uses without a definition stay plain text, of several definitions of a label the first holds.
    """
    own = inlines.where("kind = 'footnote:reference'").select("doc_id", F.col("destination").alias("key"), F.col("block_pre").alias("use_pre"), "inline_ord", "start", "end")
    defined = blocks.where("kind = 'footnote:definition'").select("doc_id", F.col("label_key").alias("key"), F.col("ext")["label"].alias("label"), "pre", "last_pre", "text")
    first = defined.groupBy("doc_id", "key").agg(F.min_by(F.struct("label", "pre", "last_pre", "text"), "pre").alias("d")).select("doc_id", "key", "d.*")
    used = own.join(first.select("doc_id", "key", "label"), ["doc_id", "key"])
    occurrence = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("use_pre", "inline_ord"))
    begins = F.min(F.struct("use_pre", "inline_ord")).over(Window.partitionBy("doc_id", "key"))
    numbered = used.withColumn("occurrence", occurrence).withColumn("begins", begins).withColumn("number", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("begins")))
    notes = first.join(numbered.where("occurrence = 1").select("doc_id", "key", "number"), ["doc_id", "key"])
    uses = numbered.select("doc_id", "label", "number", "occurrence", F.col("use_pre").alias("pre"), "start", "end")
    return uses, notes.select("doc_id", "label", "number", "pre", "last_pre", "text")


def footnote_html_id(number: Column, occurrence: Column) -> Column:
    return F.concat(F.lit("fnref-"), number.cast("string"), F.when(occurrence > 1, F.concat(F.lit("-"), occurrence.cast("string"))).otherwise(""))


# ---- headings ----------------------------------------------------------------------------------------------------


def contents(blocks: DataFrame, least: int = 1, most: int = 6) -> DataFrame:
    """(doc_id, pre, level, text, slug) of top-level headings for a table of contents; an empty slug is toc-heading."""
    heads = views.headings(blocks).where((F.col("depth") == 1) & F.col("level").between(least, most))
    named = heads.join(views.slugs(blocks), ["doc_id", "pre"])
    return named.select("doc_id", "pre", "level", "text", F.when(F.col("slug") == "", "toc-heading").otherwise(F.col("slug")).alias("slug"))


def contents_list(rows: DataFrame) -> DataFrame:
    """(doc_id, toc): nested lists of links, one line a heading."""
    least = F.min("level").over(Window.partitionBy("doc_id"))
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - F.col("least")), F.lit("- ["), F.col("text"), F.lit("](#"), F.col("slug"), F.lit(")"))
    lines = rows.withColumn("least", least).withColumn("line", line)
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", "line"))), lambda x: x["line"]), "\n").alias("toc"))


def contents_splice(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Patches that write the contents in place of @toc markers, with their own min, max and ordered options; malformed markers stay."""
    marks = blocks.where("kind = 'table-of-contents:block'").select("doc_id", F.col("pre").alias("mark_pre"), "start", "end", options(F.coalesce(F.col("ext")["options"], F.lit("")), ("min", "max", "ordered")).alias("o")).where("o is not null")
    rows = marks.join(contents(blocks), "doc_id").where(F.col("level").between(F.coalesce(F.col("o")["min"].try_cast("int"), F.lit(1)), F.coalesce(F.col("o")["max"].try_cast("int"), F.lit(6))))
    least = F.min("level").over(Window.partitionBy("doc_id", "mark_pre"))
    bullet = F.when(F.lower(F.col("o")["ordered"]) == "true", "1. ").otherwise("- ")
    line = F.concat(F.repeat(F.lit("   "), F.col("level") - F.col("least")), bullet, F.lit("["), md_escape(F.col("text")), F.lit("](#"), F.col("slug"), F.lit(")"))
    listed = rows.withColumn("least", least).withColumn("line", line).groupBy("doc_id", "start", "end").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", "line"))), lambda x: x["line"]), "\n").alias("toc"))
    return patches.patch(listed, F.col("start"), F.col("end"), F.col("toc"), "table of contents")


def tab_groups(blocks: DataFrame, name: str = "tabs") -> DataFrame:
    """(doc_id, pre, group, panel, title, tab_id, panel_id) of tab items, nested ones too; groups are numbered in document order, with those without tabs."""
    groups = blocks.where("kind = 'tabs:group'").select("doc_id", F.col("pre").alias("parent_pre"), F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")).alias("group"))
    rows = blocks.where("kind = 'tabs:item'").select("doc_id", "pre", "parent_pre", F.col("ext")["title"].alias("title")).join(groups, ["doc_id", "parent_pre"])
    rows = rows.withColumn("panel", F.row_number().over(Window.partitionBy("doc_id", "parent_pre").orderBy("pre")))
    own = lambda part: F.concat(F.lit(f"{name}-"), F.col("group").cast("string"), F.lit(f"-{part}-"), F.col("panel").cast("string"))
    return rows.select("doc_id", "pre", "group", "panel", "title", own("tab").alias("tab_id"), own("panel").alias("panel_id"))


def permalinks(blocks: DataFrame, prefix: str = "") -> DataFrame:
    return views.slugs(blocks).select("doc_id", "pre", F.concat(F.lit("#" + prefix), F.col("slug")).alias("href"))


def shifted_levels(headings: DataFrame, by: int = 0, mapping: dict[int, int] | None = None) -> DataFrame:
    """headings with new_level; a result outside 1 to 6 fails."""
    moved = F.col("level") + by
    if mapping:
        moved = F.coalesce(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[F.col("level")], F.col("level")) + by
    bad = F.raise_error(F.concat(F.lit("heading level out of range: "), moved.cast("string"))).try_cast("int")
    return headings.withColumn("new_level", F.when(moved.between(1, 6), moved).otherwise(bad))


def slices(blocks: DataFrame, least: int = 2) -> DataFrame:
    """Nested sections of top-level headings of at least a level: (doc_id, pre, level, parent_pre), the parent being the last heading of a smaller level that still holds."""
    heads = views.headings(blocks).where((F.col("depth") == 1) & (F.col("level") >= least)).select("doc_id", "pre", "level")
    listed = heads.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pre", "level"))).alias("h"))

    def step(acc: Column, x: Column) -> Column:
        stack = F.filter(acc["stack"], lambda s: s["level"] < x["level"])
        parent = F.when(F.size(stack) > 0, F.element_at(stack, -1)["pre"])
        return F.struct(F.concat(stack, F.array(x)).alias("stack"), F.concat(acc["out"], F.array(F.struct(x["pre"].alias("pre"), x["level"].alias("level"), parent.alias("parent_pre")))).alias("out"))

    empty = F.expr("named_struct('stack', cast(array() as array<struct<pre:int,level:int>>), 'out', cast(array() as array<struct<pre:int,level:int,parent_pre:int>>))")
    return listed.select("doc_id", F.inline(F.aggregate("h", empty, step, lambda a: a["out"])))


# ---- links -------------------------------------------------------------------------------------------------------


def link_host(destination: Column) -> Column:
    return F.lower(F.rtrim(F.try_parse_url(destination, F.lit("HOST")), F.lit(".")))


def classified_links(links: DataFrame, internal: list[str], subdomains: bool = False) -> DataFrame:
    """links with host and scope: relative, internal or external."""
    host = link_host(F.col("destination"))
    hosts = [h.lower().rstrip(".") for h in internal]
    own = host.isin(hosts)
    if subdomains:
        own = reduce(lambda c, h: c | host.endswith("." + h), hosts, own)
    return links.withColumn("host", host).withColumn("scope", F.when(host.isNull(), "relative").when(own, "internal").otherwise("external"))


def rewritten_destination(destination: Column, base: str | None = None, mapping: dict[str, str] | None = None, patterns: list[tuple[str, str]] = (), callback: Callable[[str], str] | None = None) -> Column:
    """A destination through the steps in order: exact map, patterns, a function, base for relative ones; none may hold a null sign."""
    out = destination
    if mapping:
        out = F.coalesce(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[out], out)
    for pattern, replacement in patterns:
        out = F.regexp_replace(out, pattern, replacement)
    if callback is not None:
        out = _mapped(callback)(out)
    if base:
        relative = ~out.rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:|//|#|/)")
        out = F.when(relative & (out != ""), F.concat(F.lit(base.rstrip("/") + "/"), out)).otherwise(out)
    return F.when(F.instr(out, "\0") > 0, F.raise_error(F.lit("a destination holds a null sign")).cast("string")).otherwise(out)


def _mapped(function: Callable[[str], str]):
    @F.pandas_udf("string")
    def each(values: pd.Series) -> pd.Series:
        return values.map(function)

    return each


def rewrite_links(links: DataFrame, new: Column) -> tuple[DataFrame, DataFrame]:
    """(patches, counts) of inline links with a new destination; references and links inside links are left."""
    rows = links.withColumn("new", new).withColumn("reach", F.max("end").over(Window.partitionBy("doc_id").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)))
    state = F.when(F.col("ref_label").isNotNull(), "reference").when(F.col("start") < F.col("reach"), "overlap").when(F.col("new") == F.col("destination"), "unchanged").otherwise("rewritten")
    rows = rows.withColumn("state", state)
    counts = rows.groupBy("doc_id").pivot("state", ["rewritten", "unchanged", "reference", "overlap"]).count().fillna(0)
    return patches.set_link_destinations(rows.where("state = 'rewritten'"), F.col("new")), counts


# ---- text --------------------------------------------------------------------------------------------------------


def mentions(inlines: DataFrame, people: DataFrame, prefix: str = "@", pattern: str = "[A-Za-z0-9_-]{1,128}") -> DataFrame:
    """(doc_id, block_pre, name, …) of the names in text that people (name, …) knows; a word before the prefix bars it.

    Several definitions are several calls; first_mentions() keeps the first that resolves a name.
    """
    text = inlines.where("kind = 'text'")
    names = text.select("doc_id", "block_pre", "inline_ord", F.explode(F.regexp_extract_all("text", F.lit(f"(?<![A-Za-z0-9_]){re.escape(prefix)}({pattern})"), F.lit(1))).alias("name"))
    return names.join(people, "name")


def first_mentions(*found: DataFrame) -> DataFrame:
    """Mentions of several definitions of equal columns, in order; what an earlier one resolved is no mention of a later one."""
    out = found[0]
    for later in found[1:]:
        out = out.unionByName(later.join(out.select("doc_id", "block_pre", "name").distinct(), ["doc_id", "block_pre", "name"], "left_anti"))
    return out


def smart_punctuation(text: Column) -> Column:
    """Typographic dashes, ellipses and quotes of plain text."""
    out = _dashes(F.regexp_replace(text, r"\.\.\.", "…"))
    out = F.regexp_replace(out, r"(^|[\s(\[{–—])\"", "$1“")
    out = F.replace(out, F.lit('"'), F.lit("”"))
    out = F.regexp_replace(out, r"(^|[\s(\[{–—“])'", "$1‘")
    return F.replace(out, F.lit("'"), F.lit("’"))


def code_title(info: Column) -> Column:
    """title= or else filename= of an info string, quoted or bare."""
    def value(name: str) -> Column:
        quoted = F.regexp_extract(info, rf'(?:^|[\s{{]){name}="([^"]*)"', 1)
        bare = F.regexp_extract(info, rf"(?:^|[\s{{]){name}=([^\s\"'}}]+)", 1)
        return F.when(quoted != "", quoted).when(bare != "", bare)

    return F.coalesce(value("title"), value("filename"))


# ---- resources ---------------------------------------------------------------------------------------------------


def safe_path(path: Column, extensions: tuple[str, ...] = ("md", "markdown")) -> Column:
    """Whether a path is relative, stays below its root and has an allowed extension."""
    parts = F.split(path, "/")
    return (path != "") & ~path.rlike(r"^(?:/|[A-Za-z]:|[A-Za-z][A-Za-z0-9+.-]*://)|\\|\x00") & ~F.exists(parts, lambda p: p.isin("..", ".", "")) & F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(*extensions)


def selected_lines(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last of a text, counted from 1."""
    return F.array_join(F.slice(F.split(text, "\r\n|\r|\n"), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def resolved(paths: DataFrame, resolver: Callable[[str], str | None]) -> DataFrame:
    """(path, text) of the paths that a function knows, for included() and imports()."""

    @F.pandas_udf("string")
    def read(values: pd.Series) -> pd.Series:
        return values.map(resolver)

    return paths.select("path").distinct().withColumn("text", read("path")).where("text is not null")


def filesystem_resources(spark, root: str, pattern: str = "*.{md,markdown}", most_bytes: int = 1 << 20) -> DataFrame:
    """(path, text, resource_id) of the files below root, up to a size; the id names root and path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).where(F.col("length") <= most_bytes)
    below = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    path = below.substr(F.lit(len(root.rstrip("/")) + 2), F.length(below))
    coded = F.rtrim(F.translate(F.base64(path.cast("binary")), "+/", "-_"), F.lit("="))
    return files.select(path.alias("path"), F.col("content").cast("string").alias("text"), F.concat(F.lit("filesystem:"), F.sha2(F.lit(root.rstrip("/")), 256), F.lit(":"), coded).alias("resource_id"))


PLACES = "array<struct<start: int, end: int, path: string>>"


def include_places(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, places) of rows: where include blocks stand at the root of a text, in code points; code and quotes hold none."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = Options.profile("commonmark", line_rules=(INCLUDE,))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("path", pa.string())]))
        for batch in batches:
            out = []
            for source in batch.column(1).to_pylist():
                found = BlockParser(source, options).parse().children if source and "@include" in source else []
                out.append([{"start": b.start, "end": b.end, "path": b.data["ext"]["path"]} for b in found if b.kind == "include"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], [key, text, "places"])

    picked = rows.select(key, F.col(text).cast("string").alias(text))
    return picked.mapInArrow(kernel, f"{key} {rows.schema[key].dataType.simpleString()}, {text} string, places {PLACES}")


def assembled(source: str, places: list[dict], found: list[dict], most_resources: int, most_bytes: int) -> tuple[str, int]:
    """A source with its includes in place, and the deepest level used; includes of too many resources or bytes stay as written."""
    held = {tuple(x["branch"]): x for x in found}
    totals: dict[int, list[int]] = {}
    for branch, x in held.items():
        own = totals.setdefault(branch[0], [0, 0])
        own[0] += 1
        own[1] += len(x["text"].encode())
    reached = 0

    def expand(text: str, own: list[dict], branch: tuple[int, ...]) -> str:
        nonlocal reached
        out, at = [], 0
        for k, p in enumerate(own):
            inner = held.get((*branch, k))
            if inner is None or (not branch and (totals[k][0] > most_resources or totals[k][1] > most_bytes)):
                continue
            reached = max(reached, len(branch) + 1)
            out += [text[at : p["start"]], expand(inner["text"], inner["places"], (*branch, k))]
            at = p["end"]
        return "".join([*out, text[at:]])

    return expand(source, places, ()), reached


def included(documents: DataFrame, resources: DataFrame, depth: int = 8, most_resources: int = 64, most_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, source, depth_reached) with @include "path" blocks replaced by resources (path, text), level by level.

    Only blocks at the root of a document or resource count, not lines of code.  A path may come again on another branch;
    unsafe, unknown and circular paths stay as they are written, and so do those below depth.  An include whose tree takes
    in more resources or bytes than allowed stays as a whole.
    """
    held = include_places(resources.select("path", F.regexp_replace("text", r"[\r\n]+$", "").alias("text")), "path", "text").withColumnRenamed("path", "_path").persist()
    docs = include_places(documents.select("doc_id", "source"), "doc_id", "source").persist()
    asked = docs.select("doc_id", F.array().cast("array<int>").alias("above"), F.array().cast("array<string>").alias("active"), F.posexplode("places").alias("k", "p"))
    levels = []
    for _ in range(depth):
        level = asked.where(safe_path(F.col("p.path")) & ~F.array_contains("active", F.col("p.path"))).join(held, F.col("p.path") == F.col("_path"))
        level = level.select("doc_id", F.concat("above", F.array("k")).alias("branch"), F.concat("active", F.array("_path")).alias("active"), "text", "places").persist()
        if level.isEmpty():
            break
        levels.append(level)
        asked = level.select("doc_id", F.col("branch").alias("above"), "active", F.posexplode("places").alias("k", "p"))
    if not levels:
        return docs.select("doc_id", "source", F.lit(0).alias("depth_reached"))
    listed = reduce(DataFrame.unionByName, levels).groupBy("doc_id").agg(F.collect_list(F.struct("branch", "text", "places")).alias("found"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("source", "places", "found"))
            made = [assembled(s, p, f, most_resources, most_bytes) if f else (s, 0) for s, p, f in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int32())], ["doc_id", "source", "depth_reached"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return docs.join(listed, "doc_id", "left").select("doc_id", "source", "places", "found").mapInArrow(kernel, f"doc_id {id_type}, source string, depth_reached int")


def _dashes(text: Column) -> Column:
    """Runs of two hyphens or more as em dashes of three and en dashes of two: all em, else all en, else em and as few en as fill the run."""

    def written(n: Column) -> Column:
        em = F.when(n % 3 == 0, n / 3).when(n % 2 == 0, 0).when(n % 3 == 2, (n - 2) / 3).otherwise((n - 4) / 3).try_cast("int")
        return F.concat(F.repeat(F.lit("—"), em), F.repeat(F.lit("–"), ((n - em * 3) / 2).try_cast("int")))

    hits = F.regexp_extract_all(text, F.lit("--+"), F.lit(0))
    return F.array_join(F.transform(F.split(text, "--+", -1), lambda p, i: F.concat(p, F.coalesce(written(F.length(F.get(hits, i))), F.lit("")))), "")
