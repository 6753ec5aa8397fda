"""Lint rules as windows, anti-joins and predicates over the flat tables.

Every rule gives problems (doc_id, rule_id, message, start, end, fix struct); check() unions the enabled ones with
their severity, and fixes() makes patches of those that can be fixed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell import intervals, views
from inkwell.parse import blocks, dominant_eol, inlines, lines, references

FIX = "struct<start:int,end:int,replacement:string>"
#: Block kinds whose lines keep their trailing blanks.
OPAQUE = ("fenced-code", "indented-code", "html-block", "frontmatter:block")
#: What the rules here read of a parse: fields of blocks, and kinds of inlines.
FIELDS = ("pre", "depth", "kind", "start", "end", "level", "info", "language", "code", "fence_closed", "fence", "text", "fold", "slug", "own", "header", "rows", "row_ranges", "eol")
INLINE_KINDS = ("link", "image", "autolink", "code-span", "html-inline", "hard-break")


class Tables:
    """The flat tables of parsed documents that rules read."""

    def __init__(self, parsed: DataFrame):
        self.documents = parsed.select("doc_id", "source")
        self.blocks, self.inlines, self.references = blocks(parsed), inlines(parsed), references(parsed)
        self.headings = views.headings(self.blocks)
        self.lines = lines(parsed)


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    check: Callable[[Tables, Config], DataFrame]
    fixable: bool = False
    recommended: bool = False


@dataclass(frozen=True)
class Config:
    """Enabled rules, severities and options; changes give a new config."""

    rules: tuple[str, ...] = ()
    severities: dict[str, str] = field(default_factory=dict)
    options: dict[str, dict] = field(default_factory=dict)
    custom: tuple[Rule, ...] = ()

    @staticmethod
    def recommended() -> Config:
        return Config(tuple(r.id for r in RULES.values() if r.recommended))

    @staticmethod
    def all() -> Config:
        return Config(tuple(RULES))

    def with_rule(self, rule: str | Rule, **options) -> Config:
        name = rule if isinstance(rule, str) else rule.id
        known = {**RULES, **{r.id: r for r in self.custom}}
        if isinstance(rule, Rule):
            if name in known:
                raise ValueError(f"duplicate rule {name!r}")
            return replace(self, rules=(*self.rules, name), custom=(*self.custom, rule))
        if name not in known:
            raise ValueError(f"unknown rule {name!r}")
        return replace(self, rules=self.rules if name in self.rules else (*self.rules, name), options={**self.options, name: options})

    def without_rule(self, name: str) -> Config:
        return replace(self, rules=tuple(r for r in self.rules if r != name))

    def with_severity(self, name: str, severity: str) -> Config:
        if severity not in ("error", "warning", "info"):
            raise ValueError(f"unknown severity {severity!r}")
        return replace(self, severities={**self.severities, name: severity})

    def enabled(self) -> list[Rule]:
        known = {**RULES, **{r.id: r for r in self.custom}}
        if missing := [r for r in self.rules if r not in known]:
            raise ValueError(f"unknown rules {missing}")
        return [known[r] for r in self.rules]


def problem(rows: DataFrame, message: str | Column, start: Column | str = "start", end: Column | str = "end", fix: tuple[Column, Column, Column] | None = None) -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    fixed = F.struct(fix[0].cast("int").alias("start"), fix[1].cast("int").alias("end"), fix[2].cast("string").alias("replacement")) if fix else F.lit(None).cast(FIX)
    return rows.select("doc_id", (F.lit(message) if isinstance(message, str) else message).alias("message"), col(start).cast("int").alias("start"), col(end).cast("int").alias("end"), fixed.alias("fix"))


def _in_order():
    return Window.partitionBy("doc_id").orderBy("pre")


def _single_h1(t: Tables, c: Config) -> DataFrame:
    rows = t.headings.where("level = 1").withColumn("n", F.row_number().over(_in_order()))
    return problem(rows.where("n > 1"), "more than one heading of level 1")


def _skipped(t: Tables, c: Config) -> DataFrame:
    rows = t.headings.withColumn("before", F.lag("level").over(_in_order()))
    return problem(rows.where("level > before + 1"), "a heading level is skipped")


def _require_title(t: Tables, c: Config) -> DataFrame:
    top = t.blocks.where("depth = 1 and kind <> 'frontmatter:block'").groupBy("doc_id").agg(F.min_by(F.struct("kind", "level", "start", "end"), "pre").alias("b"))
    rows = t.documents.select("doc_id").join(top, "doc_id", "left").where("b is null or b.level is null or b.level <> 1")
    return problem(rows, "the document does not begin with a title", F.coalesce("b.start", F.lit(0)), F.coalesce("b.end", F.lit(0)))


def _duplicate_headings(t: Tables, c: Config) -> DataFrame:
    rows = t.headings.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "fold").orderBy("pre")))
    return problem(rows.where("n > 1"), "a heading repeats")


def _image_alt(t: Tables, c: Config) -> DataFrame:
    return problem(t.inlines.where("kind = 'image' and trim(text) = ''"), "an image has no alternative text")


def _empty_links(t: Tables, c: Config) -> DataFrame:
    return problem(t.inlines.where("kind in ('link', 'image') and destination = ''"), "a link has no destination")


def _bare_urls(t: Tables, c: Config) -> DataFrame:
    rows = t.inlines.where("kind = 'autolink' and not bracketed")
    return problem(rows, "a bare URL", fix=(F.col("start"), F.col("end"), F.concat(F.lit("<"), F.when(F.col("destination").startswith("mailto:"), F.col("text")).otherwise(F.col("destination")), F.lit(">"))))


def _dead_references(t: Tables, c: Config) -> DataFrame:
    unused = t.references.where("not used").select("doc_id", F.col("block_pre").alias("pre"))
    return problem(t.blocks.where("kind = 'link-reference-definition'").select("doc_id", "pre", "start", "end").join(unused, ["doc_id", "pre"]), "a reference definition is not used")


def _fence_line(t: Tables) -> DataFrame:
    """Fenced blocks with their opening line."""
    own = t.blocks.where("kind = 'fenced-code'").select("doc_id", "start", "end", "depth", "language", "fence", "info", "code", "fence_closed", "own")
    return own.withColumn("opening", F.substring_index("own", "\n", 1)).drop("own")


def _code_language(t: Tables, c: Config) -> DataFrame:
    rows = t.blocks.where("kind = 'fenced-code' and language is null")
    default = c.options.get("require-code-block-language", {}).get("default_language")
    at = F.col("start") + F.length("fence")
    return problem(rows, "a code block names no language", fix=(at, at, F.lit(default)) if default else None)


def _info_spacing(t: Tables, c: Config) -> DataFrame:
    rows = _fence_line(t).withColumn("gap", F.length(F.regexp_extract("opening", "^(?:`+|~+)([ \t]+)[^ \t]", 1))).where("gap > 0")
    at = F.col("start") + F.length("fence")
    return problem(rows, "blanks stand before the info string", at, at + F.col("gap"), (at, at + F.col("gap"), F.lit("")))


def _prefer_fenced(t: Tables, c: Config) -> DataFrame:
    rows = t.blocks.where("kind = 'indented-code'")
    language = "text" if "require-code-block-language" in c.rules else ""
    good = (F.col("depth") <= 1) & ~F.col("code").contains("```")
    code = F.concat(F.lit(f"```{language}"), "eol", F.replace("code", F.lit("\n"), F.col("eol")), F.lit("```"))
    found = problem(rows.withColumn("good", good), "an indented code block", fix=(F.when(F.col("good"), F.col("start")), F.col("end"), code))
    return found.withColumn("fix", F.when(F.col("fix.start").isNotNull(), F.col("fix")))


def _closed_fence(t: Tables, c: Config) -> DataFrame:
    return problem(t.blocks.where("kind = 'fenced-code' and not fence_closed"), "a code fence is not closed")


def _table_columns(t: Tables, c: Config) -> DataFrame:
    rows = t.blocks.where("kind = 'gfm:table'").select("doc_id", F.size("header").alias("width"), F.inline(F.arrays_zip(F.col("rows").alias("cells"), F.col("row_ranges").alias("r"))))
    return problem(rows.where("size(cells) <> width"), "a table row has another number of cells than the header", "r.start", "r.end")


def _trailing_spaces(t: Tables, c: Config) -> DataFrame:
    blank = t.lines.withColumn("gap", F.length("text") - F.length(F.regexp_replace("text", "[ \t]+$", ""))).where("gap > 0")
    opaque = t.blocks.where(F.col("kind").isin(*OPAQUE)).select("doc_id", F.col("start").alias("a"), F.col("end").alias("b"))
    raw = t.inlines.where("kind in ('code-span', 'html-inline')").select("doc_id", F.col("start").alias("a"), F.col("end").alias("b"))
    outside = intervals.apart(blank, opaque.unionByName(raw), F.col("content_end") - F.col("gap"), F.col("content_end"))
    # A hard break of two blanks or more keeps two.
    breaks = t.inlines.where("kind = 'hard-break'").select("doc_id", (F.col("end") - 1).alias("at"), F.lit(True).alias("hard"))
    marked = outside.join(breaks, (outside["doc_id"] == breaks["doc_id"]) & (outside["content_end"] == breaks["at"]), "left").select(outside["*"], "hard")
    keep = F.when(F.col("hard") & F.col("text").endswith("  "), 2).otherwise(0)
    rows = marked.withColumn("keep", keep).where("gap > keep")
    begin = F.col("content_end") - F.col("gap")
    return problem(rows, "blanks at the end of a line", begin, "content_end", (begin, F.col("content_end"), F.repeat(F.lit(" "), F.col("keep"))))


def _final_newline(t: Tables, c: Config) -> DataFrame:
    last = F.expr("cast(substring(source, -1, 1) as string)")
    rows = t.documents.where(F.octet_length("source") > 0).where(~last.isin("\n", "\r")).withColumn("n", F.octet_length("source"))
    return problem(rows, "the last line has no ending", "n", "n", (F.col("n"), F.col("n"), dominant_eol(F.col("source"))))


def _dead_anchors(t: Tables, c: Config) -> DataFrame:
    target = F.expr("substring(destination, 2)")
    decoded = F.coalesce(F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B"))), target)
    own = t.inlines.where("kind = 'link' and startswith(destination, '#') and length(destination) > 1").withColumn("slug", decoded)
    return problem(own.join(views.slugs(t.blocks).select("doc_id", "slug"), ["doc_id", "slug"], "left_anti"), "no heading has this anchor")


RULES: dict[str, Rule] = {
    r.id: r
    for r in (
        Rule("single-h1", "structure", _single_h1, recommended=True),
        Rule("no-skipped-heading-levels", "structure", _skipped, recommended=True),
        Rule("require-title", "structure", _require_title, recommended=True),
        Rule("no-duplicate-headings", "structure", _duplicate_headings, recommended=True),
        Rule("require-image-alt", "accessibility", _image_alt),
        Rule("no-empty-links", "links", _empty_links),
        Rule("no-bare-urls", "links", _bare_urls, fixable=True),
        Rule("no-dead-reference-definitions", "links", _dead_references),
        Rule("require-code-block-language", "code", _code_language, fixable=True),
        Rule("code-fence-info-spacing", "code", _info_spacing, fixable=True),
        Rule("prefer-fenced-code-blocks", "code", _prefer_fenced, fixable=True),
        Rule("require-closed-code-fence", "code", _closed_fence),
        Rule("consistent-table-columns", "structure", _table_columns),
        Rule("no-trailing-spaces", "style", _trailing_spaces, fixable=True),
        Rule("final-newline", "style", _final_newline, fixable=True),
        Rule("no-dead-anchor", "links", _dead_anchors, recommended=True),
    )
}


def check(parsed: DataFrame, config: Config | None = None) -> DataFrame:
    """All problems (doc_id, rule_id, severity, message, start, end, fix) of the enabled rules; parsed should be persisted."""
    config = config or Config.recommended()
    tables = Tables(parsed)
    found = None
    for rule in config.enabled():
        rows = rule.check(tables, config).withColumn("rule_id", F.lit(rule.id)).withColumn("severity", F.lit(config.severities.get(rule.id, "error")))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = problem(tables.documents.limit(0), "", F.lit(0), F.lit(0)).withColumn("rule_id", F.lit("")).withColumn("severity", F.lit(""))
    return found.select("doc_id", "rule_id", "severity", "message", "start", "end", "fix")


def fixes(problems: DataFrame) -> DataFrame:
    """Patches of the problems that can be fixed."""
    return problems.where("fix is not null").select("doc_id", "fix.start", "fix.end", F.col("fix.replacement").cast("binary").alias("replacement"), F.concat(F.lit("fix "), F.col("rule_id")).alias("description")).dropDuplicates(["doc_id", "start", "end", "replacement"])


def report(problems: DataFrame) -> DataFrame:
    """Per document: how many problems and errors."""
    return problems.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_problems"), F.count_if(F.col("severity") == "error").alias("n_errors"))


def ordered(problems: DataFrame) -> DataFrame:
    """Problems by document, place and rule."""
    return problems.orderBy("doc_id", "start", "end", "rule_id")


def clean(documents: DataFrame, problems: DataFrame) -> DataFrame:
    """documents with is_clean and has_errors."""
    found = report(problems)
    joined = documents.join(found, "doc_id", "left")
    return joined.withColumn("is_clean", F.col("n_problems").isNull()).withColumn("has_errors", F.coalesce(F.col("n_errors") > 0, F.lit(False))).drop("n_problems", "n_errors")


def metadata(spark) -> DataFrame:
    return spark.createDataFrame([(r.id, r.category, r.fixable, r.recommended) for r in RULES.values()], "rule_id string, category string, fixable boolean, recommended boolean")
