"""Queries over whole real texts: documents and conversations written as marked-up sources, with the truth from their rows.

Every line of a document becomes a heading, a paragraph, a quote, a list item or fenced code by its number; every turn of
a conversation a quote or a paragraph of its lines.  What parsing, rendering, editing and formatting must give follows from
the lines, so the SQL says it without a parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell import format as formatting
from inkwell import functions as fn
from inkwell import lint, patches, stats, views
from inkwell.parse import blocks, inlines, kept, parse
from inkwell.sanitize import md_to_html


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of_lines(text: Column) -> Column:
    """The lines of a text that are not blank, with single blanks inside and none around."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(F.regexp_replace(x, "[ \t]+", " ")))
    return F.filter(lines, lambda x: x != "")


def level_of(i: Column) -> Column:
    return (F.floor(i / 5) % 6 + 1).cast("int")


def as_block(line: Column, i: Column) -> Column:
    kind = i % 5
    escaped = fn.md_escape(line)
    heading = F.concat(F.repeat(F.lit("#"), level_of(i)), F.lit(" "), escaped)
    return F.when(kind == 0, heading).when(kind == 1, escaped).when(kind == 2, F.concat(F.lit("> "), escaped)).when(kind == 3, F.concat(F.lit("- "), escaped)).otherwise(fn.md_code(line, F.lit("text")))


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source) of every document with a line."""
    rows = table(spark, sf_dir, "documents").select("doc_id", text_of_lines(F.col("text")).alias("lines")).where("size(lines) > 0")
    return rows.select("doc_id", fn.md_document(F.transform("lines", as_block)).alias("source"))


def untidy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents with other marks, blanks at line ends, too many blank lines and no final line ending."""

    def untidy(line: Column, i: Column) -> Column:
        kind, escaped = i % 5, fn.md_escape(line)
        heading = F.concat(F.repeat(F.lit("#"), level_of(i)), F.lit("   "), escaped)
        fence = F.concat(F.lit("~~~  text\n"), F.regexp_replace(line, "`|~", "'"), F.lit("\n~~~"))
        return F.when(kind == 0, heading).when(kind == 1, F.concat(escaped, F.lit("   "))).when(kind == 2, F.concat(F.lit("> "), escaped, F.lit("\t"))).when(kind == 3, F.concat(F.lit("* "), escaped)).otherwise(fence)

    rows = table(spark, sf_dir, "documents").select("doc_id", text_of_lines(F.col("text")).alias("lines")).where("size(lines) > 0")
    return rows.select("doc_id", F.array_join(F.transform("lines", untidy), "\n\n\n").alias("source"))


def conversation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source) of every conversation: turns of users as quotes, others as paragraphs."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.transform(text_of_lines(F.col("text")), fn.md_escape).alias("lines")).where("size(lines) > 0")
    quote = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("> "), x)), "\n")
    turns = turns.withColumn("block", F.when(F.col("role") == "user", quote).otherwise(F.array_join("lines", "\n")))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("turn", "block"))), lambda x: x["block"])
    return turns.groupBy("conv_id").agg(fn.md_document(listed).alias("source")).select(F.col("conv_id").cast("long").alias("doc_id"), "source")


def text_html(spark, sf_dir):
    """The HTML of every document, as a digest, and its length."""
    html = text_documents(spark, sf_dir).select("doc_id", md_to_html()(F.col("source")).alias("html"))
    return html.select("doc_id", F.md5("html").alias("digest"), F.length("html").cast("long").alias("n_chars"))


def text_blocks(spark, sf_dir):
    """How many blocks of a kind a document has below the root, and how long their texts are."""
    found = blocks(parse(text_documents(spark, sf_dir))).where("kind in ('atx-heading', 'paragraph', 'fenced-code')")
    text = F.coalesce("text", F.rtrim("code", F.lit("\n")))
    return found.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("cnt"), F.sum(F.length(text)).cast("long").alias("n_chars"), F.max("depth").cast("long").alias("deepest"))


def text_sections(spark, sf_dir):
    """Bytes and words of the section of every heading of level one."""
    parsed = kept(parse(text_documents(spark, sf_dir), fields=views.HEADING_COLUMNS, inline_kinds=()))
    b = blocks(parsed)
    heads = views.sections(b, parsed).where("level = 1")
    return heads.select("doc_id", "text", (F.col("section_end") - F.col("start")).cast("long").alias("n_bytes"))


def text_edits(spark, sf_dir):
    """Sources without quotes, with another language on code, and with renamed headings of level one."""
    docs = text_documents(spark, sf_dir)
    b = blocks(parse(docs, with_inlines=False).persist())
    made = patches.remove_blocks(b.where("kind = 'block-quote'")).unionByName(patches.set_code_languages(views.code_blocks(b), F.lit("txt")))
    made = made.unionByName(patches.rename_headings(views.headings(b, 1), F.lit("Part")))
    return patches.apply(docs, made).select("doc_id", F.md5("source").alias("digest"), F.octet_length("source").cast("long").alias("n_bytes"), "changed")


def text_formats(spark, sf_dir):
    """Untidy sources in the common style."""
    done = formatting.format_documents(untidy_documents(spark, sf_dir))
    return done.select("doc_id", F.md5("source").alias("digest"), F.octet_length("source").cast("long").alias("n_bytes"), "changed")


def text_problems(spark, sf_dir):
    """Problems of untidy sources by rule."""
    rules = ("no-trailing-spaces", "final-newline", "single-h1", "code-fence-info-spacing", "prefer-fenced-code-blocks")
    found = lint.check(kept(parse(untidy_documents(spark, sf_dir), fields=lint.FIELDS, inline_kinds=lint.INLINE_KINDS)), lint.Config(rules))
    return found.groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("cnt"))


def conversation_html(spark, sf_dir):
    html = conversation_documents(spark, sf_dir).select("doc_id", md_to_html()(F.col("source")).alias("html"))
    return html.select("doc_id", F.md5("html").alias("digest"), F.length("html").cast("long").alias("n_chars"))


def conversation_words(spark, sf_dir):
    """Words and paragraphs of conversations, by whether they stand in a quote."""
    parsed = parse(conversation_documents(spark, sf_dir)).persist()
    found = blocks(parsed).where("kind = 'paragraph'").withColumn("quoted", F.col("depth") > 1)
    return found.groupBy("doc_id", "quoted").agg(F.count(F.lit(1)).alias("cnt"), F.sum(stats.word_count(F.col("text"))).cast("long").alias("words"))


_QUERIES = (text_html, text_blocks, text_sections, text_edits, text_formats, text_problems, conversation_html, conversation_words)
QUERIES = {q.__name__: q for q in _QUERIES}

_LINES = r"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> '')"
_ESC = r"regexp_replace(line, '([!-/:-@\[-`{-~])', '\\\1', 'g')"
_HTML = """replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""
_NL = "chr(10)"
#: (doc_id, i, line, level): the lines of all documents, numbered from 0.
_L = f"""l AS (SELECT doc_id, i, lines[i + 1] AS line, (i // 5) % 6 + 1 AS level FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS i FROM (SELECT doc_id, {_LINES} AS lines FROM documents)))"""
_FENCE = "repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(line, '`+'), lambda x: length(x))), 0) + 1))"


def _source(heading: str, quote: str, language: str) -> str:
    return f"""CASE i % 5 WHEN 0 THEN {heading} WHEN 1 THEN {_ESC} WHEN 2 THEN {quote} WHEN 3 THEN '- ' || {_ESC} ELSE {_FENCE} || '{language}' || {_NL} || line || {_NL} || {_FENCE} END"""


_HEADING = f"repeat('#', CAST(level AS INTEGER)) || ' ' || {_ESC}"
_PLAIN = _source(_HEADING, f"'> ' || {_ESC}", "text")
_EDITED = _source(f"CASE WHEN level = 1 THEN '# Part' ELSE {_HEADING} END", "NULL", "txt")
_TIDY = f"""CASE i % 5 WHEN 0 THEN {_HEADING} WHEN 1 THEN {_ESC} WHEN 2 THEN '> ' || {_ESC} WHEN 3 THEN '- ' || {_ESC} ELSE '```text' || {_NL} || regexp_replace(line, '`|~', '''', 'g') || {_NL} || '```' END"""
_BLOCK_HTML = f"""CASE i % 5 WHEN 0 THEN '<h' || level || '>' || {_HTML} || '</h' || level || '>' WHEN 1 THEN '<p>' || {_HTML} || '</p>'
    WHEN 2 THEN '<blockquote>' || {_NL} || '<p>' || {_HTML} || '</p>' || {_NL} || '</blockquote>' WHEN 3 THEN '<ul>' || {_NL} || '<li>' || {_HTML} || '</li>' || {_NL} || '</ul>'
    ELSE '<pre><code class="language-text">' || {_HTML} || {_NL} || '</code></pre>' END || {_NL}"""
_TURNS = f"""t AS (SELECT conv_id, turn, role, list_filter({_LINES}, lambda x: true) AS lines FROM conversations),
    p AS (SELECT conv_id, turn, role, lines, array_to_string(lines, {_NL}) AS line FROM t WHERE len(lines) > 0)"""

ORACLE = {
    "text_html": f"WITH {_L}, h AS (SELECT doc_id, string_agg({_BLOCK_HTML}, '' ORDER BY i) AS html FROM l GROUP BY 1) SELECT doc_id, md5(html) AS digest, CAST(length(html) AS BIGINT) AS n_chars FROM h",
    "text_blocks": f"""WITH {_L} SELECT doc_id, CASE i % 5 WHEN 0 THEN 'atx-heading' WHEN 4 THEN 'fenced-code' ELSE 'paragraph' END AS kind, count(*) AS cnt, CAST(sum(length(line)) AS BIGINT) AS n_chars,
        CAST(max(CASE i % 5 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END) AS BIGINT) AS deepest FROM l GROUP BY 1, 2""",
    "text_sections": f"""WITH {_L}, s AS (SELECT *, count(*) FILTER (i % 5 = 0 AND level = 1) OVER (PARTITION BY doc_id ORDER BY i) AS part, strlen({_PLAIN}) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS back FROM l)
        SELECT doc_id, arg_min(line, i) AS text, CAST(sum(n + CASE WHEN back = 1 THEN 1 ELSE 2 END) AS BIGINT) AS n_bytes FROM s GROUP BY doc_id, part""",
    "text_edits": f"""WITH {_L}, e AS (SELECT doc_id, string_agg({_EDITED}, {_NL} || {_NL} ORDER BY i) || {_NL} AS source FROM l GROUP BY 1)
        SELECT doc_id, md5(e.source) AS digest, CAST(strlen(e.source) AS BIGINT) AS n_bytes, e.source <> o.source AS changed FROM e JOIN (SELECT doc_id, string_agg({_PLAIN}, {_NL} || {_NL} ORDER BY i) || {_NL} AS source FROM l GROUP BY 1) o USING (doc_id)""",
    "text_formats": f"WITH {_L}, f AS (SELECT doc_id, string_agg({_TIDY}, {_NL} || {_NL} ORDER BY i) || {_NL} AS source FROM l GROUP BY 1) SELECT doc_id, md5(source) AS digest, CAST(strlen(source) AS BIGINT) AS n_bytes, true AS changed FROM f",
    "text_problems": f"""WITH {_L} SELECT doc_id, 'no-trailing-spaces' AS rule_id, count(*) AS cnt FROM l WHERE i % 5 IN (1, 2) GROUP BY 1 UNION ALL SELECT doc_id, 'final-newline', 1 FROM l GROUP BY 1
        UNION ALL SELECT doc_id, 'code-fence-info-spacing', count(*) FROM l WHERE i % 5 = 4 GROUP BY 1 UNION ALL SELECT doc_id, 'single-h1', count(*) - 1 FROM l WHERE i % 5 = 0 AND level = 1 GROUP BY 1 HAVING count(*) > 1""",
    "conversation_html": f"""WITH {_TURNS}, h AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '<blockquote>' || {_NL} || '<p>' || {_HTML} || '</p>' || {_NL} || '</blockquote>' ELSE '<p>' || {_HTML} || '</p>' END || {_NL}, '' ORDER BY turn) AS html FROM p GROUP BY 1)
        SELECT CAST(conv_id AS BIGINT) AS doc_id, md5(html) AS digest, CAST(length(html) AS BIGINT) AS n_chars FROM h""",
    "conversation_words": rf"""WITH {_TURNS} SELECT CAST(conv_id AS BIGINT) AS doc_id, role = 'user' AS quoted, count(*) AS cnt, CAST(sum(len(regexp_extract_all(line, '[\p{{L}}\p{{N}}_]+'))) AS BIGINT) AS words FROM p GROUP BY 1, 2""",
}
