"""Registered queries of the engine, each with SQL that says what it must return.

Documents are built from relational rows by column functions, parsed by the kernel, and read back as tables; the SQL
computes the truth from the rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell import cases, corpus
from inkwell import format as formatting
from inkwell import functions as fn
from inkwell import lint, patches, stats, views
from inkwell.parse import blocks, dominant_eol, inlines, kept, lines, parse, references


#: Keys of customers that share the documents of their nations, so that documents stay as long as they are when there are more.
CUSTOMERS = 1000
#: Blocks of a document that a row of a parse holds at most, where documents grow with the tables.
PART = 5000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grouped(rows: DataFrame, key: str, order: list[str], line: Column, head: Column | None = None) -> DataFrame:
    """(doc_id, source): the lines of a key's rows in order, below a heading."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"])
    made = rows.groupBy(key).agg(parts.alias("parts"), *([F.first(head).alias("head")] if head is not None else []))
    body = F.concat(F.array("head"), F.col("parts")) if head is not None else F.col("parts")
    return made.select(F.col(key).cast("long").alias("doc_id"), fn.md_document(body).alias("source"))


def nation_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    """Customers with their nation, the section of each, and the heading of its nation."""
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    section = F.concat(fn.md_heading(2, F.col("c_name")), F.lit("\n\n"), fn.md_paragraph(F.col("c_mktsegment")))
    return rows, section, fn.md_heading(1, F.col("n_name"))


def nation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per nation and CUSTOMERS keys: the nation's name, and a section for every customer."""
    rows, section, head = nation_rows(spark, sf_dir)
    rows = rows.withColumn("doc", F.floor(F.col("c_custkey") / CUSTOMERS) * 25 + F.col("n_nationkey"))
    return grouped(rows, "doc", ["c_custkey"], section, head)


def whole_nation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per nation, whose length grows with the customers: its name, and a section for every customer."""
    rows, section, head = nation_rows(spark, sf_dir)
    return grouped(rows, "n_nationkey", ["c_custkey"], section, head)


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per 100 orders: headings of varying level over task items."""
    rows = table(spark, sf_dir, "orders").withColumn("doc", F.floor(F.col("o_orderkey") / 100))
    box = F.when(F.col("o_orderstatus") == "F", "- [x] ").otherwise("- [ ] ")
    level = (F.col("o_orderkey") % 6 + 1).cast("int")
    line = F.concat(fn.md_heading(level, F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))), F.lit("\n\n"), box, fn.md_escape(F.col("o_orderpriority")))
    return grouped(rows, "doc", ["o_orderkey"], line)


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per event: its JSON in a fenced block, open for every fifth."""
    rows = table(spark, sf_dir, "events")
    close = F.when(F.col("event_id") % 5 == 0, "").otherwise("\n```\n")
    source = F.concat(F.lit("```"), F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.col("event_type")), F.lit("\n"), F.coalesce("props", F.lit("{}")), close)
    return rows.select(F.col("event_id").alias("doc_id"), source.alias("source"))


def line_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per order: a table of its lines, every fourth row one cell short."""
    rows = table(spark, sf_dir, "lineitem")
    cells = F.concat(F.lit("| "), F.col("l_partkey").cast("string"), F.lit(" | "), F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linenumber") % 4 == 0, "").otherwise(F.concat(F.lit(" | "), F.col("l_returnflag"))), F.lit(" |"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", cells.alias("c")))), lambda x: x["c"])
    head = F.lit("| part | qty | flag |\n| --- | --: | :-: |\n")
    return rows.groupBy("l_orderkey").agg(F.concat(head, F.array_join(parts, "\n"), F.lit("\n")).alias("source")).select(F.col("l_orderkey").alias("doc_id"), "source")


def supplier_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per supplier: a reference, a use of it but for every third, a dead anchor for every fourth, a bare URL for every fifth."""
    rows = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    use = F.when(F.col("s_suppkey") % 3 == 0, fn.md_escape(F.col("s_name"))).otherwise(F.concat(F.lit("["), fn.md_escape(F.col("s_name")), F.lit("][k"), key, F.lit("]")))
    anchor = F.when(F.col("s_suppkey") % 4 == 0, "[gone](#nowhere)").otherwise("[up](#supplier)")
    bare = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("\n\nsee https://s"), key, F.lit(".example/p"))).otherwise("")
    source = F.concat(F.lit("# Supplier\n\n"), use, F.lit(" "), anchor, F.lit(" ![]("), key, F.lit(".png)"), bare, F.lit("\n\n[k"), key, F.lit("]: https://n"), F.col("s_nationkey").cast("string"), F.lit(".example/"), key, F.lit("\n"))
    return rows.select(F.col("s_suppkey").cast("long").alias("doc_id"), source.alias("source"))


def part_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per 50 parts: headings of few distinct names, so that slugs repeat; skipped levels; trailing blanks."""
    rows = table(spark, sf_dir, "part").withColumn("doc", F.floor(F.col("p_partkey") / 50))
    level = (F.when(F.col("p_partkey") % 50 == 0, 1).otherwise(F.col("p_partkey") % 3 + 2)).cast("int")
    blanks = F.when(F.col("p_partkey") % 7 == 0, "  ").otherwise("")
    line = F.concat(fn.md_heading(level, F.col("p_name")), F.lit("\n\n"), fn.md_escape(F.col("p_brand")), blanks)
    return grouped(rows, "doc", ["p_partkey"], line)


def heading_levels(spark, sf_dir):
    found = views.headings(blocks(parse(nation_documents(spark, sf_dir))))
    return found.groupBy((F.col("doc_id") % 25).alias("n_nationkey"), F.col("level").cast("int").alias("level")).agg(F.count(F.lit(1)).alias("cnt"))


def document_titles(spark, sf_dir):
    return views.titles(blocks(parse(nation_documents(spark, sf_dir)))).select("doc_id", "title")


def section_extents(spark, sf_dir):
    """Bytes of every customer's section."""
    parsed = kept(parse(whole_nation_documents(spark, sf_dir), fields=("pre", "kind", "level", "text", "start"), inline_kinds=(), part=PART))
    found = views.sections(blocks(parsed), parsed).where("level = 2")
    return found.select("doc_id", "text", (F.col("section_end") - F.col("start")).cast("long").alias("n_bytes"))


def section_word_counts(spark, sf_dir):
    parsed = kept(parse(whole_nation_documents(spark, sf_dir), fields=("pre", "kind", "level", "text"), inline_kinds=("text", "code-span", "autolink"), part=PART))
    return stats.section_words(blocks(parsed), inlines(parsed)).where("section_pre > 1").select("doc_id", "text", "words")


def order_headings(spark, sf_dir):
    found = views.headings(blocks(parse(order_documents(spark, sf_dir))))
    return found.groupBy("doc_id", F.col("level").cast("int").alias("level")).agg(F.count(F.lit(1)).alias("cnt"))


def task_states(spark, sf_dir):
    found = views.tasks(blocks(parse(order_documents(spark, sf_dir), fields=("pre", "parent_pre", "sibling", "kind", "task_state", "text"), inline_kinds=())))
    return found.groupBy("doc_id", "task_state", "text").agg(F.count(F.lit(1)).alias("cnt"))


def skipped_levels(spark, sf_dir):
    problems = lint.check(kept(parse(order_documents(spark, sf_dir), fields=views.HEADING_COLUMNS, inline_kinds=())), lint.Config(("no-skipped-heading-levels", "single-h1")))
    return problems.groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("cnt"))


def code_languages(spark, sf_dir):
    found = views.code_blocks(blocks(parse(event_documents(spark, sf_dir), with_inlines=False)))
    return found.groupBy(F.coalesce("language", F.lit("plain")).alias("language"), "fence_closed").agg(F.count(F.lit(1)).alias("cnt"), F.sum(F.octet_length("code")).cast("long").alias("n_bytes"))


def code_rules(spark, sf_dir):
    problems = lint.check(parse(event_documents(spark, sf_dir)).persist(), lint.Config(("require-closed-code-fence", "require-code-block-language", "final-newline")))
    return problems.groupBy("rule_id").agg(F.count(F.lit(1)).alias("cnt"))


def table_cells(spark, sf_dir):
    found = views.table_rows(blocks(parse(line_documents(spark, sf_dir), with_inlines=False)))
    return found.select("doc_id", F.get("cells", F.lit(0)).cast("long").alias("part"), F.get("cells", F.lit(1)).cast("long").alias("qty"), F.get("cells", F.lit(2)).alias("flag"))


def ragged_rows(spark, sf_dir):
    problems = lint.check(parse(line_documents(spark, sf_dir)).persist(), lint.Config(("consistent-table-columns",)))
    return problems.groupBy("doc_id").agg(F.count(F.lit(1)).alias("cnt"))


def link_hosts(spark, sf_dir):
    found = views.links(inlines(parse(supplier_documents(spark, sf_dir)))).withColumn("host", F.try_parse_url("destination", F.lit("HOST"))).where("host is not null")
    return found.groupBy("host").agg(F.count(F.lit(1)).alias("cnt"))


def unused_references(spark, sf_dir):
    return views.unused_references(references(parse(supplier_documents(spark, sf_dir)))).select("doc_id", "label_key")


def link_rules(spark, sf_dir):
    rules = ("no-dead-anchor", "no-bare-urls", "no-dead-reference-definitions", "require-image-alt", "no-empty-links")
    problems = lint.check(parse(supplier_documents(spark, sf_dir)).persist(), lint.Config(rules))
    return problems.select("doc_id", "rule_id")


def fixed_urls(spark, sf_dir):
    """Sources after the fix of bare URLs, of those that change."""
    docs = supplier_documents(spark, sf_dir)
    problems = lint.check(parse(docs).persist(), lint.Config(("no-bare-urls",)))
    done = patches.apply(docs, lint.fixes(problems)).where("changed")
    return done.select("doc_id", F.col("source").cast("string").alias("source"))


def rewritten_links(spark, sf_dir):
    """Sources after all references became inline links to a mirror."""
    docs = supplier_documents(spark, sf_dir)
    found = views.links(inlines(parse(docs))).where("ref_label is not null")
    edits = patches.set_link_destinations(found, F.concat(F.lit("https://mirror.example/"), F.col("doc_id").cast("string")))
    return patches.apply(docs, edits).where("changed").select("doc_id", F.col("source").cast("string").alias("source"))


def heading_slugs(spark, sf_dir):
    """How many headings of a document have each base slug, and how many distinct slugs they got."""
    parsed = parse(part_documents(spark, sf_dir)).persist()
    b = blocks(parsed)
    found = views.slugs(b).join(views.headings(b).select("doc_id", "pre", "fold"), ["doc_id", "pre"])
    return found.groupBy("doc_id", fn.slug_base(F.col("fold")).alias("base")).agg(F.count(F.lit(1)).alias("cnt"), F.count_distinct("slug").alias("distinct_slugs"), F.max(F.length("slug")).cast("long").alias("longest"))


def duplicate_headings(spark, sf_dir):
    problems = lint.check(parse(part_documents(spark, sf_dir)).persist(), lint.Config(("no-duplicate-headings",)))
    return problems.groupBy("doc_id").agg(F.count(F.lit(1)).alias("cnt"))


def formatted(spark, sf_dir):
    """Sources after all formatter passes."""
    return formatting.format_documents(part_documents(spark, sf_dir)).select("doc_id", F.col("source").cast("string").alias("source"), "changed")


def renamed_headings(spark, sf_dir):
    docs = nation_documents(spark, sf_dir)
    edits = patches.rename_headings(views.headings(blocks(parse(docs)), 1), F.concat(F.lit("Nation "), F.col("doc_id").cast("string")))
    done = patches.apply(docs, edits)
    return done.select("doc_id", F.substring_index(F.col("source").cast("string"), "\n", 1).alias("first_line"), F.octet_length("source").cast("long").alias("n_bytes"))


def document_statistics(spark, sf_dir):
    parsed = parse(nation_documents(spark, sf_dir)).persist()
    found = stats.statistics(parsed, blocks(parsed), inlines(parsed))
    return found.select("doc_id", "heading_count", F.col("max_heading_depth").cast("long").alias("max_heading_depth"), "word_count", "character_count", "reading_minutes", F.size("outline").cast("long").alias("outline_lines"))


def text_lines(spark, sf_dir):
    """Line table of the raw documents, summed per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source"))
    return lines(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max("line_end").cast("long").alias("n_bytes"), F.max(F.length("text")).cast("long").alias("longest"))


def text_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.regexp_count("text", F.lit(stats.WORD)).cast("long").alias("words"), F.char_length("text").cast("long").alias("characters"), dominant_eol(F.col("text")).alias("eol"))


def filtered_pages(spark, sf_dir):
    """Raw pages after the tag filter and after escaping, as digests."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.md5(fn.tag_filter(F.col("html")).cast("binary")).alias("filtered"), F.md5(fn.html_escape(F.col("html")).cast("binary")).alias("escaped"))


def page_hosts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.where(fn.url_allowed(F.col("url"))).groupBy(F.parse_url("url", F.lit("HOST")).alias("host")).agg(F.count(F.lit(1)).alias("cnt"))


def html_documents(spark, sf_dir):
    from inkwell.sanitize import md_to_html

    return whole_nation_documents(spark, sf_dir).select("doc_id", md_to_html()(F.col("source")).alias("html"))


def sanitized_pages(spark, sf_dir):
    from inkwell.sanitize import sanitize_html

    return table(spark, sf_dir, "pages").select("page_id", sanitize_html("html").alias("html"))


_QUERIES = (
    heading_levels, document_titles, section_extents, section_word_counts, order_headings, task_states, skipped_levels, code_languages, code_rules, table_cells, ragged_rows, link_hosts,
    unused_references, link_rules, fixed_urls, rewritten_links, heading_slugs, duplicate_headings, formatted, renamed_headings, document_statistics, text_lines, text_words, filtered_pages,
    page_hosts, html_documents, sanitized_pages,
)
QUERIES = {q.__name__: q for q in _QUERIES}

_ESC = r"regexp_replace({0}, '([!-/:-@\[-`{{-~])', '\\\1', 'g')"
_DOC = f"((c_custkey // {CUSTOMERS}) * 25 + c_nationkey)"
_FILTERED = "title|textarea|style|xmp|iframe|noembed|noframes|script|plaintext"
_SUPPLIER = f"""(SELECT CAST(s_suppkey AS BIGINT) AS doc_id, '# Supplier' || chr(10) || chr(10)
  || CASE WHEN s_suppkey % 3 = 0 THEN {_ESC.format("s_name")} ELSE @USE@ END || ' ' || CASE WHEN s_suppkey % 4 = 0 THEN '[gone](#nowhere)' ELSE '[up](#supplier)' END
  || ' ![](' || s_suppkey || '.png)' || CASE WHEN s_suppkey % 5 = 0 THEN chr(10) || chr(10) || 'see @OPEN@https://s' || s_suppkey || '.example/p@CLOSE@' ELSE '' END
  || chr(10) || chr(10) || '[k' || s_suppkey || ']: https://n' || s_nationkey || '.example/' || s_suppkey || chr(10) AS source FROM supplier WHERE @WHERE@)"""


def _supplier(use: str, where: str, begin: str = "", end: str = "") -> str:
    return "SELECT * FROM " + _SUPPLIER.replace("@USE@", use).replace("@OPEN@", begin).replace("@CLOSE@", end).replace("@WHERE@", where)


_REF = f"'[' || {_ESC.format('s_name')} || '][k' || s_suppkey || ']'"
_PART = f"""SELECT p_partkey // 50 AS doc_id, p_partkey, p_name, CASE WHEN p_partkey % 50 = 0 THEN 1 ELSE p_partkey % 3 + 2 END AS level, p_brand FROM part"""

ORACLE = {
    "heading_levels": f"SELECT CAST(c_nationkey AS BIGINT) AS n_nationkey, 1 AS level, count(DISTINCT {_DOC}) AS cnt FROM customer GROUP BY 1 UNION ALL SELECT CAST(c_nationkey AS BIGINT), 2, count(*) FROM customer GROUP BY 1",
    "document_titles": f"SELECT DISTINCT CAST({_DOC} AS BIGINT) AS doc_id, n_name AS title FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "section_extents": f"""SELECT CAST(c_nationkey AS BIGINT) AS doc_id, c_name AS text,
        CAST(3 + strlen({_ESC.format("c_name")}) + 2 + strlen({_ESC.format("c_mktsegment")}) + CASE WHEN row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) = 1 THEN 1 ELSE 2 END AS BIGINT) AS n_bytes FROM customer""",
    "section_word_counts": r"SELECT CAST(c_nationkey AS BIGINT) AS doc_id, c_name AS text, CAST(len(regexp_extract_all(c_name, '[\p{L}\p{N}_]+')) + len(regexp_extract_all(c_mktsegment, '[\p{L}\p{N}_]+')) AS BIGINT) AS words FROM customer",
    "order_headings": "SELECT CAST(o_orderkey // 100 AS BIGINT) AS doc_id, CAST(o_orderkey % 6 + 1 AS INTEGER) AS level, count(*) AS cnt FROM orders GROUP BY 1, 2",
    "task_states": "SELECT CAST(o_orderkey // 100 AS BIGINT) AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 'checked' ELSE 'unchecked' END AS task_state, o_orderpriority AS text, count(*) AS cnt FROM orders GROUP BY 1, 2, 3",
    "skipped_levels": """WITH h AS (SELECT CAST(o_orderkey // 100 AS BIGINT) AS doc_id, o_orderkey % 6 + 1 AS level, lag(o_orderkey % 6 + 1) OVER (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey) AS before FROM orders)
        SELECT doc_id, 'no-skipped-heading-levels' AS rule_id, count(*) AS cnt FROM h WHERE level > before + 1 GROUP BY 1
        UNION ALL SELECT doc_id, 'single-h1', count(*) - 1 FROM h WHERE level = 1 GROUP BY 1 HAVING count(*) > 1""",
    "code_languages": """SELECT CASE WHEN event_id % 7 = 0 THEN 'plain' ELSE event_type END AS language, event_id % 5 <> 0 AS fence_closed, count(*) AS cnt, CAST(sum(strlen(coalesce(props, '{}')) + 1) AS BIGINT) AS n_bytes FROM events GROUP BY 1, 2""",
    "code_rules": """SELECT 'require-closed-code-fence' AS rule_id, count(*) AS cnt FROM events WHERE event_id % 5 = 0 UNION ALL SELECT 'require-code-block-language', count(*) FROM events WHERE event_id % 7 = 0
        UNION ALL SELECT 'final-newline', count(*) FROM events WHERE event_id % 5 = 0""",
    "table_cells": """SELECT l_orderkey AS doc_id, CAST(l_partkey AS BIGINT) AS part, CAST(l_quantity AS BIGINT) AS qty,
        CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_returnflag END AS flag FROM lineitem""",
    "ragged_rows": "SELECT l_orderkey AS doc_id, count(*) AS cnt FROM lineitem WHERE l_linenumber % 4 = 0 GROUP BY 1",
    "link_hosts": "SELECT 'n' || s_nationkey || '.example' AS host, count(*) AS cnt FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY 1",
    "unused_references": "SELECT CAST(s_suppkey AS BIGINT) AS doc_id, 'k' || s_suppkey AS label_key FROM supplier WHERE s_suppkey % 3 = 0",
    "link_rules": """SELECT CAST(s_suppkey AS BIGINT) AS doc_id, unnest(list_concat(['require-image-alt'], CASE WHEN s_suppkey % 3 = 0 THEN ['no-dead-reference-definitions'] ELSE [] END,
        CASE WHEN s_suppkey % 4 = 0 THEN ['no-dead-anchor'] ELSE [] END, CASE WHEN s_suppkey % 5 = 0 THEN ['no-bare-urls'] ELSE [] END)) AS rule_id FROM supplier""",
    "fixed_urls": _supplier(_REF, "s_suppkey % 5 = 0", "<", ">"),
    "rewritten_links": _supplier(f"'[' || {_ESC.format('s_name')} || '](https://mirror.example/' || s_suppkey || ')'", "s_suppkey % 3 <> 0"),
    "heading_slugs": rf"""WITH h AS ({_PART}), s AS (SELECT doc_id, regexp_replace(regexp_replace(lower(p_name), '[^\p{{L}}\p{{N}} -]+', '', 'g'), ' +', '-', 'g') AS base FROM h)
        SELECT CAST(doc_id AS BIGINT) AS doc_id, base, count(*) AS cnt, count(*) AS distinct_slugs, CAST(length(base) + CASE WHEN count(*) > 1 THEN 1 + length(CAST(count(*) - 1 AS VARCHAR)) ELSE 0 END AS BIGINT) AS longest FROM s GROUP BY 1, 2""",
    "duplicate_headings": f"WITH h AS ({_PART}) SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(count(*) - count(DISTINCT lower(p_name)) AS BIGINT) AS cnt FROM h GROUP BY 1 HAVING count(*) > count(DISTINCT lower(p_name))",
    "formatted": f"""WITH h AS ({_PART}) SELECT CAST(doc_id AS BIGINT) AS doc_id, string_agg(repeat('#', CAST(level AS INTEGER)) || ' ' || {_ESC.format("p_name")} || chr(10) || chr(10) || {_ESC.format("p_brand")}, chr(10) || chr(10) ORDER BY p_partkey) || chr(10) AS source,
        bool_or(p_partkey % 7 = 0) AS changed FROM h GROUP BY 1""",
    "renamed_headings": f"""SELECT CAST({_DOC} AS BIGINT) AS doc_id, '# Nation ' || {_DOC} AS first_line,
        CAST(strlen('# Nation ' || {_DOC}) + 1 + sum(1 + 3 + strlen({_ESC.format("c_name")}) + 2 + strlen({_ESC.format("c_mktsegment")}) + 1) AS BIGINT) AS n_bytes
        FROM customer GROUP BY {_DOC}""",
    "document_statistics": rf"""WITH c AS (SELECT {_DOC} AS doc, any_value(c_nationkey) AS nation, count(*) AS n, sum(len(regexp_extract_all(c_name, '[\p{{L}}\p{{N}}_]+')) + len(regexp_extract_all(c_mktsegment, '[\p{{L}}\p{{N}}_]+'))) AS w, sum(length(c_name) + length(c_mktsegment)) AS ch FROM customer GROUP BY 1)
        SELECT CAST(doc AS BIGINT) AS doc_id, n + 1 AS heading_count, CAST(2 AS BIGINT) AS max_heading_depth, CAST(w + len(regexp_extract_all(n_name, '[\p{{L}}\p{{N}}_]+')) AS BIGINT) AS word_count, CAST(ch + length(n_name) AS BIGINT) AS character_count,
        CAST(greatest(1, ceil((w + len(regexp_extract_all(n_name, '[\p{{L}}\p{{N}}_]+'))) / 200)) AS BIGINT) AS reading_minutes, n + 1 AS outline_lines FROM nation JOIN c ON nation = n_nationkey""",
    "text_lines": """WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL AND text <> '')
        SELECT doc_id, count(*) - CASE WHEN any_value(right(text, 1)) = chr(10) THEN 1 ELSE 0 END AS n_lines, CAST(any_value(strlen(text)) AS BIGINT) AS n_bytes, CAST(max(length(line)) AS BIGINT) AS longest FROM l GROUP BY 1""",
    "text_words": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS characters, chr(10) AS eol FROM documents",
    "filtered_pages": rf"""SELECT page_id, md5(regexp_replace(html, '<(/?(?:{_FILTERED})(?:\s|>|/))', '&lt;\1', 'gi')) AS filtered,
        md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped FROM pages""",
    "page_hosts": "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS cnt FROM pages GROUP BY 1",
}

_HTML = """replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""
ORACLE["html_documents"] = f"""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, '<h1>' || {_HTML.format("any_value(n_name)")} || '</h1>' || chr(10)
    || string_agg('<h2>' || {_HTML.format("c_name")} || '</h2>' || chr(10) || '<p>' || {_HTML.format("c_mktsegment")} || '</p>' || chr(10), '' ORDER BY c_custkey) AS html
    FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey"""

QUERIES |= cases.QUERIES | corpus.QUERIES
ORACLE |= cases.ORACLE | corpus.ORACLE
