"""What keeps queries within an executor: bounded passes, rows in parts, tables written once, one scan of a parse."""

import pytest
from inkwell import corpus, format, lint, parse, queries, views
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LONG = "# T\n\n[r]: /x\n\n" + "".join(f"## H{i} *e*\n\n- [x] a `b`\n\n" for i in range(300)) + "[r]\n"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def cached(spark):
    return not spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_parts_give_the_same_tables(spark):
    docs = spark.createDataFrame([(1, LONG), (2, None), (3, "a\n"), (4, "")], "doc_id long, source string")
    whole, parts = parse.parse(docs), parse.parse(docs, part=100)
    assert parts.count() > 4 and parts.select(F.max(F.size("blocks"))).first()[0] <= 100
    assert parts.where("source is not null").count() == 3
    for table in (parse.blocks, parse.inlines, parse.references):
        columns = [c for c, t in table(whole).dtypes if not t.startswith("map")]
        assert sorted(map(str, table(whole).select(columns).collect())) == sorted(map(str, table(parts).select(columns).collect()))
    ends = lambda p: sorted(views.sections(parse.blocks(p), p).select("doc_id", "pre", "section_end").collect())
    assert ends(whole) == ends(parts)


def test_a_parse_of_named_fields(spark):
    docs = spark.createDataFrame([(1, LONG)], "doc_id long, source string")
    some = parse.parse(docs, fields=("pre", "kind"), inline_kinds=("code-span",))
    assert parse.blocks(some).columns == ["doc_id", "pre", "kind"] and parse.blocks(some).count() == parse.blocks(parse.parse(docs)).count()
    assert {r.kind for r in parse.inlines(some).collect()} == {"code-span"}
    with pytest.raises(ValueError, match="unknown fields"):
        parse.parse(docs, fields=("nope",))


def test_passes_are_bounded_by_bytes():
    assert list(parse._passes([])) == []
    assert list(parse._passes([1] * 450)) == [(0, 200), (200, 400), (400, 450)]
    assert list(parse._passes([1, parse.PASS_BYTES, 1, 1])) == [(0, 1), (1, 2), (2, 4)]


def test_rules_and_passes_name_all_that_they_read(spark):
    docs = spark.createDataFrame([(1, "# A\n\n### A\n\n    x\n\n* i  \n\n~~~  js\ny\n~~~\n\nhttp://a.b [x]() ![](z)\n\n|a|\n|-|\n|b|c|\n")], "doc_id long, source string")
    rows = lambda p: sorted(map(str, lint.check(p, lint.Config.all()).collect()))
    assert rows(parse.parse(docs)) == rows(parse.parse(docs, fields=lint.FIELDS, inline_kinds=lint.INLINE_KINDS)) != []
    patches = lambda p: sorted(map(str, format.format_patches(p).collect()))
    assert patches(parse.parse(docs)) == patches(parse.parse(docs, fields=format.FIELDS, inline_kinds=lint.INLINE_KINDS)) != []


@pytest.mark.parametrize("name", ["text_formats", "text_problems", "text_sections", "structural_views", "edits", "lint_problems", "statistics", "skipped_levels", "section_extents", "section_word_counts"])
def test_no_query_caches_whole_parsed_documents(spark, name):
    spark.catalog.clearCache()
    made = queries.QUERIES[name](spark, SF)
    assert "InMemoryTableScan" not in plan(made) or name in ("structural_views", "edits")  # patches and small tables may be cached
    assert made.count() > 0
    if name not in ("structural_views", "edits"):
        assert not cached(spark)
    spark.catalog.clearCache()


def test_tasks_parse_once(spark):
    assert plan(queries.task_states(spark, SF)).count("MapInArrow") == 1


def test_documents_of_nations_are_whole(spark):
    """A nation is one document however many customers it has."""
    sf = "/root/testdata/sf0.01"
    nations = spark.read.parquet(f"{sf}/customer.parquet").select("c_nationkey").distinct().count()
    assert queries.html_documents(spark, sf).count() == nations
    assert queries.section_extents(spark, sf).select("doc_id").distinct().count() == nations
    assert queries.section_word_counts(spark, sf).select("doc_id").distinct().count() == nations
