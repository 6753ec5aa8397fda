import pytest
from inkwell import format as formatting
from inkwell import lint, patches, stats, views
from inkwell.functions import html_escape, md_document, md_escape, md_heading, slug_sequence, tag_filter, url_allowed
from inkwell.kernel.render import Policy, inline_to_html, to_html
from inkwell.parse import blocks, inlines, lines, parse, references
from pyspark.sql import functions as F

SAMPLE = """---
a: 1
---
# Title

Intro with [in](#details) and [out](https://example.com/x "t") and ![logo](l.png).

## Details

- [ ] open
- [x] done

```php
echo 1;
```

| a | b |
|---|--:|
| 1 | 2 |
| 3 |

[dead]: /x
### Details
see www.bare.example.com now
"""


@pytest.fixture(scope="module")
def parsed(spark):
    return parse(spark.createDataFrame([(1, SAMPLE), (2, ""), (3, None), (4, "Ä *b*\r\nc\r\n")], "doc_id long, source string")).persist()


def test_views(parsed):
    b, i = blocks(parsed), inlines(parsed)
    heads = views.headings(b).where("doc_id = 1").orderBy("pre").collect()
    assert [(h.level, h.text) for h in heads] == [(1, "Title"), (2, "Details"), (3, "Details")]
    assert views.titles(b).collect()[0].title == "Title"
    assert [r.slug for r in views.slugs(b).orderBy("pre").collect()] == ["title", "details", "details-1"]
    sections = views.section_text(views.sections(b, parsed), parsed).orderBy("pre").collect()
    assert sections[1].section_source.startswith("## Details") and sections[1].section_end == len(SAMPLE)
    assert [(r.text, r.destination) for r in views.links(i).orderBy("inline_ord").collect()] == [("in", "#details"), ("out", "https://example.com/x")]
    assert views.images(i).collect()[0].alt == "logo"
    assert views.code_blocks(b, "php").collect()[0].code == "echo 1;\n"
    assert views.front_matter(b).collect()[0].content == "a: 1\n"
    assert [r.cells for r in views.table_rows(b).orderBy("row").collect()] == [["1", "2"], ["3"]]
    assert sorted((r.task_state, r.text) for r in views.tasks(b).collect()) == [("checked", "done"), ("unchecked", "open")]
    assert [r.label_key for r in views.unused_references(references(parsed)).collect()] == ["dead"]
    assert views.Query(b).kind("nope").get().count() == 0
    assert views.Query(b).kind("list-item", "nope").where("task_state = 'checked'").get().count() == 1
    em = i.where("kind = 'emphasis'").collect()[0]
    assert "Ä *b*".encode()[em.start : em.end] == b"*b*"


def test_stats(spark, parsed):
    out = {r.doc_id: r for r in stats.statistics(parsed, blocks(parsed), inlines(parsed)).collect()}
    one = out[1]
    assert (one.heading_count, one.max_heading_depth, one.link_count, one.internal_link_count, one.image_count, one.code_block_count, one.table_count) == (3, 3, 2, 1, 1, 1, 1)
    assert one.outline == ["# Title", "## Details", "### Details"] and [tuple(x) for x in one.links_by_host] == [("example.com", 1)]
    assert out[2].word_count == 0 and out[2].reading_minutes == 0 and out[4].word_count == 3 and out[4].reading_minutes == 1
    words = {r.text: r.words for r in stats.section_words(blocks(parsed), inlines(parsed)).where("doc_id = 1 and section_pre < 8").collect()}
    assert words["Title"] == 8


def test_lint_and_fix(spark, parsed):
    found = lint.check(parsed, lint.Config.all()).where("doc_id = 1").collect()
    rules = sorted(r.rule_id for r in found)
    assert rules == ["consistent-table-columns", "no-bare-urls", "no-dead-reference-definitions", "no-duplicate-headings"]
    docs = spark.createDataFrame([(1, "#  A  \nx   \ny\n\n\n\n* b \n*\tc\n\nend\n\n    code\n\n``` py\nopen"), (2, "ok\n")], "doc_id long, source string")
    own = parse(docs).persist()
    problems = lint.check(own, lint.Config.all())
    assert {r.rule_id for r in problems.where("doc_id = 1").collect()} >= {"no-trailing-spaces", "final-newline", "code-fence-info-spacing", "prefer-fenced-code-blocks", "require-closed-code-fence"}
    once = formatting.format_documents(docs).persist()
    text = {r.doc_id: bytes(r.source).decode() for r in once.collect()}
    assert text[2] == "ok\n" and text[1].startswith("# A\nx  \ny\n\n- b\n-\tc\n") and text[1].endswith("```py\nopen\n")
    again = formatting.format_documents(once.select("doc_id", F.col("source").cast("string").alias("source"))).collect()
    assert not any(r.changed for r in again)
    with pytest.raises(ValueError, match="unknown rule"):
        lint.Config().with_rule("nope")


def test_patches_and_diff(spark):
    docs = spark.createDataFrame([(1, "# Ä\n\ntext\n"), (2, "same\n")], "doc_id long, source string")
    own = parse(docs).persist()
    edit = patches.rename_headings(views.headings(blocks(own)), F.lit("New"))
    done = patches.apply(docs, edit)
    assert {r.doc_id: (bytes(r.source).decode(), r.changed) for r in done.collect()} == {1: ("# New\n\ntext\n", True), 2: ("same\n", False)}
    assert patches.diffs(docs, done).collect()[0].diff == "--- a\n+++ b\n@@ -1,3 +1,3 @@\n-# Ä\n+# New\n \n text\n"
    clash = spark.createDataFrame([(1, 0, 3, "a", ""), (1, 2, 4, "b", "")], "doc_id long, start int, end int, replacement string, description string")
    assert patches.conflicts(clash).count() == 1
    assert not any(r.changed for r in patches.apply(docs, clash, on_conflict="skip").collect())
    with pytest.raises(Exception, match="conflicting"):
        patches.apply(docs, clash).collect()


def test_lines_and_functions(spark):
    docs = spark.createDataFrame([(1, "a\r\nä\rb\n\nc"), (2, "﻿x\n"), (3, "")], "doc_id long, source string")
    rows = [tuple(r) for r in lines(docs).orderBy("doc_id", "line_no").collect()]
    assert [(r[0], r[2], r[3], r[4], r[5], r[6]) for r in rows] == [
        (1, 0, 1, 3, "\r\n", "a"), (1, 3, 5, 6, "\r", "ä"), (1, 6, 7, 8, "\n", "b"), (1, 8, 8, 9, "\n", ""), (1, 9, 10, 10, "", "c"), (2, 3, 4, 5, "\n", "x")]
    one = spark.range(1)
    col = lambda c: one.select(c.alias("x")).first().x
    assert col(slug_sequence(F.array(*map(F.lit, ["a", "a", "a-1", "a", "", "", "a-1"])))) == ["a", "a-1", "a-1-1", "a-2", "", "-1", "a-1-2"]
    assert col(md_document(F.array(md_heading(2, F.lit("a_b")), md_escape(F.lit("1*2"))))) == "## a\\_b\n\n1\\*2\n"
    assert col(html_escape(F.lit('<&">'))) == "&lt;&amp;&quot;&gt;"
    assert col(tag_filter(F.lit("<script> <b> </STYLE>"))) == "&lt;script> <b> &lt;/STYLE>"
    assert [col(url_allowed(F.lit(u))) for u in ("http://a", "java\tscript:x", "/x", "mailto:a", "%01javascript:x")] == [True, False, True, True, False]


def test_limits(spark):
    docs = spark.createDataFrame([(1, "> > > deep\n"), (2, "a\n\nb\n")], "doc_id long, source string")
    rows = {r.doc_id: r.parse_error for r in parse(docs, nesting=2, blocks=1).collect()}
    assert rows[1].kind in ("nesting", "block-count") and rows[2].kind == "block-count" and rows[2].attempted == 2
    assert parse(docs, with_inlines=False).first().inlines is None


def test_more_passes(spark):
    source = "~~~ js\na ``` b\n~~~ \n\n1) x\n2) y\n\nt\n\n1) a\n1. b\n\n[k]:/u\n"
    docs = spark.createDataFrame([(1, source)], "doc_id long, source string")
    done = bytes(formatting.format_documents(docs).first().source).decode()
    assert done == "````js\na ``` b\n```` \n\n1. x\n2. y\n\nt\n\n1) a\n1. b\n\n[k]: /u\n"


SPEC = [
    ("\tfoo\tbaz\n", "<pre><code>foo\tbaz\n</code></pre>\n"),
    ("- foo\n\n\t\tbar\n", "<ul>\n<li>\n<p>foo</p>\n<pre><code>  bar\n</code></pre>\n</li>\n</ul>\n"),
    ("> foo\nbar\n===\n", "<blockquote>\n<p>foo\nbar\n===</p>\n</blockquote>\n"),
    ("[foo]: /url\n===\n[foo]\n", '<p>===\n<a href="/url">foo</a></p>\n'),
    ("***foo** bar*\n", "<p><em><strong>foo</strong> bar</em></p>\n"),
    ("[foo [bar](/uri)](/uri)\n", '<p>[foo <a href="/uri">bar</a>](/uri)</p>\n'),
    ("- a\n  - b\n\n    c\n- d\n", "<ul>\n<li>a\n<ul>\n<li>\n<p>b</p>\n<p>c</p>\n</li>\n</ul>\n</li>\n<li>d</li>\n</ul>\n"),
    ("| a |\n|---|\n| `x|y` |\n", "<table>\n<thead>\n<tr>\n<th>a</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td><code>x|y</code></td>\n</tr>\n</tbody>\n</table>\n"),
    ("~~a~~ ~b~\n", "<p><del>a</del> ~b~</p>\n"),
    ("> [!TIP] x\n", '<div class="markdown-alert markdown-alert-tip">\n<p class="markdown-alert-title">Tip</p>\n<p>x</p>\n</div>\n'),
]


@pytest.mark.parametrize(("source", "want"), SPEC)
def test_html(source, want):
    assert to_html(source, "github", Policy.spec()) == want


def test_safe_html():
    assert to_html('[x](javascript:a) <b onclick="x">') == '<p><a href="">x</a> &lt;b onclick=&quot;x&quot;&gt;</p>\n'
    assert inline_to_html("# *a*") == "# <em>a</em>" and to_html(None) is None
