import pytest
from inkwell import extensions as ext
from inkwell.kernel.rules import TABS
from inkwell import files, patches, views
from inkwell.parse import blocks, inlines, parse
from inkwell.sanitize import sanitized
from pyspark.sql import functions as F


def parsed_of(spark, *sources, **options):
    return parse(spark.createDataFrame(list(enumerate(sources, 1)), "doc_id long, source string"), **options).persist()


def test_footnotes(spark):
    own = parsed_of(spark, "a[^x] b[^y] c[^x] d[^no]\n\n[^y]: why\n\n[^x]: ex\n\n[^z]: unused\n", footnotes=True)
    uses, notes = ext.footnotes(blocks(own), inlines(own))
    assert sorted((r.label, r.number, r.occurrence) for r in uses.collect()) == [("x", 1, 1), ("x", 1, 2), ("y", 2, 1)]
    assert sorted((r.number, r.text) for r in notes.collect()) == [(1, "ex"), (2, "why")]
    assert spark.range(1).select(ext.footnote_html_id(F.lit(1), F.lit(2)).alias("x")).first().x == "fnref-1-2"


def test_contents_levels_slices(spark):
    own = parsed_of(spark, "# A\n## B\n### C\n## B\n> ## quoted\n")
    b = blocks(own)
    assert ext.contents_list(ext.contents(b, 2)).first().toc == "- [B](#b)\n  - [C](#c)\n- [B](#b-1)"
    assert [r.parent_pre for r in ext.slices(b).orderBy("pre").collect()] == [None, 2, None]
    assert [r.new_level for r in ext.shifted_levels(views.headings(b), 1).orderBy("pre").collect()] == [2, 3, 4, 3, 3]
    with pytest.raises(Exception, match="out of range"):
        ext.shifted_levels(views.headings(b), 4).collect()
    assert ext.permalinks(b, "u-").orderBy("pre").first().href == "#u-a"


def test_links(spark):
    own = parsed_of(spark, "[a](x.md) [b](http://Own.example./p) [c](https://sub.own.example) [d](//far.example) [e][k]\n\n[k]: /k\n")
    found = views.links(inlines(own))
    scopes = {r.text: r.scope for r in ext.classified_links(found, ["own.example"], subdomains=True).collect()}
    assert scopes == {"a": "relative", "b": "internal", "c": "internal", "d": "external", "e": "relative"}
    new = ext.rewritten_destination(F.col("destination"), "/docs", {"//far.example": "https://near.example"}, [("^http:", "https:")])
    edits, counts = ext.rewrite_links(found, new)
    done = bytes(patches.apply(own, edits).first().source).decode()
    assert done.startswith("[a](/docs/x.md) [b](https://Own.example./p) [c](https://sub.own.example) [d](https://near.example) [e][k]")
    assert counts.select("rewritten", "unchanged", "reference").first() == (3, 1, 1)


def test_text_functions(spark):
    col = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert col(ext.smart_punctuation(F.lit("\"It's\" 1--2 --- ... ----"))) == "“It’s” 1–2 — … ––"
    assert col(ext.code_title(F.lit('php title="a b" filename=x.php'))) == "a b" and col(ext.code_title(F.lit("php filename=x.php"))) == "x.php"
    assert [col(ext.safe_path(F.lit(p))) for p in ("a/b.md", "../a.md", "/a.md", "a.php", "a//b.md")] == [True, False, False, False, False]
    assert col(ext.selected_lines(F.lit("a\nb\nc\nd"), F.lit(2), F.lit(3))) == "b\nc"
    own = parsed_of(spark, "hi @ann and x@bob @carl `@ann`")
    people = spark.createDataFrame([("ann", "/u/ann")], "name string, url string")
    assert [r.url for r in ext.mentions(inlines(own), people).collect()] == ["/u/ann"]


def test_includes(spark):
    docs = spark.createDataFrame([(1, 'top\n@include "a.md"\nend'), (2, '@include "../x.md"')], "doc_id long, source string")
    resources = spark.createDataFrame([("a.md", 'A $1\n@include "b.md"\n'), ("b.md", 'B\n@include "a.md"\n')], "path string, text string")
    got = {r.doc_id: (r.source, r.depth_reached) for r in ext.included(docs, resources, depth=3).collect()}
    many = spark.createDataFrame([(1, '@include "c.md"\n@include "b.md"\n')], "doc_id long, source string")
    tree = spark.createDataFrame([("c.md", '@include "b.md"\n' * 3), ("b.md", "four")], "path string, text string")
    four = "four\nfour\nfour\nfour\n"
    assert ext.included(many, tree, most_bytes=70).first().source == four and ext.included(many, tree, most_resources=4).first().source == four
    for bound in ({"most_bytes": 50}, {"most_resources": 3}):  # summed over the levels of one include; the other one stays in
        assert ext.included(many, tree, **bound).first().source == '@include "c.md"\nfour\n'
    assert got == {1: ('top\nA $1\nB\n@include "a.md"\nend', 2), 2: ('@include "../x.md"', 0)}


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_bytes(b"# A\r\n")
    rows = files.read_files(spark, str(tmp_path / "in")).withColumn("path", F.lit("a.md"))
    write = lambda df, **k: {r.path: r.state for r in files.write_files(df, str(tmp_path / "in"), **k).collect()}
    kept = rows.select("path", "source", "sha256").collect()
    df = spark.createDataFrame(kept, "path string, source binary, sha256 string")
    assert write(df) == {"a.md": "unchanged"}
    edited = df.withColumn("source", F.lit(b"# B\n"))
    assert write(edited) == {"a.md": "written"} and (tmp_path / "in/a.md").read_bytes() == b"# B\n"
    assert write(df) == {"a.md": "conflict"}
    assert write(edited.withColumn("path", F.lit("../out.md"))) == {"../out.md": "refused"}


def test_sanitizer():
    assert sanitized('<p onclick=x class="a">t<script>x</script><center>u</center><a href="javascript:1">l</a><img src=i.png></p>') == '<p class="a">tu<a>l</a><img src="i.png" /></p>'
    assert sanitized(None) is None and sanitized("<b>x") == "<b>x</b>"


def test_custom_syntax(spark):
    from inkwell.kernel.render import Policy, to_html, normalised

    source = "@toc {min: 2}\n\na ==b c== d ++e++\n\n@tabs\n@tab One\n- x\n@endtabs\nafter\n\n{#top .wide .tall}\n# H\n\nhttps://video.example/1\n\n@import \"a.py\" {lines: 2-3}\n"
    rules = {"inline_rules": (ext.HIGHLIGHT, ext.paired_delimiter("insert", "++", "ins")), "line_rules": (ext.TABLE_OF_CONTENTS, ext.ATTRIBUTES, ext.EMBED, ext.IMPORT), "block_rules": TABS}
    own = parsed_of(spark, source, **rules)
    b = blocks(own).persist()
    kinds = [r.kind for r in b.where("depth > 0").orderBy("pre").collect()]
    assert kinds == ["table-of-contents:block", "paragraph", "tabs:group", "tabs:item", "list", "list-item", "paragraph", "paragraph", "attributes:block", "atx-heading", "embed", "import"]
    assert [(r.kind, r.text) for r in inlines(own).where("kind in ('highlight', 'insert')").orderBy("inline_ord").collect()] == [("highlight", "b c"), ("insert", "e")]
    at = ext.attributed(b).first()
    assert b.where(f"pre = {at.target_pre}").first().kind == "atx-heading" and at.attributes.id == "top" and at.attributes.classes == ["wide", "tall"]
    assert [r.url for r in ext.embeds(b, ["video.example"]).collect()] == ["https://video.example/1"] and ext.embeds(b, []).count() == 0
    assert ext.imports(b, spark.createDataFrame([("a.py", "1\n2\n3\n4\n")], "path string, text string")).first().code == "2\n3"
    assert "<mark>b c</mark> d <ins>e</ins>" in to_html(source, "github", Policy.spec(), **rules)
    plain = "Title\n=====\n\n* a\n* b\n\n    code\n\n1) x\n\n   y\n\n***\n> q\n\n| a |\n|:-|\n| 1 |\n"
    once = normalised(plain)
    assert once == normalised(once) and to_html(once) == to_html(plain)


def test_engine_composition(spark):
    from inkwell import lint
    from inkwell.engine import Engine, Extension
    from inkwell.kernel.render import normalised, Plugins

    marks = Extension("marks", inline_rules=(ext.HIGHLIGHT,), metrics={"paragraphs": F.count_if(F.col("kind") == "paragraph")})
    rule = lint.Rule("no-html", "style", lambda t, c: lint.problem(t.blocks.where("kind = 'html-block'"), "raw HTML"))
    engine = Engine("gfm").with_extension(marks, Extension("house", rules=(rule,)))
    docs = spark.createDataFrame([(1, "# A\n\n==b==\n\n<div>\n")], "doc_id long, source string")
    parsed = engine.parse(docs).persist()
    assert [r.rule_id for r in engine.check(parsed).collect()] == ["no-html"]
    assert engine.statistics(parsed).first().marks_paragraphs == 1
    assert "<mark>b</mark>" in docs.select(engine.html(F.col("source")).alias("h")).first().h
    assert not engine.format(docs).first().changed
    for bad in (marks, Extension("x", inline_rules=(ext.HIGHLIGHT,)), Extension("y", line_rules=(("paragraph", "z"),)), Extension("z", rules=(rule,))):
        with pytest.raises(ValueError, match="duplicate"):
            engine.with_extension(bad)
    with pytest.raises(ValueError, match="reserved"):
        Engine().with_extension(Extension("w", inline_rules=(("w", r"\*w(.)\*", "i"),)))
    assert normalised("@x\n", plugins=Plugins(printers={"at": lambda own, data: f"@@{data['n']}"}), line_rules=(("at", "@(?P<n>.)"),)) == "@@x\n"


def test_resources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.md").write_text("inside\n")
    (tmp_path / "big.md").write_text("x" * 100)
    found = {r.path: (r.text, r.resource_id) for r in ext.filesystem_resources(spark, str(tmp_path), most_bytes=50).collect()}
    assert list(found) == ["d/a.md"] and found["d/a.md"][0] == "inside\n" and found["d/a.md"][1].startswith("filesystem:") and found["d/a.md"][1].endswith(":ZC9hLm1k")
    paths = spark.createDataFrame([("a",), ("b",), ("a",)], "path string")
    assert [tuple(r) for r in ext.resolved(paths, {"a": "text"}.get).collect()] == [("a", "text")]
    docs = spark.createDataFrame([(1, '@include "a.md"\n')], "doc_id long, source string")
    loop = spark.createDataFrame([("a.md", '@include "b.md"'), ("b.md", "long" * 10)], "path string, text string")
    # An include whose tree is too large stays as a whole.
    assert ext.included(docs, loop, most_bytes=20).first().source == '@include "a.md"\n'
    assert ext.included(docs, loop, most_resources=1).first().source == '@include "a.md"\n'


def test_edit_errors(spark):
    own = parsed_of(spark, "---\na: 1\n---\n\n```js\nx\n```\n\nb\n")
    b = blocks(own)
    for bad in (
        patches.replace_front_matter(views.front_matter(b), F.lit("x\n---\ny")),
        patches.set_code_languages(views.code_blocks(b), F.lit("two words")),
        patches.move_blocks(b.where("kind = 'fenced-code'"), own, F.col("start") + 1),
    ):
        with pytest.raises(Exception, match="closes|one word|into itself"):
            bad.collect()
    with pytest.raises(ValueError, match="wrapper"):
        patches.wrap_blocks(b, own, "?")
    twice = spark.createDataFrame([(1, 5, 5, "\n", "end"), (1, 5, 5, "text", "append"), (1, 0, 2, "x", "r")], "doc_id long, start int, end int, replacement string, description string")
    assert sorted((r.start, r.replacement) for r in patches.composed(twice).collect()) == [(0, "x"), (5, "text\n")]
    journal = patches.Journal().record(twice)
    assert journal.pending(twice).count() == 0 and journal.entries().select("seq").distinct().count() == 1 and journal.clear().parts == ()


def test_option_values():
    names = ("a", "b-c")
    assert ext.option_values('a: 1, b-c: "x, \\"y\\""', names) == {"a": "1", "b-c": 'x, "y"'}
    assert ext.option_values("", names) == {} and ext.option_values(None, names) is None
    for bad in ("a: 1, a: 2", "z: 1", "a", "a:", "a: 1,", 'a: "x', "a: 1; b-c: 2: 3,, ", 'a: "x" b-c: 1'):
        assert ext.option_values(bad, names) is None


def test_quick_lines_are_the_same():
    import random

    from inkwell.kernel import blocks as kernel
    from inkwell.parse import document_rows

    rng = random.Random(1)
    lines = ["a b", "# h", "```", "~~~", "> q", "- x", "  y", "", "    c", "| a | b |", "|---|---|", "===", "---", "<div>", "[a]: /b", "1. z", "é ü", "```js", "\tt", "> ", "- "]
    sources = ["\n".join(rng.choices(lines, k=rng.randrange(1, 14))).encode() for _ in range(2000)]
    options = kernel.Options.profile("github")
    quick, way = [document_rows(s, options) for s in sources], kernel.BlockParser.plain_line
    kernel.BlockParser.plain_line = lambda *a: False
    try:
        assert quick == [document_rows(s, options) for s in sources]
    finally:
        kernel.BlockParser.plain_line = way


def test_save_options(spark, tmp_path):
    df = spark.createDataFrame([("a.md", b"x\r\ny\n\r\n", None), ("b.md", b"x\ny\r\nz\n", None)], "path string, source binary, sha256 string")
    states = files.write_files(df, str(tmp_path)).persist()
    assert {r.state for r in states.collect()} == {"written"}
    assert (tmp_path / "a.md").read_bytes() == b"x\r\ny\r\n\r\n" and (tmp_path / "b.md").read_bytes() == b"x\ny\r\nz\n"
    own = files.rebased(df.where("path = 'b.md'"), states)
    changed = own.withColumn("source", F.lit(b"new\r\n\n\n"))
    assert [r.state for r in files.write_files(changed, str(tmp_path), atomic=False, preserve_eol=False).collect()] == ["written"]
    assert (tmp_path / "b.md").read_bytes() == b"new\n\n\n" and sorted(p.name for p in tmp_path.iterdir()) == ["a.md", "b.md"]
    assert [r.state for r in files.write_files(own, str(tmp_path)).collect()] == ["conflict"]
