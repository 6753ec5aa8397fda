"""Byte-exact edits, overlapping edits, diffs and sweeps."""

import random
import time

import pytest
from inkwell import intervals, lint, patches, views
from inkwell import format as formatting
from inkwell.files import read_files, write_files
from inkwell.kernel.blocks import Options
from inkwell.kernel.lowering import Stale, lowered
from inkwell.parse import blocks, inlines, parse
from pyspark.sql import functions as F

GITHUB = Options.profile("github")
BAD = b"\xff\xfe"


def documents(spark, *sources):
    return spark.createDataFrame([(i, s) for i, s in enumerate(sources)], "doc_id long, source binary")


def results(done):
    return [bytes(r.source) for r in done.orderBy("doc_id").collect()]


def test_every_edit_keeps_bytes_that_are_no_text(spark):
    """One document an edit; what an edit does not replace comes through as it was."""
    para = b"a" + BAD + b" b\r\n\r\nlast " + BAD + b"\r\n"
    head = b"# H " + BAD + b"\n\nx" + BAD + b"\n\n## I\n\ny" + BAD
    code = b"```js\n" + BAD + b"\n```\n\nz" + BAD + b"\n"
    front = b"---\na: " + BAD + b"\n---\nx " + BAD + b"\n"
    link = b"[a](b) " + BAD + b" ![c](d)\n"
    docs = documents(spark, para, head, code, front, link).persist()
    parsed = parse(docs).persist()
    b, i = blocks(parsed), inlines(parsed)
    first = b.where("doc_id = 0 and pre = 1")
    end = F.lit(len(para))
    more = F.lit("more")

    def after(made, doc_id):
        return bytes(patches.apply(docs, made).where(F.col("doc_id") == doc_id).first().source)

    a, last = b"a" + BAD + b" b", b"last " + BAD + b"\r\n"
    assert after(patches.move_blocks(first, docs, end), 0) == last + b"\r\n" + a + b"\r\n"
    assert after(patches.clone_blocks(first, docs, end), 0) == para + b"\r\n" + a + b"\r\n"
    assert after(patches.wrap_blocks(first, docs), 0) == b"> " + para
    assert after(patches.wrap_blocks(first, docs, "-"), 0) == b"- " + para
    assert after(patches.remove_blocks(first), 0) == last
    assert after(patches.replace_blocks(first, more), 0) == b"more\r\n\r\n" + last
    assert after(patches.insert_after(first, docs, more), 0) == a + b"\r\n\r\nmore\r\n\r\n" + last
    assert after(patches.insert_before(first, docs, more), 0) == b"more\r\n\r\n" + para
    sections = views.sections(b, parsed).where("doc_id = 1 and level = 2")
    assert after(patches.append_to_sections(sections, docs, more), 1) == head + b"\nmore\n\n"
    assert after(patches.rename_headings(sections, F.lit("New")), 1) == head.replace(b"## I", b"## New")
    assert after(patches.replace_code(views.code_blocks(b).where("doc_id = 2"), F.lit("new")), 2) == code.replace(BAD + b"\n`", b"new\n`")
    assert after(patches.replace_front_matter(views.front_matter(b), F.lit("b: 1")), 3) == b"---\nb: 1\n---\nx " + BAD + b"\n"
    assert after(patches.set_links(views.links(i), F.lit("/n")), 4) == link.replace(b"(b)", b"(/n)")
    missing = spark.createDataFrame([(1, "More")], "doc_id long, title string")
    assert after(patches.ensure_sections(docs, views.headings(b), missing), 1) == head + b"\n\n# More\n"


def test_files_keep_bytes_that_are_no_text(spark, tmp_path):
    source = b"a" + BAD + b"\r\nb\rc\r\n"
    (tmp_path / "in.md").write_bytes(source)
    read = read_files(spark, str(tmp_path)).select(F.lit("out.md").alias("path"), "source", "sha256")
    for options, want in (({}, b"a" + BAD + b"\r\nb\r\nc\r\n"), ({"eol": "\n"}, b"a" + BAD + b"\nb\nc\n")):
        root = tmp_path / f"root{len(options)}"
        root.mkdir()
        assert [r.state for r in write_files(read, str(root), **options).collect()] == ["written"]
        assert (root / "out.md").read_bytes() == want


def test_moves_take_one_separator_along(spark):
    """Between its neighbours, at the start, without blank lines; next to its place a block stays."""
    three = b"First.\n\nSecond.\n\nThird.\n"
    docs = documents(spark, three, three, three, three)
    b = blocks(parse(docs)).where("depth = 1")
    at = lambda doc_id, pre: b.where((F.col("doc_id") == doc_id) & (F.col("pre") == pre))
    moves = [patches.move_blocks(at(0, 2), docs, F.lit(24)), patches.move_blocks(at(1, 3), docs, F.lit(0)), patches.move_blocks(at(2, 1), docs, F.lit(8)), patches.move_blocks(at(3, 2), docs, F.lit(7))]
    every = moves[0].unionByName(moves[1]).unionByName(moves[2]).unionByName(moves[3])
    assert results(patches.apply(docs, every)) == [b"First.\n\nThird.\n\nSecond.\n", b"Third.\n\nFirst.\n\nSecond.\n", three, three]


def test_overlapping_edits_write_the_smallest_block_anew():
    quote = b"# T\n\n> * a `x`\n>   more\n> * b\n\nend **x**\n" + BAD + b" raw\n"
    i = quote.index(b"a `x`")
    got, anew = lowered(quote, [(i, i + 5, b"A"), (i, i + 5, b"B *c*"), (0, 3, b"# U")], GITHUB)
    assert got == quote.replace(b"a `x`", b"B *c*").replace(b"# T", b"# U") and anew == [("ancestor", i, i + 14)]
    got, anew = lowered(b"Old\n===\n\nx\n\n~~~\ny\n~~~\n", [(0, 7, b"New\n==="), (0, 7, b"Newer\n---")], GITHUB)
    assert got == b"## Newer\n\nx\n\n~~~\ny\n~~~\n" and anew == [("ancestor", 0, 7)]
    got, anew = lowered(b"a\r\n\r\nb\r\n\r\nc\r\n", [(5, 6, b"x"), (5, 6, b"```\nx")], GITHUB)
    assert got == b"a\r\n\r\n```\r\nx\r\n\r\nc\r\n```\r\n" and anew == [("root", 0, 13)]
    with pytest.raises(Stale):
        lowered(quote, [(i, i + 5, b"A"), (i + 2, i + 5, b"`y`")], GITHUB)
    with pytest.raises(ValueError):
        lowered(b"abc", [(1, 4, b"x")], GITHUB)
    assert lowered(b"a\nb\nc\n", [(4, 5, b"C"), (2, 3, b"B"), (2, 2, b"1"), (2, 2, b"2")], GITHUB) == (b"a\n12B\nC\n", [])


def test_random_overlaps_parse_to_the_edited_blocks():
    """Two edits of one random block: what comes out holds the later one, and the blocks around it byte by byte."""
    rng = random.Random(5)
    kinds = ["para *x*\nmore", "# Head", "Set\n---", "~~~ py\ncode\n~~~", "> quote\n> more", "+ item\n+ two", "| a | b |\n|---|---|\n| 1 | 2 |", "***"]
    for _ in range(200):
        own = [rng.choice(kinds) for _ in range(5)]
        eol = rng.choice(["\n", "\r\n"])
        source = ("\n\n<!-- -->\n\n".join(own) + "\n").replace("\n", eol).encode()
        k = rng.randrange(5)
        start = len("\n\n<!-- -->\n\n".join([*own[:k], ""]).replace("\n", eol).encode())
        end = start + len(own[k].replace("\n", eol).encode())
        got, anew = lowered(source, [(start, end, b"gone"), (start, end, b"Text **b**")], GITHUB)
        assert got == source[:start] + b"Text **b**" + source[end:] and len(anew) == 1


def test_lower_over_tables(spark):
    docs = documents(spark, b"# A\n\nb\n", b"# A\n\nb\n", b"# A\n\nb\n", b"plain\n")
    rows = [(0, 0, 3, b"# X", "", 1), (0, 5, 6, b"Y", "", 2), (1, 0, 3, b"# X", "", 1), (1, 0, 3, b"# Z", "", 2), (2, 0, 3, b"# X", "", 1), (2, 2, 3, b"Z", "", 2)]
    made = spark.createDataFrame(rows, "doc_id long, start int, end int, replacement binary, description string, seq int")
    got = {r.doc_id: r for r in patches.lower(docs, made, on_stale="skip").collect()}
    assert [bytes(got[i].source) for i in range(4)] == [b"# X\n\nY\n", b"# Z\n\nb\n", b"# A\n\nb\n", b"plain\n"]
    assert [got[i].changed for i in range(4)] == [True, True, False, False]
    assert [[x.kind for x in got[i].rewritten] for i in range(4)] == [[], ["ancestor"], ["stale"], []]
    with pytest.raises(Exception, match="meets a part"):
        patches.lower(docs, made).collect()


def hunks(a, b, context=1):
    return patches.unified("".join(x + "\n" for x in a), "".join(x + "\n" for x in b), context)


def test_large_diffs():
    lines = [f"line {k}" for k in range(1, 1101)]
    aligned = [*lines[:99], "changed", *lines[100:999], "changed", *lines[1000:]]
    assert hunks(lines, aligned).count("@@ -") == 2
    assert hunks(lines, [*lines[:550], "inserted", *lines[550:]]).count("@@ -") == 1
    shifted = [*lines[:100], "inserted", *lines[100:999], *lines[1000:]]
    assert hunks(lines, shifted).count("@@ -") == 2 and hunks(lines, shifted).count("\n") <= 12
    same = ["same"] * 1100
    assert hunks(same, ["changed", *same[1:-1], "changed"]).count("@@ -") == 2
    moved = [f"x{k}" for k in range(1200)]
    assert len(patches.common_lines(moved, [moved[-1], *moved[:-1]])) == 1199
    many = [f"x{k}" for k in range(100_000)]
    rng = random.Random(1)
    other = [x for x in many if rng.random() > 0.01]
    for k in range(0, len(other), 97):
        other[k] += " new"
    start = time.process_time()
    found = patches.common_lines(many, other)
    assert time.process_time() - start < 20 and len(found) > 97_000
    assert all(many[i] == other[j] for i, j in found) and all(p < q and r < s for (p, r), (q, s) in zip(found, found[1:], strict=False))


def test_diffs_rebuild_the_text():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.choice("abcdef") for _ in range(rng.randrange(30))]
        b = [rng.choice("abcdef") for _ in range(rng.randrange(30))]
        pairs = patches.common_lines(a, b)
        assert len(pairs) == len(patches.longest_common(a, b)) and all(a[i] == b[j] for i, j in pairs)


def test_sweeps_equal_joins(spark):
    """Windows over random rows and ranges give what comparing every pair gives."""
    rng = random.Random(7)
    rows = [(d, k, s, s + rng.randrange(1, 5)) for d in range(3) for k, s in enumerate(rng.randrange(60) for _ in range(50))]
    ranges = [(d, s, s + rng.randrange(0, 9)) for d in range(2) for s in (rng.randrange(60) for _ in range(12))]
    r = spark.createDataFrame(rows, "doc_id long, k int, start int, end int")
    o = spark.createDataFrame(ranges, "doc_id long, a int, b int")
    keys = lambda df: {(x.doc_id, x.k) for x in df.collect()}
    start, end = F.col("start"), F.col("end")
    assert keys(intervals.apart(r, o, start, end)) == {(d, k) for d, k, s, e in rows if not any(d == x and e > a and s < b for x, a, b in ranges)}
    assert keys(intervals.beyond(r, o, start, end)) == {(d, k) for d, k, s, e in rows if not any(d == x and a <= s and e <= b for x, a, b in ranges)}
    gaps = [(0, 0, 5), (0, 7, 12), (0, 30, 40), (1, 2, 50)]
    got = intervals.within(r, spark.createDataFrame(gaps, "doc_id long, a int, b int"), start, end)
    assert {(x.doc_id, x.k, x.a) for x in got.collect()} == {(d, k, a) for d, k, s, e in rows for x, a, b in gaps if d == x and a <= s and e <= b}


def test_smallest_blocks_equal_a_search(spark):
    text = b"# A\n\n> - x *y*\n>\n>   z\n> - u\n\npara\n\n    code\n"
    docs = documents(spark, text)
    b = blocks(parse(docs)).persist()
    spots = spark.createDataFrame([(0, s, e, s * 100 + e) for s in range(len(text)) for e in range(s + 1, min(len(text), s + 9))], "doc_id long, start int, end int, k int")
    own = [(x.start, x.end, x.depth, x.pre) for x in b.collect()]
    got = {(x.start, x.end): x.block_pre for x in views.smallest_block(b, spots).collect()}
    for (s, e), pre in got.items():
        assert pre == max((depth, p) for a, z, depth, p in own if a <= s and e <= z)[1]
    assert len(got) == spots.count()


def test_long_documents_take_time_in_proportion(spark):
    """Lint and format of one document of many lines and blocks."""
    source = b"".join(b"Text %d  \n\n\n    code \n\nmore `x` \n\n" % k for k in range(8000))
    docs = documents(spark, source)
    start = time.time()
    found = lint.check(parse(docs).persist(), lint.Config(("no-trailing-spaces", "prefer-fenced-code-blocks")))
    assert found.count() > 16000
    assert formatting.format_documents(docs).first().changed
    assert time.time() - start < 90
