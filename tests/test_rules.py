"""Block and inline rules with state, notes, tabs, attributes and document plans, in the kernel and over tables."""

import re
import sys
import time

import pytest
from inkwell import extensions as ext
from inkwell.engine import Engine, Extension
from inkwell.kernel.blocks import Options, ParseLimit
from inkwell.kernel.render import Plan, Plugins, Policy, to_html
from inkwell.kernel.rules import CLOSE, TABS, AttributePolicy, BlockRule, Go, InlineRule, Opened, read_list
from inkwell.parse import blocks, inlines, parse
from inkwell.sanitize import ELEMENTS, sanitized
from pyspark import cloudpickle
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test
SPEC = Policy.spec()


def html(source, plugins=None, **options):
    return to_html(source, "github", SPEC, plugins, **options)


def start_fold(line):
    """A container whose mark says how deep its lines are indented; it sees what it stands in."""
    found = re.match(r"\+\+([0-9])[ \t]*", line.text)
    if found is None or line.paragraph_open:
        return None
    return Opened({"columns": int(found[1]), "lines": 0, "inside": line.parent_kind}, found.end())


def proceed_fold(line, state):
    state["lines"] += 1
    if not line.text:
        return Go()
    return Go(columns=state["columns"]) if line.indent >= state["columns"] else None


FOLD = BlockRule("fold", "+", start_fold, proceed_fold)
FOLDS = {"block_rules": (FOLD,)}
SHOW = Plugins({"fold": lambda inner, data: f"<f in={data['inside']}>\n{inner}</f>\n"})


def test_a_rule_keeps_state_and_nests():
    got = html("++2 a\n  b\n  ++3 c\n\n     d\n  e\nf\n\ng\n", SHOW, **FOLDS)
    assert got == "<f in=document>\n<p>a\nb\n++3 c</p>\n<p>d\ne\nf</p>\n</f>\n<p>g</p>\n"
    got = html("++2 a\n\n  ++3 c\n\n     - d\n\n  e\n> ++1 q\n>  r\n", SHOW, **FOLDS)
    assert got == "<f in=document>\n<p>a</p>\n<f in=fold>\n<p>c</p>\n<ul>\n<li>d</li>\n</ul>\n</f>\n<p>e</p>\n</f>\n<blockquote>\n<f in=block-quote>\n<p>q\nr</p>\n</f>\n</blockquote>\n"
    assert html("++2\n  ```\n  x\n  ```\n", SHOW, **FOLDS) == "<f in=document>\n<pre><code>x\n</code></pre>\n</f>\n"
    with pytest.raises(ParseLimit, match="nesting"):
        html("".join(" " * k + "++1\n" for k in range(40)).replace(" ", " "), SHOW, nesting=20, **FOLDS)


def test_rules_over_tables(spark):
    docs = spark.createDataFrame([(1, "++2 a\n\n  b\n\nafter\n"), (2, None), (3, "")], "doc_id long, source string")
    rows = blocks(parse(docs, **FOLDS)).where("depth > 0").orderBy("doc_id", "pre").collect()
    assert [(r.kind, r.text) for r in rows] == [("fold", None), ("paragraph", "a"), ("paragraph", "b"), ("paragraph", "after")]
    assert rows[0].ext == {"columns": "2", "lines": "4", "inside": "document"} and rows[0].last_pre == 3


def test_inline_parsers_may_decline():
    calls = []

    def twice(content, at):
        """$…$ of which both halves are the same."""
        calls.append(at)
        end = content.find("$", at + 1)
        inner = content[at + 1 : end]
        return (end + 1, inner, None) if end > 0 and inner and inner[: len(inner) // 2] * 2 == inner else None

    rule = {"inline_parsers": (InlineRule("twice", "$", twice),)}
    plugins = Plugins({"twice": lambda inner, data: f"<t>{inner}</t>"})
    assert html("a $bb$ *$cc$* $b$ `$dd$` \\$ee$ $\n", plugins, **rule) == "<p>a <t>bb</t> <em><t>cc</t></em> $b$ <code>$dd$</code> $ee$ $</p>\n"
    assert len(calls) >= 4
    assert html("$bb$", **rule) == '<p><span data-kind="twice">bb</span></p>\n'
    with pytest.raises(ValueError, match="outside"):
        html("$", inline_parsers=(InlineRule("bad", "$", lambda c, at: (at, "", None)),))
    with pytest.raises(ValueError, match="reserved"):
        Engine().with_extension(Extension("bad", inline_parsers=(InlineRule("bad", "[", twice),)))
    with pytest.raises(ValueError, match="duplicate"):
        Engine().with_extension(Extension("a", block_rules=(FOLD,)), Extension("b", block_rules=(FOLD,)))


def test_notes_hold_blocks(spark):
    source = "x[^a]\n\n[^a]: one\n\n    - two\n\n    ```\n    three\n    ```\n\n[^A]: later\n\n[^b]: see[^a] and[^b]\n\nend `[^a]` \\[^a] [^A]\n"
    got = html(source, footnotes=True)
    assert "<pre><code>three\n</code></pre> <a href=\"#fnref-1\"" in got and got.count("role=\"doc-noteref\"") == 4 and "later" not in got
    assert got.index('id="fn-1"') < got.index('id="fn-2"') and "<code>[^a]</code> [^a] <sup" in got
    own = parse(spark.createDataFrame([(1, source)], "doc_id long, source string"), footnotes=True).persist()
    uses, notes = ext.footnotes(blocks(own), inlines(own))
    assert sorted((r.number, r.label, r.text) for r in notes.collect()) == [(1, "a", "one\n\ntwo"), (2, "b", "see and")]
    assert sorted((r.number, r.occurrence) for r in uses.collect()) == [(1, 1), (1, 2), (1, 3), (2, 1)]
    assert html("\x1e0: a[^n]\n\n[^n]: b\n", footnotes=True).startswith("<p>\x1e0: a<sup")


def test_nested_tabs():
    deep = "".join("@" * k + "tabs\n" + "@" * k + f"tab T{k}\n" for k in range(1, 33)) + "x\n" + "".join("@" * k + "endtabs\n" for k in range(32, 0, -1))
    got = html(deep, block_rules=TABS)
    assert got.count('class="tabs"') == 32 and 'id="tabs-32-panel-1"' in got and "<p>x</p>" in got
    assert html("@" * 33 + "tabs\n", block_rules=TABS) == f"<p>{'@' * 33}tabs</p>\n"
    assert html("@tabs\n@endtabs\n", block_rules=TABS) == "" and 'id="own-1-tab-1"' in html("@tabs\n@tab A\n", block_rules=TABS, tabs_class="own")
    assert html("@tabs\n@tab " + "a" * 257 + "\n@tab ''\n@tab 'b\n@endtabs\nc\n", block_rules=TABS) == "<p>c</p>\n"


def test_attribute_lists_have_limits():
    policy = AttributePolicy(("id", "class", "title"), most=2, list_bytes=64, value_bytes=10)
    assert read_list(policy, "{.a #b}", 0) == (7, {"class": "a", "id": "b"})
    assert read_list(policy, "{: title='x y' class=\"c c\"}", 0)[1] == {"title": "x y", "class": "c c"}
    for bad in ("{}", "{.a .b .c}", "{title=too-long-value}", "{.}", "{#1}", "{a}", "{title=}", "{.a", "{" + " " * 70 + ".a}", "{id=1x}", "{title='a\nb'}"):
        assert read_list(policy, bad, 0) is None, bad
    for names in (("onclick",), ("a", "A"), ("1",)):
        with pytest.raises(ValueError):
            AttributePolicy(names)
    own = {"attributes": AttributePolicy(("id", "class", "href", "src"))}
    assert to_html("*x*{href=javascript:alert(1) .c}\n", attributes=own["attributes"]) == '<p><em class="c">x</em></p>\n'
    assert html("[a](/b){href=/c .d}\n", **own) == '<p><a href="/b" class="d">a</a></p>\n'
    assert html("~~~\nx\n~~~\n{.q}\n\n| a |\n|---|\n| b |\n\n{.t}\n***\n", **own) == '<pre class="q"><code>x\n</code></pre>\n' + html("| a |\n|---|\n| b |\n") + '<hr class="t" />\n'
    start = time.process_time()
    html("{" * 20000 + "\n" + "*a*{.b" * 5000, **own)
    assert time.process_time() - start < 20


def test_attribute_blocks_over_tables(spark):
    docs = spark.createDataFrame([(1, "{#a .x}\n{.y}\n# H\n\np\n{.z}\n\nq\n")], "doc_id long, source string")
    b = blocks(parse(docs, attributes=AttributePolicy())).persist()
    at = ext.attributed(b).join(b.select("doc_id", F.col("pre").alias("target_pre"), "text"), ["doc_id", "target_pre"]).orderBy("pre").collect()
    assert [(r.text, r.attributes.id, r.attributes.classes) for r in at] == [("H", "a", ["x", "y"]), ("p", None, ["z"])]


def test_plans_between_tree_and_html():
    """A transform shifts levels, lays the root's blocks out in sections, and changes the finished page; a second one adds to it."""

    def sections(views):
        heads = {v.pre for v in views if v.level and v.depth == 1}

        def layout(parts):
            out, open_ = "", False
            for pre, own in parts:
                if pre in heads:
                    out += ("</section>\n" if open_ else "") + "<section>\n"
                    open_ = True
                out += own
            return out + ("</section>\n" if open_ else "")

        return Plan({v.pre: v.level + 1 for v in views if v.level}, layout, lambda page: f"<main>\n{page}</main>\n")

    count = lambda views: Plan(finish=lambda page: page + f"<!-- {sum(v.kind == 'paragraph' for v in views)} {next(v.text for v in views if v.level)} -->\n")
    got = html("a\n\n# B *c*\n\n> ## D\n\ne\n", Plugins(plans=(sections, count)))
    assert got == "<main>\n<p>a</p>\n<section>\n<h2>B <em>c</em></h2>\n<blockquote>\n<h3>D</h3>\n</blockquote>\n<p>e</p>\n</section>\n</main>\n<!-- 2 B c -->\n"
    assert "fn-1" in html("a[^n]\n\n[^n]: b\n", Plugins(plans=(count_nothing,)), footnotes=True)
    with pytest.raises(ValueError, match="level"):
        html("###### A\n", Plugins(plans=(sections,)))
    with pytest.raises(ValueError, match="two transforms"):
        html("# A\n", Plugins(plans=(sections, lambda views: Plan(layout=str))))


def count_nothing(views):
    return Plan()


def test_engine_carries_rules_to_the_workers(spark):
    engine = Engine().with_extension(Extension("folds", block_rules=(FOLD,), plans=(count_nothing,)), Extension("lists", options={"attributes": AttributePolicy()}))
    docs = spark.createDataFrame([(1, "++2 *a*{.b}\n")], "doc_id long, source string")
    assert docs.select(engine.html(F.col("source"), SPEC).alias("h")).first().h == '<div data-kind="fold" data-columns="2" data-lines="0" data-inside="document">\n<p><em class="b">a</em></p>\n</div>\n'
    assert CLOSE.used == -1 and Options.profile("github", block_rules=(FOLD,)).block_rules == (FOLD,)


def plain_sanitized(page):
    """The synthetic pages' curated HTML by a list of tags and texts: no attribute of theirs is odd, so those on the list stay."""
    import html as entities

    kept_attributes = {"a": ("href",), "img": ("src", "alt", "width", "height")}
    out, stack, dropped = "", [], None
    for token in re.findall(r"<!--.*?-->|<![^>]*>|</?[a-zA-Z][^>]*>|[^<]+|<", page, re.S):
        name = re.match(r"</?([a-zA-Z0-9]+)", token)
        if dropped:
            dropped = None if token.lower().startswith(f"</{dropped}") else dropped
        elif name is None:
            out += "" if token.startswith("<!") else entities.escape(entities.unescape(token), quote=True).replace("&#x27;", "'")
        elif token.startswith("</"):
            if name[1] in stack:
                while True:
                    last = stack.pop()
                    out += f"</{last}>"
                    if last == name[1]:
                        break
        elif name[1] in ("script", "style", "form", "title", "noscript", "button", "iframe", "svg", "template", "select", "textarea"):
            dropped = name[1]
        elif name[1] in ELEMENTS and name[1] != "input":
            found = re.findall(r'([a-z-]+)="([^"]*)"', token)
            own = "".join(f' {k}="{v}"' for k, v in found if k in ("class", "id", "title", "lang", "dir") or k in kept_attributes.get(name[1], ()))
            void = name[1] in ("br", "hr", "img", "wbr", "source")
            out += f"<{name[1]}{own}{' /' if void else ''}>"
            stack += [] if void else [name[1]]
    return out + "".join(f"</{t}>" for t in reversed(stack))


def test_sanitized_pages_equal_a_plain_version(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    for page in pages:
        assert sanitized(page) == plain_sanitized(page)
