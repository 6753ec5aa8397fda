import html
import itertools
import re
import time

import pytest
from inkwell.llm import templates


def marked(page):
    """The plain answer for the synthetic pages: the text between the article's tags."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


def test_synthetic_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = templates.op4_templates(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == marked(pages[r.page_id]) and r.n_chars == len(r.text)


def test_template_without_marks(spark):
    """Pages without an article element: repeated text around the slot goes, text in the slot stays."""
    page = "<html><body><div><div>Daily Owl</div><div>Since 1900</div><div>{}</div><div>Imprint &amp; contact</div></div></body></html>"
    rows = [(i, f"http://Owl.example/{i}", page.format("".join(f"<p>story {i} line {j}</p>" for j in range(i % 3 + 1)))) for i in range(12)]
    rows += [(100, "http://other.example/", page.format("<p>alone</p>")), (101, None, "<p>no url</p>"), (102, "http://owl.example/x", None), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, template string")
    got = {}
    for r in templates.extracted(df).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert len(got[3]) == 2
    for i in range(12):
        assert got[i][0] == " ".join(f"story {i} line {j}" for j in range(i % 3 + 1))
    assert got[100] == ["Daily Owl Since 1900 alone Imprint & contact"] and got[101] == ["no url"] and got[102] == [""]
    assert templates.extracted(df.limit(0)).count() == 0


def test_furniture():
    page = """<!DOCTYPE html><title>t</title><body class="has-sidebar"><header>h</header><div id="cookie-notice">c</div><div class=wrapper-ads-none><main><article><header><h1>T<b>it</b>le</h1></header>
    <p>One &lt;two&gt;&nbsp; three<br>four<script>x("</p>")</script><style>p{}</style><!-- no --><p>five <form>f</form><aside>s</aside>
    <ul><li>six<li>seven</ul><section class="reader-comments"><p>first!</p></section><article class="comment">me too</article></article></main></div><footer>f</footer><nav><a href="a>b">n</a></nav>"""
    assert templates.Page(page).main_text(None) == "Title One <two> three four five six seven"
    assert templates.Page("a < b <p>c").main_text(None) == "a < b c"
    assert templates.Page("").main_text(None) == ""
    assert templates.Page('<p title="' * 3000 + "x").main_text(None).endswith("x")
    assert templates.Page("<b>" * 50_000 + "deep").main_text(None) == "deep"


def test_copies_of_one_article_are_one_vote(spark):
    """A host of copies of one article keeps its text, whatever stands in the furniture around it."""
    page = "<html><body><nav>menu {}</nav><div><h1>One story</h1><div>first part</div><div>second part</div><div>{}</div></div></body></html>"
    rows = [(i, f"http://copies.example/{i}", page.format(i, "third part")) for i in range(38)]
    rows += [(i, f"http://copies.example/{i}", f"<html><body><div><p>other {i}</p></div></body></html>") for i in (38, 39)]
    got = {r.page_id: r.text for r in templates.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "One story first part second part third part" for i in range(38))
    assert got[38] == "other 38" and got[39] == "other 39"


def test_slots_decide_in_marked_pages(spark):
    """Blocks that repeat inside the article of all pages of a host go; copies of one article keep their text."""
    page = "<html><body><nav>menu</nav><article><h1>Story {0}</h1><p>text of {0}</p><div class=x7>Pass it on</div><div class=x8>All rights reserved</div></article></body></html>"
    rows = [(i, f"http://owl.example/{i}", page.format(i)) for i in range(12)]
    rows += [(i, f"http://copies.example/{i}", page.format("one")) for i in range(20, 40)]
    rows += [(i, "http://few.example/", page.format(i)) for i in range(40, 45)]
    got = {r.page_id: r.text for r in templates.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} text of {i}" for i in range(12))
    assert all(got[i] == "Story one text of one Pass it on All rights reserved" for i in range(20, 40))
    assert all(got[i] == f"Story {i} text of {i} Pass it on All rights reserved" for i in range(40, 45))


def test_many_open_elements():
    """End tags close elements however deep they lie, and elements without end tags don't nest."""
    main = "<article><p>story</p></article><div>after</div>"
    text = lambda html: templates.Page(html).main_text(None)
    assert text(f"<header><form><select>{'<option>x' * 100}</select></form></header>{main}") == "story"
    assert text(f"<header><nav><dl>{'<dt>a<dd>b' * 50}</dl></nav></header>{main}") == "story"
    assert text(f"<header><div>{'<i>x' * 100}</div></header>{main}") == "story"
    assert text(f"<article>story{'<i>x' * 70}</article><div>after</div>") == "story" + " ".join("x" * 70).replace(" ", "")
    assert text(f"<article><table>{'<tr><td>x<td>y' * 40}</table></article><div>after</div>") == " ".join("xy" * 40)
    assert text("<b>" * 100 + "<article>one</b> two</article><div>after</div>") == "one two"
    paths = lambda html: templates.Page(html).paths
    assert paths("<select><optgroup><option>a<option>b<optgroup><option>c</select>") == paths("<select><optgroup><option>a</option><option>b</option></optgroup><optgroup><option>c</option></optgroup></select>")
    assert paths("<table><tr><td>a<table><tr><td>b<td>c</table><td>d<tr><th>e<tbody><tr><td>f</table>") == paths(
        "<table><tr><td>a<table><tr><td>b</td><td>c</td></tr></table></td><td>d</td></tr><tr><th>e</th></tr><tbody><tr><td>f</td></tr></tbody></table>"
    )
    assert text("<p>" + "<b>" * 100_000 + "<hr>" * 100_000 + "deep") == "deep"


def plain(pages):
    """Main text by a plain deduction: occurrence vectors over distinct contents as tuples, classes, order and containment page by page."""
    tokens = {}
    for i, page in pages.items():
        out, path = [], []
        for close, tag, text in re.findall(r"<(/?)(\w+)>|([^<]+)", page):
            if text:
                out.append(("/".join(path), text))
            elif close:
                path.pop()
            else:
                path.append(tag)
                out.append(("/".join(path), None))
        tokens[i] = out
    contents = {" ".join(t for _, t in own if t): own for own in tokens.values()}
    lists = [contents[k] for k in sorted(contents)]
    vectors = {}
    for token in {t for own in lists for t in own}:
        vectors.setdefault(tuple(own.count(token) for own in lists), []).append(token)
    least = 0.9 * len(lists)
    classes = [v for k, v in vectors.items() if sum(map(bool, k)) >= least and len(v) >= 3]
    mean = lambda t: sum(own.index(t) / len(own) for own in lists if t in own) / sum(t in own for own in lists)
    classes = [sorted(c, key=mean) for c in classes]

    def span(own, c):
        at = [own.index(t) for t in c if t in own]
        return at if len(at) == len(c) and at == sorted(at) else None

    def place(own, c):
        mine = span(own, c)
        around = [(s[-1] - s[0], k, s) for k, x in enumerate(classes) if x is not c and (s := span(own, x)) and s[0] < mine[0] < s[-1] and place(own, x)]
        if not around:
            return -1, 0
        _, k, s = min(around)
        gap = sum(p < mine[0] for p in s)
        return (k, gap) if mine[-1] < s[gap] else None

    valid = {}
    for k, c in enumerate(classes):
        seen = [place(own, c) for own in lists if span(own, c)]
        best = max(set(seen), key=seen.count, default=None)
        if best and seen.count(best) >= 0.81 * len(lists):
            valid[k] = best
    fixed = {t for k in valid if valid[k][0] in valid or valid[k][0] < 0 for t in classes[k]}
    return {i: " ".join(t for p, t in own if t and (p, t) not in fixed) for i, own in tokens.items()}


def test_against_a_plain_deduction(spark):
    """Hosts without any naming: frames, a box that one page in twenty lacks, rows of repeated cells."""
    pages = {}
    for i in range(60):
        stories = "".join(f"<p>host {i % 2} story {i} part {j}</p>" for j in range(i % 4 + 1))
        box = "" if i in (20, 21) else f"<dl><dt>Seen</dt><dd>elsewhere {i}</dd><dt>Heard</dt><dd>again {i}</dd><dt>Said</dt></dl>"
        cells = "".join(f"<tr><td>row</td><td>{i}-{j}</td><td>unit</td></tr>" for j in range(3))
        pages[i] = f"<html><body><div><div>Owl</div><div>{stories}{box}</div><div>Since 1900</div></div><table>{cells}</table><div>Imprint</div></body></html>"
    rows = [(i, f"http://h{i % 2}.example/{i}", p) for i, p in pages.items()]
    got = {r.page_id: r.text for r in templates.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for h in (0, 1):
        want = plain({i: p for i, p in pages.items() if i % 2 == h})
        assert {i: got[i] for i in want} == want
        assert all("Owl" not in t and "story" in t and "Since" not in t for t in want.values())


def test_without_article_elements(spark):
    """The synthetic pages with their article elements renamed or taken out."""
    sf = "/root/testdata/sf0.001"
    pages = [r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    for new in ("<\\1div>", ""):
        rows = [(r.page_id, r.url, re.sub("<(/?)article>", new, r.html)) for r in pages]
        got = {r.page_id: r.text for r in templates.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        want = {r.page_id: marked(r.html) for r in pages}
        assert sum(len(got[i]) for i in want if got[i] == want[i]) >= 0.95 * sum(map(len, want.values()))


def test_templates_met_by_a_salted_join(spark, monkeypatch):
    page = "<html><body><div><p>Top</p><p>Under</p><p>story {}</p><p>End</p></div></body></html>"
    rows = [(i, "http://owl.example/", page.format(i)) for i in range(12)]
    monkeypatch.setattr(templates, "BROADCAST_BYTES", 0)
    got = {r.page_id: r.text for r in templates.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"story {i}" for i in range(12)}


def test_tokens_out_of_order_leave_their_class(spark):
    """Two blocks that change places don't unmake the frame they share their occurrences with."""
    parts = ["<h2>one</h2>", "<h3>two</h3>"]
    rows = [(i, "http://owl.example/", f"<body><div><p>Top</p>{''.join(parts[:: 1 if i % 3 else -1])}<h4>story {i}</h4><p>End</p><p>Last</p></div></body>") for i in range(30)]
    got = {r.page_id: r.text for r in templates.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(f"story {i}" in t and not {"Top", "End", "Last"} & set(t.split()) for i, t in got.items())
    assert any(w in got[0] for w in ("one", "two"))


def test_longest_rise():
    for own in itertools.permutations(range(6)):
        found = templates.longest_rise(list(own))
        values = [own[i] for i in found]
        assert values == sorted(values) and found == sorted(found)
        assert len(found) == max(len(c) for n in range(7) for c in itertools.combinations(own, n) if list(c) == sorted(c))


@pytest.mark.parametrize("shape", ["<header>", "<div>|<article></article>", "<div>|<header></header>", '<div class="nav">|<article></article>', "<ul><li>", '<a "', '<p x="', "<article><b>|</b>", "<select><option>a"])
def test_nested_pages_take_time_in_proportion(shape):
    """A page of a megabyte in a few seconds, and twice the page in about twice the time."""
    def took(size):
        parts = shape.split("|")
        n = size // sum(map(len, parts))
        html = "".join(p * n for p in parts)
        start = time.thread_time()
        page = templates.Page(html)
        page.tokens()
        page.main_text(None)
        return time.thread_time() - start

    small, large = took(250_000), took(1_000_000)
    assert large < max(8 * small, 1.0)


def test_rare_gaps_of_one_merged_gap_are_heard():
    """A class lies in 150 gaps, each in under one content of a hundred, between tokens that leave their class: one gap."""
    holder = list(range(1000, 1302))
    kept = (0, 151, 301)
    votes = [{"class": 0, "parent": -1, "gap": 0, "n": 300}, *({"class": 0, "parent": -2, "gap": i, "n": 100} for i in range(302) if i not in kept)]
    votes += [{"class": 1, "parent": 0, "gap": g, "n": 2} for g in range(152, 302)]
    made = templates.nested_classes([holder, [1, 2, 3]], votes, 300)
    assert made == [{"parent": -1, "gap": 0, "tokens": [1000, 1151, 1301]}, {"parent": 0, "gap": 2, "tokens": [1, 2, 3]}]
