"""Queries over small documents of every construct, with the answers written out.

A case is a source and the answer to it, both with {n} for a row's key.  Every part of the parts table takes the case of
its key modulo the number of cases, so the documents grow with the data and every case meets many keys.  The SQL of a
query joins the same keys with the answers as they stand here.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell import extensions as ext
from inkwell import format as formatting
from inkwell import functions as fn
from inkwell import lint, patches, sanitize, stats, views
from inkwell.engine import Engine, Extension
from inkwell.kernel.render import Decorator, Policy, normalised
from inkwell.kernel.rules import CLOSE, TABS, AttributePolicy, BlockRule, Go, InlineRule, LineView, Opened
from inkwell.parse import blocks, inlines, kept, lines, parse, references

Cases = list[tuple[str, str, str]]

GRAMMAR: Cases = [
    ("paragraphs", "aaa {n}\nbbb\n\nccc", "<p>aaa {n}\nbbb</p>\n<p>ccc</p>\n"),
    ("lazy line", "> a {n}\nb\n", "<blockquote>\n<p>a {n}\nb</p>\n</blockquote>\n"),
    ("atx heading", "### T {n} ###\n#5 no\n", "<h3>T {n}</h3>\n<p>#5 no</p>\n"),
    ("setext heading", "T {n}\nmore\n===\nU\n---\n", "<h1>T {n}\nmore</h1>\n<h2>U</h2>\n"),
    ("thematic break", "a{n}\n\n* * *\n__\n", "<p>a{n}</p>\n<hr />\n<p>__</p>\n"),
    ("block quote", "> # q {n}\n> - i\n>\n> > in\n", "<blockquote>\n<h1>q {n}</h1>\n<ul>\n<li>i</li>\n</ul>\n<blockquote>\n<p>in</p>\n</blockquote>\n</blockquote>\n"),
    ("ordered list", "7) a {n}\n8) b\n", '<ol start="7">\n<li>a {n}</li>\n<li>b</li>\n</ol>\n'),
    ("loose list", "- a {n}\n\n- b\n", "<ul>\n<li>\n<p>a {n}</p>\n</li>\n<li>\n<p>b</p>\n</li>\n</ul>\n"),
    ("nested list", "- a {n}\n  - b\n    1. c\n", "<ul>\n<li>a {n}\n<ul>\n<li>b\n<ol>\n<li>c</li>\n</ol>\n</li>\n</ul>\n</li>\n</ul>\n"),
    ("two lists", "- a {n}\n+ b\n", "<ul>\n<li>a {n}</li>\n</ul>\n<ul>\n<li>b</li>\n</ul>\n"),
    ("item with code", "1.  a {n}\n\n        b\n", "<ol>\n<li>\n<p>a {n}</p>\n<pre><code>b\n</code></pre>\n</li>\n</ol>\n"),
    ("tasks", "- [x] a {n}\n- [ ] b\n", '<ul>\n<li><input checked="" disabled="" type="checkbox"> a {n}</li>\n<li><input disabled="" type="checkbox"> b</li>\n</ul>\n'),
    ("fenced code", "~~~ js x\na `{n}`\n~~~\n", '<pre><code class="language-js">a `{n}`\n</code></pre>\n'),
    ("open fence", "```\nx {n}", "<pre><code>x {n}\n</code></pre>\n"),
    ("indented fence", "  ```\n  a {n}\n    b\n  ```\n", "<pre><code>a {n}\n  b\n</code></pre>\n"),
    ("indented code", "    a {n}\n      b\n\n    c\n", "<pre><code>a {n}\n  b\n\nc\n</code></pre>\n"),
    ("no code in a paragraph", "p {n}\n    q\n", "<p>p {n}\nq</p>\n"),
    ("html pre", "<pre {n}>\n*a*\n\nb</pre>\nc\n", "<pre {n}>\n*a*\n\nb</pre>\n<p>c</p>\n"),
    ("html comment", "<!-- {n}\n\n*x* -->\ny\n", "<!-- {n}\n\n*x* -->\n<p>y</p>\n"),
    ("html instruction", "<?php {n} ?>\n*a*\n", "<?php {n} ?>\n<p><em>a</em></p>\n"),
    ("html declaration", "<!X {n}>\nb\n", "<!X {n}>\n<p>b</p>\n"),
    ("html cdata", "<![CDATA[ {n}\n*a* ]]>\nb\n", "<![CDATA[ {n}\n*a* ]]>\n<p>b</p>\n"),
    ("html block", "<div id={n}>\n*a*\n\n*b*\n</div>\n", "<div id={n}>\n*a*\n<p><em>b</em></p>\n</div>\n"),
    ("html other tag", '<x-y a="{n}">\n*a*\n\nb\n', '<x-y a="{n}">\n*a*\n<p>b</p>\n'),
    ("definitions", "[f{n}]: <my url> 'tit'\n\n[F{n}] and [f{n}][]\n", '<p><a href="my%20url" title="tit">F{n}</a> and <a href="my%20url" title="tit">f{n}</a></p>\n'),
    ("first definition", "[a]: /{n}\n[a]: /two\n\n[a]\n", '<p><a href="/{n}">a</a></p>\n'),
    (
        "table", "| a | b |\n|:--|--:|\n| {n} | x \\| y |\n| z |\n\nafter\n",
        '<table>\n<thead>\n<tr>\n<th align="left">a</th>\n<th align="right">b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td align="left">{n}</td>\n<td align="right">x | y</td>\n</tr>\n'
        '<tr>\n<td align="left">z</td>\n<td align="right"></td>\n</tr>\n</tbody>\n</table>\n<p>after</p>\n',
    ),
    ("no table", "| a {n} |\n| - | - |\n", "<p>| a {n} |\n| - | - |</p>\n"),
    ("front matter", "---\na: {n}\n---\n# T\n", "<h1>T</h1>\n"),
    ("alert", "> [!WARNING]\n> x {n}\n", '<div class="markdown-alert markdown-alert-warning">\n<p class="markdown-alert-title">Warning</p>\n<p>x {n}</p>\n</div>\n'),
    ("breaks", "a {n}  \nb\\\nc\nd\n", "<p>a {n}<br />\nb<br />\nc\nd</p>\n"),
    ("escapes", "\\*{n}\\* \\a \\\\\n", "<p>*{n}* \\a \\</p>\n"),
    ("references of signs", "&amp; &copy; &#65; &#x42; &nope; {n}\n", "<p>&amp; © A B &amp;nope; {n}</p>\n"),
    ("code spans", "`` a`{n} `` ` b ` `c\n", "<p><code>a`{n}</code> <code>b</code> `c</p>\n"),
    ("autolinks", "<https://a.b/{n}?x=&y> <m{n}@x.org>\n", '<p><a href="https://a.b/{n}?x=&amp;y">https://a.b/{n}?x=&amp;y</a> <a href="mailto:m{n}@x.org">m{n}@x.org</a></p>\n'),
    ("raw html", "a <b c='{n}'> <!-- x --> </b>\n", "<p>a <b c='{n}'> <!-- x --> </b></p>\n"),
    ("emphasis", "*a* **b{n}** ***c*** _d_e_ a*b*c\n", "<p><em>a</em> <strong>b{n}</strong> <em><strong>c</strong></em> <em>d_e</em> a<em>b</em>c</p>\n"),
    ("no emphasis", "a * b {n} * ** c\n", "<p>a * b {n} * ** c</p>\n"),
    ("strikethrough", "~~a {n}~~ ~b~\n", "<p><del>a {n}</del> ~b~</p>\n"),
    ("links", '[a {n}](/u "t") ![i *j*](x.png) [b](<>) [c [d](/e)](/f)\n', '<p><a href="/u" title="t">a {n}</a> <img src="x.png" alt="i j" /> <a href="">b</a> [c <a href="/e">d</a>](/f)</p>\n'),
    ("folded labels", "[ẞ  x {n}]: /u\n\n[SS X {n}]\n", '<p><a href="/u">SS X {n}</a></p>\n'),
    ("encoded targets", '[a](/ä%20b"{n})\n', '<p><a href="/%C3%A4%20b%22{n}">a</a></p>\n'),
    ("bare links", "(www.a.org/{n}). https://b.org/(x) c{n}@d.org\n", '<p>(<a href="http://www.a.org/{n}">www.a.org/{n}</a>). <a href="https://b.org/(x)">https://b.org/(x)</a> <a href="mailto:c{n}@d.org">c{n}@d.org</a></p>\n'),
    ("crlf", "a {n}\r\nb\r\n\r\n- c\r\n", "<p>a {n}\nb</p>\n<ul>\n<li>c</li>\n</ul>\n"),
    ("cr", "# a {n}\rb\r", "<h1>a {n}</h1>\n<p>b</p>\n"),
    ("byte order mark", "\ufeff# T {n}\n", "<h1>T {n}</h1>\n"),
    ("tabs", "\ta {n}\n\n-\tb\n", "<pre><code>a {n}\n</code></pre>\n<ul>\n<li>b</li>\n</ul>\n"),
    ("tag filter", "<script>{n}</script>\n", "&lt;script>{n}&lt;/script>\n"),
]

SAFE: Cases = [
    ("raw html", "<b>{n}</b>\n", "<p>&lt;b&gt;{n}&lt;/b&gt;</p>\n"),
    ("html block", "<div>{n}</div>\n", "&lt;div&gt;{n}&lt;/div&gt;\n"),
    ("script scheme", "[a](javascript:{n}) [b](JAVA%0aSCRIPT:x) [c](data:x)\n", '<p><a href="">a</a> <a href="">b</a> <a href="">c</a></p>\n'),
    ("safe schemes", "[a](https://x/{n}) [b](mailto:x) [c](tel:1) [d](/e:f)\n", '<p><a href="https://x/{n}">a</a> <a href="mailto:x">b</a> <a href="tel:1">c</a> <a href="/e:f">d</a></p>\n'),
    ("image", "![a](javascript:{n})\n", '<p><img src="" alt="a" /></p>\n'),
]

STRUCTURE: Cases = [
    ("blocks", "# A {n}\n\nb\nc\n", "atx-heading[# A {n}] paragraph[b\nc]"),
    ("byte slices", "é{n}\n\n> ü\n", "paragraph[é{n}] block-quote[> ü] paragraph[ü]"),
    ("mark", "\ufeffa {n}\r\n\r\n- b\r\n", "paragraph[a {n}] list[- b] list-item[- b] paragraph[b]"),
    ("front matter", "---\na: {n}\n---\nx\n", "frontmatter:block[---\na: {n}\n---] paragraph[x]"),
    ("definition", "[a]: /{n}\n\nx\n", "link-reference-definition[[a]: /{n}] paragraph[x]"),
    ("fence", "```js\n{n}\n```\nx\n", "fenced-code[```js\n{n}\n```] paragraph[x]"),
    ("html", "<div>{n}\n\nx\n", "html-block[<div>{n}] paragraph[x]"),
    ("table", "| a |\n|---|\n| {n} |\n\nx\n", "gfm:table[| a |\n|---|\n| {n} |] paragraph[x]"),
]

INLINE: Cases = [
    ("kinds", "a *b{n}* `c` [d](e) ![f](g) <ht:i/jj> ~~k~~\n", "text:a ;emphasis:b{n};text:b{n};text: ;code-span:c;text: ;link:d;text:d;text: ;image:f;text:f;text: ;autolink:ht:i/jj;text: ;strikethrough:k;text:k"),
    ("breaks", "a{n}  \nb\n", "text:a{n};hard-break:;text:b"),
    ("html", "x<br>{n}\n", "text:x;html-inline:<br>;text:{n}"),
    ("signs", "&lt;{n}&gt; \\*\n", "text:<{n}> *"),
    ("plain", "only words {n}\n", "text:only words {n}"),
]

LINES: Cases = [
    ("lf", "a{n}\nb", "a{n}:1 b:0"),
    ("mixed", "é\r\n\rx\n{n}\r\n", "é:2 :1 x:1 {n}:2"),
    ("mark", "\ufeffa{n}\n", "a{n}:1"),
    ("blank", "\n{n}\n\n", ":1 {n}:1 :1"),
]

# The name of a case is the rule whose problems count.
LINT: Cases = [
    ("single-h1", "# a {n}\n# b\n", "[# b]"),
    ("no-skipped-heading-levels", "# a\n### b {n}\n", "[### b {n}]"),
    ("require-title", "para {n}\n", "[para {n}]"),
    ("require-title", "---\nx: 1\n---\n# t {n}\n", ""),
    ("no-duplicate-headings", "# A {n}\n## a {n}\n", "[## a {n}]"),
    ("require-image-alt", "![]({n}.png) ![x](y)\n", "[![]({n}.png)]"),
    ("no-empty-links", "[a]() ![b]() [c](d{n})\n", "[[a]()][![b]()]"),
    ("no-bare-urls", "see https://x.org/{n} <https://y.org>\n", "[https://x.org/{n}]"),
    ("no-dead-reference-definitions", "[a]\n\n[a]: /{n}\n[b]: /{n}\n", "[[b]: /{n}]"),
    ("require-code-block-language", "```\n{n}\n```\n\n```js\nx\n```\n", "[```\n{n}\n```]"),
    ("code-fence-info-spacing", "```  js\n{n}\n```\n", "[  ]"),
    ("prefer-fenced-code-blocks", "a\n\n    code {n}\n", "[    code {n}]"),
    ("require-closed-code-fence", "```js\n{n}\n", "[```js\n{n}]"),
    ("consistent-table-columns", "| a | b |\n|---|---|\n| {n} |\n", "[{n}]"),
    ("no-trailing-spaces", "a {n} \nb  \nc\t\n\n    code  \n", "[ ][\t]"),
    ("final-newline", "a {n}", "[]"),
    ("no-dead-anchor", "# A {n}\n[x](#a-{n}) [y](#nope)\n", "[[y](#nope)]"),
]

FIXES: Cases = [
    ("no-bare-urls", "see www.x.org/{n}\n", "see <http://www.x.org/{n}>\n"),
    ("require-code-block-language", "```\n{n}\n```\n", "```text\n{n}\n```\n"),
    ("code-fence-info-spacing", "```  js\n{n}\n```\n", "```js\n{n}\n```\n"),
    ("prefer-fenced-code-blocks", "a\n\n\tcode {n}\n", "a\n\n```text\ncode {n}\n```\n"),
    ("prefer-fenced-code-blocks", "> \t\n>     in a quote {n}\n", "> \t\n>     in a quote {n}\n"),
    ("no-trailing-spaces", "a {n} \nb   \nc\n", "a {n}\nb  \nc\n"),
    ("final-newline", "a {n}\r\nb", "a {n}\r\nb\r\n"),
]

FORMATS: Cases = [
    ("trailing spaces", "a {n} \n", "a {n}\n"),
    ("heading spacing", "#   a {n}\n", "# a {n}\n"),
    ("fence marker", "~~~js\n{n}\n~~~\n", "```js\n{n}\n```\n"),
    ("fence with backticks", "~~~\n```{n}\n~~~\n", "````\n```{n}\n````\n"),
    ("info spacing", "```  js\n{n}\n```\n", "```js\n{n}\n```\n"),
    ("bullets", "* a {n}\n* b\n", "- a {n}\n- b\n"),
    ("bullets side by side", "* a {n}\n+ b\n", "* a {n}\n+ b\n"),
    ("ordered delimiter", "1) a {n}\n2) b\n", "1. a {n}\n2. b\n"),
    ("definition spacing", "[a]:/{n}\n\n[a]\n", "[a]: /{n}\n\n[a]\n"),
    ("table delimiter", "| a | b |\n|:-|-:|\n| {n} | 1 |\n", "| a | b |\n| :--- | ---: |\n| {n} | 1 |\n"),
    ("blank lines", "a {n}\n\n\n\nb\n", "a {n}\n\nb\n"),
    ("final newline", "a {n}", "a {n}\n"),
    ("nothing to do", "# a {n}\n\nb\n", "# a {n}\n\nb\n"),
]

EDITS: Cases = [
    ("rename", "## a {n}\n\nb\n", "## New\n\nb\n"),
    ("rename", "a {n}\n---\nb\n", "New\n---\nb\n"),
    ("rename", "a {n}\r\n===\r\n", "New\r\n===\r\n"),
    ("append", "# A {n}\n\nx\n# B\n", "# A {n}\n\nx\n\nmore\n\n# B\n"),
    ("append", "# A {n}\n\nx\n\n# B\n", "# A {n}\n\nx\n\nmore\n\n# B\n"),
    ("prepend", "# A {n}\n\nx\n", "# A {n}\n\nmore\n\nx\n"),
    ("replace body", "# A {n}\n\nx\n# B\n", "# A {n}\n\nmore\n\n# B\n"),
    ("remove section", "# A {n}\n\nx\n# B\n", "# B\n"),
    ("set language", "```js x\n{n}\n```\n", "```php x\n{n}\n```\n"),
    ("set language", "~~~\n{n}\n~~~\n", "~~~php\n{n}\n~~~\n"),
    ("replace code", "```js\n{n}\n```\nz\n", "```js\nnew\n```\nz\n"),
    ("replace code", "    {n}\nz\n", "```\nnew\n```\nz\n"),
    ("replace code", "```js\r\n{n}\r\n```\r\nz\r\n", "```js\r\nnew\r\n```\r\nz\r\n"),
    ("front matter", "---\na: {n}\n---\nx\n", "---\nb: 2\n---\nx\n"),
    ("insert before", "a {n}\n\nb\n", "a {n}\n\nmore\n\nb\n"),
    ("insert before", "# a {n}\nb\n", "# a {n}\n\nmore\n\nb\n"),
    ("insert after", "b\n\na {n}\n", "b\n\nmore\n\na {n}\n"),
    ("insert after", "a {n}\r\n\r\nb", "a {n}\r\n\r\nb\r\n\r\nmore\r\n"),
    ("move to the end", "First {n}.\n\nSecond.\n\nThird.\n", "Second.\n\nThird.\n\nFirst {n}.\n"),
    ("move to the end", "\ufeff##   a {n} ###\r\n\r\nMiddle  \r\n\r\n## b\r\n", "\ufeffMiddle  \r\n\r\n## b\r\n\r\n##   a {n} ###\r\n"),
    ("move to the end", "# A {n}\n# B\n# C\n", "# B\n# C\n\n# A {n}\n"),
    ("move to the end", "# A {n}\r# B\r# C\r", "# B\r# C\r\r# A {n}\r"),
    ("move last first", "# A\n# B\n# b {n}\n", "# b {n}\n\n# A\n# B\n"),
    ("move last first", "# T\r\rFirst.\r\rb {n}\r", "b {n}\r\r# T\r\rFirst.\r"),
    ("clone to the end", "a {n}\n\nb\n", "a {n}\n\nb\n\na {n}\n"),
    ("wrap quote", "a {n}\nb\n", "> a {n}\n> b\n"),
    ("wrap bullet", "a {n}\nb\n", "- a {n}\n  b\n"),
    ("wrap ordered", "a {n}\r\nb\r\n", "7) a {n}\r\n   b\r\n"),
    ("replace block", "a {n}\n\nb\n", "a {n}\n\nmore\n"),
    ("remove block", "a {n}\n\nb\n", "a {n}\n"),
    ("remove block", "a {n}\n\nb\n\nc\n", "a {n}\n\nc\n"),
    ("remove block", "b\n\nc {n}\n", "c {n}\n"),
    ("replace by nothing", "a {n}\n\nb\n\nc\n", "a {n}\n\nc\n"),
    ("wrap quote", "  a {n}  \nb  \n", ">   a {n}  \n> b  \n"),
    ("link destination", '[a {n}](b "t")\n', '[a {n}](<c d)> "t")\n'),
    ("link destination", "[a][k {n}]\n\n[k {n}]: /u\n", "[a](<c d)>)\n\n[k {n}]: /u\n"),
    ("link title", "[a {n}](b)\n", '[a {n}](b "say \\"x\\"")\n'),
    ("image alt", "![a {n}](b)\n", "![n\\!](b)\n"),
    ("edit twice", "```php\n{n}\n```\n", "```php\nthree\n```\n"),
    ("edit twice", "```php\r\n{n}\r\n```\r\n", "```php\r\nthree\r\n```\r\n"),
    ("edit twice", "```php\r{n}\r```\r", "```php\rthree\r```\r"),
    ("edit twice", "a *b* {n}\n\n~~~\nx\n~~~\n\n* c\n", "a *b* {n}\n\n```\nthree\n```\n\n* c\n"),
    ("rename and remove", "# A\n\n## B {n}\n\nx\n\n## C\n", "# A\n\n## C\n"),
    ("ensure section", "# A {n}\nx", "# A {n}\nx\n\n# More\n"),
    ("ensure section", "## more\n{n}\n", "## more\n{n}\n"),
]

SYNTAX: Cases = [
    ("highlight", "a ==b {n}== c\n", "<p>a <mark>b {n}</mark> c</p>\n"),
    ("paired delimiter", "++x{n}++ + +\n", "<p><ins>x{n}</ins> + +</p>\n"),
    ("descriptions", "T {n}\n: d\n: e\n", "<dl>\n<dt>T {n}</dt>\n<dd>d</dd>\n<dd>e</dd>\n</dl>\n"),
    ("loose description", "T\n:   d {n}\n\n    e\n\nafter\n", "<dl>\n<dt>T</dt>\n<dd>\n<p>d {n}</p>\n<p>e</p>\n</dd>\n</dl>\n<p>after</p>\n"),
    ("no description", ": d {n}\n", "<p>: d {n}</p>\n"),
    ("link decorator", "[a](https://x.org/{n}) [b](/c)\n", '<p><a href="https://x.org/{n}" rel="nofollow">a</a> <a href="/c">b</a></p>\n'),
    ("default attributes", "# T {n}\n", '<h1 class="head">T {n}</h1>\n'),
    ("block renderer", "@note {n}\n", "<aside>{n}</aside>\n"),
    ("container", "@box\n*a* {n}\n@end\nb\n", '<div data-kind="box">\n<p><em>a</em> {n}</p>\n</div>\n<p>b</p>\n'),
    ("inline renderer", "%%k{n}%%\n", "<p><kbd>k{n}</kbd></p>\n"),
    ("inline parser", "see #12{n} and # x\n", '<p>see <a data-ticket="12{n}">12{n}</a> and # x</p>\n'),
    ("block with state", "::: note\na {n}\n\n:::: tip\n- b\n::::\n:::\nc\n", '<section class="note">\n<p>a {n}</p>\n<section class="tip">\n<ul>\n<li>b</li>\n</ul>\n</section>\n</section>\n<p>c</p>\n'),
    ("block with state", "> ::: note\n> a {n}\n\nb\n", '<blockquote>\n<section class="note">\n<p>a {n}</p>\n</section>\n</blockquote>\n<p>b</p>\n'),
    ("block with state", "- ::: note\n  a {n}\n  :::\n- b\n", '<ul>\n<li>\n<section class="note">\n<p>a {n}</p>\n</section>\n</li>\n<li>b</li>\n</ul>\n'),
    ("block with state", "text\n::: note\n```\n::: x\n```\n{n}\n", '<p>text</p>\n<section class="note">\n<pre><code>::: x\n</code></pre>\n<p>{n}</p>\n</section>\n'),
    ("leaf with state", "%%%\n*a* {n}\n\n> b\n%%%\nc\n", '<div data-kind="math">*a* {n}\n\n&gt; b\n</div>\n<p>c</p>\n'),
    ("footnotes", "a[^n] b[^n] c[^none]\n\n[^n]: T *e* {n}\n\n    more\n\n[^m]: unused\n", '<p>a<sup id="fnref-1"><a href="#fn-1" role="doc-noteref">1</a></sup> b<sup id="fnref-1-2"><a href="#fn-1" role="doc-noteref">1</a></sup> c[^none]</p>\n<div class="footnotes" role="doc-endnotes">\n<hr />\n<ol>\n<li id="fn-1" role="doc-endnote">\n<p>T <em>e</em> {n}</p>\n<p>more <a href="#fnref-1" role="doc-backlink">↩</a> <a href="#fnref-1-2" role="doc-backlink">↩</a></p>\n</li>\n</ol>\n</div>\n'),
    ("footnotes", "# h[^X]\n\n[^x]: ~~~\n    y {n}\n    ~~~\n", '<h1 class="head">h<sup id="fnref-1"><a href="#fn-1" role="doc-noteref">1</a></sup></h1>\n<div class="footnotes" role="doc-endnotes">\n<hr />\n<ol>\n<li id="fn-1" role="doc-endnote">\n<pre><code>y {n}\n</code></pre> <a href="#fnref-1" role="doc-backlink">↩</a>\n</li>\n</ol>\n</div>\n'),
    ("tabs", "@tabs\nlost\n@tab One\na\n@@tabs\n@@tab In {n}\n- x\n@@endtabs\n@tab \"Two\"\n@endtabs\nc\n", """<div class="tabs" id="tabs-1">
<div class="tabs-list">
<a class="tabs-tab is-active" id="tabs-1-tab-1" href="#tabs-1-panel-1" aria-controls="tabs-1-panel-1">One</a>
<a class="tabs-tab" id="tabs-1-tab-2" href="#tabs-1-panel-2" aria-controls="tabs-1-panel-2">Two</a>
</div>
<div class="tabs-panels">
<div class="tabs-panel is-active" id="tabs-1-panel-1" aria-labelledby="tabs-1-tab-1">
<p>a</p>
<div class="tabs" id="tabs-2">
<div class="tabs-list">
<a class="tabs-tab is-active" id="tabs-2-tab-1" href="#tabs-2-panel-1" aria-controls="tabs-2-panel-1">In {n}</a>
</div>
<div class="tabs-panels">
<div class="tabs-panel is-active" id="tabs-2-panel-1" aria-labelledby="tabs-2-tab-1">
<ul>
<li>x</li>
</ul>
</div>
</div>
</div>
</div>
<div class="tabs-panel" id="tabs-1-panel-2" aria-labelledby="tabs-1-tab-2"></div>
</div>
</div>
<p>c</p>
"""),
    ("attributes", "{#intro .lead title=\"Welcome {n}\"}\n{.wide .lead}\n# Hello\n\n> Quote\n> {: .quoted}\n\nParagraph\n{: .after}\n", '<h1 class="head lead wide" id="intro" title="Welcome {n}">Hello</h1>\n<blockquote>\n<p class="quoted">Quote</p>\n</blockquote>\n<p class="after">Paragraph</p>\n'),
    ("attributes", "*red*{.accent title=Warm{n}}, **bold**{#strong}, `code`{.token}, ![Logo](logo.png){.media disabled=true}, and plain{.literal}.\n".replace("Warm{n}", "Warm").replace("plain", "plain {n}"), '<p><em class="accent" title="Warm">red</em>, <strong id="strong">bold</strong>, <code class="token">code</code>, <img src="logo.png" alt="Logo" class="media" disabled />, and plain {n}{.literal}.</p>\n'),
    ("attributes", '[Link {n}](/actual "Actual"){.one .two .one title=Other}\n', '<p><a href="/actual" title="Actual" class="one two">Link {n}</a></p>\n'),
    ("no attributes", "{.}\n# H {n}\n\n*x*{}\n", '<p>{.}</p>\n<h1 class="head">H {n}</h1>\n<p><em>x</em>{}</p>\n'),
    ("no tabs", "@tab Orphan {n}\n\n@tabs extra\n", "<p>@tab Orphan {n}</p>\n<p>@tabs extra</p>\n"),
]

NORMAL: Cases = [
    ("headings", "Title {n}\n===\n\n## b ##\n", "# Title {n}\n\n## b\n"),
    ("lists", "* a {n}\n* b\n\n3) c\n", "- a {n}\n- b\n\n3. c\n"),
    ("code", "    a {n}\n\n~~~js\n```\n~~~\n", "```\na {n}\n```\n\n````js\n```\n````\n"),
    ("quote", ">a {n}\nb\n", "> a {n}\n> b\n"),
    ("table", "a | b\n:- | -\n{n} | x\n", "| a | b |\n| :--- | --- |\n| {n} | x |\n"),
    ("breaks", "a {n}  \nb\n\n* * *\n", "a {n}\\\nb\n\n---\n"),
    ("alert", "> [!TIP]\n> x {n}\n", "> [!TIP]\n> x {n}\n"),
    ("descriptions", "T {n}\n:   d\n", "T {n}\n: d\n"),
    ("definition", "[a]: /{n}\n", "[a]: /{n}\n"),
    ("html", "<div>\n{n}\n</div>\n", "<div>\n{n}\n</div>\n"),
]

CURATED: Cases = [
    ("handlers", "<p onclick=x>t {n}<script>x</script></p>", "<p>t {n}</p>"),
    ("unwrapped", "<center>a <font color=red>{n}</font></center>", "a {n}"),
    ("schemes", '<a href="javascript:{n}">l</a><a href="/{n}">m</a><img src="mailto:x">', '<a>l</a><a href="/{n}">m</a><img />'),
    ("numbers", '<td colspan="1000" rowspan="0" align="LEFT">{n}</td>', '<td colspan="1000" align="left">{n}</td>'),
    ("numbers beyond", '<td colspan="1001" rowspan="7">{n}</td>', '<td rowspan="7">{n}</td>'),
    ("inputs", '<input type="text" value="{n}"><input type="checkbox" checked>', '<input type="checkbox" checked="" />'),
    ("open elements", "<b>x {n}", "<b>x {n}</b>"),
    ("comments", "a<!-- {n} -->b", "ab"),
    ("signs", "a &lt;b&gt; &amp; {n}", "a &lt;b&gt; &amp; {n}"),
]

VIEWS: Cases = [
    ("title", "## no\n# A *{n}*\n", "A {n}"),
    ("section by title", "# A\nx\n# Straße {n}\ny\n# C\n", "# Straße {n}\ny\n"),
    ("slugs", "# A b{n}\n# A b{n}!\n# A_c\n", "a-b{n},a-b{n}-1,ac"),
    ("anchors", "# A {n}\n", "true"),
    ("front matter", "---\na: {n}\nb: x\n---\n", "a={n},b=x"),
    ("link targets", "[a](b{n}) [c] <d:e/{n}>\n\n[c]: /x\n", "b{n}:true,/x:false"),
    ("smallest block", "> - a {n}\n", "paragraph"),
    ("tasks", "- [x] a {n}\n- b\n- [ ] c\n", "checked=a {n},unchecked=c"),
    ("unused labels", "[a]\n\n[a]: /1\n[B {n}]: /2\n", "b {n}"),
    ("images", "![a *b* {n}](c \"d\")\n", "a b {n}|c|d"),
    ("code", "``` php x\n{n}\n```\n\n    y\n", "php:{n}\n,:y\n"),
    ("table cells", "| a |\n|---|\n| {n} |\n| x \\| y |\n", "{n},x | y"),
    ("kinds", "# a\n\n- {n}\n", "atx-heading,list"),
    ("footnotes", "x[^a] y[^b] z[^a] `[^b]` [^no]\n\n[^b]: B\n\n[^a]: A {n}\n\n[^c]: C\n", "1=A {n},2=B;a1.1,a1.2,b2.1"),
    ("contents", "@toc {min: 2}\n\n# A\n## B {n}\n### C\n", "- [B {n}](#b-{n})\n   - [C](#c)\n\n# A\n## B {n}\n### C\n"),
    ("tabs", "@tabs\n@tab One\na\n@tab Two {n}\nb\n@endtabs\n", "One=tabs-1-tab-1,Two {n}=tabs-1-tab-2"),
    ("tabs", "@tabs\n@tab A\n@@tabs\n@@tab B {n}\n@@endtabs\n@tab C\n@endtabs\n", "A=tabs-1-tab-1,B {n}=tabs-2-tab-1,C=tabs-1-tab-2"),
    ("mentions", "hi @ann and x@ann `@ann` @bob{n}\n", "/u/ann"),
    ("footnotes", "# h[^x]\n\n| t[^z] |\n|---|\n| c[^x] |\n\n- i[^y]\n\n[^x]: X\n\n    more\n\n[^y]: Y {n}\n\n[^z]: Z\n", "1=X\n\nmore,2=Z,3=Y {n};x1.1,x1.2,y3.1,z2.1"),
    ("includes", '```\n@include "a.md"\n```\n\n    @include "b.md"\n\n> @include "b.md"\n{n}\n', '```\n@include "a.md"\n```\n\n    @include "b.md"\n\n> @include "b.md"\n{n}\n'),
    ("includes", '@include "b.md"\n@include "a.md"\n@include "a.md"\n{n}\n', 'B\nA1\nB\nA1\nB\n{n}\n'),
    ("includes", '@include "loop.md"\n{n}\n', 'L\n@include "loop.md"\n{n}\n'),
    ("includes", '@include "a.md"\n{n}\n@include "../b.md"\n', 'A1\nB\n{n}\n@include "../b.md"\n'),
    ("imports", '@import "a.py" {lines: 2-3, indent: 2}\n\n{n}\n', "  2\n  3|py"),
    ("excerpts", '@source "a.py" {lines: 2-3, title: "T {n}", numbers: true, highlight: "3"}\n', '<figure class="code-block has-title"><figcaption class="code-title">T {n}</figcaption><pre><code class="language-py"><span class="line-number">2</span>2\n<span class="line-number">3</span><mark>3</mark>\n</code></pre></figure>'),
    ("bad options", '@source "a.py" {lines: 2, lines: 3}\n\n{n}\n', ""),
    ("embeds", "https://video.example/{n}\n\nhttps://far.example/\n", "https://video.example/{n}=,https://far.example/=<p><a href=\"https://far.example/\">https://far.example/</a></p>"),
    ("attributes", "{#top{n} .wide}\n# H\n", "atx-heading:top{n}:wide"),
    ("levels", "# A {n}\n## B\n", "2,3"),
    ("slices", "## A {n}\n### B\n## C\n", "2:,3:A {n},2:"),
    ("link scopes", "[a](x{n}) [b](https://own.example/) [c](https://far.example/)\n", "relative,internal,external"),
    ("rewritten links", "[a](x{n}.md) [b](http://c.d/) [e][f]\n\n[f]: /g\n", "[a](/base/x{n}.md) [b](https://c.d/) [e][f]\n\n[f]: /g\n"),
    ("diff", "a\nb {n}\nc\n", "--- a\n+++ b\n@@ -1,3 +1,3 @@\n a\n-b {n}\n+B {n}\n c\n"),
    ("journal", "a {n}\n\nb\n", "1"),
    ("blocks apart", "# A {n}\n\nb\n\n# C\n", "<h1>A {n}</h1>\n<p>b</p>\n"),
]

STATS: Cases = [
    (
        "counts", "# T {n}\n\na [b](#t) [c](https://x.org/) [d](https://x.org/y) ![e](f)\n\n## D\n\n```js\nx\n```\n\n    y\n\n| a |\n|---|\n| 1 |\n",
        "headings=2 depth=2 levels=1:1,2:1 outline=# T {n},## D links=3/1/2 hosts=x.org:2 images=1 code=2 languages=js:1,plain:1 tables=1 words=8 minutes=1",
    ),
    ("empty", "", "headings=0 depth=0 levels= outline= links=0/0/0 hosts= images=0 code=0 languages= tables=0 words=0 minutes=0"),
]

TEXTS: Cases = [
    ("smart punctuation", "\"a\" -- b --- c ----- d ------- ... 'e' {n}", "“a” – b — c —– d —–– … ‘e’ {n}"),
    ("slug", "Ünï-Code & b_c {n}", "Ünï-Code-bc-{n}"),
    ("code title", 'js title="a {n}" filename=b', "a {n}"),
    ("options", 'a: 1, b-c: "x, \\"{n}\\""', 'a=1,b-c=x, "{n}"'),
    ("bad options", "a: 1, z: {n}", "null"),
    ("allowed", "https://x/{n}", "true"),
    ("not allowed", "java%0Ascript:{n}", "false"),
    ("inline html", "# *{n}*", "# <em>{n}</em>"),
    ("quote", "a\n{n}", "> a\n> {n}"),
    ("list", "x*{n}", "1. x\\*{n}"),
    ("code", "a ``` {n}", "````\na ``` {n}\n````"),
    ("fragment", "{n}", "## {n}\n\n<b>\n\n---"),
    ("words", "one twö_3 {n} - ", "3"),
]


# ---- the engine's answers ----------------------------------------------------------------------------------------


def case_documents(spark, sf_dir: str, cases: Cases) -> DataFrame:
    """(doc_id, case, source): a document per part, of the case of its key."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("doc_id"))
    pick = lambda k: F.element_at(F.array(*(F.lit(c[k]) for c in cases)), (F.col("doc_id") % len(cases) + 1).cast("int"))
    return parts.select("doc_id", pick(0).alias("case"), F.replace(pick(1), F.lit("{n}"), F.col("doc_id").cast("string")).alias("source"))


def dealt(docs: DataFrame) -> DataFrame:
    """docs over all cores: a file of keys is so small that few tasks would parse all of its documents."""
    return docs.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, "doc_id")


def of_case(cases: Cases, name: str) -> Column:
    """Whether a doc_id is one of a case's, as case_documents() deals them."""
    return (F.col("doc_id") % len(cases)).isin([i for i, c in enumerate(cases) if c[0] == name])


def literal(text: str) -> str:
    """A DuckDB string with its control signs escaped."""
    out = text.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f"E'{out}'"


def answers(cases: Cases) -> str:
    rows = ", ".join(f"({i}, {literal(name)}, {literal(want)})" for i, (name, _, want) in enumerate(cases))
    return f"""SELECT CAST(p_partkey AS BIGINT) AS doc_id, c.name AS "case", replace(c.want, '{{n}}', CAST(p_partkey AS VARCHAR)) AS answer
        FROM part JOIN (VALUES {rows}) AS c(i, name, want) ON p_partkey % {len(cases)} = c.i"""


def joined(rows: DataFrame, order: list[str], value: Column, by: str = ",") -> DataFrame:
    """(doc_id, got): the values of a document's rows in order."""
    parts = F.sort_array(F.collect_list(F.struct(*order, value.alias("v"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["v"]), by).alias("got"))


def answered(docs: DataFrame, *found: DataFrame) -> DataFrame:
    """(doc_id, case, answer) from (doc_id, got) of some of the documents; others answer nothing."""
    from functools import reduce

    got = reduce(DataFrame.unionByName, (f.select("doc_id", "got") for f in found))
    return docs.select("doc_id", "case").join(got, "doc_id", "left").select("doc_id", "case", F.coalesce("got", F.lit("")).alias("answer"))


def _slice(start: str = "start", stop: str = "end") -> Column:
    return F.expr(f"cast(substring(source, {start} + 1, {stop} - {start}) as string)")


def _map_text(data: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(data)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def grammar_html(docs):
    return docs.select("doc_id", "case", sanitize.md_to_html("github", Policy.spec())(F.col("source")).alias("answer"))


def safe_html(docs):
    return docs.select("doc_id", "case", sanitize.md_to_html()(F.col("source")).alias("answer"))


def block_ranges(docs):
    parsed = parse(docs, with_inlines=False)
    rows = parsed.select("doc_id", "source", F.inline("blocks")).where("depth > 0")
    return answered(docs, joined(rows, ["pre"], F.concat("kind", F.lit("["), _slice(), F.lit("]")), " "))


def inline_kinds(docs):
    return answered(docs, joined(inlines(parse(docs)), ["block_pre", "inline_ord"], F.concat("kind", F.lit(":"), F.coalesce("text", F.lit(""))), ";"))


def line_table(docs):
    return answered(docs, joined(lines(docs), ["line_no"], F.concat("text", F.lit(":"), F.length("eol")), " "))


def lint_problems(docs):
    parsed = kept(parse(dealt(docs), fields=lint.FIELDS, inline_kinds=lint.INLINE_KINDS))
    found = lint.check(parsed, lint.Config.all()).join(docs.select("doc_id", "case", F.col("source").cast("binary").alias("source")), "doc_id").where("rule_id = case")
    return answered(docs, joined(found, ["start"], F.concat(F.lit("["), _slice(), F.lit("]")), ""))


def lint_fixes(docs):
    parsed = parse(docs).persist()
    config = lint.Config.all().with_rule("require-code-block-language", default_language="text")
    found = lint.check(parsed, config).join(docs.select("doc_id", "case"), "doc_id").where("rule_id = case").drop("case")
    done = patches.apply(docs, lint.fixes(found))
    return answered(docs, done.select("doc_id", F.col("source").cast("string").alias("got")))


def formats(docs):
    done = formatting.format_documents(docs)
    return answered(docs, done.select("doc_id", F.col("source").cast("string").alias("got")))


def edits(docs):
    """Every edit on the documents of its case, all applied at once."""
    parsed = kept(parse(dealt(docs)))
    b, i = blocks(parsed), inlines(parsed)
    of = lambda rows, case: rows.where(of_case(EDITS, case))
    heads, sections = views.headings(b), views.sections(b, parsed)
    first = lambda rows: rows.where("pre = 1")
    code, front, links, images = views.code_blocks(b), views.front_matter(b), views.links(i), views.images(i)
    last, more, end = b.where("kind = 'paragraph' and text = 'b'"), F.lit("more\n"), F.octet_length("source")
    ends = parsed.select("doc_id", F.octet_length("source").alias("n"))
    wanted = docs.where("case = 'ensure section'").select("doc_id", F.lit("More").alias("title"))
    made = [
        patches.rename_headings(of(first(heads), "rename"), F.lit("New")),
        patches.append_to_sections(of(first(sections), "append"), parsed, more),
        patches.prepend_to_sections(of(first(sections), "prepend"), more),
        patches.replace_section_bodies(of(first(sections), "replace body"), more),
        patches.remove_sections(of(first(sections), "remove section")),
        patches.set_code_languages(of(code, "set language"), F.lit("php")),
        patches.replace_code(of(code, "replace code"), F.lit("new\n")),
        patches.replace_front_matter(of(front, "front matter"), F.lit("b: 2")),
        patches.insert_before(of(last, "insert before"), parsed, more),
        patches.insert_after(of(last, "insert after"), parsed, more),
        patches.move_blocks(of(first(b), "move to the end").join(ends, "doc_id"), parsed, F.col("n")),
        patches.move_blocks(of(b.where("text like 'b %'"), "move last first"), parsed, F.lit(0)),
        patches.replace_blocks(of(last, "replace by nothing"), F.lit("\n")),
        patches.clone_blocks(of(first(b), "clone to the end").join(ends, "doc_id"), parsed, F.col("n")),
        patches.wrap_blocks(of(first(b), "wrap quote"), parsed),
        patches.wrap_blocks(of(first(b), "wrap bullet"), parsed, "-"),
        patches.wrap_blocks(of(first(b), "wrap ordered"), parsed, "ordered", 7, ")"),
        patches.replace_blocks(of(last, "replace block"), more),
        patches.remove_blocks(of(last, "remove block")),
        patches.set_links(of(links, "link destination"), F.lit("c d)")),
        patches.set_links(of(links, "link title"), title=F.lit('say "x"')),
        patches.set_images(of(images, "image alt"), alt=F.lit("n!")),
        patches.ensure_sections(parsed, heads, wanted),
    ]
    every = reduce(DataFrame.unionByName, made)
    twice = [every.withColumn("seq", F.lit(0)), patches.replace_code(of(code, "edit twice"), F.lit("two\n")).withColumn("seq", F.lit(1)), patches.replace_code(of(code, "edit twice"), F.lit("three\n")).withColumn("seq", F.lit(2))]
    second = heads.where("text like 'B %'")
    twice += [patches.rename_headings(of(second, "rename and remove"), F.lit("New")).withColumn("seq", F.lit(1)), patches.remove_sections(of(sections.where("text like 'B %'"), "rename and remove")).withColumn("seq", F.lit(2))]
    made = reduce(DataFrame.unionByName, twice)
    done = patches.lower(docs, made.persist())  # it is read several times
    return answered(docs, done.select("doc_id", F.col("source").cast("string").alias("got")))


def _rel(kind: str, attributes: dict, data: dict) -> dict:
    return attributes | {"rel": "nofollow"} if attributes.get("href", "").startswith("https:") else attributes


def _start_callout(line: LineView) -> Opened | None:
    found = re.match(r"(:{3,})[ \t]*([a-z]+)[ \t]*$", line.text)
    return Opened({"marks": found[1], "name": found[2]}) if found else None


def _proceed_callout(line: LineView, state: dict) -> Go | None:
    return CLOSE if line.indent <= 3 and line.text.rstrip() == state["marks"] else Go(columns=0)


def _start_math(line: LineView) -> Opened | None:
    return Opened() if line.text.rstrip() == "%%%" else None


def _proceed_math(line: LineView, state: dict) -> Go | None:
    return CLOSE if line.text.rstrip() == "%%%" else Go(columns=0)


def _ticket(content: str, at: int) -> tuple[int, str, None] | None:
    found = re.compile("#([0-9]+)").match(content, at)
    return (found.end(), found[1], None) if found else None


EXTENSIONS = (
    Extension("callouts", block_rules=(BlockRule("callout", ":", _start_callout, _proceed_callout), BlockRule("math", "%", _start_math, _proceed_math, container=False)), renderers={"callout": lambda inner, data: f'<section class="{data["name"]}">\n{inner}</section>\n'}),
    Extension("tickets", inline_parsers=(InlineRule("ticket", "#", _ticket),), renderers={"ticket": lambda inner, data: f'<a data-ticket="{data["text"]}">{inner}</a>'}),
    Extension("tabs", block_rules=TABS),
    Extension("attributes", options={"attributes": AttributePolicy(("id", "class", "title", "disabled"))}),
    Extension("numbered notes", options={"footnotes": True}),
    Extension("marks", inline_rules=(ext.HIGHLIGHT, ext.paired_delimiter("insert", "++", "ins"), ext.paired_delimiter("key", "%%", "kbd")), renderers={"key": lambda inner, data: f"<kbd>{inner}</kbd>"}),
    Extension("notes", line_rules=(("note", "@note (?P<body>.+)"),), renderers={"note": lambda inner, data: f"<aside>{data['body']}</aside>\n"}),
    Extension("boxes", container_rules=(("box", "@box", "@end"),)),
    Extension("descriptions", options={"descriptions": True}),
    Extension("looks", decorators=(Decorator(_rel, "link"),), defaults={"atx-heading": {"class": "head"}}),
)


def extended_html(docs):
    engine = Engine().with_extension(*EXTENSIONS)
    return docs.select("doc_id", "case", engine.html(F.col("source"), Policy.spec()).alias("answer"))


def _udf(function: Callable[[str], str]):
    return ext._mapped(function)


def normal_sources(docs):
    return docs.select("doc_id", "case", _udf(lambda s: normalised(s, descriptions=True))(F.col("source")).alias("answer"))


def curated_html(docs):
    return docs.select("doc_id", "case", sanitize.sanitize_html("source").alias("answer"))


RULES = {"footnotes": True, "line_rules": (ext.TABLE_OF_CONTENTS, ext.ATTRIBUTES, ext.EMBED, ext.IMPORT, ext.SOURCE), "block_rules": TABS}


def _front(content: str) -> dict:
    return dict(line.split(": ", 1) for line in content.splitlines())


def structural_views(docs):
    """Every view and extension on the documents of its case."""
    spark = docs.sparkSession
    parsed = kept(parse(dealt(docs), **RULES))
    of = lambda rows, case: rows.where(of_case(VIEWS, case))
    b, i, r = blocks(parsed), inlines(parsed), references(parsed)
    heads, sections = views.headings(b), views.sections(b, parsed)
    own = lambda rows, case, order, value, by=",": joined(of(rows, case), order, value, by)
    key = F.col("doc_id").cast("string")
    resources = spark.createDataFrame([("a.md", 'A1\n@include "b.md"\n'), ("b.md", "B\n"), ("loop.md", 'L\n@include "loop.md"\n'), ("a.py", "1\n2\n3\n4\n")], "path string, text string")
    people = spark.createDataFrame([("ann", "/u/ann")], "name string, url string")
    by_title = [views.section_text(views.section(of(sections, "section by title").withColumn("fold", F.regexp_replace("fold", " [0-9]+$", "")), "STRASSE"), parsed).select("doc_id", F.col("section_source").alias("got"))]
    wanted = docs.where("case = 'anchors'").select("doc_id", F.concat(F.lit("a-"), key).alias("anchor"))
    decoded = views.decoded_front_matter(of(views.front_matter(b), "front matter"), _front)
    spots = docs.where("case = 'smallest block'").select("doc_id", F.lit(4).alias("start"), F.lit(5).alias("end"))
    uses, notes = ext.footnotes(of(b, "footnotes"), i)
    noted = joined(notes, ["number"], F.concat(F.col("number").cast("string"), F.lit("="), "text")).withColumnRenamed("got", "a")
    used = joined(uses, ["label", "occurrence"], F.concat("label", F.col("number").cast("string"), F.lit("."), F.col("occurrence").cast("string"))).withColumnRenamed("got", "b")
    toc = patches.apply(docs.where("case = 'contents'"), ext.contents_splice(of(b, "contents"), parsed))
    imports = ext.imports(b, resources)
    at = ext.attributed(of(b, "attributes")).join(b.select("doc_id", F.col("pre").alias("target_pre"), "kind"), ["doc_id", "target_pre"])
    parents = ext.slices(of(b, "slices")).join(heads.select("doc_id", F.col("pre").alias("parent_pre"), "text"), ["doc_id", "parent_pre"], "left")
    new = ext.rewritten_destination(F.col("destination"), "/base", patterns=[("^http:", "https:")])
    moved, _ = ext.rewrite_links(of(views.links(i), "rewritten links"), new)
    changed = docs.where("case = 'diff'").select("doc_id", F.regexp_replace("source", "(?m)^b", "B").alias("source"))
    removal = patches.remove_blocks(of(b, "journal").where("pre = 1"))
    journal = patches.Journal().record(removal).record(removal)
    once = journal.entries().groupBy("doc_id").agg(F.count(F.lit(1)).cast("string").alias("got"))
    apart = sanitize.rendered_ranges(of(sections, "blocks apart").where("pre = 1"), sanitize.rendered_blocks(docs.where("case = 'blocks apart'")))
    return answered(
        docs,
        of(views.titles(b), "title").select("doc_id", F.col("title").alias("got")),
        *by_title,
        own(views.slugs(b), "slugs", ["pre"], F.col("slug")),
        views.has_anchor(b, wanted).select("doc_id", F.col("found").cast("string").alias("got")),
        decoded.select("doc_id", _map_text(F.col("data")).alias("got")),
        own(views.link_targets(i, parsed), "link targets", ["inline_ord"], F.concat("destination", F.lit(":"), F.col("inline_syntax").cast("string"))),
        views.smallest_block(b, spots).select("doc_id", F.col("block_kind").alias("got")),
        own(views.tasks(b), "tasks", ["item_pre"], F.concat("task_state", F.lit("="), "text")),
        own(views.unused_references(r), "unused labels", ["label_key"], F.col("label_key")),
        own(views.images(i), "images", ["inline_ord"], F.concat_ws("|", "alt", "destination", "title")),
        own(views.code_blocks(b), "code", ["pre"], F.concat(F.coalesce("language", F.lit("")), F.lit(":"), "code")),
        own(views.table_rows(b), "table cells", ["pre", "row"], F.array_join("cells", ";")),
        own(views.Query(b).kind("atx-heading", "list").where("depth = 1").get(), "kinds", ["pre"], F.col("kind")),
        noted.join(used, "doc_id").select("doc_id", F.concat("a", F.lit(";"), "b").alias("got")),
        toc.select("doc_id", F.col("source").cast("string").alias("got")),
        own(ext.tab_groups(b), "tabs", ["pre"], F.concat("title", F.lit("="), "tab_id")),
        own(ext.first_mentions(ext.mentions(i, people)), "mentions", ["block_pre"], F.col("url")),
        ext.included(docs.where("case = 'includes'"), resources).select("doc_id", F.col("source").alias("got")),
        own(imports, "imports", ["pre"], F.concat(F.rtrim("code", F.lit("\n")), F.lit("|"), "language")),
        own(ext.code_html(imports), "excerpts", ["pre"], F.col("html")),
        own(ext.code_html(imports), "bad options", ["pre"], F.col("html")),
        own(ext.embeds(b, ["video.example"], "link"), "embeds", ["pre"], F.concat("url", F.lit("="), F.coalesce("html", F.lit("")))),
        at.select("doc_id", F.concat("kind", F.lit(":"), "attributes.id", F.lit(":"), F.array_join("attributes.classes", ";")).alias("got")),
        own(ext.shifted_levels(of(heads, "levels"), 1), "levels", ["pre"], F.col("new_level").cast("string")),
        joined(parents, ["pre"], F.concat(F.col("level").cast("string"), F.lit(":"), F.coalesce("text", F.lit("")))),
        own(ext.classified_links(views.links(i), ["own.example"]), "link scopes", ["inline_ord"], F.col("scope")),
        patches.apply(docs.where("case = 'rewritten links'"), moved).select("doc_id", F.col("source").cast("string").alias("got")),
        patches.diffs(docs.where("case = 'diff'"), changed).select("doc_id", F.col("diff").alias("got")),
        once,
        apart.select("doc_id", F.col("html").alias("got")),
    )


def statistics(docs):
    parsed = kept(parse(dealt(docs)))
    s = stats.statistics(parsed, blocks(parsed), inlines(parsed))
    entries = lambda name: F.array_join(F.transform(F.coalesce(F.col(name), F.expr(f"cast(array() as {dict(s.dtypes)[name]})")), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["n"].cast("string"))), ",")
    slash = F.concat_ws("/", *(F.col(f"{k}_count").cast("string") for k in ("link", "internal_link", "external_link")))
    text = F.concat(
        F.lit("headings="), "heading_count", F.lit(" depth="), "max_heading_depth", F.lit(" levels="), entries("headings_by_level"), F.lit(" outline="), F.coalesce(F.array_join("outline", ","), F.lit("")),
        F.lit(" links="), slash, F.lit(" hosts="), entries("links_by_host"), F.lit(" images="), "image_count", F.lit(" code="), "code_block_count", F.lit(" languages="),
        entries("code_blocks_by_language"), F.lit(" tables="), "table_count", F.lit(" words="), "word_count", F.lit(" minutes="), "reading_minutes",
    )
    return answered(docs, s.select("doc_id", text.alias("got")))


def text_functions(docs):
    t = F.col("source")
    tokens = ext.options(t, ("a", "b-c"))
    by_case = {
        "smart punctuation": ext.smart_punctuation(t), "slug": fn.slug_base(t), "code title": ext.code_title(t), "options": _map_text(tokens), "bad options": F.when(tokens.isNull(), "null"),
        "allowed": fn.url_allowed(t).cast("string"), "not allowed": fn.url_allowed(t).cast("string"), "inline html": sanitize.md_inline_to_html()(t), "quote": fn.md_quote(t),
        "list": fn.md_list(F.array(t), ordered=True), "code": fn.md_code(t), "fragment": fn.md_fragment(F.array(fn.md_heading(2, t), fn.md_raw(F.lit("\n<b>\n")), fn.md_break())),
        "words": stats.word_count(t).cast("string"),
    }
    parts = [docs.where(F.col("case") == name).select("doc_id", column.alias("got")) for name, column in by_case.items()]
    return answered(docs, *parts)


def _query(run: Callable[[DataFrame], DataFrame], cases: Cases):
    return lambda spark, sf_dir: run(case_documents(spark, sf_dir, cases))


_FAMILIES = {
    "grammar_html": (grammar_html, GRAMMAR), "safe_html": (safe_html, SAFE), "block_ranges": (block_ranges, STRUCTURE), "inline_kinds": (inline_kinds, INLINE), "line_table": (line_table, LINES),
    "lint_problems": (lint_problems, LINT), "lint_fixes": (lint_fixes, FIXES), "format_cases": (formats, FORMATS), "edits": (edits, EDITS), "extended_html": (extended_html, SYNTAX),
    "normal_sources": (normal_sources, NORMAL), "curated_html": (curated_html, CURATED), "structural_views": (structural_views, VIEWS), "statistics": (statistics, STATS), "text_functions": (text_functions, TEXTS),
}
QUERIES = {name: _query(*family) for name, family in _FAMILIES.items()}
ORACLE = {name: answers(cases) for name, (_, cases) in _FAMILIES.items()}
