"""Curated HTML: an allow-list of elements and attributes, as an Arrow UDF."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.kernel.names import SAFE_SCHEMES
from inkwell.kernel.render import Plugins, Policy, blocks_to_html, escape, inline_to_html, scheme_of, to_html

# Elements of curated HTML, and those that go with all they hold.
ELEMENTS = frozenset(
    "a abbr b bdo blockquote br caption cite code dd del details dfn div dl dt em figcaption figure h1 h2 h3 h4 h5 h6 hr i img input ins kbd li mark ol p picture pre q rp rt ruby s samp "
    "small source span strike strong sub summary sup table tbody td tfoot th thead time tr tt ul var wbr".split()
)
DROPPED = frozenset(
    "audio button canvas embed form iframe math noembed noframes noscript object option plaintext script select style svg template textarea title video xmp".split()
)
VOID = frozenset("br embed hr img input source wbr".split())
#: Attributes by element; this list is our own and lets class and id stand anywhere.
ATTRIBUTES = {
    "*": frozenset(("class", "id", "title", "lang", "dir")), "a": frozenset(("href", "role", "aria-controls")), "blockquote": frozenset(("cite",)), "del": frozenset(("cite",)),
    "details": frozenset(("open",)), "div": frozenset(("role", "aria-labelledby")), "figure": frozenset(("data-title",)), "img": frozenset(("src", "alt", "width", "height", "loading")),
    "input": frozenset(("type", "checked", "disabled")), "ins": frozenset(("cite",)), "li": frozenset(("role", "value")), "ol": frozenset(("reversed", "start", "type")),
    "q": frozenset(("cite",)), "td": frozenset(("align", "colspan", "rowspan")), "th": frozenset(("align", "colspan", "rowspan", "scope")), "time": frozenset(("datetime",)),
}
#: Values an attribute may take; others go.
CHOICES = {"dir": ("ltr", "rtl", "auto"), "align": ("left", "center", "right"), "scope": ("row", "col", "rowgroup", "colgroup"), "loading": ("lazy", "eager")}
EMPTY = frozenset(("open", "checked", "disabled", "reversed"))
NUMBERS = {"colspan": (1, 1000), "rowspan": (1, 1000), "width": (1, 100_000), "height": (1, 100_000), "start": (-999_999_999, 999_999_999), "value": (-999_999_999, 999_999_999)}
URLS = {"href": SAFE_SCHEMES, "src": ("http", "https"), "cite": ("http", "https")}


def attribute_value(name: str, value: str) -> str | None:
    """The value as it may stand, None if it may not."""
    if name in URLS:
        scheme = scheme_of(value)
        return value if scheme is None or scheme in URLS[name] else None
    if name in CHOICES:
        return value.lower() if value.lower() in CHOICES[name] else None
    if name in EMPTY:
        return ""
    if name in NUMBERS:
        least, most = NUMBERS[name]
        whole = re.fullmatch("-?[0-9]{1,9}" if least < 0 else "[0-9]{1,9}", value)
        return (value if least < 0 else str(int(value))) if whole and least <= int(value) <= most else None
    if name == "lang":
        return value if re.fullmatch("[A-Za-z0-9-]{1,64}", value) else None
    return value


class Sanitizer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.dropping: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.dropping:
            if tag == self.dropping[-1]:
                self.dropping.append(tag)
            return
        if tag in DROPPED:
            if tag not in VOID:
                self.dropping.append(tag)
            return
        if tag not in ELEMENTS or (tag == "input" and "checkbox" not in [(v or "").lower() for k, v in attrs if k == "type"]):
            return
        kept, seen = [], set()
        for name, value in attrs:
            if name in seen or not (name in ATTRIBUTES["*"] or name in ATTRIBUTES.get(tag, ())):
                continue
            seen.add(name)
            if (value := attribute_value(name, value or "")) is not None:
                kept.append(f' {name}="{escape(value)}"')
        self.out.append(f"<{tag}{''.join(kept)}{' /' if tag in VOID else ''}>")
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in DROPPED and self.dropping:
            self.dropping.pop()

    def handle_endtag(self, tag: str) -> None:
        if self.dropping:
            if tag == self.dropping[-1]:
                self.dropping.pop()
            return
        if tag in self.open:
            while True:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.dropping:
            self.out.append(escape(data))


def sanitized(html: str | None) -> str | None:
    """html with allowed elements and attributes only; other elements are unwrapped, dangerous ones dropped with content."""
    if html is None:
        return None
    parser = Sanitizer()
    parser.feed(html)
    parser.close()
    return "".join(parser.out) + "".join(f"</{t}>" for t in reversed(parser.open))


def sanitize_html(html: Column | str) -> Column:
    """Curated HTML of a column."""

    @F.pandas_udf("string")
    def convert(source: pd.Series) -> pd.Series:
        return source.map(sanitized)

    return convert(html)


def md_to_html(profile: str = "github", policy: Policy | None = None, plugins: Plugins | None = None, **options):
    """A column function from documents to HTML."""

    @F.pandas_udf("string")
    def convert(source: pd.Series) -> pd.Series:
        return source.map(lambda s: to_html(s, profile, policy, plugins, **options))

    return convert


def rendered_blocks(documents: DataFrame, profile: str = "github", policy: Policy | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(doc_id, ord, start, end, html) of every top-level block; a section or fragment is their concatenation in order."""

    @F.pandas_udf("array<struct<start:int,end:int,html:string>>")
    def convert(source: pd.Series) -> pd.Series:
        return source.map(lambda s: None if s is None else [{"start": a, "end": b, "html": h} for a, b, h in blocks_to_html(s, profile, policy)])

    rows = documents.select(F.col(id_col).alias("doc_id"), F.posexplode(convert(F.col(source_col).cast("string"))).alias("ord", "b"))
    return rows.select("doc_id", "ord", "b.start", "b.end", "b.html")


def rendered_ranges(ranges: DataFrame, rendered: DataFrame, start: str = "start", stop: str = "section_end") -> DataFrame:
    """ranges (such as sections) with html: that of the top-level blocks that begin in them."""
    own = rendered.select("doc_id", "ord", F.col("start").alias("_at"), "html")
    inside = ranges.join(own, "doc_id").where((F.col("_at") >= F.col(start)) & (F.col("_at") < F.col(stop)))
    return inside.groupBy(*ranges.columns).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "html"))), lambda b: b["html"]), "").alias("html"))


def md_inline_to_html(profile: str = "github", policy: Policy | None = None):
    @F.pandas_udf("string")
    def convert(source: pd.Series) -> pd.Series:
        return source.map(lambda s: inline_to_html(s, profile, policy))

    return convert
