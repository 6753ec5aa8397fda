"""Column functions: building documents from columns, slugs, escaping, URL policy."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.kernel.names import FILTERED_TAGS, SAFE_SCHEMES
from inkwell.kernel.slugs import Slugs


def md_escape(text: Column) -> Column:
    """text with every ASCII punctuation sign behind a backslash."""
    return F.regexp_replace(text, r"([!-/:-@\[-`{-~])", r"\\$1")


def md_heading(level: Column | int, text: Column) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.concat(F.repeat(F.lit("#"), level), F.lit(" "), md_escape(text))


def md_paragraph(text: Column) -> Column:
    return md_escape(text)


def md_code(code: Column, language: Column | None = None) -> Column:
    """A fenced block whose fence is longer than any run of backticks inside."""
    runs = F.transform(F.regexp_extract_all(code, F.lit("`+"), F.lit(0)), F.length)
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    body = F.regexp_replace(code, "\n$", "")
    return F.concat(fence, F.coalesce(language, F.lit("")) if language is not None else F.lit(""), F.lit("\n"), body, F.lit("\n"), fence)


def md_list(items: Column, ordered: bool = False) -> Column:
    mark = (lambda i: F.concat((i + 1).cast("string"), F.lit(". "))) if ordered else (lambda i: F.lit("- "))
    return F.array_join(F.transform(items, lambda x, i: F.concat(mark(i), md_escape(x))), "\n")


def md_quote(text: Column) -> Column:
    return F.regexp_replace(md_escape(text), "(?m)^", "> ")


def md_break() -> Column:
    return F.lit("---")


def md_raw(source: Column) -> Column:
    """Source as it stands, but for line endings around it."""
    return F.trim(source, F.lit("\r\n"))


def md_fragment(parts: Column) -> Column:
    """Blocks joined by a blank line, without a final line ending."""
    return F.array_join(parts, "\n\n")


def md_document(parts: Column) -> Column:
    """Blocks joined by a blank line, with a final line ending."""
    return F.concat(F.array_join(parts, "\n\n"), F.lit("\n"))


def md_table(header: list[str], rows: Column) -> Column:
    """A table with plain header names over an array of rows of cells."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    head = "| " + " | ".join(header) + " |\n|" + " --- |" * len(header)
    return F.concat_ws("\n", F.lit(head), F.array_join(F.transform(rows, line), "\n"))


def html_escape(text: Column) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")), text)


def tag_filter(html: Column) -> Column:
    return F.regexp_replace(html, rf"(?i)<(?=/?(?:{'|'.join(FILTERED_TAGS)})(?:\s|>|/))", "&lt;")


def url_allowed(url: Column, schemes: tuple[str, ...] = SAFE_SCHEMES) -> Column:
    """Whether a destination has no scheme or one of schemes.

    Signs up to U+0020 are no part of a URL, plain or percent-encoded, so they are taken out before the scheme is read.
    """
    encoded = "|".join(f"%{code:02x}" for code in range(0x21))
    plain = F.regexp_replace(F.regexp_replace(url, f"(?i)(?:{encoded})", ""), "[\\x{0}-\\x{20}]", "")
    scheme = F.lower(F.regexp_extract(plain, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return (scheme == "") | scheme.isin(*schemes)


def slug_base(fold: Column) -> Column:
    """The anchor of a folded, trimmed title: letters, digits, hyphens; blanks become hyphens."""
    return F.regexp_replace(F.regexp_replace(fold, r"[^\p{L}\p{N} -]+", ""), " +", "-")


def slug_sequence(bases: Column) -> Column:
    """Unique slugs in order: the base, or the base with the least free number.  Parsed headings carry their slug already."""

    @F.pandas_udf("array<string>")
    def numbered(lists: pd.Series) -> pd.Series:
        return lists.map(lambda own: None if own is None else list(map(Slugs().next, own)))

    return numbered(bases)
