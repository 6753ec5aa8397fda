"""Main text of web pages by equivalence classes of template tokens.

Tokens of a page are its opening tags with their paths and its text blocks with theirs.  Tokens of a host's pages that
occur in the same pages equally often (equal occurrence vectors) form a class.  A class is valid when it spans nearly
all pages of a host with enough pages, has several tokens, and in nearly all pages lies in one gap between neighbouring
tokens of one other class, or of none; tokens that often break their class's order leave it.  So valid classes nest into
the host's template.
A page is matched class by class, each in its gap, and what the template doesn't hold are its slots.

Text of a page counts when it lies in a slot and not inside furniture (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments); where a page marks its article, only the slots in there count.

Copies of an article on one host repeat as exactly as a menu does, so pages of a host vote once per distinct content,
the text that remains without a template; one page stands for all of its content.

Occurrence vectors are kept as sums of content hashes, so they add up map-side and a host with a third of all pages costs
each task one row a token.  The votes on order and containment add up likewise.

Defined cases: null html is empty and gives empty text; a null url is a host of its own without template; very long
pages are read in one pass, in time in proportion to their length; of pages with equal content the one with the least
tokens votes, so ties don't matter; repeated rows are extracted each and vote once; other columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect, bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import cut, cut_table, small_batches, table

#: Distinct contents that a host's pages need before a template is deduced.
LEAST_PAGES = 8
#: Share of a host's contents that a valid class spans.
SUPPORT = 0.9
#: Tokens that a valid class has.
LEAST_TOKENS = 3
#: Bytes of templates (tokens of eight bytes, and a row's name) up to which they are broadcast.
BROADCAST_BYTES = 16 << 20
#: Parts that the pages of one host are dealt in where templates are too many to broadcast.
SALTS = 32

# Elements of the HTML standard by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
FURNITURE = frozenset("nav header footer aside form script style noscript template iframe button select option datalist dialog menu svg canvas object embed audio video head title".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Open elements that the start of an element closes, up to the innermost holder.
_CELLS = ("td", "th")
_ROWS = (*_CELLS, "tr")
_PARTS = (*_ROWS, "tbody", "thead", "tfoot", "caption", "colgroup")
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl",))),
    **dict.fromkeys(_CELLS, (_CELLS, ("table", "tr"))),
    "tr": ((*_ROWS, "caption", "colgroup"), ("table", "tbody", "thead", "tfoot")),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (_PARTS, ("table",))),
}
#: Words of class, id and role that name furniture.
NAMES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar aside footer header masthead "
    "topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended "
    "comment comments commentlist disqus reply replies respond pagination pager widget widgets complementary contentinfo form".split()
)
MARKED = frozenset(("article", "main"))
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
STARTS = tuple("<" + c for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
NAMING = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def named_furniture(attributes: str) -> bool:
    for found in NAMING.findall(attributes):
        value = found[0] or found[1] or found[2]
        if any(p.lower() in NAMES for p in PARTS.findall(value)):
            return True
    return False


class Page:
    """Blocks (text, element) and elements (name, parent, furniture) of one page, in page order."""

    def __init__(self, html: str):
        self.names, self.parents, self.furniture, self.paths = ["#root"], [-1], [False], [0]
        # Per element: whether it lies in a marked element, in furniture by its name, and around the article.
        self.within, self.in_named, self.around = [False], [False], [True]
        self.blocks: list[tuple[str, int]] = []
        self.opens: list[tuple[int, int]] = []  # (element, blocks before it)
        self.marked = False
        stack = [0]
        places: dict[str | frozenset, list[int]] = {}  # places in the stack of the open elements of a name, and of all blocks
        parts: list[str] = []
        at, n, quotes, final = 0, len(html), True, html.rfind(">")

        def flush() -> None:
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                parts.clear()
                if text:
                    self.blocks.append((text, stack[-1]))

        def last(names: frozenset | tuple) -> int:
            return max((places[k][-1] for k in ((names,) if names is BLOCK else names) if places.get(k)), default=0)

        def shut(place: int) -> None:
            """Close the elements from that place of the stack on."""
            while len(stack) > place:
                name = self.names[stack.pop()]
                places[name].pop()
                if name in BLOCK:
                    places[BLOCK].pop()

        while at < n:
            sign = html.find("<", at)
            if sign < 0:
                parts.append(html[at:])
                break
            if sign > at:
                parts.append(html[at:sign])
            if html.startswith("<!--", sign):
                end = html.find("-->", sign + 4)
                at = n if end < 0 else end + 3
                continue
            if html.startswith(("<!", "<?"), sign):
                end = html.find(">", sign)
                at = n if end < 0 else end + 1
                continue
            found = TAG.match(html, sign) if quotes and sign < final else None
            if found is None and sign < final:  # beyond the last sign that ends a tag there are none
                found = LOOSE.match(html, sign)
                quotes = quotes and not html.startswith(("</", *STARTS), sign)  # an open quote would swallow the rest each time
            if found is None:
                parts.append("<")
                at = sign + 1
                continue
            at = found.end()
            close, name, attributes = found[1], found[2].lower(), found[3]
            if name in BLOCK or name in RAW:
                flush()
            if close:
                if places.get(name) and (name in BLOCK or name in FURNITURE or places[name][-1] > last(MARKED)):  # an inline end tag doesn't end the article
                    shut(places[name][-1])
                continue
            if name in CLOSES_P and last(BLOCK) and self.names[stack[last(BLOCK)]] == "p":
                shut(last(BLOCK))
            ends, holders = CLOSES.get(name, ((), ()))
            if ends and (first := min((places[e][k] for e in ends if places.get(e) and (k := bisect(places[e], last(holders))) < len(places[e])), default=0)):
                shut(first)
            element = self.add(name, stack[-1], attributes)
            if name in RAW:
                end = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(html, at)
                at = n if end is None else end.end()
            elif name not in VOID and not attributes.endswith("/"):
                for key in (name, BLOCK) if name in BLOCK else (name,):
                    places.setdefault(key, []).append(len(stack))
                stack.append(element)
        flush()

    def add(self, name: str, parent: int, attributes: str) -> int:
        element = len(self.names)
        in_article = name in ("header", "footer") and self.within[parent]
        by_name = name not in ("html", "body") and name not in MARKED and bool(attributes) and named_furniture(attributes)
        noise = (name in FURNITURE and not (in_article and name == "header")) or by_name
        if name in MARKED and attributes and named_furniture(attributes) and self.within[parent]:
            noise = True  # an article inside the article, such as a reader's comment
        if name in MARKED and not noise and not self.in_named[parent]:
            self.marked = True
            up = parent
            while not self.around[up]:  # furniture by class doesn't wrap the article; above an element seen so all are
                self.furniture[up] = self.furniture[up] and self.names[up] in FURNITURE
                self.around[up] = True
                up = self.parents[up]
        self.names.append(name)
        self.parents.append(parent)
        self.furniture.append(noise)
        self.within.append(name in MARKED or self.within[parent])
        self.in_named.append((noise and name in FURNITURE) or self.in_named[parent])
        self.around.append(False)
        self.paths.append(xxhash.xxh3_64_intdigest(name, self.paths[parent]))
        self.opens.append((element, len(self.blocks)))
        return element

    def tokens(self) -> list[tuple[int, int]]:
        """(hash, block index or -1) of tags with paths and text blocks with paths, in page order."""
        out, k = [], 0
        for b, (text, element) in enumerate(self.blocks):
            while k < len(self.opens) and self.opens[k][1] <= b:
                out.append((self.paths[self.opens[k][0]], -1))
                k += 1
            out.append((xxhash.xxh3_64_intdigest(text, self.paths[element] ^ 1), b))
        out += [(self.paths[e], -1) for e, _ in self.opens[k:]]
        return out

    def main_text(self, template: list[dict] | None) -> str:
        """Text of the slots outside furniture; in the marked article if there is one."""
        tokens = self.tokens() if template else []
        where = matched([t for t, _ in tokens], template) if template else ()
        fixed = {tokens[i][1] for i in where}
        noisy = [False]
        for e in range(1, len(self.names)):  # parents come first
            noisy.append(self.furniture[e] or noisy[self.parents[e]])
        return " ".join(text for b, (text, e) in enumerate(self.blocks) if b not in fixed and not noisy[e] and (self.within[e] or not self.marked))


def occurrences(tokens: list[int]) -> dict[int, list[int]]:
    """The places of every token, in order."""
    out: dict[int, list[int]] = {}
    for i, token in enumerate(tokens):
        out.setdefault(token, []).append(i)
    return out


def in_class_order(own: list[int], places: dict[int, list[int]], start: int, stop: int) -> list[int] | None:
    """Where the tokens of a class first come one after the other between start and stop; None if they don't."""
    found, at = [], start
    for token in own:
        here = places.get(token, ())
        k = bisect_left(here, at)
        if k == len(here) or here[k] >= stop:
            return None
        found.append(here[k])
        at = here[k] + 1
    return found


def longest_rise(at: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tails, ends, before = [], [], []
    for i, x in enumerate(at):
        k = bisect_left(tails, x)
        before.append(ends[k - 1] if k else -1)
        tails[k:], ends[k:] = [x, *tails[k + 1 :]], [i, *ends[k + 1 :]]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def nesting(classes: list[list[int]], tokens: list[int]) -> tuple[list[tuple[int, int] | None], list[tuple[int, int]]]:
    """For each class its (parent, gap) in one page, and the (class, index) of tokens out of their class's order.

    The parent is the class with the narrowest span around it, gap the index of that one's next token; (-1, 0) at the top;
    None where the class isn't in the page, or crosses another class's gap.
    """
    places = occurrences(tokens)
    displaced: list[tuple[int, int]] = []
    spans: list[tuple[list[int], list[int]] | None] = []  # indices in order, and their places
    for c, own in enumerate(classes):
        at = [places[t][0] if t in places else -1 for t in own]
        if min(at) < 0:
            spans.append(None)
            continue
        kept = longest_rise(at)
        spans.append((kept, [at[i] for i in kept]))
        if len(kept) < len(own):
            displaced += [(c, i) for i in sorted(set(range(len(own))) - set(kept))]
    out: list[tuple[int, int] | None] = [None] * len(classes)
    around: list[int] = []
    for c in sorted((c for c, s in enumerate(spans) if s), key=lambda c: (spans[c][1][0], -spans[c][1][-1])):
        first, last = spans[c][1][0], spans[c][1][-1]
        while around and spans[around[-1]][1][-1] < first:
            around.pop()
        out[c] = -1, 0
        if around:
            kept, at = spans[around[-1]]
            k = bisect(at, first)
            out[c] = (around[-1], kept[k]) if last < at[k] else None
        if out[c]:
            around.append(c)
    return out, displaced


def nested_classes(classes: list[list[int]], votes: list[dict], all_pages: int) -> list[dict]:
    """A host's template: its valid classes with parent and gap, parents first; votes are (class, parent, gap, n), parent -2 where the token of that gap's index is out of order."""
    gone = {(v["class"], v["gap"]) for v in votes if v["parent"] == -2 and v["n"] > (1 - SUPPORT) * all_pages}
    kept = [[i for i in range(len(own)) if (c, i) not in gone] for c, own in enumerate(classes)]
    sums: dict[tuple[int, int, int], int] = {}
    for v in votes:
        if v["parent"] > -2:
            key = v["class"], v["parent"], bisect_left(kept[v["parent"]], v["gap"]) if v["parent"] >= 0 else 0
            sums[key] = sums.get(key, 0) + v["n"]
    under = {c: (parent, gap) for (c, parent, gap), n in sums.items() if n >= SUPPORT * SUPPORT * all_pages and len(kept[c]) >= LEAST_TOKENS and (parent < 0 or 0 < gap < len(kept[parent]))}
    number: dict[int, int] = {-1: -1}
    out: list[dict] = []
    while ready := sorted(c for c in under if c not in number and under[c][0] in number):
        for c in ready:
            number[c] = len(out)
            out.append({"parent": number[under[c][0]], "gap": under[c][1], "tokens": [classes[c][i] for i in kept[c]]})
    return out


def matched(tokens: list[int], template: list[dict]) -> list[int]:
    """Places of a page's tokens that the nested template holds: a class lies in the gap of its parent that the template
    names, its tokens in order; their repeats in that gap belong to it.  A class that isn't there leaves its gap a slot."""
    places = occurrences(tokens)
    found: list[list[int] | None] = []
    out: list[int] = []
    for own in template:  # parents come first
        start, stop = 0, len(tokens)
        if own["parent"] >= 0:
            around = found[own["parent"]]
            if around is None:
                found.append(None)
                continue
            start, stop = around[own["gap"] - 1] + 1, around[own["gap"]]
        found.append(in_class_order(own["tokens"], places, start, stop))
        if found[-1]:
            for token in own["tokens"]:
                here = places[token]
                out += here[bisect_left(here, start) : bisect_left(here, stop)]
    return out


def host_of(url: str | None) -> str | None:
    found = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", url or "")
    return found[1].lower() if found else None


def page_contents(pages: DataFrame) -> DataFrame:
    """(host, content, tokens): one page for every distinct content of a host, its token hashes in page order as bytes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[tuple[str, int], bytes] = {}
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                host = host_of(url)
                if host is None:
                    continue
                page = Page(html or "")
                tokens = np.array([t for t, _ in page.tokens()], np.uint64).tobytes()
                key = host, xxhash.xxh3_64_intdigest(page.main_text(None))
                own[key] = min(tokens, own.get(key, tokens))
            contents = np.array([c for _, c in own], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in own], pa.string()), pa.array(contents), pa.array(own.values(), pa.binary())], ["host", "content", "tokens"])

    small_batches(pages.sparkSession, 2000)
    found = pages.select("url", "html").mapInArrow(kernel, "host string, content long, tokens binary")
    return found.groupBy("host", "content").agg(F.min("tokens").alias("tokens"))


def page_tokens(contents: DataFrame) -> DataFrame:
    """(host, token, n_pages, vector, at) of the contents of a task: how many hold a token, the sum of their hashes with counts, the sum of its places."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int], list] = {}
            counts: dict[str, int] = {}
            for host, content, packed in zip(*(batch.column(c).to_pylist() for c in ("host", "content", "tokens")), strict=True):
                counts[host] = counts.get(host, 0) + 1
                seen: dict[int, list] = {}
                tokens = np.frombuffer(packed, np.uint64).tolist()
                for i, token in enumerate(tokens):
                    seen.setdefault(token, [0, i / len(tokens)])[0] += 1
                for token, (n, at) in seen.items():
                    own = sums.setdefault((host, token), [0, 0, 0.0])
                    own[0] += 1
                    own[1] += xxhash.xxh3_64_intdigest(f"{content}\0{n}")
                    own[2] += at
            for host, n in counts.items():
                sums[host, 0] = [n, 0, 0.0]
            hosts = [k[0] for k in sums]
            signed = lambda values: pa.array(np.array([v & 0xFFFFFFFFFFFFFFFF for v in values], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), signed(k[1] for k in sums), pa.array([v[0] for v in sums.values()], pa.int64()), signed(v[1] for v in sums.values()), pa.array([v[2] for v in sums.values()], pa.float64())],
                ["host", "token", "n_pages", "vector", "at"],
            )

    return contents.mapInArrow(kernel, "host string, token long, n_pages long, vector long, at double")


def _wrapping(column):
    """The sum of 64-bit numbers modulo 2**64, halves apart so that none overflows."""
    low, high = F.sum(column.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(column, 32))
    return F.concat_ws(":", low % F.lit(1 << 32), (high + F.floor(low / F.lit(1 << 32))) % F.lit(1 << 32))


def classes_of(contents: DataFrame) -> DataFrame:
    """(host, all_pages, classes array<array<long>>): the token classes that span nearly all contents of a host, tokens by their mean place."""
    tokens = page_tokens(contents).groupBy("host", "token").agg(F.sum("n_pages").alias("n_pages"), _wrapping(F.col("vector")).alias("vector"), F.sum("at").alias("at"))
    tokens = cut(tokens.where(f"token = 0 or n_pages >= {LEAST_PAGES // 2}"))
    hosts = tokens.where(f"token = 0 and n_pages >= {LEAST_PAGES}").select("host", F.col("n_pages").alias("all_pages"))
    wide = tokens.where("token <> 0").join(hosts, "host").where(F.col("n_pages") >= SUPPORT * F.col("all_pages"))
    placed = F.transform(F.sort_array(F.collect_list(F.struct((F.col("at") / F.col("n_pages")).alias("at"), F.col("token")))), lambda t: t["token"])
    classes = wide.groupBy("host", "all_pages", "vector").agg(placed.alias("tokens")).where(F.size("tokens") >= LEAST_TOKENS)
    return classes.groupBy("host", "all_pages").agg(F.transform(F.sort_array(F.collect_list(F.struct("vector", "tokens"))), lambda c: c["tokens"]).alias("classes"))


def met(rows: DataFrame, found: DataFrame, salted_by: str) -> DataFrame:
    """rows joined with the found row of their host, if any; found is broadcast while its size is small, else a host's rows are dealt over SALTS parts."""
    size = found.agg(F.count(F.lit(1)) * 64 + F.coalesce(F.sum("weight"), F.lit(0)) * 8).first()[0]
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(found.drop("weight")), "host", "left")
    parts = rows.withColumn("_salt", F.pmod(F.xxhash64(salted_by), F.lit(SALTS)).cast("int"))
    return parts.join(found.drop("weight").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "_salt"], "left").drop("_salt")


def unsigned(tokens: list[int]) -> list[int]:
    return [t & 0xFFFFFFFFFFFFFFFF for t in tokens]


TEMPLATE = "array<struct<parent: int, gap: int, tokens: array<bigint>>>"


def nested(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, all_pages, classes, votes) to the host's template."""
    for batch in rows:
        made = [nested_classes(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("classes", "votes", "all_pages")), strict=True)]
        kind = pa.list_(pa.struct([("parent", pa.int32()), ("gap", pa.int32()), ("tokens", pa.list_(pa.int64()))]))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(made, kind)], ["host", "template"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, template, weight): the valid classes of every host, nested by order and containment; weight counts their tokens.

    A class is valid if in nearly all contents it lies in the same gap of the same class.
    """
    contents = cut_table(page_contents(pages))
    classes = cut(classes_of(contents))
    weight = F.aggregate("classes", F.lit(0).cast("long"), lambda a, c: a + F.size(c))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, int, int, int], int] = {}
            for host, packed, own in zip(batch.column("host").to_pylist(), batch.column("tokens").to_pylist(), batch.column("classes").to_pylist(), strict=True):
                if own:
                    found, displaced = nesting([unsigned(x) for x in own], np.frombuffer(packed, np.uint64).tolist())
                    for key in [*((c, *x) for c, x in enumerate(found) if x), *((c, -2, i) for c, i in displaced)]:
                        votes[host, *key] = votes.get((host, *key), 0) + 1
            types = (pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in votes], t) for i, t in enumerate(types)), pa.array(votes.values(), pa.int64())], ["host", "class", "parent", "gap", "n"])

    rows = met(contents, classes.select("host", "classes", weight.alias("weight")), "content")
    votes = rows.select("host", "tokens", "classes").mapInArrow(kernel, "host string, class int, parent int, gap int, n long").groupBy("host", "class", "parent", "gap").agg(F.sum("n").alias("n"))
    # Every vote counts, however rare: gaps between tokens that leave their class are merged later.
    found = votes.join(classes, "host").groupBy("host", "all_pages", "classes").agg(F.collect_list(F.struct("class", "parent", "gap", "n")).alias("votes"))
    made = found.mapInArrow(nested, f"host string, template {TEMPLATE}")
    return made.withColumn("weight", F.aggregate("template", F.lit(0).cast("long"), lambda a, c: a + F.size(c["tokens"]) + 2))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row (page_id, url, html)."""
    small_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)).alias("host")
    joined = met(pages.select("page_id", "url", "html", host), cut(templates(pages)), "page_id")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, template in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True):
                for own in template or ():
                    own["tokens"] = unsigned(own["tokens"])
                texts.append(Page(html or "").main_text(template))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.select("page_id", "url", "html", "template").mapInArrow(kernel, "page_id long, url string, text string")


def op4_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extracted(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op4_templates": op4_templates}
