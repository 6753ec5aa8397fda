"""HTML and normalised source of a parsed document, without recursion over blocks."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from inkwell.kernel.blocks import Block, BlockParser, Options, code_of, language_of
from inkwell.kernel.inlines import InlineParser, Node, encoded, label_key, plain
from inkwell.kernel.names import FILTERED_TAGS, SAFE_SCHEMES
from inkwell.kernel.rules import ATTRIBUTES_BLOCK, ATTRIBUTES_INLINE, merged_attributes, whole_list

FILTER = re.compile(rf"<(?=/?(?:{'|'.join(FILTERED_TAGS)})(?:[\s/>]|$))", re.I)
SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
CODED = re.compile("%([0-9A-Fa-f]{2})")


def scheme_of(destination: str) -> str | None:
    """The scheme of a destination, in lower case.

    Signs up to U+0020 are no part of a URL, written as they are or percent-encoded, so they are taken out first.
    """
    coded = CODED.sub(lambda m: "" if int(m[1], 16) <= 0x20 else m[0], destination)
    found = SCHEME.match("".join(c for c in coded if ord(c) > 0x20))
    return found[1].lower() if found else None


@dataclass
class Policy:
    """What of the source may reach the HTML: raw HTML verbatim, escaped or stripped, and link schemes (None: all)."""

    raw: str = "escape"
    schemes: tuple[str, ...] | None = SAFE_SCHEMES
    #: Applied to the whole HTML of a document, such as inkwell.sanitize.sanitized.
    sanitizer: Callable[[str], str] | None = None

    @staticmethod
    def spec() -> Policy:
        return Policy("verbatim", None)

    def allowing(self, *schemes: str) -> Policy:
        """The same with further link schemes."""
        return replace(self, schemes=None if self.schemes is None else tuple(dict.fromkeys((*self.schemes, *(s.lower() for s in schemes)))))

    def with_raw(self, raw: str) -> Policy:
        if raw not in ("verbatim", "escape", "strip"):
            raise ValueError(f"unknown treatment of raw HTML {raw!r}")
        return replace(self, raw=raw)

    def finished(self, html: str) -> str:
        return self.sanitizer(html) if self.sanitizer else html


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


@dataclass(frozen=True)
class Decorator:
    """change(kind, attributes, data) gives the attributes of an opening tag; role says of which: node (all), link, heading or block."""

    change: Callable[[str, dict, dict], dict]
    role: str = "node"
    priority: int = 0


@dataclass(frozen=True)
class BlockView:
    """A block as a transform of the document sees it; pre counts blocks in document order, the root is 0."""

    pre: int
    parent_pre: int
    depth: int
    kind: str
    level: int | None
    text: str
    ext: dict[str, str]


@dataclass(frozen=True)
class Plan:
    """What a transform decides between tree and HTML: other heading levels by pre, a layout of the root's blocks from
    (pre, HTML) pairs, and a last change of the HTML."""

    levels: dict[int, int] = field(default_factory=dict)
    layout: Callable[[list[tuple[int, str]]], str] | None = None
    finish: Callable[[str], str] | None = None


@dataclass(frozen=True)
class Plugins:
    """Renderers by kind, f(inner HTML, data) -> HTML; decorators by priority, then in order; default attributes by kind."""

    renderers: dict[str, Callable[[str, dict], str]] = field(default_factory=dict)
    printers: dict[str, Callable[[str, dict], str]] = field(default_factory=dict)
    decorators: tuple[Decorator, ...] = ()
    plans: tuple[Callable[[list[BlockView]], Plan], ...] = ()
    defaults: dict[str, dict[str, str]] = field(default_factory=dict)


ROLES = {"link": ("link", "image", "autolink"), "heading": ("atx-heading", "setext-heading")}
INLINE_KINDS = ("link", "image", "autolink", "emphasis", "strong", "strikethrough", "code-span")
OPENING = re.compile(r"<[A-Za-z][^<>]*?(?= ?/?>)")
ATTRIBUTE = re.compile(r"[A-Za-z_:][A-Za-z0-9_.:-]*")


def note_suffix(time: int) -> str:
    return "" if time == 1 else f"-{time}"


class Html:
    def __init__(self, text: str, options: Options, policy: Policy, plugins: Plugins | None = None):
        self.parser = BlockParser(text, options)
        self.root = self.parser.parse()
        self.text, self.options, self.policy, self.plugins = text, options, policy, plugins or Plugins()
        self.decorators = sorted(self.plugins.decorators, key=lambda d: -d.priority)
        self.plain_tags = not self.decorators and not self.plugins.defaults
        self.own = {kind: element for kind, _, element in options.inline_rules}
        self.read = frozenset(r.kind for r in options.inline_parsers)
        self.notes: dict[str, str] = {}  # HTML of the first note of a label
        self.uses: list[tuple[str, str]] = []  # (label's key, source) of uses in the order they are written
        self.mark = next(m for k in range(len(text) + 1) if (m := f"\x1e{k}:") not in text) if options.footnotes else ""
        self.groups: dict[int, int] | None = None
        if options.attributes:
            self.attach(self.root)

    def attach(self, root: Block) -> None:
        """Give blocks the attributes of the lists before them, or after them where a blank line or the end follows."""
        stack = [root]
        while stack:
            block = stack.pop()
            before, waiting = None, {}
            for c in block.children:
                if c.kind == ATTRIBUTES_BLOCK and "state" in c.data:
                    own: dict = {}
                    for line in c.data["state"]["attributes"].split("\n"):
                        own = merged_attributes(own, whole_list(self.options.attributes, line) or {})
                    if c.data["state"]["target"] == "next":
                        waiting = merged_attributes(waiting, own)
                    elif before is not None:
                        before.data["attributes"] = merged_attributes(before.data.get("attributes", {}), own)
                    continue
                holds = c.kind not in ("frontmatter:block", "html-block", "link-reference-definition")
                if waiting and holds:
                    c.data["attributes"] = waiting
                waiting = {}
                before = c if holds else None
            stack.extend(block.children)

    def with_attributes(self, tag: str, own: dict[str, str | bool]) -> str:
        """HTML that begins with a tag, with attributes it has not; classes add up."""
        found = OPENING.match(tag)
        if not found:
            return tag
        head, rest = found[0], tag[found.end() :]
        has = {k.lower() for k in re.findall(r' ([A-Za-z_:][A-Za-z0-9_.:-]*)(?==|[ /]|$)', head)}
        for name, value in sorted(own.items()):
            if name == "class" and (old := re.search(' class="([^"]*)"', head)):
                both = " ".join(dict.fromkeys(f"{old[1]} {escape(str(value))}".split()))
                head = head[: old.start()] + f' class="{both}"' + head[old.end() :]
            elif name not in has:
                shown = self.url(value) if name in ("href", "src") and isinstance(value, str) else value
                if shown or not value:
                    head += f" {name}" if value is True else f' {name}="{escape(shown)}"'
        return head + rest

    def views(self) -> tuple[list[BlockView], list[Block]]:
        """All blocks in document order."""
        views, blocks, stack = [], [], [(self.root, 0, -1)]
        while stack:
            block, depth, parent = stack.pop()
            pre = len(views)
            text = plain(self.inlines(block.pieces)) if block.pieces and block.kind in ("paragraph", "atx-heading", "setext-heading", "description-term") else ""
            views.append(BlockView(pre, parent, depth, block.kind, block.level, text, dict(block.data.get("ext", {}))))
            blocks.append(block)
            stack.extend((c, depth + 1, pre) for c in reversed(block.children))
        return views, blocks

    def planned(self) -> str:
        """The document under the plans of all transforms, in their order."""
        views, blocks = self.views()
        layout, ends = None, []
        for transform in self.plugins.plans:
            plan = transform(views)
            for pre, level in plan.levels.items():
                if not 1 <= level <= 6 or blocks[pre].level is None:
                    raise ValueError(f"block {pre} can't have the heading level {level}")
                blocks[pre].level = level
            if plan.layout and layout:
                raise ValueError("two transforms lay the document out")
            layout = layout or plan.layout
            ends += [plan.finish] if plan.finish else []
        if layout:
            place = {id(b): v.pre for v, b in zip(views, blocks, strict=True)}
            html = layout([(place[id(b)], self.render([b])) for b in self.root.children])
        else:
            html = self.render(self.root.children)
        html = self.noted(html) if self.options.footnotes else html
        for finish in ends:
            html = finish(html)
        return html

    def inlines(self, pieces: list) -> list[Node]:
        return InlineParser(self.text, pieces, self.parser.references, self.options).parse()

    def url(self, destination: str) -> str:
        if self.policy.schemes is not None:
            scheme = scheme_of(destination)
            if scheme and scheme not in self.policy.schemes:
                return ""
        return encoded(destination)

    def tag(self, name: str, kind: str, attributes: dict[str, str] | None = None, data: dict | None = None, end: str = ">") -> str:
        """An opening tag: native attributes, changed by the decorators; defaults fill in, classes add up."""
        own = dict(attributes or {})
        if not self.plain_tags:
            for decorator in self.decorators:
                if decorator.role == "node" or kind in ROLES.get(decorator.role, ()) or (decorator.role == "block" and kind not in INLINE_KINDS):
                    own = decorator.change(kind, own, data or {})
            for key, value in self.plugins.defaults.get(kind, {}).items():
                own[key] = " ".join(dict.fromkeys(f"{own[key]} {value}".split())) if key == "class" and key in own else own.get(key, value)
            if bad := [k for k in own if not ATTRIBUTE.fullmatch(k)]:
                raise ValueError(f"bad attribute names {bad}")
        return f"<{name}{''.join(f' {k}="{escape(v)}"' for k, v in own.items())}{end}"

    def raw(self, source: str) -> str:
        if self.policy.raw == "strip":
            return ""
        if self.policy.raw == "escape":
            return escape(source)
        return FILTER.sub("&lt;", source) if self.options.tagfilter else source

    def inline(self, nodes: list[Node]) -> str:
        out: list[str] = []
        stack: list = list(reversed(nodes))
        names = {"emphasis": "em", "strong": "strong", "strikethrough": "del"}
        last = end = -1  # where the element begins and ends that was written last
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                out.append(node[0])
                last, end = node[1], len(out)
            elif node.kind == "text":
                out.append(escape(node.text))
            elif node.kind in names:
                out.append(self.tag(names[node.kind], node.kind))
                stack.append((f"</{names[node.kind]}>", len(out) - 1))
                stack.extend(reversed(node.children))
            elif node.kind == ATTRIBUTES_INLINE:
                if end == len(out):
                    out[last] = self.with_attributes(out[last], whole_list(self.options.attributes, node.text) or {})
                else:
                    out.append(escape(node.text))
                continue
            elif node.kind == "footnote:reference":
                out.append(f"{self.mark}{len(self.uses)}\x1f")
                self.uses.append((node.destination, escape(f"[^{node.text}]")))
            elif node.kind in self.plugins.renderers:
                inner = self.inline(node.children) if node.children else escape(node.text or "")
                out.append(self.plugins.renderers[node.kind](inner, {"text": node.text, "destination": node.destination, "title": node.title}))
            elif node.kind == "code-span":
                out.append(f"{self.tag('code', node.kind)}{escape(node.text)}</code>")
            elif node.kind in ("link", "image"):
                title = {} if node.title is None else {"title": node.title}
                if node.kind == "image":
                    out.append(self.tag("img", "image", {"src": self.url(node.destination), "alt": plain(node.children)} | title, end=" />"))
                else:
                    out.append(self.tag("a", "link", {"href": self.url(node.destination)} | title))
                    stack.append(("</a>", len(out) - 1))
                    stack.extend(reversed(node.children))
            elif node.kind == "autolink":
                out.append(f"{self.tag('a', 'autolink', {'href': self.url(node.destination)})}{escape(node.text)}</a>")
            elif node.kind in self.read:
                out.append(f'<span data-kind="{escape(node.kind)}">{escape(node.text)}</span>')
            elif node.kind in self.own:
                out.append(f"<{self.own[node.kind]}>{escape(node.text)}</{self.own[node.kind]}>")
            elif node.kind == "html-inline":
                out.append(self.raw(node.text))
            else:
                out.append("<br />\n" if node.kind == "hard-break" else "\n")
            if not isinstance(node, tuple) and node.kind in ("code-span", "image", "autolink"):
                last, end = len(out) - 1, len(out)
        return "".join(out)

    def render(self, blocks: list[Block] | None = None) -> str:
        if blocks is None and self.plugins.plans:
            return self.planned()
        out: list[str] = []
        stack: list = [(c, False) for c in reversed(self.root.children if blocks is None else blocks)]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
                continue
            block, tight = item
            at = len(out)
            self.block(block, tight, out, stack)
            if "attributes" in block.data and len(out) > at:
                out[at] = self.with_attributes(out[at], block.data["attributes"])
        html = "".join(out)
        return self.noted(html) if self.options.footnotes and blocks is None else html

    def noted(self, html: str) -> str:
        """The HTML of a document with numbers at the uses of notes, in their order, and the notes below."""
        numbers: dict[str, int] = {}
        times: dict[str, int] = {}
        shown: dict[str, str] = {}
        for k, (key, source) in enumerate(self.uses):
            if key not in self.notes:
                shown[str(k)] = source
                continue
            n = numbers.setdefault(key, len(numbers) + 1)
            times[key] = times.get(key, 0) + 1
            shown[str(k)] = f'<sup id="fnref-{n}{note_suffix(times[key])}"><a href="#fn-{n}" role="doc-noteref">{n}</a></sup>'
        items = []
        for key, n in numbers.items():
            back = "".join(f' <a href="#fnref-{n}{note_suffix(t)}" role="doc-backlink">↩</a>' for t in range(1, times[key] + 1))
            body = self.notes[key].rstrip("\n")
            body = body[:-4] + back + "</p>" if body.endswith("</p>") else body + back
            items.append(f'<li id="fn-{n}" role="doc-endnote">\n{body}\n</li>\n')
        if items:
            html += f'<div class="footnotes" role="doc-endnotes">\n<hr />\n<ol>\n{"".join(items)}</ol>\n</div>\n'
        return re.sub(re.escape(self.mark) + "([0-9]+)\x1f", lambda m: shown[m[1]], html)

    def tabs(self, group: Block) -> str:
        """A group of tabs with its panels; groups are numbered through the document, what stands outside of tabs goes."""
        if self.groups is None:
            self.groups, stack = {}, [self.root]
            while stack:
                block = stack.pop()
                if block.kind == "tabs:group":
                    self.groups[id(block)] = len(self.groups) + 1
                stack.extend(reversed(block.children))
        items = [c for c in group.children if c.kind == "tabs:item"]
        if not items:
            return ""
        name = escape(self.options.tabs_class)
        own = f"{name}-{self.groups[id(group)]}"
        active = lambda k: " is-active" if k == 1 else ""
        heads = "".join(f'<a class="{name}-tab{active(k)}" id="{own}-tab-{k}" href="#{own}-panel-{k}" aria-controls="{own}-panel-{k}">{escape(c.data["ext"]["title"])}</a>\n' for k, c in enumerate(items, 1))
        panels = ""
        for k, c in enumerate(items, 1):
            inner = self.render(c.children)
            panels += f'<div class="{name}-panel{active(k)}" id="{own}-panel-{k}" aria-labelledby="{own}-tab-{k}">{chr(10) + inner if inner else ""}</div>\n'
        return f'<div class="{name}" id="{own}">\n<div class="{name}-list">\n{heads}</div>\n<div class="{name}-panels">\n{panels}</div>\n</div>\n'

    def block(self, block: Block, tight: bool, out: list[str], stack: list) -> None:
        kind = block.kind
        if kind in self.plugins.renderers:
            out.append(self.plugins.renderers[kind](self.inner(block), {**block.data.get("ext", {}), "level": block.level}))
        elif kind == "footnote:definition" and "rule" in block.data:
            self.notes.setdefault(label_key(block.data["state"]["label"]), self.render(block.children))
        elif kind == "tabs:group" and "rule" in block.data:
            out.append(self.tabs(block))
        elif kind == ATTRIBUTES_BLOCK and "state" in block.data:
            pass
        elif "leaf" in block.data:
            out.append(f'<div data-kind="{escape(kind)}">{escape(code_of(self.text, block))}</div>\n')
        elif kind == "paragraph":
            body = self.inline(self.inlines(block.pieces))
            task = block.data.get("task_html", "")
            out.append(task + body if tight else f"{self.tag('p', kind)}{task}{body}</p>\n")
        elif kind in ("atx-heading", "setext-heading"):
            out.append(f"{self.tag(f'h{block.level}', kind, data={'level': block.level})}{self.inline(self.inlines(block.pieces))}</h{block.level}>\n")
        elif kind == "thematic-break":
            out.append(self.tag("hr", kind, end=" />\n"))
        elif kind == "description-list":
            out.append(self.tag("dl", kind, end=">\n"))
            stack.append("</dl>\n")
            stack.extend((c, False) for c in reversed(block.children))
        elif kind == "description-term":
            out.append(f"{self.tag('dt', kind)}{self.inline(self.inlines(block.pieces))}</dt>\n")
        elif kind == "description":
            self.item(block, not block.data["loose"], out, stack, "dd")
        elif kind in ("fenced-code", "indented-code"):
            language = language_of(block.data.get("info"))
            named = {"class": f"language-{language}"} if language else {}
            out.append(f"{self.tag('pre', kind)}<code{''.join(f' {k}="{escape(v)}"' for k, v in named.items())}>{escape(code_of(self.text, block))}</code></pre>\n")
        elif kind == "html-block":
            out.append(self.raw(code_of(self.text, block)[:-1]) + "\n")
        elif kind == "block-quote":
            out.append(self.tag("blockquote", kind, end=">\n"))
            stack.append("</blockquote>\n")
            stack.extend((c, False) for c in reversed(block.children))
        elif kind == "github:alert":
            name = block.data["alert"]
            out.append(f'<div class="markdown-alert markdown-alert-{name}">\n<p class="markdown-alert-title">{name.capitalize()}</p>\n')
            stack.append("</div>\n")
            stack.extend((c, False) for c in reversed(block.children))
        elif kind == "list":
            name = "ol" if block.data["ordered"] else "ul"
            start = {} if block.data["start"] in (None, 1) else {"start": str(block.data["start"])}
            out.append(self.tag(name, kind, start, end=">\n"))
            stack.append(f"</{name}>\n")
            stack.extend((c, not block.data["loose"]) for c in reversed(block.children))
        elif kind == "list-item":
            self.item(block, tight, out, stack)
        elif kind == "gfm:table":
            out.append(self.table(block))
        elif "ext" in block.data:
            out.append(f'<div data-kind="{escape(kind)}"{"".join(f' data-{escape(k)}="{escape(v)}"' for k, v in block.data["ext"].items())}>\n')
            stack.append("</div>\n")
            stack.extend((c, False) for c in reversed(block.children))

    def inner(self, block: Block) -> str:
        """The HTML of what a block holds: its text, code or blocks."""
        if block.kind in ("fenced-code", "indented-code"):
            return escape(code_of(self.text, block))
        return self.inline(self.inlines(block.pieces)) if block.pieces else self.render(block.children)

    def item(self, block: Block, tight: bool, out: list[str], stack: list, name: str = "li") -> None:
        shown = [c for c in block.children if c.kind != "link-reference-definition"]
        task = block.data.get("task")
        if task:
            box = f'<input {"checked=\"\" " if task == "checked" else ""}disabled="" type="checkbox"> '
            if shown and shown[0].kind == "paragraph":
                shown[0].data["task_html"] = box
        if not shown:
            out.append(f"{self.tag(name, block.kind)}</{name}>\n")
            return
        inline = [tight and c.kind == "paragraph" for c in shown]
        parts: list = [self.tag(name, block.kind, end=">" if inline[0] else ">\n")]
        for k, c in enumerate(shown):
            if k and inline[k - 1]:
                parts.append("\n")
            parts.append((c, tight))
        parts.append(f"</{name}>\n")
        stack.extend(reversed(parts))

    def table(self, block: Block) -> str:
        align = [f' align="{a}"' if a else "" for a in block.data["align"]]

        def row(cells: list, name: str) -> str:
            cells = (cells + [None] * len(align))[: len(align)]
            return "<tr>\n" + "".join(f"<{name}{a}>{self.cell(c)}</{name}>\n" for c, a in zip(cells, align, strict=True)) + "</tr>\n"

        body = "".join(row(r, "td") for r in block.data["rows"])
        return f"{self.tag('table', block.kind)}\n<thead>\n{row(block.data['header'], 'th')}</thead>\n" + (f"<tbody>\n{body}</tbody>\n" if body else "") + "</table>\n"

    def cell(self, span: tuple[int, int] | None) -> str:
        if span is None or span[0] >= span[1]:
            return ""
        text = self.text[span[0] : span[1]].replace("\\|", "|")
        return self.inline(InlineParser(text, [(0, len(text), 0)], self.parser.references, self.options).parse())


def page_of(source: str | bytes, profile: str, policy: Policy | None, plugins: Plugins | None, options: dict) -> Html:
    text = source.decode("utf-8", "replace") if isinstance(source, bytes) else source
    return Html(text.replace("\0", "\ufffd"), Options.profile(profile, **options), policy or Policy(), plugins)


def to_html(source: str | bytes | None, profile: str = "github", policy: Policy | None = None, plugins: Plugins | None = None, **options) -> str | None:
    """HTML of one document; null stays null."""
    return None if source is None else (policy or Policy()).finished(page_of(source, profile, policy, plugins, options).render())


def blocks_to_html(source: str | bytes | None, profile: str = "github", policy: Policy | None = None, plugins: Plugins | None = None, **options) -> list[tuple[int, int, str]] | None:
    """(start, end, HTML) of every top-level block, in bytes of the source."""
    if source is None:
        return None
    page = page_of(source, profile, policy, plugins, options)
    place = lambda i: len(page.text[:i].encode()) if not page.text.isascii() else i
    return [(place(b.start), place(b.end), page.render([b])) for b in page.root.children]


def inline_to_html(source: str | None, profile: str = "github", policy: Policy | None = None) -> str | None:
    if source is None:
        return None
    page = Html("", Options.profile(profile), policy or Policy())
    return page.inline(InlineParser(source, [(0, len(source), 0)], {}, page.options).parse())


class Normaliser(Html):
    """The same document in one style: ATX headings, fenced code, - bullets, --- breaks."""

    def lines_of(self, block: Block) -> list[str]:
        text, data, kind = self.text, block.data, block.kind
        if kind == "paragraph":
            own = [text[a:b].strip(" \t") if i == len(block.pieces) - 1 else text[a:b].lstrip(" \t") for i, (a, b, _) in enumerate(block.pieces)]
            own = [x if k == len(own) - 1 else re.sub(" {2,}$", "\\\\", x).rstrip(" ") for k, x in enumerate(own)]
            return own
        if kind in ("atx-heading", "setext-heading"):
            return [f"{'#' * block.level} {' '.join(text[a:b].strip(' \t') for a, b, _ in block.pieces)}".rstrip(" ")]
        if kind == "thematic-break":
            return ["---"]
        if kind in ("fenced-code", "indented-code"):
            code = code_of(text, block)
            fence = "`" * max(3, 1 + max(map(len, re.findall("`+", code)), default=0))
            return [fence + data.get("info", ""), *code.split("\n")[:-1], fence]
        if kind == "html-block":
            return code_of(text, block)[:-1].split("\n")
        if kind in ("link-reference-definition", "frontmatter:block"):
            return re.split("\r\n|\r|\n", text[block.start : block.end])
        if kind == "gfm:table":
            row = lambda cells: "| " + " | ".join(text[a:b] for a, b in cells) + " |"
            marks = {None: "---", "left": ":---", "right": "---:", "center": ":---:"}
            return [row(data["header"]), "| " + " | ".join(marks[a] for a in data["align"]) + " |", *map(row, data["rows"])]
        if kind in ("block-quote", "github:alert"):
            own = self.joined(block.children)
            own = [f"[!{data['alert'].upper()}]", *own] if kind == "github:alert" else own
            return [f"> {x}".rstrip(" ") for x in own] or [">"]
        if kind == "list":
            return self.list_lines(block)
        if kind in self.plugins.printers:
            return self.plugins.printers[kind](text[block.start : block.end], data.get("ext", {})).split("\n")
        if kind == "description-list":
            return [x for c in block.children for x in self.lines_of(c)]
        if kind == "description-term":
            return [text[a:b].strip(" \t") for a, b, _ in block.pieces]
        if kind == "description":
            own = self.joined(block.children, data["loose"]) or [""]
            return [f": {own[0]}".rstrip(" "), *((f"  {x}" if x else "") for x in own[1:])]
        return re.split("\r\n|\r|\n", text[block.start : block.end])

    def list_lines(self, block: Block) -> list[str]:
        out: list[str] = []
        for k, item in enumerate(block.children):
            mark = f"{block.data['start'] + k}. " if block.data["ordered"] else "- "
            task = {"checked": "[x] ", "unchecked": "[ ] "}.get(item.data.get("task"), "")
            own = self.joined(item.children, block.data["loose"]) or [""]
            if k and block.data["loose"]:
                out.append("")
            out.append((mark + task + own[0]).rstrip(" "))
            out += [(" " * len(mark) + x) if x else "" for x in own[1:]]
        return out

    def joined(self, blocks: list[Block], loose: bool = True) -> list[str]:
        out: list[str] = []
        for k, block in enumerate(blocks):
            if k and (loose or block.kind == "paragraph"):
                out.append("")
            if k and block.kind == blocks[k - 1].kind == "list" and block.data["ordered"] == blocks[k - 1].data["ordered"]:
                out += ["<!-- -->", ""]
            out += self.lines_of(block)
        return out

    def render(self, blocks: list[Block] | None = None) -> str:
        own = self.joined(self.root.children if blocks is None else blocks)
        return "\n".join(own) + "\n" if own else ""


def normalised(source: str | None, profile: str = "github", plugins: Plugins | None = None, **options) -> str | None:
    """source in one style; parsing it again gives the same structure."""
    return None if source is None else Normaliser(source.replace("\0", "\ufffd"), Options.profile(profile, **options), Policy(), plugins).render()
