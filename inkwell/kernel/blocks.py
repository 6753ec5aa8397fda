"""Block structure of one CommonMark or GFM document.

A document is a stack of open containers.  Every line first continues the containers that match it, then opens new
blocks, and what is left is text of the innermost leaf.  Offsets are code points of the decoded text here; the caller
turns them into bytes.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

from inkwell.kernel.names import HTML_BLOCK_TAGS
from inkwell.kernel.rules import ATTRIBUTES_BLOCK, CLOSE, NOTE_USES, NOTES, AttributePolicy, BlockRule, InlineRule, LineView, attribute_rules

LEAVES = frozenset(("paragraph", "atx-heading", "setext-heading", "indented-code", "fenced-code", "html-block", "thematic-break", "link-reference-definition", "gfm:table", "frontmatter:block", "description-term"))

RAW_LINES = frozenset(("fenced-code", "html-block", "indented-code"))

ATX = re.compile(r"(#{1,6})(?:[ \t]+|$)")
ATX_CLOSE = re.compile(r"(?:^|[ \t]+)#+[ \t]*$")
SETEXT = re.compile(r"(=+|-+)[ \t]*$")
THEMATIC = re.compile(r"(?:\*[ \t]*){3,}$|(?:-[ \t]*){3,}$|(?:_[ \t]*){3,}$")
FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
BULLET = re.compile(r"[*+-](?=[ \t]|$)")
DESCRIPTION = re.compile(r":(?=[ \t])")
ORDERED = re.compile(r"([0-9]{1,9})([.)])(?=[ \t]|$)")
TASK = re.compile(r"\[([ xX])\][ \t]+(?=\S)")
ALERT = re.compile(r"\[!(NOTE|TIP|IMPORTANT|WARNING|CAUTION)\][ \t]*")
FRONT = re.compile(r"(---|\+\+\+)[ \t]*$")
DELIMITER_CELL = re.compile(r":?-+:?$")
LINES = re.compile(r"([^\r\n]*)(\r\n|\n|\r|$)")
TAG = r"<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][A-Za-z0-9_.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>"
HTML_OPEN = (
    re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"<!--"), re.compile(r"<\?"), re.compile(r"<![A-Za-z]"), re.compile(r"<!\[CDATA\["),
    re.compile(rf"</?(?:{'|'.join(HTML_BLOCK_TAGS)})(?:\s|/?>|$)", re.I), re.compile(rf"(?:{TAG})\s*$"),
)
HTML_CLOSE = (re.compile(r"</(?:script|pre|style|textarea)>", re.I), re.compile("-->"), re.compile(r"\?>"), re.compile(">"), re.compile(r"\]\]>"))


class ParseLimit(Exception):
    """A document beyond a parse limit."""

    def __init__(self, kind: str, limit: int, attempted: int, offset: int):
        super().__init__(f"{kind} limit {limit} exceeded")
        self.kind, self.limit, self.attempted, self.offset = kind, limit, attempted, offset


@dataclass
class Options:
    """What a profile turns on, and the limits of a parse."""

    tables: bool = True
    tasks: bool = True
    strikethrough: bool = True
    autolinks: bool = True
    tagfilter: bool = True
    alerts: bool = True
    front_matter: bool = True
    descriptions: bool = False  # a paragraph followed by ": text" lines is a term with descriptions
    footnotes: bool = False  # labels that begin with ^ are notes, which hold blocks, and their uses
    #: Further inline syntax: (kind, pattern whose group 1 is the text, HTML element). The first sign of a match must be fixed.
    inline_rules: tuple[tuple[str, str, str], ...] = ()
    #: Further one-line root blocks: (kind, pattern); named groups become attributes.
    line_rules: tuple[tuple[str, str], ...] = ()
    #: Further containers at the root: (kind, opening pattern, closing pattern); what stands between is parsed as blocks.
    container_rules: tuple[tuple[str, str, str], ...] = ()
    #: Further blocks with a state of their own, and inlines that a function reads.
    block_rules: tuple[BlockRule, ...] = ()
    inline_parsers: tuple[InlineRule, ...] = ()
    #: Lists of attributes in braces, after inlines and on lines of their own, are read under this policy.
    attributes: AttributePolicy | None = None
    #: Class, and beginning of the ids, of tab groups in HTML.
    tabs_class: str = "tabs"
    nesting: int = 256
    blocks: int | None = None
    inlines: int | None = None
    references: int | None = None
    source_bytes: int | None = None

    def __post_init__(self) -> None:
        if self.footnotes and NOTES not in self.block_rules:
            self.block_rules, self.inline_parsers = (*self.block_rules, NOTES), (*self.inline_parsers, NOTE_USES)
        if self.attributes and not any(r.kind == ATTRIBUTES_BLOCK for r in self.block_rules):
            block, inline = attribute_rules(self.attributes)
            self.block_rules, self.inline_parsers = (*self.block_rules, block), (*self.inline_parsers, inline)

    @staticmethod
    def profile(name: str, **more) -> Options:
        if name not in ("commonmark", "gfm", "github"):
            raise ValueError(f"unknown profile {name!r}")
        gfm, github = name != "commonmark", name == "github"
        return Options(tables=gfm, tasks=gfm, strikethrough=gfm, autolinks=gfm, tagfilter=gfm, alerts=github, front_matter=github, **more)


@dataclass(slots=True)
class Block:
    kind: str
    start: int
    end: int = 0
    parent: Block | None = None
    children: list[Block] = field(default_factory=list)
    open: bool = True
    pieces: list[tuple[int, int, int]] = field(default_factory=list)  # (start, end, pad) of content lines
    level: int | None = None
    data: dict = field(default_factory=dict)
    blank_last: bool = False


class Line:
    """A line with a cursor that counts tab stops."""

    __slots__ = ("text", "base", "at", "column", "partial", "next", "indent", "blank")

    def __init__(self, text: str, base: int):
        self.text, self.base, self.at, self.column, self.partial = text, base, 0, 0, False
        self.find()

    def find(self) -> None:
        i, column, text = self.at, self.column, self.text
        n = len(text)
        while i < n:
            c = text[i]
            if c == " ":
                column += 1
            elif c == "\t":
                column += 4 - column % 4
            else:
                break
            i += 1
        self.next, self.indent, self.blank = i, column - self.column, i >= n

    def advance(self, columns: int) -> None:
        """Over white space, by columns; a tab may be left in part."""
        while columns > 0 and self.at < len(self.text):
            if self.text[self.at] == "\t":
                width = 4 - self.column % 4
                self.partial = width > columns
                step = min(width, columns)
                self.column += step
                columns -= step
                self.at += not self.partial
            else:
                self.partial = False
                self.at += 1
                self.column += 1
                columns -= 1
        self.find()

    def skip(self, count: int) -> None:
        """Over count signs that are not white space."""
        self.at += count
        self.column += count
        self.partial = False
        self.find()

    def to_content(self) -> None:
        self.column += self.indent
        self.at, self.partial, self.indent = self.next, False, 0

    @property
    def pad(self) -> int:
        return 4 - self.column % 4 if self.partial else 0

    def piece(self) -> tuple[int, int, int]:
        return self.base + self.at + self.partial, self.base + len(self.text), self.pad


class BlockParser:
    def __init__(self, text: str, options: Options, references: dict | None = None):
        self.text, self.options = text, options
        self.lines = [(m.start(), m.end(1), m.end()) for m in LINES.finditer(text) if m.end() > m.start()]
        self.root = Block("document", 0)
        self.references: dict[str, dict] = references if references is not None else {}
        self.count = 0
        self.tip = self.root

    def parse(self) -> Block:
        from inkwell.kernel.inlines import take_definitions

        self.take_definitions = take_definitions
        first = self.front_matter() if self.options.front_matter else 0
        quick = not (self.options.line_rules or self.options.container_rules or any(c.isalpha() for r in self.options.block_rules for c in r.triggers))
        for start, content, end in self.lines[first:]:
            if not (quick and start < content and self.plain_line(start, content)):
                self.line(Line(self.text[start:content], start), end)
        self.close_to(self.root)
        self.close(self.root)
        self.root.end = len(self.text)
        return self.root

    def plain_line(self, start: int, content: int) -> bool:
        """Take a line that can only be text: one of a fence, or one that begins with a letter, right below the root."""
        root, tip, c = self.root, self.tip, self.text[start]
        if tip.kind == "fenced-code" and tip.open and tip.parent is root:
            if c in " \t" or c == tip.data["mark"][0]:
                return False
            tip.pieces.append((start, content, 0))
        elif not c.isalpha():
            return False
        elif tip.kind == "paragraph" and tip.open and tip.parent is root:
            tip.pieces.append((start, content, 0))
        elif not (root.children and root.children[-1].open):
            self.tip = root
            tip = self.add("paragraph", start)
            tip.pieces.append((start, content, 0))
        else:
            return False
        tip.end = root.end = content
        tip.blank_last = root.blank_last = False
        return True

    def front_matter(self) -> int:
        if not self.lines or self.lines[0][0] > (self.text[:1] == "\ufeff"):
            return 0
        start, content, _ = self.lines[0]
        skip = self.text.startswith("\ufeff")
        found = FRONT.match(self.text[start + skip : content])
        if not found:
            return 0
        for i, (a, b, _) in enumerate(self.lines[1:], 1):
            close = FRONT.match(self.text[a:b])
            if close and close[1] == found[1]:
                block = self.add("frontmatter:block", start + skip)
                block.data |= {"fence": found[1], "content": self.text[self.lines[0][2] : a]}
                block.end, block.open = b, False
                self.tip = self.root
                return i + 1
        return 0

    def add(self, kind: str, start: int, nests: bool = False) -> Block:
        parent = self.tip
        while parent.kind in LEAVES or ("ext" in parent.data and "closer" not in parent.data and "nests" not in parent.data) or (parent.kind == "list" and kind != "list-item") or (parent.kind == "description-list" and kind != "description") or (kind == "list-item" and parent.kind != "list"):
            self.close(parent)
            parent = parent.parent
        block = Block(kind, start, start, parent)
        parent.children.append(block)
        self.tip = block
        self.count += 1
        if self.options.blocks is not None and self.count > self.options.blocks:
            raise ParseLimit("block-count", self.options.blocks, self.count, start)
        depth, up = 0, parent
        if nests or kind in ("block-quote", "list", "list-item", "description"):
            while up is not None:
                depth, up = depth + 1, up.parent
            if depth > self.options.nesting:
                raise ParseLimit("nesting", self.options.nesting, depth, start)
        return block

    # -- one line --------------------------------------------------------------------------------------------------

    def line(self, line: Line, end: int) -> None:
        if line.base == 0 and line.text.startswith("\ufeff"):
            line = Line(line.text[1:], 1)
        container, matched = self.root, True
        while container.children and container.children[-1].open:
            child = container.children[-1]
            state = self.continues(child, line)
            if state is None:
                return  # the line closed a fence
            if not state:
                matched = False
                break
            container = child
        unmatched = not matched
        opaque = matched and (container.kind in RAW_LINES or "leaf" in container.data)
        last = container
        if not opaque:
            last = self.open_blocks(container, line, unmatched)
        if last is None:
            return
        tip = self.tip
        lazy = unmatched and last is container and tip.kind == "paragraph" and tip.open and not line.blank
        if lazy and not opaque:
            line.to_content()
            tip.pieces.append(line.piece())
            self.extend(tip, line.base + len(line.text))
            return
        if last is container and unmatched:
            self.close_to(container)
            self.tip = container
        self.text_of_line(last, line, end)

    def extend(self, block: Block | None, end: int) -> None:
        while block is not None:
            block.end = max(block.end, end)
            block = block.parent

    def continues(self, block: Block, line: Line) -> bool | None:
        kind = block.kind
        if kind == "block-quote":
            if line.indent <= 3 and line.text[line.next : line.next + 1] == ">":
                line.to_content()
                line.skip(1)
                if line.text[line.at : line.at + 1] in (" ", "\t"):
                    line.advance(1)
                return True
            return False
        if kind == "list":
            return True
        if kind == "list-item":
            if line.blank:
                if not block.children:
                    return False
                line.to_content()
                return True
            if line.indent >= block.data["width"]:
                line.advance(block.data["width"])
                return True
            return False
        if kind == "description-list":
            if line.blank or (line.indent <= 3 and DESCRIPTION.match(line.text, line.next)):
                return True
            last = block.children[-1]
            return last.kind == "description" and last.open and line.indent >= last.data["width"]
        if kind == "description":
            if line.blank:
                line.to_content()
                return bool(block.children)
            if line.indent >= block.data["width"]:
                line.advance(block.data["width"])
                return True
            return False
        if "closer" in block.data:
            return True
        if "rule" in block.data:
            return self.proceeds(block, line)
        if kind == "fenced-code":
            fence = block.data["mark"]
            if line.indent <= 3:
                rest = line.text[line.next :].rstrip(" \t")
                if len(rest) >= len(fence) and rest == fence[0] * len(rest):
                    block.data["closed"] = True
                    self.extend(block, line.base + len(line.text))
                    self.close_to(block)
                    self.close(block)
                    self.tip = block.parent
                    return None
            line.advance(min(line.indent, block.data["indent"]))
            return True
        if kind == "indented-code":
            if line.indent >= 4:
                line.advance(4)
                return True
            if line.blank:
                line.to_content()
                return True
            return False
        if kind == "html-block":
            return not (line.blank and block.data["type"] in (6, 7))
        if kind == "paragraph":
            return not line.blank
        if kind == "gfm:table":
            return not line.blank and not self.interrupts(line)
        return False

    def interrupts(self, line: Line) -> bool:
        """Whether a line begins a block that ends a table."""
        if line.indent > 3:
            return False
        rest = line.text[line.next :]
        return bool(rest.startswith(">") or ATX.match(rest) or FENCE.match(rest) or THEMATIC.match(rest) or BULLET.match(rest) or ORDERED.match(rest) or any(p.match(rest) for p in HTML_OPEN[:6]))

    def open_blocks(self, container: Block, line: Line, unmatched: bool) -> Block | None:
        """Open what the line begins; the innermost new block, the container if nothing began, None if the line is used up."""
        while True:
            if (container.kind in LEAVES and container.kind != "paragraph") or "leaf" in container.data:
                return container
            at = line.next
            rest = line.text[at:]
            paragraph = self.tip if self.tip.kind == "paragraph" and self.tip.open else None
            in_paragraph = container if container.kind == "paragraph" else None
            if line.blank:
                return container
            if line.indent >= 4:
                if paragraph is None:
                    self.leave(container)
                    block = self.add("indented-code", line.base + line.at)  # with its blanks
                    line.advance(4)
                    return block
                return container
            if self.options.block_rules and (own := self.begun(rest, container, line, paragraph is not None)) is not None:
                if "leaf" in own.data:
                    return None if line.blank else own
                if line.blank:
                    return own
                container, unmatched = own, False
                continue
            if (own := self.custom(rest, container, line)) is not None:
                return own
            c = rest[0]
            if c == ":" and self.options.descriptions and DESCRIPTION.match(rest) and (home := self.described(container, line, unmatched)) is not None:
                container, unmatched = home, False
                continue
            if c == ">":
                self.leave(container)
                line.to_content()
                container = self.add("block-quote", line.base + line.at)
                line.skip(1)
                if line.text[line.at : line.at + 1] in (" ", "\t"):
                    line.advance(1)
                unmatched = False
                continue
            if c == "#" and (found := ATX.match(rest)):
                self.leave(container)
                block = self.add("atx-heading", line.base + at)
                block.level = len(found[1])
                content = ATX_CLOSE.sub("", rest[found.end() :]).rstrip(" \t")
                begin = line.base + at + found.end()
                block.pieces = [(begin, begin + len(content), 0)]
                return self.used(block, line)
            if c in "`~" and (found := FENCE.match(rest)):
                self.leave(container)
                block = self.add("fenced-code", line.base + at)
                mark, info = (found[1], found[2]) if found[1] else (found[3], found[4])
                block.data |= {"mark": mark, "indent": line.indent, "info": info.strip(" \t"), "closed": False}
                self.extend(block, line.base + len(line.text))
                return None
            if c == "<":
                for kind, pattern in enumerate(HTML_OPEN, 1):
                    if pattern.match(rest) and (kind < 7 or paragraph is None):
                        self.leave(container)
                        block = self.add("html-block", line.base + line.at)
                        block.data["type"] = kind
                        self.text_of_line(block, line, 0)
                        return None
            if in_paragraph is not None and not unmatched and (found := SETEXT.match(rest)):
                self.definitions(in_paragraph)
                if in_paragraph.pieces:
                    in_paragraph.kind, in_paragraph.level = "setext-heading", 1 if found[1][0] == "=" else 2
                    in_paragraph.data["underline"] = line.base + at
                    return self.used(in_paragraph, line)
                self.tip = container = in_paragraph.parent
                if not in_paragraph.open and THEMATIC.match(rest):
                    continue
                return container
            if self.options.tables and in_paragraph is not None and not unmatched and "-" in rest and (table := self.table(in_paragraph, line)):
                return self.used(table, line, close=False)
            if THEMATIC.match(rest):
                self.leave(container)
                return self.used(self.add("thematic-break", line.base + at), line)
            marker = self.marker(rest, container if in_paragraph is None else None, line, paragraph if container.kind == "paragraph" else None)
            if marker is not None:
                self.leave(container)
                if self.tip.kind != "list" or self.tip.data["signature"] != marker["signature"]:
                    block = self.add("list", line.base + at)
                    block.data |= {k: marker[k] for k in ("signature", "ordered", "start")} | {"loose": False}
                item = self.add("list-item", line.base + at)
                indent = line.indent
                line.to_content()
                line.skip(marker["size"])
                if line.blank:
                    item.data["width"] = indent + marker["size"] + 1
                    line.to_content()
                elif line.indent >= 5:
                    item.data["width"] = indent + marker["size"] + 1
                    line.advance(1)
                else:
                    item.data["width"] = indent + marker["size"] + line.indent
                    line.advance(line.indent)
                self.extend(item, line.base + len(line.text))
                if self.options.tasks and (task := TASK.match(line.text[line.at :])):
                    item.data["task"] = "unchecked" if task[1] == " " else "checked"
                    line.skip(3)
                    line.advance(line.indent)
                container, unmatched = item, False
                continue
            return container

    def described(self, container: Block, line: Line, unmatched: bool) -> Block | None:
        """A description that the line begins, below the open paragraph as its term or one more of the open list."""
        if container.kind == "paragraph" and not unmatched:
            self.definitions(container)
            if not container.pieces:
                return None
            home = container.parent
            group = Block("description-list", container.start, container.end, home)
            home.children[place_among(home.children, container)] = group
            container.kind, container.parent, container.open = "description-term", group, False
            container.end = container.pieces[-1][1]
            group.children.append(container)
            self.count += 1
            self.tip = group
        elif container.kind == "description-list":
            self.leave(container)
        else:
            return None
        block = self.add("description", line.base + line.next)
        indent = line.indent
        line.to_content()
        line.skip(1)
        block.data["width"] = indent + 1 + (1 if line.blank or line.indent >= 5 else line.indent)
        line.advance(1 if line.indent >= 5 else line.indent)
        self.extend(block, line.base + len(line.text))
        return block

    def view(self, line: Line, parent: Block, paragraph: bool) -> LineView:
        return LineView(line.text[line.next :], line.indent, paragraph, parent.kind, parent.data.get("state", {}))

    def proceeds(self, block: Block, line: Line) -> bool | None:
        """Whether a rule's block goes on with the line; None if the line is its last."""
        go = block.data["rule"].proceed(self.view(line, block.parent, self.tip.kind == "paragraph" and self.tip.open), block.data["state"])
        if go is None:
            return False
        if go is CLOSE:
            self.extend(block, line.base + len(line.text))
            self.close_to(block)
            self.close(block)
            self.tip = block.parent
            return None
        if go.columns is None:
            line.to_content()
        else:
            line.advance(min(line.indent, go.columns))
        if go.used:
            line.to_content()
            line.skip(go.used)
        return True

    def begun(self, rest: str, container: Block, line: Line, paragraph: bool) -> Block | None:
        """The block of a rule that the line begins."""
        home = container
        while home.kind in ("paragraph", "list", "description-list"):
            home = home.parent
        view = None
        for rule in self.options.block_rules:
            if rest[0] not in rule.triggers or (rule.within is not None and home.kind != rule.within):
                continue
            view = view or self.view(line, home, paragraph)
            opened = rule.start(view)
            if opened is None:
                continue
            self.close_to(home)
            self.tip = home
            block = self.add(rule.kind, line.base + line.next, rule.container)
            block.data |= {"rule": rule, "state": dict(opened.state), "ext": {k: str(v) for k, v in opened.state.items()}, "nests" if rule.container else "leaf": True}
            self.extend(block, line.base + len(line.text))
            if opened.used is None:
                line.at = line.next = len(line.text)
                line.blank, line.indent = True, 0
            else:
                line.to_content()
                line.skip(opened.used)
            return block
        return None

    def custom(self, rest: str, container: Block, line: Line) -> Block | None:
        """A block of the line and container rules; its parent, since the line is used up and blank to it."""
        options = self.options
        home = container
        while home.kind in ("paragraph", "list"):
            home = home.parent
        if not (options.line_rules or options.container_rules) or (home.parent is not None and "closer" not in home.data):
            return None
        for kind, pattern in options.line_rules:
            if found := re.fullmatch(pattern, rest.rstrip(" \t")):
                self.leave(home)
                block = self.add(kind, line.base + line.next)
                block.data["ext"] = {k: v for k, v in found.groupdict().items() if v is not None}
                return self.used_up(block, line)
        if "closer" in home.data and re.fullmatch(home.data["closer"], rest.rstrip(" \t")):
            self.leave(home)
            return self.used_up(home, line)
        for kind, opener, closer in options.container_rules:
            if found := re.fullmatch(opener, rest.rstrip(" \t")):
                self.leave(home)
                block = self.add(kind, line.base + line.next)
                block.data |= {"closer": closer, "ext": {k: v for k, v in found.groupdict().items() if v is not None}}
                self.extend(block, line.base + len(line.text))
                line.at = line.next = len(line.text)
                line.blank, line.indent = True, 0
                return block
        return None

    def used_up(self, block: Block, line: Line) -> Block:
        self.extend(block, line.base + len(line.text))
        self.close(block)
        self.tip = block.parent
        line.at = line.next = len(line.text)
        line.blank, line.indent = True, 0
        return block.parent

    def leave(self, container: Block) -> None:
        """Close what the line did not match, or the paragraph it interrupts."""
        target = container.parent if container.kind == "paragraph" else container
        self.close_to(target)
        self.tip = target

    def used(self, block: Block, line: Line, close: bool = True) -> None:
        self.extend(block, line.base + len(line.text.rstrip(" \t")) if block.kind != "gfm:table" else line.base + len(line.text))
        if close:
            self.close(block)
            self.tip = block.parent
        return None

    def marker(self, rest: str, container: Block | None, line: Line, paragraph: Block | None) -> dict | None:
        if found := BULLET.match(rest):
            out = {"signature": rest[0], "ordered": False, "start": None, "size": 1}
        elif found := ORDERED.match(rest):
            out = {"signature": found[2], "ordered": True, "start": int(found[1]), "size": found.end()}
        else:
            return None
        if paragraph is not None and (not rest[found.end() :].strip(" \t") or (out["ordered"] and out["start"] != 1)):
            return None
        return out

    def text_of_line(self, block: Block, line: Line, end: int) -> None:
        kind = block.kind
        raw = kind in RAW_LINES or "leaf" in block.data
        if line.blank and not raw:
            if block.children:
                block.children[-1].blank_last = True
            quiet = kind == "block-quote" or (kind == "list-item" and not block.children and block.start >= line.base)
            up = block
            if not quiet:
                block.blank_last = True
            while up.parent is not None:
                up = up.parent
                up.blank_last = False
            return
        up = block
        while up is not None:
            up.blank_last = False
            up = up.parent
        if raw:
            block.pieces.append(line.piece())
            if kind != "indented-code" or not line.blank:
                self.extend(block, line.base + len(line.text))
            if kind == "html-block" and block.data["type"] <= 5 and HTML_CLOSE[block.data["type"] - 1].search(line.text, line.at):
                self.close(block)
                self.tip = block.parent
            return
        line.to_content()
        if kind == "paragraph":
            block.pieces.append(line.piece())
        elif kind == "gfm:table":
            block.data["rows"].append(self.cells(line.base + line.at, line.base + len(line.text)))
        else:
            block = self.add("paragraph", line.base + line.at)
            block.pieces.append(line.piece())
        self.extend(block, line.base + len(line.text))

    # -- tables ----------------------------------------------------------------------------------------------------

    def cells(self, start: int, end: int) -> list[tuple[int, int]]:
        """Cell ranges of a table line; a pipe inside a code span or after a backslash does not split."""
        text = self.text
        while end > start and text[end - 1] in " \t":
            end -= 1
        while start < end and text[start] in " \t":
            start += 1
        if start < end and text[start] == "|":
            start += 1
        out, begin, i = [], start, start
        runs: dict[int, int] = {}
        while i < end:
            c = text[i]
            if c == "\\":
                i += 2
                continue
            if c == "`":
                j = i
                while j < end and text[j] == "`":
                    j += 1
                close = re.compile(r"(?<!`)" + "`" * (j - i) + r"(?!`)").search(text, j, end) if runs.get(j - i) != -1 else None
                if close is None:
                    runs[j - i] = -1
                    i = j
                else:
                    i = close.end()
                continue
            if c == "|":
                out.append((begin, i))
                begin = i + 1
            i += 1
        if begin < end:
            out.append((begin, end))
        trimmed = []
        for a, b in out:
            while a < b and text[a] in " \t":
                a += 1
            while b > a and text[b - 1] in " \t":
                b -= 1
            trimmed.append((a, b))
        return trimmed

    def table(self, paragraph: Block, line: Line) -> Block | None:
        start, stop = line.base + line.next, line.base + len(line.text)
        marks = [self.text[a:b] for a, b in self.cells(start, stop)]
        if not marks or not all(DELIMITER_CELL.match(m) for m in marks) or ("|" not in line.text[line.next :] and len(marks) == 1 and ":" not in marks[0]):
            return None
        a, b, _ = paragraph.pieces[-1]
        header = self.cells(a, b)
        if len(header) != len(marks):
            return None
        if len(paragraph.pieces) > 1:
            paragraph.pieces.pop()
            paragraph.end = paragraph.pieces[-1][1]
            self.close(paragraph)
            self.tip = paragraph.parent
        else:
            del paragraph.parent.children[place_among(paragraph.parent.children, paragraph)]
            self.count -= 1
            self.tip = paragraph.parent
        block = self.add("gfm:table", a)
        names = {(False, False): None, (True, False): "left", (False, True): "right", (True, True): "center"}
        block.data |= {"header": header, "align": [names[m[0] == ":", m[-1] == ":"] for m in marks], "rows": [], "delimiter": (start, stop)}
        return block

    # -- closing ---------------------------------------------------------------------------------------------------

    def close_to(self, container: Block) -> None:
        """Close everything open below container."""
        chain, block = [], container
        while block.children and block.children[-1].open:
            block = block.children[-1]
            chain.append(block)
        for block in reversed(chain):
            self.close(block)

    def definitions(self, paragraph: Block) -> None:
        """Take leading reference definitions out of a paragraph into blocks of their own before it."""
        found, rest = self.take_definitions(self.text, paragraph.pieces, self.options.footnotes)
        if not found:
            return
        siblings = paragraph.parent.children
        made = []
        for d in found:
            block = Block("link-reference-definition", d["start"], d["end"], paragraph.parent, open=False)
            block.data |= d
            made.append(block)
            self.count += 1
            if d["key"] not in self.references:
                if self.options.references is not None and len(self.references) >= self.options.references:
                    raise ParseLimit("reference-count", self.options.references, len(self.references) + 1, d["start"])
                self.references[d["key"]] = {"destination": d["destination"], "title": d["title"], "block": block, "used": False}
        paragraph.pieces = rest
        at = place_among(siblings, paragraph)
        if rest:
            paragraph.start = rest[0][0]
            siblings[at:at] = made
        else:
            siblings[at : at + 1] = made
            self.count -= 1

    def close(self, block: Block) -> None:
        if not block.open:
            return
        block.open = False
        text = self.text
        if block.kind == "paragraph":
            if block.pieces and text[block.pieces[0][0] : block.pieces[0][0] + 1] == "[":
                self.definitions(block)
            if block.pieces:
                block.end = block.pieces[-1][1]
        elif block.kind == "indented-code":
            while block.pieces and not text[block.pieces[-1][0] : block.pieces[-1][1]].strip(" \t"):
                block.pieces.pop()
        elif block.kind == "block-quote" and self.options.alerts and block.children and block.children[0].kind == "paragraph":
            first = block.children[0]
            a, b, _ = first.pieces[0]
            if found := ALERT.match(text[a:b]):
                block.kind = "github:alert"
                block.data["alert"] = found[1].lower()
                if found.end() < b - a:
                    first.pieces[0] = (a + found.end(), b, 0)
                    first.start = a + found.end()
                else:
                    first.pieces.pop(0)
                    if first.pieces:
                        first.start = first.pieces[0][0]
                    else:
                        block.children.pop(0)
                        self.count -= 1
        elif block.kind == "description":
            block.data["loose"] = any(ends_blank(c) for c in block.children[:-1])
        elif block.kind == "list":
            items = block.children
            for k, item in enumerate(items):
                inner = item.children
                gaps = any(ends_blank(c) for c in inner[:-1])
                if gaps or (k < len(items) - 1 and ends_blank(item)):
                    block.data["loose"] = True


def place_among(siblings: list[Block], block: Block) -> int:
    """The place of a block, which is one of the last."""
    return next(i for i in range(len(siblings) - 1, -1, -1) if siblings[i] is block)


def ends_blank(block: Block) -> bool:
    while True:
        if block.blank_last:
            return True
        if block.kind in ("list", "list-item") and block.children:
            block = block.children[-1]
        else:
            return False


def code_of(text: str, block: Block) -> str:
    return "".join(" " * pad + text[a:b] + "\n" for a, b, pad in block.pieces)


def unescaped(text: str) -> str:
    """Backslash escapes and character references of an info string, destination or title."""
    from inkwell.kernel.inlines import entity

    return re.sub(r"\\([!-/:-@\[-`{-~])|&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]*);", lambda m: m[1] or entity(m[0]) or m[0], text)


def language_of(info: str | None) -> str | None:
    words = (info or "").split()
    return unescaped(words[0]) if words else None


__all__ = ["Block", "BlockParser", "Options", "ParseLimit", "code_of", "language_of", "unescaped", "html"]
