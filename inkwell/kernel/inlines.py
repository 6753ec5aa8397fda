"""Inline structure of a paragraph, heading or table cell: one scan with a delimiter list and a bracket stack."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field
from html.entities import html5

PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
SPECIAL = re.compile(r"[\\`*_\[\]!<&\n~]")
SPECIAL_LINKS = re.compile(r"[\\`*_\[\]!<&\n~]|(?:(?<![^\s*_~(])(?:www\.|https?://|ftp://))|@")
ENTITY = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]*);")
URI = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>\x00-\x1f]*)>")
MAIL = re.compile(r"<([a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*)>")
RAW = re.compile(
    r"<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][A-Za-z0-9_.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>"
    r"|<!-->|<!--->|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)  # fmt: skip
LABEL = re.compile(r"\[((?:[^\\\[\]]|\\.){0,999})\]", re.S)
SPACE = re.compile(r"[ \t\n]*")
TITLE = re.compile(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\)", re.S)
ANGLE = re.compile(r"<((?:[^<>\n\\]|\\.)*)>")
HOST = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*")
LOCAL = re.compile(r"[A-Za-z0-9._+-]+$")
DOMAIN = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+")


def entity(reference: str) -> str | None:
    """The text of a character reference; None if it is not one."""
    if reference.startswith("&#"):
        number = int(reference[3:-1], 16) if reference[2] in "xX" else int(reference[2:-1])
        return "\ufffd" if number == 0 or number > 0x10FFFF or 0xD800 <= number < 0xE000 else chr(number)
    return html5.get(reference[1:])


def unescaped(text: str) -> str:
    return re.sub(r"\\([!-/:-@\[-`{-~])|" + ENTITY.pattern, lambda m: m[1] or entity(m[0]) or m[0], text)


def label_key(label: str) -> str:
    return " ".join(label.split()).casefold()


def encoded(destination: str) -> str:
    """A destination as an attribute may hold it: other bytes percent-encoded, what is encoded stays."""
    return "".join(chr(b) if 0x20 < b < 0x7F and b not in b'"<>[]\\^`{|}' else f"%{b:02X}" for b in destination.encode("utf-8", "surrogatepass"))


def destination_at(text: str, at: int) -> tuple[str, int] | None:
    if text.startswith("<", at):
        found = ANGLE.match(text, at)
        return (unescaped(found[1]), found.end()) if found else None
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text) and text[i + 1] in PUNCTUATION:
            i += 2
            continue
        if c == "(":
            depth += 1
            if depth > 32:
                return None
        elif c == ")":
            if not depth:
                break
            depth -= 1
        elif c <= " " or c == "\x7f":
            break
        i += 1
    return (unescaped(text[at:i]), i) if not depth else None


def content_of(text: str, pieces: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The content lines joined, and (place in content, place in text) at the start of each."""
    parts, marks, at = [], [], 0
    for start, end, _ in pieces:
        marks.append((at, start))
        parts.append(text[start:end])
        at += end - start + 1
    return "\n".join(parts), marks


def source_place(marks: list[tuple[int, int]], at: int) -> int:
    place = marks[max(0, bisect_right(marks, at, key=lambda mark: mark[0]) - 1)]
    return place[1] + at - place[0]


def take_definitions(text: str, pieces: list[tuple[int, int, int]], footnotes: bool = False) -> tuple[list[dict], list[tuple[int, int, int]]]:
    """Leading reference definitions of a paragraph, and the pieces that are left."""
    content, marks = content_of(text, pieces)
    found, at = [], 0
    while at < len(content) and content[at] == "[":
        label = LABEL.match(content, at)
        if not label or not label[1].strip() or (footnotes and label[1][0] == "^") or content[label.end() : label.end() + 1] != ":":
            break
        i = SPACE.match(content, label.end() + 1).end()
        if i >= len(content) or content.count("\n", label.end(), i) > 1:
            break
        target = destination_at(content, i)
        if target is None or (target[1] == i):
            break
        destination, i = target
        end_of_line = re.compile(r"[ \t]*(?:\n|$)").match(content, i)
        title, end = None, end_of_line.end() if end_of_line else None
        gap = SPACE.match(content, i).end()
        if gap > i and (named := TITLE.match(content, gap)) and "\n\n" not in named[0]:
            close = re.compile(r"[ \t]*(?:\n|$)").match(content, named.end())
            if close:
                title, end = unescaped(named[1] or named[2] or named[3] or ""), close.end()
        if end is None:
            break
        stop = end
        while stop > at and content[stop - 1] == "\n":
            stop -= 1
        found.append({"label": label[1], "key": label_key(label[1]), "destination": destination, "title": title, "start": source_place(marks, at), "end": source_place(marks, stop)})
        at = end
    if not found:
        return [], pieces
    return found, [p for p, (place, _) in zip(pieces, marks, strict=True) if place >= at]


@dataclass
class Node:
    kind: str
    start: int
    end: int
    text: str | None = None
    destination: str | None = None
    title: str | None = None
    children: list[Node] = field(default_factory=list)
    bracketed: bool = False
    ref_label: str | None = None
    label_end: int | None = None


@dataclass
class Run:
    node: Node
    sign: str
    count: int
    original: int
    opens: bool
    closes: bool


def punctuation(c: str) -> bool:
    return c in PUNCTUATION or unicodedata.category(c)[0] in "PS"


class InlineParser:
    def __init__(self, text: str, pieces: list[tuple[int, int, int]], references: dict, options):
        self.content, self.marks = content_of(text, pieces)
        self.content = self.content.rstrip(" \t")
        self.references, self.options = references, options
        self.nodes: list[Node] = []
        self.runs: list[Run] = []
        self.brackets: list[tuple] = []  # (node index, image, runs so far, place after the bracket)
        self.dead = 0  # link brackets below this place of the stack can't open a link any more
        self.ticks: dict[int, list[int]] | None = None

    def place(self, at: int) -> int:
        return source_place(self.marks, at) if self.marks else 0

    def parse(self) -> list[Node]:
        content, n, at = self.content, len(self.content), 0
        special = SPECIAL_LINKS if self.options.autolinks else SPECIAL
        parsers = self.options.inline_parsers
        if parsers:
            special = re.compile(f"{special.pattern}|[{re.escape(''.join(r.triggers for r in parsers))}]")
        if not self.options.inline_rules and not special.search(content):  # plain text
            return [Node("text", 0, n, content)] if n else []
        rules = [(kind, re.compile(pattern)) for kind, pattern, _ in self.options.inline_rules]
        if rules:
            special = re.compile("|".join([special.pattern, *(f"(?={p.pattern})[\\s\\S]" for _, p in rules)]))
        while at < n:
            found = special.search(content, at)
            stop = found.start() if found else n
            if stop > at:
                self.literal(at, stop)
                at = stop
            if found is None:
                break
            for kind, pattern in rules:
                if own := pattern.match(content, at):
                    self.nodes.append(Node(kind, at, own.end(), own[1]))
                    at = own.end()
                    break
            else:
                if parsers and (end := self.read(content, at)) is not None:
                    at = end
                    continue
                at = self.sign(content[at], at, found[0])
        self.emphasise(0)
        return merged(self.nodes)

    def read(self, content: str, at: int) -> int | None:
        """The end of an inline that a parser reads at a place; None if all decline."""
        for rule in self.options.inline_parsers:
            if content[at] in rule.triggers and (found := rule.parse(content, at)) is not None:
                end, text, data = found
                if not at < end <= len(content):
                    raise ValueError(f"{rule.kind} ends at {end}, outside of its text")
                self.nodes.append(Node(rule.kind, at, end, text, data))
                return end
        return None

    def literal(self, start: int, end: int, text: str | None = None) -> None:
        self.nodes.append(Node("text", start, end, self.content[start:end] if text is None else text))

    def sign(self, c: str, at: int, matched: str) -> int:
        content = self.content
        if c == "\\":
            after = content[at + 1 : at + 2]
            if after == "\n":
                return self.line_break(at, at + 1, True)
            if after and after in PUNCTUATION:
                self.literal(at, at + 2, after)
                return at + 2
        elif c == "`":
            return self.code(at)
        elif c in "*_" or (c == "~" and self.options.strikethrough):
            return self.run(c, at)
        elif c == "[":
            self.nodes.append(Node("text", at, at + 1, "["))
            self.brackets.append((len(self.nodes) - 1, False, len(self.runs), at + 1))
            return at + 1
        elif c == "!" and content.startswith("[", at + 1):
            self.nodes.append(Node("text", at, at + 2, "!["))
            self.brackets.append((len(self.nodes) - 1, True, len(self.runs), at + 2))
            return at + 2
        elif c == "]":
            return self.link_end(at)
        elif c == "<":
            for pattern, prefix in ((URI, ""), (MAIL, "mailto:")):
                if found := pattern.match(content, at):
                    self.nodes.append(Node("autolink", at + 1, found.end() - 1, found[1], prefix + found[1], bracketed=True))
                    return found.end()
            if found := RAW.match(content, at):
                self.nodes.append(Node("html-inline", at, found.end(), found[0]))
                return found.end()
        elif c == "&":
            if (found := ENTITY.match(content, at)) and (text := entity(found[0])) is not None:
                self.literal(at, found.end(), text)
                return found.end()
        elif c == "\n":
            return self.line_break(at, at, False)
        elif c == "@":
            return self.mail(at)
        elif len(matched) > 1 and (end := self.bare_link(at, matched)):
            return end
        size = max(1, len(matched))
        self.literal(at, at + size)
        return at + size

    def line_break(self, at: int, newline: int, hard: bool) -> int:
        last = self.nodes[-1] if self.nodes else None
        if not hard and last is not None and last.kind == "text" and last.text.endswith(" "):
            kept = last.text.rstrip(" ")
            hard = len(last.text) - len(kept) >= 2
            last.text = kept
            if not kept:
                self.nodes[-1] = Node("text", last.start, last.end, "")
        self.nodes.append(Node("hard-break" if hard else "soft-break", at, newline + 1))
        end = newline + 1
        while end < len(self.content) and self.content[end] in " \t":
            end += 1
        return end

    def code(self, at: int) -> int:
        content = self.content
        if self.ticks is None:  # places of all backtick runs by length, last first
            self.ticks = {}
            for m in re.finditer("`+", content):
                self.ticks.setdefault(m.end() - m.start(), []).append(m.start())
            for places in self.ticks.values():
                places.reverse()
        end = at
        while end < len(content) and content[end] == "`":
            end += 1
        places = self.ticks.get(end - at, [])
        while places and places[-1] < end:
            places.pop()
        if not places:
            self.literal(at, end)
            return end
        text = content[end : places[-1]].replace("\n", " ")
        if text.strip(" ") and text[0] == text[-1] == " ":
            text = text[1:-1]
        stop = places[-1] + end - at
        self.nodes.append(Node("code-span", at, stop, text))
        return stop

    def run(self, sign: str, at: int) -> int:
        content, end = self.content, at
        while end < len(content) and content[end] == sign:
            end += 1
        before = content[at - 1] if at else "\n"
        after = content[end] if end < len(content) else "\n"
        space_before, space_after = before.isspace(), after.isspace()
        mark_before, mark_after = punctuation(before), punctuation(after)
        left = not space_after and (not mark_after or space_before or mark_before)
        right = not space_before and (not mark_before or space_after or mark_after)
        opens, closes = left, right
        if sign == "_":
            opens, closes = left and (not right or mark_before), right and (not left or mark_after)
        if sign == "~" and end - at != 2:
            opens = closes = opens and closes and False
        self.nodes.append(Node("text", at, end, content[at:end]))
        if opens or closes:
            self.runs.append(Run(self.nodes[-1], sign, end - at, end - at, opens, closes))
        return end

    def link_end(self, at: int) -> int:
        if not self.brackets:
            self.literal(at, at + 1)
            return at + 1
        index, image, runs, begin = self.brackets.pop()
        dead = len(self.brackets) < self.dead
        self.dead = min(self.dead, len(self.brackets))
        if dead and not image:
            self.literal(at, at + 1)
            return at + 1
        target = self.inline_target(at + 1) or self.reference_target(begin, at)
        if target is None:
            self.literal(at, at + 1)
            return at + 1
        destination, title, end, label = target
        self.emphasise(runs)
        opener = self.nodes[index]
        link = Node("image" if image else "link", opener.start, end, None, destination, title, merged(self.nodes[index + 1 :]), ref_label=label, label_end=at)
        del self.nodes[index:]
        self.nodes.append(link)
        del self.runs[runs:]
        if not image:
            self.dead = len(self.brackets)
        return end

    def inline_target(self, at: int) -> tuple | None:
        content = self.content
        if not content.startswith("(", at):
            return None
        i = SPACE.match(content, at + 1).end()
        if content.startswith(")", i):
            return "", None, i + 1, None
        target = destination_at(content, i)
        if target is None:
            return None
        destination, i = target
        gap = SPACE.match(content, i).end()
        title = None
        if gap > i and (named := TITLE.match(content, gap)) and "\n\n" not in named[0]:
            title, gap = unescaped(named[1] or named[2] or named[3] or ""), SPACE.match(content, named.end()).end()
        return (destination, title, gap + 1, None) if content.startswith(")", gap) else None

    def reference_target(self, begin: int, at: int) -> tuple | None:
        content, own = self.content, self.content[begin:at]
        label, end = own, at + 1
        if (found := LABEL.match(content, at + 1)) is not None:
            end = found.end()
            if found[1].strip():
                label = found[1]
        if len(label) > 999 or not label.strip() or (label is own and re.search(r"(?<!\\)(?:\\\\)*[\[]", own)):
            return None
        key = label_key(label)
        known = None if self.options.footnotes and key.startswith("^") else self.references.get(key)
        if known is None:
            return None
        known["used"] = True
        return known["destination"], known["title"], end, key

    def emphasise(self, bottom: int) -> None:
        """Pair the delimiter runs above bottom; a floor per sign and length keeps this linear."""
        runs, nodes = self.runs, self.nodes
        if len(runs) <= bottom:
            return
        floor: dict[tuple, int] = {}
        place = {id(node): i for i, node in enumerate(nodes)}
        k = bottom
        while k < len(runs):
            closer = runs[k]
            if not closer.closes or not closer.count:
                k += 1
                continue
            key = (closer.sign, closer.opens, closer.original % 3)
            j, found = k - 1, None
            while j >= max(bottom, floor.get(key, bottom)):
                opener = runs[j]
                if opener.sign == closer.sign and opener.opens and opener.count:
                    odd = closer.sign != "~" and (opener.closes or closer.opens) and (opener.original + closer.original) % 3 == 0 and (opener.original % 3 or closer.original % 3)
                    if not odd:
                        found = j
                        break
                j -= 1
            if found is None:
                floor[key] = k
                k += 1
                continue
            opener = runs[found]
            size = 2 if opener.count >= 2 and closer.count >= 2 else 1
            a, b = place[id(opener.node)], place[id(closer.node)]
            kind = "strikethrough" if closer.sign == "~" else "strong" if size == 2 else "emphasis"
            inside = merged([n for n in nodes[a + 1 : b] if n is not None])
            wrap = Node(kind, opener.node.end - size, closer.node.start + size, children=inside)
            opener.node.text, opener.node.end = opener.node.text[size:], opener.node.end - size
            closer.node.text, closer.node.start = closer.node.text[size:], closer.node.start + size
            opener.count -= size
            closer.count -= size
            for i in range(a + 1, b):
                nodes[i] = None
            if b - a > 1:
                nodes[a + 1] = wrap
            else:
                nodes.insert(b, wrap)
                place = {id(node): i for i, node in enumerate(nodes) if node is not None}
            for between in runs[found + 1 : k]:
                between.count = 0
                between.opens = between.closes = False
            if not closer.count:
                k += 1
        del runs[bottom:]
        self.nodes = [n for n in nodes if n is not None]

    # -- bare links ------------------------------------------------------------------------------------------------

    def trimmed(self, at: int, end: int) -> int:
        content = self.content
        while end > at:
            c = content[end - 1]
            if c in "?!.,:*_~'\"":
                end -= 1
            elif c == ")" and content.count(")", at, end) > content.count("(", at, end):
                end -= 1
            elif c == ";" and (found := re.search(r"&[A-Za-z0-9]+;$", content[at:end])):
                end = at + found.start()
            else:
                break
        return end

    def bare_link(self, at: int, prefix: str) -> int | None:
        content = self.content
        host = HOST.match(content, at if prefix == "www." else at + len(prefix))
        if not host:
            return None
        labels = host[0].split(".")
        if len(labels) < 2 or any("_" in x for x in labels[-2:]):
            return None
        end = re.compile(r"[^\s<]*").match(content, host.end()).end()
        end = self.trimmed(at, end)
        if end < host.end() - 1 or end <= at + len(prefix):
            return None
        label = content[at:end]
        self.nodes.append(Node("autolink", at, end, label, ("http://" if prefix == "www." else "") + label))
        return end

    def mail(self, at: int) -> int:
        last = self.nodes[-1] if self.nodes else None
        local = LOCAL.search(last.text) if last is not None and last.kind == "text" and last.end == at and last.text == self.content[last.start : at] else None
        domain = DOMAIN.match(self.content, at + 1)
        if not local or not domain:
            self.literal(at, at + 1)
            return at + 1
        end = domain.end()
        while self.content[end - 1] in ".":
            end -= 1
        name = self.content[at + 1 : end]
        if name[-1] in "-_" or "." not in name:
            self.literal(at, at + 1)
            return at + 1
        start = at - len(local[0])
        last.text, last.end = last.text[: local.start()], start
        label = self.content[start:end]
        self.nodes.append(Node("autolink", start, end, label, "mailto:" + label))
        return end


def merged(nodes: list[Node]) -> list[Node]:
    """Neighbouring texts joined, empty ones dropped."""
    out: list[Node] = []
    for node in nodes:
        if node is None or (node.kind == "text" and not node.text):
            continue
        if node.kind == "text" and out and out[-1].kind == "text":
            last = out[-1]
            out[-1] = Node("text", last.start, node.end, last.text + node.text)
        else:
            out.append(node)
    return out


def walk(nodes: list[Node]):
    """(node, depth) in document order, without recursion."""
    stack = [(n, 0) for n in reversed(nodes)]
    while stack:
        node, depth = stack.pop()
        yield node, depth
        stack.extend((c, depth + 1) for c in reversed(node.children))


#: Inlines whose text is no text of their document.
UNSHOWN = frozenset(("footnote:reference", "attributes:inline"))


def plain(nodes: list[Node]) -> str:
    return "".join("\n" if n.kind in ("soft-break", "hard-break") else n.text or "" for n, _ in walk(nodes) if not n.children and n.kind not in UNSHOWN)
