"""Edits of one document in the order they were recorded, also where they overlap.

A later edit that covers an earlier one takes its place.  Where edits overlapped, the smallest block around them is
parsed again with the edits in it and written anew in the common style, since what it held is no longer what its bytes
were; all other bytes stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

from inkwell.kernel.blocks import Block, BlockParser, Options
from inkwell.kernel.render import Normaliser, Plugins, Policy

EOL = re.compile(r"\r\n|\r|\n")
#: Blocks that are only written as part of the block around them.
PARTS = frozenset(("list-item", "description", "description-term"))

Patch = tuple[int, int, bytes]


class Stale(ValueError):
    """An edit of something that an earlier edit has replaced."""


def clusters(patches: list[Patch]) -> list[list[Patch]]:
    """Patches by place, those that overlap together, each cluster in recorded order."""
    out: list[list[tuple[int, Patch]]] = []
    reach = -1
    for k, p in sorted(enumerate(dict.fromkeys(patches)), key=lambda x: (x[1][0], x[1][1] > x[1][0], x[0])):
        if out and p[0] < reach:
            out[-1].append((k, p))
        else:
            out.append([(k, p)])
        reach = max(reach, p[1])
    return [[p for _, p in sorted(c)] for c in out]


def superseded(cluster: list[Patch]) -> list[Patch]:
    """What is left of overlapping patches, by place; raises where one changes what an earlier one has replaced in part."""
    live: list[Patch] = []
    for p in cluster:
        met = [q for q in live if q[0] < p[1] and p[0] < q[1]]
        if any(not (p[0] <= q[0] and q[1] <= p[1]) for q in met):
            raise Stale(f"an edit at {p[0]} to {p[1]} meets a part of an earlier one")
        live = [q for q in live if q not in met and not (p[0] < p[1] and p[0] < q[0] < p[1])] + [p]
    return sorted(live, key=lambda q: (q[0], q[1] > q[0]))


def applied(source: bytes, patches: list[Patch]) -> bytes:
    out, at = [], 0
    for start, end, replacement in patches:
        out += [source[at:start], replacement]
        at = end
    return b"".join([*out, source[at:]])


class Document:
    """A parsed source with blocks by byte; the text has a code point for every byte that is no UTF-8."""

    def __init__(self, source: bytes, options: Options):
        self.original = source.decode("utf-8", "surrogateescape")
        self.page = Normaliser(self.original.replace("\0", "�"), options, Policy(), Plugins())

        self.bytes: list[int] | None = None
        if not self.original.isascii():
            self.bytes = [0, *accumulate(1 if c < 0x80 or 0xDC80 <= c <= 0xDCFF else 2 if c < 0x800 else 3 if c < 0x10000 else 4 for c in map(ord, self.original))]

    def place(self, i: int) -> int:
        return i if self.bytes is None else self.bytes[i]

    def point(self, i: int) -> int:
        return i if self.bytes is None else bisect_left(self.bytes, i)

    def path_to(self, start: int, end: int) -> list[int]:
        """Sibling numbers down to the smallest block around a stretch of code points; none for the root."""
        path: list[int] = []
        block = self.page.root
        while True:
            k = next((k for k, c in enumerate(block.children) if c.start <= start and end <= c.end and c.start < c.end), None)
            if k is None or start == end:
                break
            path.append(k)
            block = block.children[k]
        while path and self.at(path).kind in PARTS:
            path.pop()
        return path

    def at(self, path: list[int]) -> Block:
        block = self.page.root
        for k in path:
            block = block.children[k]
        return block


def prefix_of(document: Document, path: list[int]) -> str:
    """What stands before the further lines of a block: the signs of the containers around it."""
    out, block = "", document.page.root
    for k in path:
        if block.kind in ("block-quote", "github:alert"):
            out += "> "
        elif block.kind in ("list-item", "description"):
            out += " " * block.data["width"]
        block = block.children[k]
    return out


def eol_of(text: str, fallback: str) -> str:
    found = EOL.findall(text)
    return (found[-1] if text.endswith(("\r", "\n")) else found[0]) if found else fallback


def dominant(text: str) -> str:
    found = EOL.findall(text)
    return max(("\n", "\r\n", "\r"), key=found.count)


def lowered(source: bytes, patches: list[Patch], options: Options) -> tuple[bytes, list[tuple[str, int, int]]]:
    """The source with its patches, and (kind, start, end) of what was written anew: "ancestor" or "root", in bytes of the source."""
    if any(not 0 <= s <= e <= len(source) for s, e, _ in patches):
        raise ValueError("a patch lies outside of its document")
    groups = clusters(patches)
    live = [superseded(c) if len(c) > 1 else c for c in groups]
    every = [p for own in live for p in own]
    new_source = applied(source, every)
    mixed = [(min(p[0] for p in c), max(p[1] for p in c)) for c in groups if len(c) > 1]
    if not mixed:
        return new_source, []
    before, after = Document(source, options), Document(new_source, options)
    paths = [before.path_to(before.point(a), before.point(b)) for a, b in mixed]
    while True:
        paths = [p for k, p in enumerate(paths) if not any(p[: len(q)] == q and (len(q) < len(p) or j < k) for j, q in enumerate(paths) if j != k)]
        if [] in paths:
            return whole(before, after), [("root", 0, len(source))]
        written, failed = [], None
        for path in paths:
            made = rewritten(before, after, path, every)
            if made is None:
                failed = path
                break
            written.append(made)
        if failed is None:
            break
        paths = [p[:-1] if p is failed else p for p in paths]
    text = new_source
    for start, end, own, _ in sorted(written, reverse=True):
        text = text[:start] + own + text[end:]
    return text, [("ancestor", *at) for *_, at in sorted(written)]


def whole(before: Document, after: Document) -> bytes:
    own = after.page.render().replace("\n", dominant(before.original))
    bom = "﻿" if before.original.startswith("﻿") else ""
    return (bom + own.removeprefix("﻿")).encode("utf-8", "surrogateescape")


def rewritten(before: Document, after: Document, path: list[int], patches: list[Patch]) -> tuple[int, int, bytes, tuple[int, int]] | None:
    """(start, end, bytes) in the new source of a block of the old one, written anew; None if the edits changed what is around it."""
    block = before.at(path)
    if block.kind in PARTS:
        return None
    start, end = before.place(block.start), before.place(block.end)
    moved = sum(len(r) - (e - s) for s, e, r in patches if e <= start and s < start)
    grown = sum(len(r) - (e - s) for s, e, r in patches if start <= s and e <= end)
    first, last = start + moved, end + moved + grown
    a, b = after.point(first), after.point(last)
    try:
        parent = after.at(path[:-1])
    except IndexError:
        return None
    if parent.kind != before.at(path[:-1]).kind:
        return None
    inside = [c for c in parent.children if a <= c.start < b]
    if any(c.start < a < c.end for c in parent.children) or (inside and len(after.original[b : inside[-1].end].strip(" \t\r\n"))):
        return None
    old = before.original[block.start : block.end]
    eol = eol_of(old, dominant(before.original))
    prefix = prefix_of(after, path)
    lines = after.page.joined(inside, parent.data.get("loose", True))
    own = eol.join([*lines[:1], *((prefix + x).rstrip(" ") if not x else prefix + x for x in lines[1:])])
    if old.endswith(("\r", "\n")) and own and not own.endswith(eol):
        own += eol
    return first, last, own.encode("utf-8", "surrogateescape"), (start, end)
