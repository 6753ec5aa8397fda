"""Syntax of extensions that keeps state: blocks that begin and go on line by line, and inlines that a function reads.

A block rule looks at the first sign of a line.  Its start() opens a block, with a state of its own, or declines; its
proceed() says for every further line whether the block goes on, ends before the line, or ends with it.  Containers hold
blocks of any kind, other rules' included; leaves hold their lines.  Rules travel to the workers, so their functions are
those of a module.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial


@dataclass(frozen=True)
class LineView:
    """A line below the open containers: its text from the first sign on, its blanks before, and what it stands in."""

    text: str
    indent: int
    paragraph_open: bool
    parent_kind: str
    parent_state: dict


@dataclass(frozen=True)
class Opened:
    """A block with its state; used are the signs of the line that belong to its mark, None for the whole line."""

    state: dict = field(default_factory=dict)
    used: int | None = None


@dataclass(frozen=True)
class Go:
    """The block goes on: after columns of blanks (all of them, if None) and used signs the line is its content."""

    used: int = 0
    columns: int | None = None


#: The line is the block's last.
CLOSE = Go(-1)


@dataclass(frozen=True)
class BlockRule:
    kind: str
    triggers: str
    start: Callable[[LineView], Opened | None]
    proceed: Callable[[LineView, dict], Go | None]
    container: bool = True
    #: The kind that the block stands directly in, if it may not stand anywhere.
    within: str | None = None


@dataclass(frozen=True)
class InlineRule:
    """An inline that begins with one of triggers; parse(content, place) gives (end, text, data) or declines with None."""

    kind: str
    triggers: str
    parse: Callable[[str, int], tuple[int, str, str | None] | None]


# ---- footnotes -------------------------------------------------------------------------------------------------

NOTE = re.compile(r"\[\^([^\s\^\]]{1,128})\]:(?:[ \t]+|$)")
NOTE_USE = re.compile(r"\[\^([^ \t\r\n\f\v^\]]{1,128})\]")


def start_note(line: LineView) -> Opened | None:
    found = None if line.paragraph_open else NOTE.match(line.text)
    return Opened({"label": found[1]}, found.end()) if found else None


def proceed_note(line: LineView, state: dict) -> Go | None:
    return Go() if not line.text or line.indent >= 4 else None


def read_note_use(content: str, at: int) -> tuple[int, str, str | None] | None:
    from inkwell.kernel.inlines import label_key

    found = NOTE_USE.match(content, at)
    return (found.end(), found[1], label_key(found[1])) if found else None


NOTES = BlockRule("footnote:definition", "[", start_note, proceed_note)
NOTE_USES = InlineRule("footnote:reference", "[", read_note_use)


# ---- tabs ------------------------------------------------------------------------------------------------------

GROUP = re.compile(r"(@{1,32})tabs[ \t]*$")
TITLE_BYTES = 256


def start_group(line: LineView) -> Opened | None:
    found = GROUP.match(line.text)
    return Opened({"marker": found[1]}) if found else None


def proceed_group(line: LineView, state: dict) -> Go | None:
    return CLOSE if line.indent <= 3 and line.text.rstrip(" \t") == state["marker"] + "endtabs" else Go(columns=0)


def tab_title(line: LineView, marker: str) -> str | None:
    """The title of a line that begins a tab of the group of that marker: up to 256 bytes, plain or in quotes."""
    found = re.match(re.escape(marker) + r"tab[ \t](.*)", line.text) if line.indent <= 3 else None
    title = found[1].strip(" \t") if found else ""
    if not title or len(title.encode()) > TITLE_BYTES:
        return None
    if title[0] in "\"'":
        if len(title) < 3 or title[-1] != title[0]:
            return None
        title = title[1:-1]
    return None if re.search(r"[\x00-\x1f\x7f]", title) else title


def start_tab(line: LineView) -> Opened | None:
    title = tab_title(line, line.parent_state["marker"])
    return None if title is None else Opened({"title": title})


def proceed_tab(line: LineView, state: dict) -> Go | None:
    return None if tab_title(line, line.parent_state["marker"]) is not None else Go(columns=0)


TABS = (BlockRule("tabs:group", "@", start_group, proceed_group), BlockRule("tabs:item", "@", start_tab, proceed_tab, within="tabs:group"))


# ---- attributes ------------------------------------------------------------------------------------------------

NAME = re.compile(r"[A-Za-z_:][A-Za-z0-9_.:-]*")
SHORT = re.compile(r"[A-Za-z_][A-Za-z0-9_:-]*")
ID = re.compile(r"[A-Za-z_][A-Za-z0-9_.:-]{0,63}")
VALUE = re.compile(r"\"([^\"]*)\"|'([^']*)'|([^ \t\"'{}=<>`]+)")
BLANKS = re.compile(r"[ \t]*")
SHORT_BYTES = 64


@dataclass(frozen=True)
class AttributePolicy:
    """Which attributes a list in braces may set, and how large it may be; event handlers never."""

    allowed: tuple[str, ...] = ("id", "class")
    most: int = 32
    list_bytes: int = 1024
    value_bytes: int = 512

    def __post_init__(self) -> None:
        names = [n.lower() for n in self.allowed]
        if bad := [n for n in names if not NAME.fullmatch(n) or n.startswith("on") or names.count(n) > 1]:
            raise ValueError(f"attributes that can't be allowed: {bad}")


def merged_attributes(own: dict[str, str | bool], more: dict[str, str | bool]) -> dict[str, str | bool]:
    """more over own, but classes add up."""
    out = own | more
    if "class" in own and "class" in more:
        out["class"] = " ".join(dict.fromkeys(f"{own['class']} {more['class']}".split()))
    return out


def read_list(policy: AttributePolicy, content: str, at: int) -> tuple[int, dict[str, str | bool]] | None:
    """The end and the attributes of a list in braces at a place; None if it is none, or too large."""
    if not content.startswith("{", at):
        return None
    i = at + 1 + content.startswith(":", at + 1)
    out: dict[str, str | bool] = {}
    count = 0
    while True:
        i = BLANKS.match(content, i).end()
        if i >= len(content) or i - at > policy.list_bytes:
            return None
        if content[i] == "}":
            return (i + 1, out) if count else None
        count += 1
        if count > policy.most:
            return None
        if content[i] in ".#":
            found = SHORT.match(content, i + 1)
            if found is None or found.end() - found.start() > SHORT_BYTES:
                return None
            name, value, i = ("class" if content[i] == "." else "id"), found[0], found.end()
        else:
            named = NAME.match(content, i)
            equals = BLANKS.match(content, named.end()).end() if named else -1
            if named is None or not content.startswith("=", equals):
                return None
            found = VALUE.match(content, BLANKS.match(content, equals + 1).end())
            if found is None:
                return None
            name, value, i = named[0].lower(), next(x for x in found.groups() if x is not None), found.end()
            if "\n" in value or len(value.encode()) > policy.value_bytes or (name == "id" and name in policy.allowed and not ID.fullmatch(value)):
                return None
        if name in policy.allowed:
            out = merged_attributes(out, {name: True if value == "true" else value})


def whole_list(policy: AttributePolicy, line: str) -> dict[str, str | bool] | None:
    found = read_list(policy, line, 0)
    return found[1] if found and not line[found[0] :].strip(" \t") else None


def start_attributes(policy: AttributePolicy, line: LineView) -> Opened | None:
    return None if whole_list(policy, line.text) is None else Opened({"attributes": line.text.strip(" \t"), "target": "previous"})


def proceed_attributes(policy: AttributePolicy, line: LineView, state: dict) -> Go | None:
    """Further lists join; the list is the next block's if that follows at once, else that of the block before."""
    if line.indent <= 3 and whole_list(policy, line.text) is not None:
        state["attributes"] += "\n" + line.text.strip(" \t")
        return Go()
    state["target"] = "next" if line.text else "previous"
    return None


def read_attributes(policy: AttributePolicy, content: str, at: int) -> tuple[int, str, None] | None:
    found = read_list(policy, content, at)
    return (found[0], content[at : found[0]], None) if found else None


ATTRIBUTES_BLOCK, ATTRIBUTES_INLINE = "attributes:block", "attributes:inline"


def attribute_rules(policy: AttributePolicy) -> tuple[BlockRule, InlineRule]:
    block = BlockRule(ATTRIBUTES_BLOCK, "{", partial(start_attributes, policy), partial(proceed_attributes, policy), container=False)
    return block, InlineRule(ATTRIBUTES_INLINE, "{", partial(read_attributes, policy))
