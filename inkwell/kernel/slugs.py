"""Anchors of headings."""

from __future__ import annotations

import re

DROPPED = re.compile(r"[^\w -]+|_")


def slug_base(fold: str) -> str:
    """The anchor of a folded, trimmed title: letters, numbers, hyphens; runs of blanks become a hyphen."""
    return re.sub(" +", "-", DROPPED.sub("", fold))


class Slugs:
    """Unique slugs of one document: the base, or the base with the least free number."""

    def __init__(self) -> None:
        self.used: set[str] = set()
        self.tried: dict[str, int] = {}

    def next(self, base: str) -> str:
        n, slug = self.tried.get(base, 0), base
        while (slug if n == 0 else f"{base}-{n}") in self.used:
            n += 1  # names are never given back, so no number below is free later
        slug = base if n == 0 else f"{base}-{n}"
        self.tried[base] = n
        self.used.add(slug)
        return slug
