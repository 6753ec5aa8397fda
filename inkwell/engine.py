"""Composition: a profile with extensions, which give grammar rules, renderers, lint rules, formatter passes and metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from inkwell import format as formatting
from inkwell import lint, patches, stats
from inkwell.kernel.render import BlockView, Decorator, Plan, Plugins, Policy
from inkwell.kernel.rules import BlockRule, InlineRule
from inkwell.parse import blocks, inlines, kept, parse
from inkwell.sanitize import md_to_html
from inkwell.views import KINDS

#: Signs that inline rules can't begin with, since the grammar itself does.
RESERVED = "\r\n*_[]!"


@dataclass(frozen=True)
class Extension:
    """What an extension adds; kinds that it names must be new, and its renderers may only be for kinds that exist."""

    name: str
    inline_rules: tuple[tuple[str, str, str], ...] = ()
    line_rules: tuple[tuple[str, str], ...] = ()
    container_rules: tuple[tuple[str, str, str], ...] = ()
    block_rules: tuple[BlockRule, ...] = ()
    inline_parsers: tuple[InlineRule, ...] = ()
    options: dict[str, object] = field(default_factory=dict)
    renderers: dict[str, Callable[[str, dict], str]] = field(default_factory=dict)
    printers: dict[str, Callable[[str, dict], str]] = field(default_factory=dict)
    decorators: tuple[Decorator, ...] = ()
    plans: tuple[Callable[[list[BlockView]], Plan], ...] = ()
    defaults: dict[str, dict[str, str]] = field(default_factory=dict)
    transforms: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    rules: tuple[lint.Rule, ...] = ()
    passes: tuple[Callable[[lint.Tables], DataFrame], ...] = ()
    metrics: dict[str, Column] = field(default_factory=dict)

    def kinds(self) -> tuple[str, ...]:
        return (*(r[0] for r in (*self.inline_rules, *self.line_rules, *self.container_rules)), *(r.kind for r in (*self.block_rules, *self.inline_parsers)))


@dataclass(frozen=True)
class Engine:
    """A profile and its extensions; with_extension() gives a new engine."""

    profile: str = "github"
    extensions: tuple[Extension, ...] = ()

    def with_extension(self, *more: Extension) -> Engine:
        every = (*self.extensions, *more)
        names = [e.name for e in every]
        kinds = [*KINDS, *(k for e in every for k in e.kinds())]
        for what, own in (("extension", names), ("node kind", kinds), ("lint rule", [*lint.RULES, *(r.id for e in every for r in e.rules)])):
            if twice := sorted({x for x in own if own.count(x) > 1}):
                raise ValueError(f"duplicate {what} {twice}")
        if bad := [k for e in more for k, pattern, _ in e.inline_rules if pattern.lstrip("\\")[:1] in RESERVED]:
            raise ValueError(f"inline rules begin with a reserved sign: {bad}")
        if bad := [r.kind for e in more for r in e.inline_parsers if not r.triggers or set(r.triggers) & set(RESERVED)]:
            raise ValueError(f"inline parsers begin with a reserved sign, or with none: {bad}")
        return Engine(self.profile, every)

    def syntax(self) -> dict:
        rules = {name: sum((getattr(e, name) for e in self.extensions), ()) for name in ("inline_rules", "line_rules", "container_rules", "block_rules", "inline_parsers")}
        return rules | {k: v for e in self.extensions for k, v in e.options.items()}

    def plugins(self) -> Plugins:
        merged = lambda name: {k: v for e in self.extensions for k, v in getattr(e, name).items()}
        return Plugins(merged("renderers"), merged("printers"), sum((e.decorators for e in self.extensions), ()), sum((e.plans for e in self.extensions), ()), merged("defaults"))

    def parse(self, documents: DataFrame, **more) -> DataFrame:
        for transform in (t for e in self.extensions for t in e.transforms):
            documents = documents.transform(transform)
        return parse(documents, self.profile, **self.syntax(), **more)

    def html(self, source: Column, policy: Policy | None = None) -> Column:
        return md_to_html(self.profile, policy, self.plugins(), **self.syntax())(source)

    def check(self, parsed: DataFrame, config: lint.Config | None = None) -> DataFrame:
        config = config or lint.Config.recommended()
        for rule in (r for e in self.extensions for r in e.rules):
            config = config.with_rule(rule)
        return lint.check(parsed, config)

    def format(self, documents: DataFrame) -> DataFrame:
        parsed = kept(self.parse(documents))
        return patches.apply(documents, formatting.format_patches(parsed, extra=sum((e.passes for e in self.extensions), ())))

    def statistics(self, parsed: DataFrame) -> DataFrame:
        return stats.statistics(parsed, blocks(parsed), inlines(parsed), **{f"{e.name}_{k}": v for e in self.extensions for k, v in e.metrics.items()})


__all__ = ["Engine", "Extension", "RESERVED"]
