"""Personal data by weak supervision, as SQL expressions only.

Base spans (email, ip, card, phone) come from fixed patterns with checks.  Further spans are candidates of wide patterns
on which four labelers vote for, against or not at all: a strict pattern, a gazetteer, the words around, and the shape.
Candidates with the same kind and votes are one pattern; the corpus is reduced to counts of patterns (at most
KINDS x 3^4 rows), on which expectation-maximisation estimates how reliable each labeler is and how likely each pattern
is personal.  A logistic classifier over kinds and votes is fitted to these soft labels, and its accepted patterns (again
a bounded list) decide about the spans of every text in native expressions.

Places are code points.  The places of many matches come from sums in two levels, so a text with m matches costs about
m * sqrt(m), never m * m copies.

Defined cases: null text is empty; without candidates nothing is added; a candidate that touches a base span is left
out; repeated rows are searched each; other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import cut, cut_table, let, named, table

KINDS = ("email", "ip", "card", "phone", "secret", "iban", "ssn")
BASE = KINDS[:4]
# The base patterns.  Loops are possessive, which matches the same and needs no stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}
# Wide candidate patterns, one alternative a kind.
CANDIDATES = (
    r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+"
    r"|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?![A-Za-z0-9])"
    r"|(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
    r"|(?<![0-9+])(?<!\+[0-9]{1,3}[\x20.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"
    r"|[A-Za-z0-9._-]{2,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{2,64}+\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z]{2,10}"
)
# Gazetteers.
KEY_PREFIXES = "^(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|pk_live_|xox[abp]-|AIza|eyJ)"
COUNTRIES = "^(?:AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK)"
DOMAINS = "(?i)[\\])]\\x20?(?:com|org|net|edu|gov|io|de|fr|es|uk|eu)$"
CUES = {
    "secret": "token|secret|password|passwd|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|bearer|credential",
    "iban": "iban|account|konto|cuenta|compte|bank",
    "ssn": "ssn|social security|taxpayer",
    "phone": "phone|tel|call|mobile|cell|fax|telefon|tél|tfno|contact",
    "email": "mail|contact|write|reach",
}
AGAINST = "(?i)(?:isbn|issn|doi|version|build|commit|sha-?[0-9]*|md5|checksum|digest|page|figure|order|invoice|article|part no|https?:|www\\.)[^.]{0,24}$"
AROUND = 48


def running(values: Column, larger: bool = False) -> Column:
    """Sums (or with larger, maxima) of the first 1, 2, … items of an array of longs, in blocks."""
    size = 64
    both = (lambda a, x: F.greatest(a, x)) if larger else (lambda a, x: a + x)
    add = lambda items: F.aggregate(items, F.lit(0).cast("long"), both)

    def blocks(v: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda b: add(F.slice(v, b * size + 1, size)))
        before = let(sums, lambda s: F.transform(s, lambda _, i: add(F.slice(s, F.lit(1), i))))
        return let(before, lambda b: F.transform(v, lambda _, i: both(F.get(b, F.floor(i / size).cast("int")), add(F.slice(v, F.floor(i / size).cast("int") * size + 1, i % size + 1)))))

    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(blocks(v)))


def matches(text: Column, pattern: str) -> Column:
    """(hit, at, before, after) of all matches in order: the match, its code point, and the text next to it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(parts: Column, hits: Column) -> Column:
        gaps = F.transform(hits, lambda _, i: (F.length(F.get(parts, i)) + F.coalesce(F.length(F.get(hits, i - 1)), F.lit(0))).cast("long"))
        around = lambda h, i: [F.right(F.get(parts, i), F.lit(AROUND)).alias("before"), F.left(F.get(parts, i + 1), F.lit(AROUND)).alias("after")]
        return let(running(gaps), lambda at: F.transform(hits, lambda h, i: F.struct(h.alias("hit"), F.get(at, i).alias("at"), *around(h, i))))

    return let(F.split(text, pattern, -1), lambda parts: let(found, lambda hits: placed(parts, hits)))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]++", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(number))
    value = lambda i: F.substring(number, -i, F.lit(1)).cast("int") * (2 - i % 2)
    total = F.aggregate(places, F.lit(0), lambda a, i: a + let(value(i), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return total % 10 == 0


def holds(kind: str, hit: Column) -> Column:
    """The check on a base match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|)"
        return hit.rlike(f"^(?:{part}\\.){{3}}{part}$")
    if kind == "card":
        return let(digits(hit), lambda d: F.length(d).between(12, 19) & luhn(d))
    return F.length(digits(hit)).between(9, 15)


def may_hold(kind: str, text: Column) -> Column:
    """A cheap test that text may have a match of the kind."""
    quick = {"email": text.contains("@"), "phone": text.contains("+")}
    return quick.get(kind, text.rlike(PATTERNS.get(kind, CANDIDATES)))


SPAN = "array<struct<at:bigint,kind:int,stop:bigint>>"


def base_spans(text: Column) -> Column:
    """All base spans (at, kind number, stop), sorted."""

    def of(number: int, kind: str) -> Column:
        good = F.filter(matches(text, PATTERNS[kind]), lambda m: holds(kind, m["hit"]))
        spans = F.transform(good, lambda m: F.struct(m["at"].alias("at"), F.lit(number).alias("kind"), (m["at"] + F.length(m["hit"])).alias("stop")))
        return F.when(may_hold(kind, text), spans).otherwise(F.array().cast(SPAN))

    return F.sort_array(F.concat(*[of(i, k) for i, k in enumerate(BASE)]))


def candidate_kind(hit: Column) -> Column:
    return (
        F.when(hit.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(hit.rlike("^\\(?[0-9]{3}\\)?[\\x20.-][0-9]{3}[.-][0-9]{4}$"), "phone")
        .when(hit.rlike("[\\[(](?:at|AT)[\\])]"), "email")
        .when(hit.rlike("^[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){3,7}$"), "iban")
        .otherwise("secret")
    )


def votes(kind: Column, hit: Column, before: Column) -> list[Column]:
    """-1, 0 or 1 of each labeler: strict pattern, gazetteer, context, shape."""
    say = lambda good, bad=None: F.when(good, 1).when(F.lit(False) if bad is None else bad, -1).otherwise(0)
    share = F.length(digits(hit)) * 100 / F.length(hit)
    by_kind = lambda cases: reduce(lambda c, k: c.when(kind == k, cases[k]), list(cases)[1:], F.when(kind == next(iter(cases)), next(iter(cases.values())))).otherwise(0)
    strict = {
        "secret": say(hit.rlike("(?i)^[0-9a-f]{32,}$") | hit.rlike("^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_+/=-]{20,}$"), ~hit.rlike("[0-9]")),
        "iban": say(F.length(F.replace(hit, F.lit(" "))).between(15, 34)),
        "ssn": say(~hit.rlike("^(?:000|666|9)") & ~hit.rlike("-00-|-0000$"), hit.rlike("^(?:000|666|9)|-00-|-0000$")),
        "phone": say(hit.rlike("^\\(?[2-9]"), hit.rlike("^\\(?[01]")),
        "email": F.lit(1),
    }
    gazetteer = {"secret": say(hit.rlike(KEY_PREFIXES)), "iban": say(hit.rlike(COUNTRIES), ~hit.rlike(COUNTRIES)), "email": say(hit.rlike(DOMAINS))}
    context = {k: say(before.rlike(f"(?i)(?:{cue})[^A-Za-z0-9]{{0,8}}(?:[a-z]+[^A-Za-z0-9]{{1,4}}){{0,2}}$"), before.rlike(AGAINST)) for k, cue in CUES.items()}
    shape = {"secret": say((share >= 10) & (share <= 90), (share < 5) | (share > 90)), "phone": say(hit.rlike("[(.-]")), "ssn": F.lit(0)}
    return [by_kind(x).cast("int") for x in (strict, gazetteer, context, shape)]


def candidates(text: Column) -> Column:
    """(at, kind number, stop, hit, pattern): pattern numbers the kind and the votes."""

    def scored(m: Column) -> Column:
        def number(kind: Column) -> Column:
            index = F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int") - 1
            pattern = reduce(lambda p, v: p * 3 + v + 1, votes(kind, m["hit"], m["before"]), index)
            return F.struct(m["at"].alias("at"), index.alias("kind"), (m["at"] + F.length(m["hit"])).alias("stop"), m["hit"].alias("hit"), pattern.alias("pattern"))

        return let(candidate_kind(m["hit"]), number)

    empty = F.array().cast("array<struct<at:bigint,kind:int,stop:bigint,hit:string,pattern:int>>")
    return F.when(may_hold("candidate", text), F.transform(matches(text, CANDIDATES), scored)).otherwise(empty)


def pattern_parts(pattern: int) -> tuple[int, list[int]]:
    out = []
    for _ in range(4):
        out.append(pattern % 3 - 1)
        pattern //= 3
    return pattern, out[::-1]


def reliabilities(counts: dict[int, int], rounds: int = 30, prior: float = 8.0) -> dict[int, float]:
    """How likely each pattern is personal, by expectation-maximisation over labelers that err independently.

    Each labeler starts as better than chance, with the weight of prior votes.
    """
    parts = {p: pattern_parts(p)[1] for p in counts}
    likely = {p: 1 / (1 + math.exp(-1.5 * sum(v))) for p, v in parts.items()}
    start = {1: {1: 0.6, 0: 0.3, -1: 0.1}, 0: {1: 0.1, 0: 0.3, -1: 0.6}}
    for _ in range(rounds):
        mass = {1: prior, 0: prior}
        said = [{y: {v: prior * start[y][v] for v in (-1, 0, 1)} for y in (0, 1)} for _ in range(4)]
        share = {1: prior, 0: prior}
        for p, n in counts.items():
            for y, w in ((1, likely[p] * n), (0, (1 - likely[p]) * n)):
                share[y] += w
                mass[y] += w
                for k, v in enumerate(parts[p]):
                    said[k][y][v] += w
        for p, own in parts.items():
            score = math.log(share[1] / share[0])
            for k, v in enumerate(own):
                score += math.log(said[k][1][v] / mass[1]) - math.log(said[k][0][v] / mass[0])
            likely[p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, score))))
    return likely


def classifier(counts: dict[int, int], likely: dict[int, float], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> list[int]:
    """Patterns that a logistic model over kind and votes, fitted to the soft labels, takes for personal."""
    width = len(KINDS) + 12
    total = sum(counts.values()) or 1

    def features(p: int) -> list[int]:
        kind, own = pattern_parts(p)
        return [kind, *(len(KINDS) + 3 * k + v + 1 for k, v in enumerate(own))]

    rows = [(features(p), n / total, likely[p]) for p, n in sorted(counts.items())]
    weight = [0.0] * width
    for _ in range(rounds):
        slope = [decay * w for w in weight]
        for index, n, y in rows:
            wrong = n * (1 / (1 + math.exp(-sum(weight[i] for i in index))) - y)
            for i in index:
                slope[i] += wrong
        weight = [w - rate * s for w, s in zip(weight, slope, strict=True)]
    return [p for (index, _, _), p in zip(rows, sorted(counts), strict=True) if sum(weight[i] for i in index) > 0]


def accepted(found: DataFrame) -> list[int]:
    """Accepted patterns, from all candidates of the corpus: the counts have KINDS x 81 rows at most."""
    rows = found.select(F.explode("candidates.pattern").alias("p")).groupBy("p").count().collect()
    counts = {r[0]: r[1] for r in rows}
    return classifier(counts, reliabilities(counts))


def apart(base: Column, extra: Column) -> Column:
    """The extra spans that touch no base span."""
    return F.filter(extra, lambda c: ~F.exists(base, lambda b: (b["at"] < c["stop"]) & (c["at"] < b["stop"])))


def all_spans(base: Column, found: Column, patterns: list[int]) -> Column:
    """Base and accepted extra spans, sorted by place and kind."""
    keep = F.array(*map(F.lit, patterns)) if patterns else F.array().cast("array<int>")
    taken = F.filter(found, lambda c: F.array_contains(keep, c["pattern"]))
    extra = F.transform(let(F.struct(base.alias("b"), taken.alias("c")), lambda x: apart(x["b"], x["c"])), lambda c: F.struct(c["at"].alias("at"), c["kind"].alias("kind"), c["stop"].alias("stop")))
    return F.sort_array(F.concat(base, extra))


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["at"], s["stop"])), ",")


def searched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base, candidates) per row of docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col), base_spans(text).alias("base"), candidates(text).alias("candidates"))


def personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base, spans) per row of docs."""
    found = cut(searched(docs, id_col, text_col))
    return found.select(id_col, "base", all_spans(F.col("base"), F.col("candidates"), accepted(found)).alias("spans"))


RANGE = "array<struct<at:bigint,stop:bigint,kind:int>>"


def united(spans: Column) -> Column:
    """Sorted spans with those that overlap made one, of the kind of the first."""

    def ranges(s: Column, reach: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["at"] >= F.get(reach, i - 1)))
        stop = lambda own, k: F.get(reach, F.coalesce(F.get(own, k + 1), F.size(s)) - 1)
        return let(starts, lambda own: F.transform(own, lambda i, k: F.struct(F.get(s, i)["at"].alias("at"), stop(own, k).alias("stop"), F.get(s, i)["kind"].alias("kind"))))

    whole = let(spans, lambda s: let(running(F.transform(s, lambda x: x["stop"]), larger=True), lambda reach: ranges(s, reach)))
    return F.when(F.size(spans) == 0, F.array().cast(RANGE)).otherwise(whole)


def covered(text: Column, ranges: Column) -> Column:
    """text with a placeholder for each range; parts are cut out in two levels, so m ranges cost about sqrt(m) passes."""
    names = F.array(*(F.lit(PLACEHOLDER[k]) for k in KINDS))
    step = F.ceil(F.sqrt(F.size(ranges))).cast("int")

    def block(b: Column, size: Column) -> Column:
        own = F.slice(ranges, b * size + 1, size)
        begin = F.when(b == 0, F.lit(0).cast("long")).otherwise(F.get(ranges, b * size - 1)["stop"])

        def parts(r: Column, base: Column) -> Column:
            stop = F.element_at(r, -1)["stop"]
            piece = lambda x, i, t: F.concat(t.substr((F.coalesce(F.get(r, i - 1)["stop"], base) - base + 1).cast("int"), (x["at"] - F.coalesce(F.get(r, i - 1)["stop"], base)).cast("int")), F.get(names, x["kind"]))
            return let(text.substr((base + 1).cast("int"), (stop - base).cast("int")), lambda t: F.array_join(F.transform(r, lambda x, i: piece(x, i, t)), ""))

        return let(own, lambda r: let(begin, lambda base: parts(r, base)))

    blocks = let(step, lambda size: F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(ranges) - 1) / size).cast("int")), lambda b: block(b, size)), ""))
    tail = text.substr((F.element_at(ranges, -1)["stop"] + 1).cast("int"), F.length(text))
    return F.when(F.size(ranges) == 0, text).otherwise(F.concat(blocks, tail))


def masked(docs: DataFrame, text_col: str = "text", out_col: str = "masked") -> DataFrame:
    """docs with out_col, the text with a placeholder for every stretch of personal spans; null stays null.

    The spans are those of personal(): texts are searched once, and the rows wait with their spans for the classifier.
    """
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    found = F.struct(base_spans(text).alias("base"), candidates(text).alias("candidates"))
    rows = cut_table(docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], F.explode_outer(F.array(found)).alias("found")))
    patterns = accepted(rows.select("found.candidates"))
    spans = united(all_spans(F.col("found.base"), F.col("found.candidates"), patterns))
    text = F.col(f"c{docs.columns.index(text_col)}").cast("string")
    new = F.when(F.size("found.base") + F.size("found.candidates") == 0, text).otherwise(let(spans, lambda r: covered(text, r)))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() != out_col.lower()], new.alias(out_col))


def op5_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # A lambda of two parameters would be given the item's place as the second.
    count = lambda number: F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


QUERIES = {"op5_private": op5_private}
