"""Line-first quality rules, as SQL expressions only.

Every line with a word is judged on its own: symbols, navigation, boilerplate, shouting, and punctuation.  Lines that
fail go; a document goes when its lost lines held more than LOST of its words, when it has fewer than LEAST_WORDS
words, or when more than REPEATED of its words lie in three-word windows that the text holds twice.

Repeated windows are found inside the row: windows are hashed and sorted with their places as one array of longs, and
only windows whose hash prefix meets another's are compared word by word, so a text of n words costs n log n.

Defined cases: null text has no words and is rejected; lines without a word are neither judged nor counted but stay in
cleaned text; very long texts are judged whole, in one row; a document exactly at a threshold is kept; repeated rows are
judged each; other columns pass through, but for one of the result's own name, which is replaced; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import fresh, let, named, table

LEAST_WORDS = 50
#: Share of words (of 100) in repeated three-word windows above which a document fails.
REPEATED = 50
#: Share of words (of 100) in failed lines above which a document is rejected.
LOST = 50
SYMBOLS = "#*$%&|<>"
SEPARATOR = "[\\x20](?:[|»›·•→/]|&gt;|::)[\\x20]"
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
# Phrases of licence, legal and site notices.
BOILERPLATE = (
    "all rights reserved", "licensed under", "public license", "creative commons", "terms of (?:use|service)", "privacy policy", "cookie policy",
    "use of cookies", "accept cookies", "sign (?:in|up) (?:to|for)", "log in to", "subscribe to", "click here", "read more", "share (?:this|on)",
    "enable javascript", "lorem ipsum", "copyright (?:\\(c\\)|©|[0-9]{4})", "powered by", "follow us on", "skip to content", "back to top",
)
#: A place in a packed hash; the bits above hold the hash.
PLACE_BITS = 28


def words_of(text: Column) -> Column:
    """Words of a text, null as an empty text."""
    trimmed = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK)))


def repeated_words(words: Column, size: int = 3) -> Column:
    """How many of words lie in windows of size words that occur twice or more; words is named often, so bind it first."""

    def window(i: Column) -> list[Column]:
        return [F.get(words, i + k) for k in range(size)]

    def packed(i: Column) -> Column:
        return F.shiftleft(F.xxhash64(*window(i)), PLACE_BITS).bitwiseOR(i.cast("long"))

    def meets(items: Column, same) -> Column:
        return F.filter(items, lambda x, i: F.coalesce(same(x, F.get(items, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(items, i + 1)), F.lit(False)))

    def covered(places: Column) -> Column:
        each = F.transform(places, lambda p, i: F.least(F.lit(size), F.coalesce(F.get(places, i + 1) - p, F.lit(size))).cast("long"))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    def exact(likely: Column) -> Column:
        place = lambda p: p.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
        rows = F.sort_array(F.transform(likely, lambda p: let(place(p), lambda i: F.struct(F.array(*window(i)).alias("w"), i.alias("i")))))
        found = let(rows, lambda r: meets(r, lambda a, b: a["w"] == b["w"]))
        return let(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

    hashes = let(
        F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - size), packed)),
        lambda h: meets(h, lambda a, b: F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS)),
    )
    likely = let(hashes, lambda c: F.when(F.size(c) == 0, F.lit(0).cast("long")).otherwise(exact(c)))
    return F.when(F.size(words) < size, F.lit(0).cast("long")).otherwise(likely)


def line_fails(line: Column) -> Column:
    """Whether a line that has a word fails a rule."""
    return let(F.regexp_count(line, F.lit(f"{WORD}++")), lambda words: _fails(line, words))


def _fails(line: Column, words: Column) -> Column:
    many = lambda pattern: F.length(F.regexp_replace(line, pattern, ""))
    symbols = (F.length(line) - F.length(F.translate(line, SYMBOLS, ""))) * 20 > F.length(line)
    navigation = F.regexp_count(line, F.lit(SEPARATOR)) * 4 >= F.greatest(words, F.lit(4))
    boilerplate = (words <= 40) & line.rlike("(?i)\\b(?:" + "|".join(BOILERPLATE) + ")\\b")
    upper, letters = many("[^\\p{Lu}]++"), many("[^\\p{L}]++")
    # Where most letters are capitals, two of them follow each other among the letters; few lines have that to count.
    capitals = line.rlike("\\p{Lu}[^\\p{L}]*+\\p{Lu}") & (letters >= 20) & (upper * 2 > letters)
    shouting = capitals | (F.regexp_count(line, F.lit("!!+")) * 3 > words)
    ends = line.rlike("[.!?…:;。！？][\"'”’»)\\]]*[\\x20\\x09-\\x0D]*$")
    punctuation = ~ends & ((words < 10) | ~line.rlike("[.!?…:;,。]"))
    return symbols | navigation | boilerplate | shouting | punctuation


def judged(docs: DataFrame, text_col: str = "text", out_col: str = "quality") -> DataFrame:
    """docs with the struct out_col: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words, base_failed, kept, cleaned."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.split(text, "\n")

    def measures(words: Column) -> Column:
        chars = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w))
        return F.struct(F.size(words).cast("long").alias("n_words"), chars.alias("word_chars"), repeated_words(words).alias("n_repeat_words"))

    def line_measures(lines: Column) -> Column:
        worded = F.filter(lines, lambda x: x.rlike(WORD))
        judged_lines = F.transform(lines, lambda x: F.struct(x.alias("line"), F.when(x.rlike(WORD), line_fails(x)).otherwise(False).alias("fails")))

        def verdicts(marked: Column) -> Column:
            gone = F.filter(marked, lambda m: m["fails"])
            lost = F.aggregate(gone, F.lit(0).cast("long"), lambda a, m: a + F.regexp_count(m["line"], F.lit(f"{WORD}++")))
            left = F.array_join(F.transform(F.filter(marked, lambda m: ~m["fails"]), lambda m: m["line"]), "\n")
            return F.struct(lost.alias("lost_words"), left.alias("cleaned"))

        doubled = let(worded, lambda w: (F.size(w) - F.size(F.array_distinct(w))).cast("long"))
        return F.struct(doubled.alias("n_dup_lines"), let(judged_lines, verdicts).alias("v"))

    symbols = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")
    both = let(F.struct(let(words_of(F.col(text_col)), measures).alias("m"), let(lines, line_measures).alias("l"), symbols.alias("n_symbols")), _verdict)
    # One generator of one row, so that no filter or projection above computes the struct anew.
    return docs.select(*[named(c) for c in docs.columns if c.lower() != out_col.lower()], F.explode_outer(F.array(both)).alias(out_col))


def cleaned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, with their text cleaned of failed lines, and the columns of docs."""
    own = fresh(docs.columns, "quality")
    kept = judged(docs, text_col, own).where(named(own)["kept"])
    return kept.select(*[named(own)["cleaned"].alias(c) if c == text_col else named(c) for c in docs.columns])


def _verdict(x: Column) -> Column:
    m, lines = x["m"], x["l"]
    failed = (m["n_words"] < LEAST_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * REPEATED)
    kept = ~failed & (lines["v"]["lost_words"] * 100 <= m["n_words"] * LOST)
    return F.struct(
        m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), x["n_symbols"].alias("n_symbols"), lines["n_dup_lines"].alias("n_dup_lines"),
        m["n_repeat_words"].alias("n_repeat_words"), lines["v"]["lost_words"].alias("lost_words"), failed.alias("base_failed"), kept.alias("kept"), lines["v"]["cleaned"].alias("cleaned"),
    )


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[F.col("quality")[c].alias(c) for c in COLUMNS])


# The same rules over rows of lines and windows.
ORACLE = {
    "op6_quality": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
grams AS (SELECT doc_id, i, words[i] || chr(0) || words[i + 1] || chr(0) || words[i + 2] AS g
          FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
l AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT doc_id, line, n,
        (length(line) - length(translate(line, '{SYMBOLS}', ''))) * 20 > length(line)
        OR len(regexp_extract_all(line, '[ ](?:[|»›·•→/]|&gt;|::)[ ]')) * 4 >= greatest(n, 4)
        OR (n <= 40 AND regexp_matches(line, '(?i)\b(?:{"|".join(BOILERPLATE)})\b'))
        OR (length(regexp_replace(line, '[^\p{{L}}]+', '', 'g')) >= 20
            AND length(regexp_replace(line, '[^\p{{Lu}}]+', '', 'g')) * 2 > length(regexp_replace(line, '[^\p{{L}}]+', '', 'g')))
        OR len(regexp_extract_all(line, '!!+')) * 3 > n
        OR (NOT regexp_matches(line, '[.!?…:;。！？]["''”’»)\]]*[\x20\x09-\x0D]*$') AND (n < 10 OR NOT regexp_matches(line, '[.!?…:;,。]'))) AS fails
      FROM l),
per AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, coalesce(sum(n) FILTER (fails), 0) AS lost FROM f GROUP BY 1)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  len(words) < {LEAST_WORDS} OR coalesce(rep.n, 0) * 100 > len(words) * {REPEATED} AS base_failed,
  NOT (len(words) < {LEAST_WORDS} OR coalesce(rep.n, 0) * 100 > len(words) * {REPEATED}) AND coalesce(lost, 0) * 100 <= len(words) * {LOST} AS kept
FROM w LEFT JOIN per USING (doc_id) LEFT JOIN rep USING (doc_id)
""",
}

QUERIES = {"op6_quality": op6_quality}
