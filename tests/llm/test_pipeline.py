import re
from collections import Counter

import corpus_pipeline
import duckdb
from inkwell.llm import packing, quality
from test_packing import PATH, library
from test_private import plain as private_spans
from test_simhash import near_groups
from test_substrings import brute as passages

SF = "/root/testdata/sf0.001"


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(stage(spark, steps[-1], SF).cache())
        assert steps[-1].columns == columns
    texts = [{r.doc_id: r.text for r in s.collect()} for s in steps]
    assert all(r.n_chars == len(r.text) for r in steps[4].collect())

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    kept = {r[0] for r in con.sql(f"select doc_id from ({quality.ORACLE['op6_quality']}) where kept").fetchall()}
    assert set(texts[1]) == kept and 0 < len(kept) < len(texts[0])
    for i, text in texts[1].items():
        own = texts[0][i].split("\n")
        assert not Counter(text.split("\n")) - Counter(own)

    groups = near_groups(texts[1])  # five-word Jaccard similarity of 0.8 or more, by all pairs
    assert len(set(groups.values())) < len(set(texts[1].values()))
    assert set(texts[2]) == set(groups.values()) and all(texts[2][i] == texts[1][i] for i in texts[2])

    want = passages(list(texts[2].items()))
    for i, (n, gone, _) in want.items():
        left = len(re.findall(r"[^\x20\x09-\x0D]+", texts[3].get(i, "")))
        assert left == n - gone
        assert (i in texts[3]) == (n > gone)
        if not gone:
            assert texts[3][i] == texts[2][i]

    for i, text in texts[3].items():
        assert not private_spans(texts[4][i])
        if not private_spans(text) and "token" not in text.lower():
            assert texts[4][i] == text

    pieces = corpus_pipeline.STAGES[-1][1](spark, steps[4], SF).collect()
    ids = dict(zip(texts[4], library(list(texts[4].values())), strict=True))
    assert Counter((r.doc_id, r.start, r.length) for r in pieces) == Counter((i, *p) for i, own in ids.items() for p in packing.pieces_of([*own, 0]))
    assert packing.CAPACITY >= max(r.offset + r.length for r in pieces) and PATH


def test_odd_tables(spark):
    rows = [(1, "few words", None, None, 9), (1, "few words", None, None, 9), (None, None, "x", "y", None), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, "")
            assert out.count() <= table.count()
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 3


def test_clashing_columns_and_repeated_ids(spark):
    """Users' columns named as the stages' own, or with a dot, come through; rows of one id are told apart by their text."""
    good = lambda k: "\n".join(f"Fox {k}-{j} " + " ".join(f"w{k}x{j}x{n}" for n in range(12)) + ", and so on." for j in range(8))
    mail = good(3) + "\nPlease write to the editor at jane.roe@example.com or call +1 555 123 4567 before the end of this week."
    rows = [(i, t, "mine", 7, "dot", 1, "k") for i, t in [(1, good(1)), (2, good(2)), (5, good(1)), (5, good(4)), (6, mail), (6, mail), (None, good(9)), (8, None)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string, _text int, `a.b` string, found int, kept_text string")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "").cache()
        assert kept.columns == docs.columns
        assert {tuple(r)[2:] for r in kept.collect()} == {("mine", 7, "dot", 1, "k")}
    got = {r.doc_id: r.text for r in kept.collect()}
    assert set(got) == {1, 2, 5, 6, None} and kept.count() == 5
    assert "4-0" in got[5] and "[EMAIL]" in got[6] and "jane" not in got[6] and "[PHONE]" in got[6] and "555" not in got[6]
    assert corpus_pipeline.STAGES[-1][1](spark, kept, "").count() == 5


def test_overlapping_spans_are_masked_together(spark):
    from inkwell.llm import private

    texts = ["+1 555 123 4567@x.com", "a +1 10.20.30.40 55 b", None, "", "x@y.zz" + " 10.0.0.1 é\U0001f600 x@y.zz" * 200, "no data at all"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in private.personal(df).collect()}
    got = {r.doc_id: r.masked for r in private.masked(df).collect()}
    for i, text in enumerate(texts):
        want, at = "", 0
        if text is None:
            assert got[i] is None
            continue
        united = []
        for s in spans[i]:
            if united and s.at < united[-1][1]:
                united[-1][1] = max(united[-1][1], s.stop)
            else:
                united.append([s.at, s.stop, s.kind])
        for a, b, k in united:
            want += text[at:a] + private.PLACEHOLDER[private.KINDS[k]]
            at = b
        assert got[i] == want + text[at:]
