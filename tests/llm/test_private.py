import hashlib
import random
import re

from inkwell.llm import private
from pyspark.sql import functions as F

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def plain(text):
    out = []
    for k, kind in enumerate(PLAIN):
        for m in re.finditer(PLAIN[kind], text or ""):
            number = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0,
                "card": 12 <= len(number) <= 19 and luhn(number),
                "phone": 9 <= len(number) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_plain_patterns(spark):
    rng = random.Random(2)
    bits = ["a.b@c-d.ef", "x@y", "@", "10.0.0.1", "300.1.1.1", "1.2.3.4.5.6.7.8", "001.02.255.0", "4111 1111 1111 1111", "4111111111111111", "+1 (790) 555-2115",
            "+49-30-1234567", "é\U0001f600", " ", "  ", "-", ".", "5", "12", "\n", "%", "word", "+", "(", "a@b.c%d@e.f", "0" * 25]
    texts = ["".join(rng.choices(bits, k=rng.randrange(14))) for _ in range(1500)] + [None, "", "1 " * 4000, "a@b.cd " * 700, "9" * 5000, "x" * 20000 + "@"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "again")], "doc_id long, text string, base string")
    got = private.searched(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert [(s.at, s.kind, s.stop) for s in r.base] == plain(texts[r.doc_id]), texts[r.doc_id]


def test_query_adds_secrets_and_leaves_clean_texts(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = private.op5_private(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = r.spans.split(",") if r.spans else []
        text = texts[r.doc_id]
        secrets = {f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', text)}
        assert secrets == {s for s in spans if s.startswith("secret")}
        base = [f"{private.KINDS[k]}:{a}:{b}" for a, k, b in plain(text)]
        assert [s for s in spans if not s.startswith("secret")] == base


def test_query_counts_and_hashes_base_spans(spark, tmp_path):
    texts = ["a@b.co c@d.ef", "10.0.0.1 4111111111111111 a@b.co", "+1 (790) 555-2115", "call +4930123456 1.2.3.4 5.6.7.8", None, "1.2.3.400 none"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = private.op5_private(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)], texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{private.BASE[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()


def test_votes_decide(spark):
    lines = ['api_key = "sk-Ab3xY9' + "q7Z" * 6 + '"', "Call me on the phone: (415) 555-0134 today", "write jane.doe [at] example [dot] org", "IBAN: DE89 3704 0044 0532 0130 00",
             "my SSN 123-45-6789 is", "the checksum sha1: 7777777777777777777777777", "averyveryverylongwordwithoutdigits"]
    df = spark.createDataFrame(list(enumerate(lines * 20)), "doc_id long, text string")
    got = {r.doc_id: [private.KINDS[s.kind] for s in r.spans] for r in private.personal(df).collect()}
    assert [got[i] for i in range(7)] == [["secret"], ["phone"], ["email"], ["iban"], ["ssn"], [], []]
    text = {r.doc_id: r.masked for r in private.masked(df).collect()}
    assert text[0] == 'api_key = "[SECRET]"' and text[1].endswith("[PHONE] today") and text[6] == lines[6]


def test_masks_base_spans(spark):
    df = spark.createDataFrame([(1, "a@b.co x 4111111111111111, 4111111111111112 +1 (790) 555-2115 é 10.0.0.1", "m"), (2, None, "m"), (3, "", "m")], "doc_id long, text string, masked string")
    got = {r[0]: r[1] for r in private.masked(df).select("doc_id", "masked").collect()}
    assert got == {1: "[EMAIL] x [CARD], 4111111111111112 [PHONE] é [IP]", 2: None, 3: ""}
    assert private.masked(df.limit(0)).count() == 0


def test_running_sums(spark):
    row = spark.range(1).select(private.running(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda x: x.cast("long"))).alias("s")).first()
    assert row.s == [i * (i + 1) // 2 for i in range(1, 1001)]


def test_reliabilities_find_the_bad_labeler():
    rng = random.Random(0)
    counts, truth = {}, {}
    for _ in range(4000):
        y = rng.random() < 0.4
        v = [(1 if y else -1) * (1 if rng.random() < q else -1) for q in (0.95, 0.9, 0.85, 0.5)]
        p = 4
        for x in v:
            p = p * 3 + x + 1
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, []).append(y)
    likely = private.reliabilities(counts)
    right = sum((likely[p] > 0.5) == y for p, ys in truth.items() for y in ys)
    assert right / 4000 > 0.95
