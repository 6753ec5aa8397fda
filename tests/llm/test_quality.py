import random
import re
from collections import Counter

import duckdb
from inkwell.llm import quality


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def rows():
    rng = random.Random(5)
    vocab = ["a", "b", "c", "Dé", "ee.", "#x", "日本", "\U0001f600"]
    texts = ["".join(w + rng.choice([" ", "  ", "\n", "\t", "\x0b", "\xa0"]) for w in rng.choices(vocab, k=rng.choice([0, 1, 2, 3, 60, 400]))) for _ in range(120)]
    return [*texts, None, "", "\n\n", " x ", "y " * 3000]


def test_base_measures(spark):
    data = [(i, t, "clash") for i, t in enumerate(rows())]
    df = spark.createDataFrame([*data, data[7]], "doc_id long, text string, n_words string")
    got = quality.judged(df).collect()
    assert len(got) == len(data) + 1
    for r in got:
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == base(r.text)
        assert not (q.base_failed and q.kept)
    assert quality.judged(df.limit(0)).count() == 0


def test_lines_go_first(spark):
    rng = random.Random(1)
    clean = "\n".join(" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(15)) + "." for _ in range(5))
    texts = [
        clean,
        clean + "\nAll rights reserved.\nHome | News | About | Contact | Login",
        "\n".join(" | ".join(f"w{i}x{j}" for j in range(15)) for i in range(5)),
        "\n".join(" ".join(f"w{i}x{j}***" for j in range(15)) + "." for i in range(5)),
        clean.upper(),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.quality for r in quality.judged(df).collect()}
    assert [got[i].kept for i in range(5)] == [True, True, False, False, False]
    assert got[0].cleaned == got[1].cleaned == clean


def test_sql_says_the_same(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(rows())), "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(quality.ORACLE["op6_quality"]).fetchall())
    assert sorted(map(tuple, quality.op6_quality(spark, str(tmp_path)).collect())) == want
