import math

import numpy as np
import pytest
from inkwell.llm import languages
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = languages.op9_languages(spark, SF).where("held_out")
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    right = got.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert right[0] >= 0.98 and 0 <= right[1] and right[2] <= 1


def test_mixtures_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 1500")
    names, probability = languages.model(languages.counted(docs))
    pick = {r.lang: r.text[:1500] for r in docs.collect()}
    texts = [pick["en"], pick["en"] + " " + pick["de"], None, "", "12 !? 3", "a", pick["fr"]]
    share = languages.proportions(texts, probability)
    assert (share[0] > 0).sum() == 1 and share[0].max() > 0.999
    both = {names[k] for k in np.nonzero(share[1] > 0.2)[0]}
    assert both == {"en", "de"}
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    rows = sorted(languages.identified(df, names, probability).collect())
    assert [r.lang_pred for r in rows][2:5] == ["und"] * 3 and [r.score for r in rows][2:5] == [0.0] * 3
    assert rows[5].lang_pred in names and rows[6].lang_pred == "fr"


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    names, probability = languages.model(languages.counted(df))
    assert [tuple(r)[:3] for r in languages.identified(df, names, probability).collect()] == [(1, "und", 0.0)]


def test_maximised_is_a_likelihood_maximum():
    rng = np.random.default_rng(0)
    likely, count = rng.random((40, 3)), rng.integers(1, 5, 40).astype(float)
    share, best = languages.maximised(likely, count, np.array([0]), np.full((1, 3), 1 / 3), 500)
    for _ in range(200):
        other = rng.dirichlet(np.ones(3))
        assert (count * np.log(likely @ other)).sum() <= best[0] + 1e-6


def test_sets_of_more_than_four_languages():
    """A text that mixes six languages evenly keeps all six."""
    rng = np.random.default_rng(1)
    words = [["".join(rng.choice(list(letters), 6)) for _ in range(40)] for letters in ("abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx", "yzäö")]
    texts = [" ".join(rng.choice(own, 400)) for own in words]
    counts = np.full((7, languages.BUCKETS), languages.SMOOTHING)
    for k, text in enumerate(texts):
        _, bucket, n = languages.trigrams([text])
        counts[k, bucket] += n
    share = languages.proportions([" ".join(texts[:6]), texts[2]], counts / counts.sum(axis=1, keepdims=True))
    assert (share[0][:6] > 0.1).all() and share[0][6] < 0.01 and abs(share[0].sum() - 1) < 1e-6
    assert (share[1] > 0).sum() == 1 and share[1][2] > 0.999


def plain(text, model):
    """Shares of the best language set of one text: expectation-maximisation trigram by trigram, then nested sets by penalised likelihood."""
    _, bucket, count = languages.trigrams([text])
    grams = list(zip(bucket.tolist(), count.tolist(), strict=True))
    total = sum(n for _, n in grams)

    def climbed(share, rounds):
        for _ in range(rounds):
            new = dict.fromkeys(share, 0.0)
            for b, n in grams:
                joint = {k: s * model[k][b] for k, s in share.items()}
                for k, x in joint.items():
                    new[k] += n * x / sum(joint.values())
            share = {k: x / total for k, x in new.items()}
        return share, sum(n * math.log(sum(s * model[k][b] for k, s in share.items())) for b, n in grams)

    full, _ = climbed({k: 1 / len(model) for k in range(len(model))}, languages.ROUNDS)
    order = sorted(full, key=lambda k: (-full[k], k))
    best = None
    for k in range(1, len(model) + 1):
        start = {x: full[x] + 1e-6 for x in order[:k]}
        share, fit = climbed({x: v / sum(start.values()) for x, v in start.items()}, languages.ROUNDS // 3 if k > 1 else 0)
        fit -= languages.PENALTY * (k - 1) * math.log(max(total, 2)) / 2
        if best is None or fit > best[0]:
            best = fit, share
    return best[1]


def test_proportions_match_a_plain_mixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 300")
    names, probability = languages.model(languages.counted(docs))
    rows = docs.orderBy("doc_id").limit(40).collect()
    texts = [r.text[:300] for r in rows] + [f"{a.text[:200]} {b.text[:150]}" for a, b in zip(rows[:20], rows[20:], strict=True)]
    got = languages.proportions(texts, probability)
    for text, own in zip(texts, got, strict=True):
        want = plain(text, probability)
        assert np.allclose(own, [want.get(k, 0.0) for k in range(len(names))], atol=1e-6)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50).withColumn("lang_pred", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("id", F.lit(0))
    names, probability = languages.model(languages.counted(docs))
    assert languages.identified(docs, names, probability).count() == 50
    assert languages.identified(docs.limit(0), names, probability).count() == 0
    assert languages.model(languages.counted(docs.limit(0)))[0] == []


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(languages, "MOST_LANGUAGES", 1)
    docs = spark.createDataFrame([("abc", "x"), ("def", "y")], "text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        languages.model(languages.counted(docs))
