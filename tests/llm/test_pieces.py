import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import sentencepiece
from inkwell.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def want(text):
    return LIBRARY.encode(text or "", add_bos=True, add_eos=True)


def test_equals_the_library():
    rng = random.Random(0)
    alphabet = list("abcdeinorst  \n\t▁.,é日本\U0001f600\xa0ßᄀ\x00<s>0x41") + ["the ", "ing", "  ", "aaaa"]
    texts = ["", " ", "▁", "  a", "<s>", "<0x0A>", "ﬁ", "a" * 5000, " " * 100, "▁▁x ▁", None]
    texts += ["".join(rng.choices(alphabet, k=rng.randrange(80))) for _ in range(3000)]
    texts += pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    for text, got in zip(texts, pieces.pieces(PATH).encode(texts), strict=True):
        assert got.tolist() == want(text), text
        assert pieces.pieces(PATH).decode(got) == LIBRARY.decode(want(text))


def test_steps_back():
    """Words whose longest first piece is not what merging gives."""
    model = pieces.pieces(PATH)
    rng = random.Random(1)
    keys = list(model.ids)
    for _ in range(4000):
        text = "".join(rng.choices(keys, k=3)).lstrip("▁").replace("▁", "")
        if text and all(c in model.ids for c in text):
            assert [model.model.id_to_piece(i) for i in model.segment(text)] == pieces.merged(text, model.ids, model.score)


def test_query_columns(spark):
    rows = [(1, "Grüße\n an  alle", 3), (1, "Grüße\n an  alle", 3), (2, None, 4), (None, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    for r in pieces.digests(df, PATH).collect():
        text = {1: rows[0][1]}.get(r.doc_id)
        ids = want(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    assert [r.ids for r in pieces.encoded(df.where("doc_id = 2"), PATH).collect()] == [[1, 2]]
    assert pieces.digests(df.limit(0), PATH).count() == 0
