"""Operator 7 against the library itself and through round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

from tallyfold.llm import bpe

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


def whole(text):
    encoding, _ = bpe.coder(RANKS, P.PATTERN)
    return encoding.encode_ordinary(text)


def test_pieces_keep_tokens(monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 7)
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice("ab1' \n\t.é\u00a0\u2028\x1c's") for _ in range(rng.randrange(60)))
        assert list(bpe.encode(text, RANKS, P.PATTERN)) == whole(text)
        assert bpe.decode(bpe.encode(text, RANKS, P.PATTERN), RANKS, P.PATTERN) == text.encode()


def test_long_stretch_without_blanks():
    text = "ab" * 150_000
    assert bpe.decode(bpe.encode(text, RANKS, P.PATTERN), RANKS, P.PATTERN) == text.encode()


def test_tokenize(spark):
    texts = [None, "", "hello <|endoftext|> world", "naïve café  \n\n x", "word " * 40_000]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] * 2, "doc_id long, text string, n_tokens string")
    rows = rows.withColumns({"coded": F.lit("own"), "_bpe": F.lit("own")})
    for r in bpe.tokenize(rows, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).collect():
        assert r["coded"] == r["_bpe"] == "own"
        ids, text = np.asarray(whole(texts[r["doc_id"]] or ""), dtype="<u4"), (texts[r["doc_id"]] or "").encode()
        assert (r["n_tokens"], r["ids_sha256"], r["ids"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), ids.tolist())
        assert r["decoded_sha256"] == hashlib.sha256(text).hexdigest()
    assert bpe.tokenize(rows.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
