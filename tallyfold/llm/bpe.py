"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The rank file is read once by the driver and sent as a broadcast of at most ``MAX_RANK_BYTES``. Long texts are cut at
places where a blank follows something else: no match of the pattern can span such a place, and what follows it cannot
change a match before it, so the pieces' tokens in a row are the text's tokens.

Null texts count as empty: no tokens. Texts are encoded whole; special tokens are ordinary text. Repeated rows are
encoded one by one. Lone surrogates cannot occur in Spark's strings.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import free_name, python_ready

MAX_RANK_BYTES = 64 << 20
#: Texts are cut into pieces of about so many characters where that is safe.
PIECE = 1 << 16
SAFE = re.compile(r"(?<=\S)(?=[ \n])")


@lru_cache(maxsize=2)
def coder(ranks: bytes, pattern: str):
    """The encoding and the bytes of each token id."""
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    by_id = {rank: token for token, rank in table.items()}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={}), by_id


def pieces(text: str) -> Iterator[str]:
    """The text in order, cut at safe places only; a stretch without any stays whole."""
    start = 0
    while len(text) - start > PIECE:
        cut = SAFE.search(text, start + PIECE)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str, ranks: bytes, pattern: str) -> np.ndarray:
    encoding, _ = coder(ranks, pattern)
    if len(text) <= PIECE:
        return np.asarray(encoding.encode_ordinary(text), dtype="<u4")
    return np.concatenate([np.asarray(encoding.encode_ordinary(p), dtype="<u4") for p in pieces(text)])


def decode(ids: np.ndarray, ranks: bytes, pattern: str) -> bytes:
    """The raw bytes of the ids, in order; they need not be valid UTF-8."""
    _, by_id = coder(ranks, pattern)
    return b"".join(map(by_id.__getitem__, ids.tolist()))


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, read on the driver."""
    data = Path(path).read_bytes()
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} has {len(data)} bytes; at most {MAX_RANK_BYTES} are sent to executors")
    return data


def tokenize(docs: DataFrame, path: str, pattern: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Add ``n_tokens, ids_sha256, decoded_sha256`` and, on request, ``ids`` (array of int). Same-named columns are replaced.

    ``ids_sha256`` is over the ids as little-endian unsigned 32-bit integers, ``decoded_sha256`` over the bytes that decoding
    gives back.
    """
    spark = docs.sparkSession
    python_ready(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                ids = encode(t or "", ranks.value, pattern)
                row = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decode(ids, ranks.value, pattern)).hexdigest())
                rows.append((*row, ids.astype("int32")) if with_ids else row)
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    coded = free_name(docs, "coded")
    out = docs.withColumn(coded, run(F.col(text)))
    return out.withColumns({f.split()[0]: F.col(coded)[f.split()[0]] for f in schema.split(", ")}).drop(coded)
