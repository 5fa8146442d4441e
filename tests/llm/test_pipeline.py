"""The pipeline against a plain version of its stages, and the entry point's queries."""

import hashlib
import re

import __spark_entry__
import corpus_pipeline
import numpy as np
import public_tokenizers as P

from tallyfold.llm import bpe, decontaminate, secrets, similar, simhash
from tallyfold.llm.common import materialize


def repeats(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = {}
    for i in range(len(ws) - 4):
        grams.setdefault(tuple(ws[i : i + 5]), []).append(i)
    return len(ws), len({i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)})


def components(rows):
    label = {r["doc_id"]: r["doc_id"] for r in rows}
    find = lambda x: x if label[x] == x else find(label[x])
    prints = [(r["doc_id"], simhash.fingerprint(r["text"]), similar.shingles(similar.words_of(r["text"]))) for r in rows]
    for i, (a, x, s) in enumerate(prints):
        for b, y, t in prints[:i]:
            if ((x ^ y) & (1 << 64) - 1).bit_count() <= 2 or s and len(s & t) / len(s | t) >= 0.8:
                p, q = sorted((find(a), find(b)))
                label[q] = p
    return {d: find(d) for d in label}


def masked(text, model):
    spans = [(m.start(), m.end()) for m in re.finditer(secrets.ASSIGN, text, re.ASCII) if len(m[2]) >= 6]
    spans += [m.span() for p in (secrets.ACCESS, secrets.HEX) for m in re.finditer(p, text)]
    index = ["", *secrets.SYMBOLS]
    for m in re.finditer(secrets.TOKEN, text):
        low = m[0].lower()
        ratio = sum(model[index.index(a) * len(secrets.SYMBOLS) + secrets.SYMBOLS.index(b)] for a, b in zip(["", *low], low))
        if ratio > secrets.MIN_LLR and not any(s < m.end() and m.start() < e for s, e in spans):
            spans.append(m.span())
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    kept = [r for r in rows if (n := repeats(r["text"]))[0] >= 10 and 100 * n[1] <= 20 * n[0]]
    same = components(kept)
    kept = [r for r in kept if same[r["doc_id"]] == r["doc_id"]]
    items = [(decontaminate.normalise(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    near = lambda text: any(decontaminate.myers(i, text) <= len(i) // 10 for i in items)
    suspects = {r["doc_id"] for r in kept if any(i[k : k + 9] in decontaminate.normalise(r["text"]) for i in items for k in range(0, len(i) - 9, 9))}
    kept = [r for r in kept if not (r["doc_id"] in suspects and near(decontaminate.normalise(r["text"])))]
    model = secrets.train(spark.createDataFrame(kept, docs.schema), samples=secrets.random_strings(spark))
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    want = {}
    for r in kept:
        text = masked(r["text"], model)
        ids = np.asarray(bpe.coder(ranks, P.PATTERN)[0].encode_ordinary(text), dtype="<u4")
        want[r["doc_id"]] = (hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r["doc_id"]: (r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


def test_stages_on_odd_rows(spark, sf_dir):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(None, words, None, None, None), (1, None, "en", "a", None), (2, words + " token=abcdefgh", "en", "a", 9), (2, words + " token=abcdefgh", "en", "a", 9)]
    docs = spark.createDataFrame([(*r, "clash", "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, base string, fp string, `a.b` string")
    for part in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, part, sf_dir)
            assert out.columns == docs.columns
            part = materialize(out)
        corpus_pipeline.STAGES[-1][1](spark, part, sf_dir).collect()


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
