"""Links of similar texts against brute force."""

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tallyfold.llm import similar, simhash


def near_copies(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    line = " ".join(word() for _ in range(12))
    texts = [None, "", "one two", "One  two", line]
    for size in (8, 30, 60, 120):
        for _ in range(6):
            centre = [word() for _ in range(size)] + line.split()
            for k in range(12):
                copy = list(centre)
                for _ in range(rng.randrange(1 + size // 20)):
                    copy[rng.randrange(size)] = word()
                texts.append(" ".join(copy))
    return texts


def test_near_duplicates_stage_links_what_brute_force_links(spark, monkeypatch):
    rng = random.Random(7)
    texts = near_copies(rng)
    label = list(range(len(texts)))
    find = lambda i: i if label[i] == i else find(label[i])
    fps = [simhash.fingerprint(t) for t in texts]
    wider = 0
    for i in range(len(texts)):
        for j in range(i):
            bits, x, y = ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count(), *(similar.shingles(similar.words_of(t)) for t in (texts[i], texts[j]))
            near = bool(x) and len(x & y) / len(x | y) >= 0.8
            wider += near and bits > 2
            if near or bits <= 2:
                label[max(find(i), find(j))] = min(find(i), find(j))
    assert wider > 100  # which two bits alone leave unlinked
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(5)
    want = sorted({find(i) for i in range(len(texts))})
    for common in (similar.MAX_COMMON, 0):
        monkeypatch.setattr(similar, "MAX_COMMON", common)
        kept = corpus_pipeline.near_duplicates(spark, docs, "")
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == want


def test_copies_and_bounds(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(3))
    texts = [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    texts += [" ".join([*t.split()[: rng.randrange(1, 60)], word()]) for t in texts] + texts[:9] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    rows = simhash.sketched(docs, (np.zeros(0, "<u8"), np.zeros(0, np.int64)))
    shared = similar.shared_prefixes(rows, rows.select("key", F.col("key").alias("root")).distinct())
    found = shared.collect()
    assert len({(r["token"], r["key"]) for r in found}) == len(found)  # copies stand once
    keys = {r["id"]: r["key"] for r in rows.collect()}
    sets = {keys[i]: similar.shingles(similar.words_of(t)) for i, t in enumerate(texts)}
    pairs = {(a, b) for a in sets for b in sets if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    met = similar.met(shared.where("root <> first"), shared).select(F.least("key", "key_").alias("a"), F.greatest("key", "key_").alias("b")).distinct()
    left = {(r["a"], r["b"]) for r in similar.near(met, rows).collect()}
    assert pairs and pairs <= left <= {(r["a"], r["b"]) for r in met.collect()}


def test_pairs_that_all_rounds_miss_are_compared_at_the_end(spark, monkeypatch):
    monkeypatch.setattr(similar, "ROUNDS", ())
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([*base[: 100 - k], *[f"x{k}y{j}" for j in range(k)]]) for k in range(0, 12, 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.keep_one(docs, similar_too=True).collect()] == [0]


def test_parity_bits_bound_what_only_one_text_has(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(1100)]
    texts = [" ".join(base[:n]) for n in (5, 60, 70, 130, 510, 520, 1000, 1040)] + [" ".join(rng.sample(base, n)) for n in (60, 70, 1000, 1040)]
    found = [similar.hashes(similar.words_of(t)) for t in texts]
    rows = [(i, len(f), similar.parity(f).tolist()) for i, f in enumerate(found)]
    a = spark.createDataFrame(rows, "i int, n int, bits array<long>")
    both = a.join(a.select(*[F.col(c).alias(f"{c}_") for c in a.columns]), (F.col("i") < F.col("i_")) & (F.col("n_") <= 1.25 * F.col("n")) & (F.col("n") <= 1.25 * F.col("n_")))
    got = {(r["i"], r["i_"]): (r["d"], r["n"] + r["n_"]) for r in both.select("i", "i_", "n", "n_", similar.apart().alias("d")).collect()}
    assert {len(r[2]) for r in rows} == {1, 2, 8, 16, 32} and len(got) > 10
    assert all(d <= len(set(found[i].tolist()) ^ set(found[j].tolist())) for (i, j), (d, _) in got.items())
    assert all(9 * d > total for (i, j), (d, total) in got.items() if j > 7)  # shuffled texts are sorted out at every length


def test_marks_only_add_rows_to_look_at(spark, monkeypatch):
    rows = [(i if i % 9 else None, i // 2, i) for i in range(4000)]
    table = spark.createDataFrame(rows, "id long, key long, row long")
    wanted = {r for r in rows if r[2] % 5 == 0}
    for bits, most in ((simhash.MARKS, 0.03), (1 << 12, 0.4), (64, 1.0)):
        monkeypatch.setattr(simhash, "MARKS", bits)
        got = simhash.with_mark(table, table.where("row % 5 = 0").select("id", "key")).collect()
        assert len(got) == len(rows) and all(r["mark"] for r in got if (r["id"], r["key"], r["row"]) in wanted)
        others = [r["mark"] for r in got if r["row"] % 5 and not (r["id"] is None and r["row"] % 2)]
        assert sum(others) <= most * len(others) + 1


def test_repeated_rows_and_null_ids_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, "a b c", "x")] * 3 + [(None, long, "y")] * 2 + [(7, "a b c", "z"), (8, None, "n"), (8, None, "n"), (9, "d e f g", "k"), (10, long + " end", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string").repartition(4)
    for too in (False, True):
        got = sorted((r["doc_id"] or 0, r["mark"]) for r in simhash.keep_one(docs, similar_too=too).collect())
        assert got == [(0, "y")] * (not too) + [(1, "x"), (8, "n"), (9, "k"), (10, "m")]
    assert simhash.keep_one(docs.limit(0), similar_too=True).count() == 0


def test_texts_that_no_link_joins_make_no_rows_of_pairs(spark, monkeypatch):
    """Texts just below the threshold share their first shingles: their pairs are compared in tasks, not as rows."""
    rng = random.Random(5)
    centre = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(300):
        copy = list(centre)
        for place in rng.sample(range(0, 150, 10), 1 + k % 5):
            copy[place] = f"x{k}y{place}"
        texts.append(" ".join(copy))
    sets = [similar.shingles(similar.words_of(t)) for t in texts]
    fps = [simhash.fingerprint(t) for t in texts]
    label = list(range(len(texts)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) or ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 2:
                label[max(find(i), find(j))] = min(find(i), find(j))
    want = sorted({find(i) for i in range(len(texts))})
    made = {"met": 0, "nearest": 0}

    def counted(name):
        real = getattr(similar, name, None)

        def run(*args):
            out = real(*args)
            made[name] = max(made[name], out.count())
            return out

        monkeypatch.setattr(similar, name, run, raising=False)

    counted("met")
    counted("nearest")
    monkeypatch.setattr(similar, "ROUNDS", ())
    monkeypatch.setattr(similar, "BLOCK", 32, raising=False)
    monkeypatch.setattr(similar, "NEAREST", 2, raising=False)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs, similar_too=True).select("doc_id").collect()) == want
    assert len(want) > 20 and made["met"] + made["nearest"] < 100 * len(texts), made
