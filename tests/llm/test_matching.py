"""Operators 3 and 6 against brute force and on odd input."""

import random

import numpy as np
from pyspark.sql import functions as F

from tallyfold.llm import decontaminate, simhash


def slow_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(1)
    for _ in range(500):
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randrange(n))) for n in (20, 40))
        assert decontaminate.myers(a, b) == slow_distance(a, b)


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            del text[at]
        elif kind == 1:
            text.insert(at, rng.choice("abcdef "))
        else:
            text[at] = rng.choice("abcdef ")
    return "".join(text)


def test_items_are_found_within_their_budget(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(rng.randrange(2, 40))) for i in range(40)] + [(90, None), (91, ""), (92, "?!"), (93, "abc de"), (94, "Abc, DE"), (None, "x")]
    texts = [None, "", "x abc-de y", "xabc de y"]
    for i, (_, item) in enumerate(items[:40] * 3):
        texts.append(prose(rng.randrange(60)) + " " + edited(rng, item, rng.randrange(0, max(1, len(item) // 6))) + " " + prose(i % 30))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, matches string")
    got = {r["doc_id"]: {m["item_id"]: m["distance"] for m in r["matches"]} for r in decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    known = decontaminate.Items([(i, t) for i, t in items if t and i is not None])
    for d, text in enumerate(texts):
        body = decontaminate.normalise(text or "")
        want = {}
        for n, item in enumerate(known.texts):
            distance = (0 if b" " + item + b" " in b" " + body + b" " else 99) if len(item) < 8 else slow_distance(item, body) if body else 99
            if distance <= len(item) // 10:
                want |= dict.fromkeys(known.ids[n], distance)
        assert got[d] == want, (d, text)
    assert got[2] == {93: 0, 94: 0}
    clean = decontaminate.clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {d for d in got if not got[d]}
    assert decontaminate.clean(docs, spark.createDataFrame([], "item_id long, text string")).count() == len(texts)


def test_short_items_have_their_whole_budget():
    rng = random.Random(9)
    found = 0
    for m in range(8, 42):
        for _ in range(25):
            item = "".join(rng.choice("abcdef") for _ in range(m)).encode()
            near = item.decode()
            for _ in range(rng.randrange(m // 10 + 2)):
                near = edited(rng, near, 1)
            texts = [decontaminate.normalise(x + near + y) for x, y in (("xyz ", " zyx"), ("", ""), ("zz", "yy"))]
            got = decontaminate.Items([(1, item.decode())]).search(texts)
            want = [slow_distance(item, t) for t in texts]
            assert got == [{0: d} if d <= m // 10 else {} for d in want], (item, texts)
            found += want[0] == m // 10 > 0
    assert found > 200


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    items = spark.createDataFrame([(i, f"benchmark item number {i} here") for i in range(9)], "item_id long, text string")
    rows = [(0, "so: Benchmark item number 3 here", 1), (1, "nothing", 2), (2, None, 3), (3, "so: Benchmark item number 3 here", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, checksum long")
    assert len(decontaminate.blocks(items, "item_id", "text")) > 1
    found = decontaminate.matches(docs, items)
    assert found.columns == [*docs.columns, "matches"]
    got = {r["doc_id"]: [m["item_id"] for m in r["matches"] if m["distance"] == 0] for r in found.collect()}
    assert got == {0: [3], 1: [], 2: [], 3: [3]}
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect()) == [1, 2]


def brute_components(ids, fps):
    label = list(range(len(ids)))
    find = lambda x: x if label[x] == x else find(label[x])
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                label[find(i)] = find(j)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(ids))]


def test_fingerprint_is_the_majority_of_spark_hashes(spark):
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 4, 50):
        ws = [rng.choice(["Aé", "b", "ccc", "D"]) for _ in range(n)]
        low = [w.replace("A", "a").replace("D", "d") for w in ws]
        shingles = [" ".join(low[i : i + 3]) for i in range(max(1, n - 2))] if n else []
        hashes = [r[0] & (1 << 64) - 1 for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint("\t" + "  ".join(ws) + "\n") & (1 << 64) - 1 == want


def clustered(rng, n):
    centres = [rng.getrandbits(64) for _ in range(n // 10)]
    fps = []
    for _ in range(n):
        fp = rng.choice(centres)
        for _ in range(rng.choice((0, 0, 1, 2, 3, 5, 20))):
            fp ^= 1 << rng.randrange(64)
        fps.append(fp)
    return fps


def signed(fp):
    return fp - (1 << 64) if fp >> 63 else fp


def test_links_of_trees_join_what_brute_force_joins(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 50)
    monkeypatch.setattr(simhash, "BLOCK", 20)
    rng = random.Random(5)
    fps = clustered(rng, 900)
    ids = [None if i % 50 == 0 else i for i in range(len(fps))]
    rows = spark.createDataFrame([(d, signed(f)) for d, f in zip(ids, fps)], "doc_id long, fp long")
    want = {signed(f): c for f, c in zip(fps, brute_components(ids, fps))}
    assert {r["fp"]: r["component_id"] for r in simhash.classes(rows).collect()} == want
    monkeypatch.setattr(simhash, "SHARD", 60)  # shards get trees of their own, several deep
    monkeypatch.setattr(simhash, "MAX_LEAVES", 4)
    monkeypatch.setattr(simhash, "OWN_LEAVES", 3)
    monkeypatch.setattr(simhash, "OWN_SAMPLE", 40)
    depths, place = [], simhash.place
    monkeypatch.setattr(simhash, "place", lambda placed, by_leaf: depths.append(len(by_leaf)) or place(placed, by_leaf))
    assert {r["fp"]: r["component_id"] for r in simhash.classes(rows).collect()} == want
    assert len(depths) > 2


def test_one_tight_ball(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(6)
    splits = []
    monkeypatch.setattr(simhash, "choose_split", lambda points: splits.append(len(points)))  # nothing separates the ball
    fps = list({sum(1 << rng.randrange(64) for _ in range(4)) & (1 << 64) - 1 for _ in range(400)})
    a, b = simhash.links(np.unique(np.array(fps, dtype="<u8")))
    ids = {f: i for i, f in enumerate(sorted(fps))}
    label = dict(zip(ids, brute_components(list(ids.values()), list(ids))))
    for x, y in zip(a.tolist(), b.tolist()):
        assert label[x] == label[y]
    rows = spark.createDataFrame([(ids[f], signed(f)) for f in fps], "doc_id long, fp long")
    want = {signed(f): c for f, c in label.items()}
    assert splits and {r["fp"]: r["component_id"] for r in simhash.classes(rows).collect()} == want
    monkeypatch.setattr(simhash, "LEAF", 50)
    monkeypatch.setattr(simhash, "build", lambda points, leaf: [])
    assert {r["fp"]: r["component_id"] for r in simhash.classes(rows).collect()} == want


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(5, text, "a"), (3, text, "b"), (3, text, "b"), (9, text + " x", "c"), (1, None, "d"), (2, "", "e"), (None, "lonely words stand here", "f"), (None, "others stand over there now", "g"), (7, "others stand over there now", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = simhash.keep_one(docs)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fp"]) for r in kept.collect())
    assert kept.columns == docs.columns
    linked = (simhash.fingerprint(text) ^ simhash.fingerprint(text + " x")).bit_count() <= 2
    assert got == sorted([(-1, "f"), (1, "d"), (3, "b"), (7, "g")] + ([] if linked else [(9, "c")]))
    assert simhash.keep_one(docs.limit(0)).count() == 0 and simhash.components(docs.limit(0)).count() == 0


def test_an_item_cut_at_its_start_is_found_after_short_texts():
    rng = random.Random(8)
    item = decontaminate.normalise(" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(33)))
    known = decontaminate.Items([(1, item.decode())])
    cut = item[len(item) // 10 :]
    alone = known.search([cut])
    assert alone == [{0: int(known.errors[0])}]
    for before in ([b""], [b"", b"", b""], [b"a", b"b c", b""], [b"some words"] * 3):
        assert known.search([*before, cut, b"x"]) == [*[{}] * len(before), *alone, {}]
