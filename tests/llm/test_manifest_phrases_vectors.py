"""Merkle manifests, phrase collocations and embedding near-duplicates against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import embeddings, merkle, phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_audit(rows):
    """Trees as lists of levels, siblings by index."""

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def siblings(levels, i):
        for level in levels[:-1]:
            first = i - i % 3
            yield level[first:i], level[i + 1 : first + 3]
            i //= 3

    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h(*map(field, (r[0], r[3], r[2], r[4], text)))
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for rs in groups.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {k: tree([leaf(r, r[1]) for r in groups[k]]) for k in keys}
    top, out = tree([trees[k][-1][0] for k in keys]), []
    for at, k in enumerate(keys):
        for i, r in enumerate(groups[k]):
            path = [*siblings(trees[k], i), *siblings(top, at)]
            text = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            node = leaf(r, text)
            for before, after in path:
                node = h(*before, node, *after)
            out.append((r[0], trees[k][0][i], trees[k][-1][0], top[-1][0], h(*[x for b, a in path for x in b + a]), node, node == top[-1][0]))
    return sorted(out, key=repr)


def audited(docs):
    return sorted(map(tuple, merkle.audit(docs, tampered=merkle.without_newlines(docs["doc_id"], docs["text"])).collect()), key=repr)


def test_manifest_equals_plain_trees(spark):
    """Several blocks and levels, a hot group, null group and ids, equal ids, repeated rows, odd names, long and empty texts, clashing columns."""
    rng = random.Random(3)
    rows = [(i * (1 << 40), f"line {i}\nend" * rng.randrange(3), "en", "hot", i) for i in range(2500)]
    rows += [(i, None if i % 7 == 0 else "", None, rng.choice([None, "", "é", "z", "ab", "a"]), None) for i in range(60)]
    rows += [(None, "x\n", "de", None, 1), (None, "y\n", "de", "a", 1), (7, "one", "en", "a", 3), (7, "two", "en", "a", 3), (1, "long\n" * 300_000, "en", "z", 5)]
    rows += [(5, "same\n", "en", "copies", 5)] * 800
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("key", "hash", "rank", "block", "ID", "found", "row", "_part", "path")})
    assert audited(docs) == plain_audit(rows)


def test_manifest_of_few_rows(spark):
    assert audited(spark.createDataFrame([], DOCS)) == []
    one = [(4, "a\nb", "en", "s", 3)]
    (only,) = audited(spark.createDataFrame(one, DOCS))
    assert [only] == plain_audit(one) and only[1] == only[2] == only[3] and only[4] == h()


@pytest.mark.parametrize("levels", [1, 2, 3, 5, 7])
def test_van_emde_boas_addresses(levels):
    """Every place once, the root first, and each lower half contiguous."""
    places = merkle.addresses(levels)
    assert sorted(np.concatenate(places).tolist()) == list(range((3**levels - 1) // 2)) and places[0].tolist() == [0]
    upper = levels // 2
    if upper:
        first = [p[: 3 ** (d - upper)] for d, p in enumerate(places) if d >= upper]
        own = np.sort(np.concatenate(first))
        assert (np.diff(own) == 1).all()


def test_changed_text_fails_and_others_hold(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 3}", 6) for i in range(50)]
    docs = spark.createDataFrame(rows, DOCS)
    got = merkle.audit(docs, tampered=F.when(F.col("doc_id") == 17, "other")).where("not verified").collect()
    assert [r["doc_id"] for r in got] == [17]


def plain_collocations(rows, first=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= 10}
    dropped = {(lang, w[i : i + 2]) for (lang, w), a in candidates.items() if len(w) == 3 for i in (0, 1) if 100 * a >= 50 * f[lang, w[i : i + 2]]}
    by = {}
    for (lang, w), a in candidates.items():
        if (lang, w) not in dropped:
            score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            by.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in by.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:first], 1))


def test_collocations_equal_plain_counts(spark):
    """Nulls, empty and long texts, ties, repeated rows, piece ends, odd blanks, a hot word, more candidates than returned."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(90)] + ["The", "the", "É", " x", "K", "a\x00b", "hot", "hot", "hot"]
    glue = [" ", " ", " ", "  ", "\t", "\n", ". ", ",", "\x0b", " ; ", "?!"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(glue) for _ in range(n))
    rows = [(rng.choice(["en", "en", "de", None, "und"]), text(rng.randrange(200))) for _ in range(150)]
    rows += [("en", text(60_000)), ("fr", None), ("fr", ""), (None, " \t\n.")] + [("es", "uno dos tres. uno dos")] * 12
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(1) for c in ("phrase", "a", "rank", "n", "_part")})
    got = lambda first: sorted(map(tuple, phrases.collocations(docs.repartition(7), first=first).collect()))
    assert got(2000) == plain_collocations(rows)
    assert got(20) == plain_collocations(rows, 20)
    assert phrases.collocations(docs.limit(0)).collect() == []


def test_scores_pass_64_bits(spark):
    big = 4_000_000_000
    tables = [spark.createDataFrame([("en", "a", big), ("en", "b", big + 1)], "lang string, phrase string, a long"), spark.createDataFrame([("en", "a b", big - 1)], "lang string, phrase string, a long")]
    (row,) = phrases.scored(tables).collect()
    assert row["score"] == 1_000_000 * (big - 1) ** 2 // (big * (big + 1))


def test_trie_bursts_spills_and_restarts(monkeypatch):
    """Small limits on every path give the same sums as a plain count."""
    for name, value in {"BURST": 40, "ENTRIES": 300, "RUN_ROWS": 64, "MOST_WORDS": 90, "SEGMENT": 70, "TAKEN": 500}.items():
        monkeypatch.setattr(phrases, name, value)
    rng = random.Random(1)
    texts = [" ".join(f"v{int(rng.paretovariate(0.7)) % 400}" for _ in range(rng.randrange(300))) + ". x y z" for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": ["en"] * len(texts)})
    for k in (1, 2, 3):
        want, got, sorted_runs = Counter(), Counter(), 0
        for t in texts:
            for piece in t.split("."):
                w = piece.split()
                want.update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
        everything = None if k == 1 else np.full(phrases.BITS >> 6, (1 << 64) - 1, dtype=np.uint64)
        for out in phrases.Counter(k, everything).over(iter([batch])):
            sorted_runs += 1
            for phrase, a in zip(out["phrase"].to_pylist(), out["a"].to_pylist(), strict=True):
                got[phrase] += a
        got.pop("", None)
        assert got == want and sorted_runs > 3


def plain_links(rows, cosine=0.93):
    """n_links and component of each row, by all pairs."""
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    units = [np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) if ok(v) and label is not None else None for _, v, label in rows]
    near = lambda i, j: i != j and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine
    links = [[j for j in range(len(rows)) if near(i, j)] for i in range(len(rows))]
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((r[0], len(links[i]), least, r[0] == least))
    return sorted(out, key=repr)


def test_vectors_equal_all_pairs(spark):
    """Chains, copies, scaled copies, two dimensions, labels apart, nulls of every kind, zero and non-finite vectors, repeated and null ids."""
    rng = np.random.default_rng(2)
    f32 = lambda v: [float(x) for x in np.asarray(v, dtype=np.float32)]
    rows = [(i, f32(rng.normal(size=12)), int(i % 3)) for i in range(90)]
    base = rng.normal(size=12)
    for i in range(60):  # a chain: each near the next, the ends far apart
        base = base / np.linalg.norm(base) + 0.3 * (d := rng.normal(size=12)) / np.linalg.norm(d)
        rows.append((100 + i, f32(base), 1))
    rows += [(200 + i, rows[3][1], rows[3][2]) for i in range(5)] + [(210, f32(np.array(rows[3][1]) * 4), rows[3][2]), (211, rows[3][1], 99), (212, rows[3][1], None)]
    rows += [(220, None, 0), (221, [], 0), (222, [0.0] * 12, 0), (223, [float("nan")] + [1.0] * 11, 0), (224, [float("inf")] + [1.0] * 11, 0), (225, [None] + [1.0] * 11, 0), (226, [1.0, 2.0], 0), (227, [1.0, 2.0], 0), (227, [1.0, 2.1], 0), (None, [1.0, 2.0], 0), (None, [5.0, -1.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("cid", "v", "dim", "m", "least", "list", "home")})
    got = sorted(map(tuple, embeddings.near_duplicates(vectors, reach=1.0).collect()), key=repr)
    assert got == plain_links(rows)
    assert embeddings.near_duplicates(vectors.limit(0)).collect() == []


def test_default_reach_recalls_links_of_many_lists():
    """One label over many inverted lists, links at random angles just above the threshold: recall of probes and codes, and no false link."""
    rng = np.random.default_rng(4)
    x = embeddings.unit(rng.normal(size=(3000, 64)))
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    y = embeddings.unit(0.94 * x + np.sqrt(1 - 0.94**2) * side / np.linalg.norm(side, axis=1)[:, None])
    points = np.concatenate([x, y])
    index = embeddings.Index(points, 48, 0.93, None)
    own = embeddings.nearest(points, index.coarse)
    probes = np.zeros((len(points), 48), dtype=bool)
    probes[index.probes(points, own)] = True
    codes, errors = index.encode(points, own)
    found = 0
    for i in range(3000):
        a, b = (i, i + 3000) if own[i] <= own[i + 3000] else (i + 3000, i)
        seen = probes[a, own[b]]
        if seen:
            assert index.table_distances(points[a : a + 1], own[b], codes[b : b + 1])[0, 0] <= index.limit + errors[b] + embeddings.SLACK
        found += seen
    assert found >= 0.99 * 3000 and probes.mean() < 0.5
