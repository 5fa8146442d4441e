"""Operators 8 and 9: held-out accuracy, folds and odd input."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyfold.llm import pu_quality, toxicity

SF = "/root/testdata/sf0.1"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize(("model", "label", "folds", "fold", "least"), [(toxicity, "toxic", 4, 2, 0.96), (pu_quality, "quality", 5, 0, 0.98)])
def test_held_out_accuracy(spark, model, label, folds, fold, least):
    docs, labels = tables(spark)
    got = model.score(docs, labels).join(labels, "doc_id").toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % folds == fold)).all()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    held = got[got["held_out"]]
    assert (held["predicted"] == held[label]).mean() >= least


@pytest.mark.parametrize(("model", "label"), [(toxicity, "toxic"), (pu_quality, "quality")])
def test_odd_rows(spark, model, label):
    rows = [(None, "x y"), (0, None), (1, ""), (2, "?! ..."), (3, "w" * 100_000), (4, "a b " * 20_000), (4, "a b")]
    rows += [(10 + i, f"good words number {i} stand here") for i in range(80)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(10 + i, i % 2) for i in range(80)] + [(None, 1), (4, None)], f"doc_id long, {label} int")
    got = model.score(docs, labels).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    for few in (labels.limit(0), labels.where(f"{label} = 1"), labels.where(f"{label} = 0")):
        assert model.score(docs, few).toPandas()["score"].between(0, 1).all()
    assert model.score(docs.limit(0), labels).count() == 0


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows = [(i, f"text {'bad' if i % 3 else 'fine'} number {i % 7} here") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for model, label, folds, fold in ((toxicity, "toxic", 4, 2), (pu_quality, "quality", 5, 0)):
        scores = []
        for flip in (0, 1):
            y = lambda i: int(i % 3 > 0) ^ (flip and zlib.crc32(str(i).encode()) % folds == fold)
            labels = spark.createDataFrame([(i, int(y(i))) for i, _ in rows], f"doc_id long, {label} int")
            scores.append(model.score(docs, labels).orderBy("doc_id").toPandas()["score"].to_numpy())
        assert np.allclose(*scores)


def local(positive, unlabelled):
    d = positive.shape[1]
    of = lambda x, ws: [pu_quality.means(row, d) for row in pu_quality.sums(x, ws)]
    return lambda ws: list(zip(of(positive, ws), of(unlabelled, ws), strict=True))


def mixture(rng, n, share=0.7):
    of = lambda x: np.hstack([x, np.ones((len(x), 1))])
    good = round(share * n)
    return of(rng.normal(1, 1, (n // 3, 2))), of(np.vstack([rng.normal(1, 1, (good, 2)), rng.normal(-2, 1, (n - good, 2))])), good


def test_risk_never_fits_positives_as_negatives():
    positive, unlabelled, good = mixture(np.random.default_rng(0), 1000)
    evaluate = local(positive, unlabelled)
    w = pu_quality.minimise(evaluate, lambda p, u: pu_quality.risk(p, u, 0.7), 3)
    assert (unlabelled[:good] @ w > 0).mean() > 0.9 and (unlabelled[good:] @ w > 0).mean() < 0.1
    # far too large a prior makes the second part fall below zero unless it is held
    for prior in (0.95, 0.99):
        w = pu_quality.minimise(evaluate, lambda p, u: pu_quality.risk(p, u, prior), 3)
        (p, u), = evaluate(w[None])
        assert u.negative - prior * p.negative >= 0


def plain_nnpu(positive, unlabelled, prior, steps=4000):
    """Non-negative risk by gradient descent, one row after another in plain loops over the loss' definition."""
    w = np.zeros(positive.shape[1])
    for _ in range(steps):
        p, u = (1 / (1 + np.exp(-x @ w)) for x in (positive, unlabelled))
        negative = -np.log(1 - u).mean() + prior * np.log(1 - p).mean()
        rest = (unlabelled * u[:, None]).mean(axis=0) - prior * (positive * p[:, None]).mean(axis=0)
        gradient = -rest if negative < 0 else prior * (positive * (p - 1)[:, None]).mean(axis=0) + rest + pu_quality.RIDGE * w
        w = w - 0.5 * gradient
    return w


def test_minimum_is_that_of_a_plain_loop():
    positive, unlabelled, _ = mixture(np.random.default_rng(1), 600)
    w = pu_quality.minimise(local(positive, unlabelled), lambda p, u: pu_quality.risk(p, u, 0.7), 3)
    assert np.allclose(w, plain_nnpu(positive, unlabelled, 0.7), atol=0.02)


def clipped_risk(positive, unlabelled, prior, w):
    """The non-negative risk with its ridge, from the definition of the loss."""
    of = lambda x, sign: np.logaddexp(0, -sign * (x @ w)).mean()
    return prior * of(positive, 1) + max(0.0, of(unlabelled, -1) - prior * of(positive, -1)) + pu_quality.RIDGE / 2 * w @ w


def least_clipped_risk(positive, unlabelled, prior, steps=20_000):
    """The least non-negative risk that subgradient steps of falling length reach."""
    w = np.zeros(positive.shape[1])
    best = clipped_risk(positive, unlabelled, prior, w)
    for k in range(steps):
        p, u = (1 / (1 + np.exp(-x @ w)) for x in (positive, unlabelled))
        negative = -np.log(1 - u).mean() + prior * np.log(1 - p).mean()
        rest = (unlabelled * u[:, None]).mean(axis=0) - prior * (positive * p[:, None]).mean(axis=0)
        w = w - 2 / (1 + k) ** 0.5 * (prior * (positive * (p - 1)[:, None]).mean(axis=0) + rest * (negative >= 0) + pu_quality.RIDGE * w)
        best = min(best, clipped_risk(positive, unlabelled, prior, w))
    return best


@pytest.mark.parametrize("prior", [0.5, 0.7, 0.8, 0.9, 0.95])
def test_fit_reaches_the_least_clipped_risk(prior):
    positive, unlabelled, _ = mixture(np.random.default_rng(1), 600)
    w = pu_quality.minimise(local(positive, unlabelled), lambda p, u: pu_quality.risk(p, u, prior), 3)
    risk = clipped_risk(positive, unlabelled, prior, w)
    assert risk < least_clipped_risk(positive, unlabelled, prior) + 3e-3  # which may lie beyond the border
    assert risk < clipped_risk(positive, unlabelled, prior, plain_nnpu(positive, unlabelled, prior)) + 1e-4
    rng = np.random.default_rng(5)
    for spread in (0.01, 0.1, 1.0):
        around = w + rng.normal(0, spread, (3000, 3))
        of = lambda x, sign: np.logaddexp(0, -sign * (x @ around.T)).mean(axis=0)
        second = of(unlabelled, -1) - prior * of(positive, -1)
        values = prior * of(positive, 1) + second + pu_quality.RIDGE / 2 * (around**2).sum(axis=1)
        assert values[second >= 0].min() > risk - 1e-4


def test_prior_needs_no_negatives():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.85):
        positive, unlabelled, _ = mixture(rng, 30_000, share)
        w = pu_quality.minimise(local(positive, unlabelled), pu_quality.contrast, 3)
        histograms = [np.histogram(1 / (1 + np.exp(-x @ w)), bins=pu_quality.BINS, range=(0, 1))[0] for x in (positive, unlabelled)]
        assert abs(pu_quality.prior_of(*histograms) - share) < 0.06
    assert pu_quality.prior_of(np.zeros(9), np.ones(9)) == 0


def test_sums_over_all_rows(spark):
    rng = np.random.default_rng(3)
    x, positive = rng.normal(size=(700, len(pu_quality.NAMES))), rng.random(700) < 0.3
    rows = spark.createDataFrame([(r.tolist(), bool(p)) for r, p in zip(x, positive)], "x array<double>, positive boolean").repartition(7)
    ws = rng.normal(size=(2, x.shape[1]))
    got = pu_quality.totals(rows, lambda part: pu_quality.sums(part, ws))
    assert np.allclose(got[0], pu_quality.sums(x[positive], ws)) and np.allclose(got[1], pu_quality.sums(x, ws))


def kneser_ney(rows, text):
    """Mean log-likelihood ratio of a text, from dictionaries of words instead of numbered cells."""
    pairs = {0: Counter(), 1: Counter()}
    for t, y in rows:
        ws = [None, *t.split()]
        pairs[y].update(set(zip(ws, ws[1:])))
    follows = {y: Counter(w for _, w in pairs[y]) for y in pairs}
    both, all_pairs = follows[0] + follows[1], pairs[0] + pairs[1]
    shared = lambda w: (both[w] + 1) / (sum(both.values()) + len(both) + 1)
    after = lambda counts, u: [n for (a, _), n in counts.items() if a == u]

    def word(y, w):
        total = sum(follows[y].values())
        own = max(follows[y][w] - toxicity.DISCOUNT, 0) / total + toxicity.DISCOUNT * len(follows[y]) / total * shared(w)
        weight = both[w] / (both[w] + toxicity.SHARED)
        return weight * own + (1 - weight) * shared(w)

    def smoothed(counts, u, w, backoff):
        found = after(counts, u)
        return (max(counts[u, w] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(found) * backoff) / sum(found)

    def pair(y, u, w):
        lean = (smoothed(all_pairs, u, w, shared(w)) if after(all_pairs, u) else shared(w)) * word(y, w) / shared(w)
        own = smoothed(pairs[y], u, w, word(y, w)) if after(pairs[y], u) else lean
        weight = all_pairs[u, w] / (all_pairs[u, w] + toxicity.SHARED_PAIR)
        return weight * own + (1 - weight) * lean

    ws = [None, *text.split()]
    return float(np.mean([np.log(pair(1, u, w)) - np.log(pair(0, u, w)) for u, w in zip(ws, ws[1:])]))


def test_counts_are_those_of_a_dictionary(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = [(" ".join(rng.choice(words[5 * y :]) for _ in range(rng.randrange(1, 30))), y) for y in (0, 1) for _ in range(60)]
    cells = {toxicity.cell(int(a), int(b)) for a in toxicity.numbers([w.encode() for w in words]) for b in toxicity.numbers([w.encode() for w in words])}
    assert len(cells) == len(words) ** 2  # nothing shares a cell here
    counts = toxicity.count(spark.createDataFrame([*rows, (None, 1), ("", 0)], "text string, y int").repartition(5))
    model = toxicity.Model(counts, np.zeros(toxicity.WIDTH), np.ones(toxicity.WIDTH), np.zeros(toxicity.WIDTH + 1), 0.5)
    texts = [*[t for t, _ in rows[::9]], "w1 unseen w2", "unseen"]
    assert np.allclose(model.features(texts)[:, 0], [kneser_ney(rows, t) for t in texts], rtol=1e-4, atol=1e-6)


def test_repeated_ids_stay_within_the_calibration_bound(spark, monkeypatch):
    from tallyfold.llm.labelled import sampled

    rows = spark.range(4000).selectExpr("1 as doc_id")
    assert 50 < sampled(rows, 100).count() < 200 and sampled(rows, 5000).count() == 4000
