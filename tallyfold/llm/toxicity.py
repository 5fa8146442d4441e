"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one for each class, are counted over the labelled rows of two folds. Their unigrams are continuation
counts (how many different words stand before a word), so that copies of one text count little; a pair counts once for each
text that holds it. Rare words and pairs lean on counts that both classes share: a word's class estimate weighs m / (m + SHARED),
with m its count over both classes, and a pair's likewise, the rest being the estimate of both classes' pairs times the word's
share of its class. A score compares a text's log-likelihoods under the two models, normalised by its length
and by the root of it; as a long text may be toxic in a few words only, the ratios of its ``TOP`` most telling different words
count besides. A logistic curve fitted on a third fold maps these ratios to a probability.

Nothing is cut off as the data grow. Words are numbered by a checksum among ``WORDS`` numbers, so that rare words may share
one. The counts of words and of their neighbours are kept for each number; those of pairs in ``PAIRS`` cells, and a pair counts
no more than either of its words. So a model is some 16 MB wherever it is sent, while its counts are those of all
labelled rows, of which at most ``MAX_LABELS`` are learnt from.

Null and empty texts score the share of toxic rows. Without rows of both classes every score is that share, 0 if there are
no labels. Texts and words are read whole. Repeated rows are counted and scored one by one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import drop, materialize, python_ready
from tallyfold.llm.labelled import held_out, labels_of, sampled, sigmoid, standardised, with_texts

FOLDS, HELD_OUT, CALIBRATION = 4, 2, 3
#: Numbers of words (a power of two; one more is the start of a text) and cells of pairs (a prime).
WORDS = 1 << 18
PAIRS = 524_287
START = WORDS
#: A pair's cell is the sum of its numbers times these, modulo ``PAIRS``.
SPREAD = (1_000_003, 7_368_787)
#: Rows that the calibration is fitted on, at most.
MAX_CALIBRATION = 20_000
DISCOUNT = 0.75
SHARED = 10.0
SHARED_PAIR = 50.0
#: How many of a text's different words, by falling ratio, count one by one.
TOP = 5
WIDTH = 2 + TOP
FLUSH = 1 << 21
BLANKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
LOW = (1 << 32) - 1


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(BLANKS).split()


def numbers(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) & (WORDS - 1)


def before(ids: np.ndarray) -> np.ndarray:
    """The number of the word before each word."""
    return np.concatenate(([START], ids[:-1]))


def count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(code, n1, n0): in how many toxic and other texts of a part of the rows a pair of words occurs."""
    held: dict[int, list[np.ndarray]] = {0: [], 1: []}
    size = 0

    def out() -> Iterator[pd.DataFrame]:
        for y, codes in held.items():
            if codes:
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pd.DataFrame({"code": code, "n1": n * (y == 1), "n0": n * (y == 0)})
            codes.clear()

    for batch in batches:
        for text, y in zip(batch["text"], batch["y"], strict=True):
            ids = numbers(words_of(text))
            if len(ids):
                held[int(y == 1)].append(np.unique(before(ids) << 32 | ids))
                size += len(ids)
            if size > FLUSH:
                yield from out()
                size = 0
    yield from out()


def cell(first, second):
    return (first * SPREAD[0] + second * SPREAD[1]) % PAIRS


@dataclass
class Counts:
    """Of each class (toxic, other): a row of each array. ``follows`` and ``times`` are a word's, ``total`` and ``kinds`` those of what follows it.

    ``all_kinds`` are the kinds of both classes together.
    """

    follows: np.ndarray
    times: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    all_kinds: np.ndarray
    pairs: np.ndarray

    def __post_init__(self) -> None:
        follows = self.follows
        both = follows.sum(axis=0, dtype=np.float64)
        shared = (both + 1) / (both.sum() + (both > 0).sum() + 1)
        weight = both / (both + SHARED)
        words = []
        for c in follows:
            total = max(c.sum(dtype=np.float64), 1.0)
            own = np.maximum(c - DISCOUNT, 0) / total + DISCOUNT * (c > 0).sum() / total * shared if c.any() else shared
            words.append(weight * own + (1 - weight) * shared)
        self.words, self.shared = np.array(words, dtype=np.float32), shared.astype(np.float32)

    def word_ratios(self, ids: np.ndarray) -> np.ndarray:
        return np.log(self.words[0, ids]) - np.log(self.words[1, ids])

    def ratios(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Log-likelihood ratios (toxic to other) of the second words after the first."""
        total, word, shared = self.total[:, first], self.words[:, second], self.shared[second]
        n = np.minimum(np.minimum(self.pairs[:, cell(first, second)], total), self.times[:, second])
        both, every = n.sum(axis=0), total.sum(axis=0)
        common = np.where(every > 0, (np.maximum(both - DISCOUNT, 0) + DISCOUNT * self.all_kinds[first] * shared) / np.maximum(every, 1), shared)
        lean = common * word / shared
        own = np.where(total > 0, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * self.kinds[:, first] * word) / np.maximum(total, 1), lean)
        weight = both / (both + SHARED_PAIR)
        logs = np.log(weight * own + (1 - weight) * lean)
        return logs[0] - logs[1]


@dataclass
class Model:
    counts: Counts | None
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float

    def features(self, texts: list[str | None]) -> np.ndarray:
        """The text's ratio by its length and by the root of it, and its ``TOP`` words' ratios; zeros for a text without words."""
        out = np.zeros((len(texts), WIDTH))
        for x, text in zip(out, texts, strict=True):
            ids = numbers(words_of(text))
            if self.counts is None or not len(ids):
                continue
            ratio = self.counts.ratios(before(ids), ids)
            x[0], x[1] = ratio.mean(), ratio.sum() / np.sqrt(len(ids))
            top = np.sort(self.counts.word_ratios(np.unique(ids)))[::-1][:TOP]
            x[2 : 2 + len(top)] = top
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = self.features(texts)
        blank = ~x.any(axis=1)
        return np.where(blank, self.prior, sigmoid(np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights[:-1] + self.weights[-1]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and intercept by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(25):
        p = sigmoid(x @ w)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
    return w


def gathered(rows: DataFrame, key: Column, sums: dict[str, Column], size: int) -> list[np.ndarray]:
    """The sums of rows by a whole number below ``size``, as arrays: at most ``size`` rows of short numbers come back."""
    got = rows.groupBy(key.cast("int").alias("k")).agg(*[F.sum(c).cast("float").alias(name) for name, c in sums.items()]).toPandas()
    at = got["k"].to_numpy(dtype=np.int64)
    out = []
    for name in sums:
        values = np.zeros(size, dtype=np.float32)
        values[at] = got[name].to_numpy(dtype=np.float32)
        out.append(values)
    return out


def count(texts: DataFrame) -> Counts:
    """The counts of labelled texts (``text``, ``y``)."""
    pairs = texts.mapInPandas(count_pairs, "code long, n1 long, n0 long").groupBy("code").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    pairs = materialize(pairs)
    first, second = F.shiftright("code", 32), F.col("code").bitwiseAND(F.lit(LOW))
    some = lambda c: (F.col(c) > 0).cast("long")
    times = {"n1": F.col("n1"), "n0": F.col("n0")}
    kinds = {"t1": some("n1"), "t0": some("n0")}
    n1, n0, f1, f0 = gathered(pairs, second, times | kinds, WORDS + 1)
    m1, m0, t1, t0, t = gathered(pairs, first, times | kinds | {"t": F.lit(1)}, WORDS + 1)
    cells = gathered(pairs, cell(first, second), times, PAIRS)
    out = Counts(np.stack([f1, f0]), np.stack([n1, n0]), np.stack([m1, m0]), np.stack([t1, t0]), t, np.stack(cells))
    drop(pairs)
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Counts over all labelled rows that may be learnt from; the calibration uses about ``MAX_CALIBRATION`` rows at most."""
    spark = docs.sparkSession
    python_ready(spark)
    rows = materialize(labels_of(labels, label, FOLDS, HELD_OUT))
    classes = {(r["y"], r["c"]): r["n"] for r in rows.groupBy("y", (F.col("fold") == CALIBRATION).alias("c")).agg(F.count("*").alias("n")).collect()}
    total = sum(classes.values())
    prior = sum(n for (y, _), n in classes.items() if y == 1) / total if total else 0.0
    constant = np.array([0.0] * WIDTH + [np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))])
    model = Model(None, np.zeros(WIDTH), np.ones(WIDTH), constant, prior)
    if any((y, c) not in classes for y in (0, 1) for c in (False, True)):
        return model
    model.counts = count(with_texts(docs, rows.where(F.col("fold") != CALIBRATION)).select("text", "y"))
    ready = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = ready.value.features(list(batch["text"]))
            yield pd.DataFrame({"x": list(x), "y": batch["y"]})

    fold = with_texts(docs, rows.where(F.col("fold") == CALIBRATION)).select("text", "y")
    fold = sampled(fold, MAX_CALIBRATION, classes[0, True] + classes[1, True])
    got = sampled(materialize(fold.mapInPandas(measure, "x array<double>, y int")), MAX_CALIBRATION).toPandas()
    ready.destroy()
    if got["y"].nunique() < 2:
        return model
    x, y = np.array(got["x"].tolist()), (got["y"].to_numpy() == 1).astype(float)
    model.mean, model.spread = standardised(x)
    model.weights = logistic(np.clip((x - model.mean) / model.spread, -8, 8), y)
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Add ``held_out, score, predicted``. Same-named columns are replaced."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.value.scores(list(texts)), dtype="float64")

    out = docs.withColumn("score", run(F.col("text"))).withColumn("held_out", held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
