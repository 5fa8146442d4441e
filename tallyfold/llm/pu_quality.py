"""Quality classifier by positive-unlabelled learning.

Trusted positives are texts that a label marks as good; all texts of the table are the unlabelled ones. A linear model over
text statistics minimises the non-negative unbiased risk: the positives' loss weighed by the class prior, plus the unlabelled
texts' negative loss less the prior's part of the positives' negative loss, which may not fall below zero. With the logistic
loss that risk is convex; Newton steps go down it, and where its second part would fall below zero they go along the border, bent
back by the second part's curvature, so that the fit does not stop where it meets the border.

The class prior is estimated from positives and unlabelled texts alone: a classifier tells the two apart, and the prior is the
least ratio of the unlabelled to the positive share of texts above a score, each ratio with its margin of error.

Statistics of every row are written once (twelve numbers a row); means, spreads, gradients and histograms are sums over all
of them on the executors, and only sums come back.

Null and empty texts have all statistics zero and score like any other. Without positives or texts every score is nearly 0.
Texts are read whole; repeated rows count and are scored one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import materialize, python_ready
from tallyfold.llm.labelled import held_out, labels_of, sigmoid

FOLDS, HELD_OUT = 5, 0
#: Newton steps at most, and the shares of a step that are tried at once.
STEPS = 15
SHARES = (1.0, 0.5, 0.2, 0.05)
RIDGE = 1e-3
#: How far from the border, in its own first value, the steps along it aim; all are tried at once.
MARGINS = (0.0, 1e-4, 1e-3, 1e-2)
#: Bins of scores for the class prior.
BINS = 1000
KINDS = np.zeros(256, dtype=np.uint8)
KINDS[[*b" \t\n\v\f\r"]] = 1
KINDS[[*range(65, 91)]] = 2
KINDS[[*range(97, 123)]] = 3
KINDS[[*range(48, 58)]] = 4
KINDS[[*b".,;:'\"-?()"]] = 5
KINDS[[*b"#*$%&|<>@~^_=+\\/{}[]`"]] = 6
KINDS[33] = 7
KINDS[128:192] = 8  # continuation bytes
KINDS[192:] = 9
NAMES = ("capitals", "digits", "stops", "symbols", "shouts", "blanks", "word_length", "same_as_before", "distinct_pairs", "lines", "same_lines", "few_words")


def statistics(text: str | None) -> list[float]:
    """Shares and ratios that tell prose from tables, shouting, symbol noise and repetition."""
    data = (text or "").encode("utf-8", "replace")
    words = data.lower().split()
    if not words:
        return [0.0] * len(NAMES)
    kinds = np.bincount(KINDS[np.frombuffer(data, dtype=np.uint8)], minlength=10).astype(float)
    chars, n = len(data) - kinds[8], len(words)
    letters = max(1.0, kinds[2] + kinds[3] + kinds[9])
    pairs = max(1, n - 1)
    again = sum(map(bytes.__eq__, words, words[1:]))
    distinct = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        kinds[2] / letters, np.sqrt(kinds[4] / chars), kinds[5] / n, np.sqrt(kinds[6] / chars), np.sqrt(kinds[7] / chars), kinds[1] / chars,
        (chars - kinds[1]) / n, np.sqrt(again / pairs), 1 - distinct / pairs, np.log1p(n / len(lines)), np.sqrt(1 - len(set(lines)) / len(lines)), 1 / n,
    ]


def expand(x: np.ndarray) -> np.ndarray:
    """Bounded statistics, their squares and a constant."""
    x = np.clip(x, -5, 5)
    return np.hstack([x, x * x / 5, np.ones((len(x), 1))])


@dataclass
class Sums:
    """Means over one group of rows, for one vector of weights: losses as negative and as positive, and their derivatives."""

    n: float
    negative: float
    positive: float
    x: np.ndarray
    slope: np.ndarray
    curve: np.ndarray


def sums(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sums that ``means`` needs, one row for each row of ``weights``."""
    out = []
    for w in weights:
        z = x @ w
        p = sigmoid(z)
        out.append(np.concatenate([[len(x), np.logaddexp(0, z).sum(), np.logaddexp(0, -z).sum()], x.sum(axis=0), x.T @ p, ((x * (p * (1 - p))[:, None]).T @ x).ravel()]))
    return np.array(out)


def means(row: np.ndarray, d: int) -> Sums:
    n = row[0]
    row = row / max(n, 1.0)
    return Sums(n, row[1], row[2], row[3 : 3 + d], row[3 + d : 3 + 2 * d], row[3 + 2 * d :].reshape(d, d))


Evaluate = Callable[[np.ndarray], list[tuple[Sums, Sums]]]  # of positives and unlabelled, for each row of weights


Part = tuple[float, np.ndarray, np.ndarray]  # a smooth function's value, gradient and curvature


def risk(p: Sums, u: Sums, prior: float) -> tuple[Part, Part | None]:
    """The unbiased risk, and its second part, which may not fall below zero."""
    second = u.negative - prior * p.negative, u.slope - prior * p.slope, u.curve - prior * p.curve
    return (prior * p.positive + second[0], prior * (p.slope - p.x) + second[1], u.curve), second


def contrast(p: Sums, u: Sums) -> tuple[Part, Part | None]:
    """Mean loss of telling positives from unlabelled rows, both weighed alike."""
    return (p.positive + u.negative, p.slope - p.x + u.slope, p.curve + u.curve), None


def steps_down(loss: Part, border: Part | None) -> np.ndarray:
    """Steps to try: shares of the Newton step, those that would cross the border turned along it at several margins."""
    _, gradient, curve = loss
    step = -np.linalg.solve(curve, gradient)
    if border is None:
        return np.array(SHARES)[:, None] * step
    room, slope, bend = border
    inward = np.linalg.solve(curve, slope)
    inward /= max(slope @ inward, 1e-12)  # raises the border's linear model by one
    out = []
    for margin in MARGINS:
        along = step + max(0.0, margin - room - slope @ step) * inward
        for share in SHARES:
            s = share * along
            for _ in range(3):
                s = s + max(0.0, margin - (room + slope @ s + s @ bend @ s / 2)) * inward
            out.append(s)
    return np.unique(out, axis=0)  # far from the border all margins give the same


def minimise(evaluate: Evaluate, loss: Callable[[Sums, Sums], tuple[Part, Part | None]], d: int) -> np.ndarray:
    """Weights of least loss with a ridge, on the allowed side of the loss' border; from zero, by damped Newton steps."""

    def at(ws: np.ndarray) -> list[tuple[Part, Part | None]]:
        found = [loss(p, u) for p, u in evaluate(ws)]
        return [((v + RIDGE / 2 * w @ w, g + RIDGE * w, h + RIDGE * np.eye(d)), border) for w, ((v, g, h), border) in zip(ws, found, strict=True)]

    w = np.zeros(d)
    here = at(w[None])[0]
    for _ in range(STEPS):
        tries = w + steps_down(*here)
        found = [(x, t) for x, t in zip(at(tries), tries, strict=True) if (x[1] is None or x[1][0] >= 0) and x[0][0] < here[0][0]]
        if not found:
            break
        before = here[0][0]
        here, w = min(found, key=lambda x: x[0][0][0])
        if before - here[0][0] < 1e-7:
            break
    return w


def prior_of(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled, from histograms of scores (rising): the least ratio of shares above a score."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.0
    above_p, above_u = (np.cumsum(h[::-1]) / h.sum() for h in (positive, unlabelled))
    some = above_p > 0
    margin = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(n_p) + 1 / np.sqrt(n_u))
    ratio, bound = above_u[some] / above_p[some], margin / above_p[some]
    return float(min(1.0, ratio[np.argmin(ratio + bound)]))


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float

    def standard(self, x: np.ndarray) -> np.ndarray:
        return expand((x - self.mean) / self.spread)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.standard(x) @ self.weights)


def measured(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``row`` (all columns but ``text``), ``doc_id``, ``x`` (the statistics) and ``positive`` of every row, written once.

    The positives' ids are broadcast: they are ``labelled.MAX_LABELS`` numbers at most.
    """
    python_ready(docs.sparkSession)
    rows = labels_of(labels, label, FOLDS, HELD_OUT).where("y = 1").select(F.col("doc_id").alias("positive_id"))
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(t) for t in texts])

    source = docs.select(F.struct(*others).alias("row"), "doc_id", run("text").alias("x"))
    joined = source.join(F.broadcast(rows), F.col("doc_id") == F.col("positive_id"), "left")
    return materialize(joined.select("row", "doc_id", "x", F.col("positive_id").isNotNull().alias("positive")))


def totals(rows: DataFrame, run: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``run`` (statistics to an array of one shape) over the positives and over all rows, added up on the executors."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [0.0, 0.0]
        for batch in batches:
            if len(batch):
                x, positive = np.stack(batch["x"].to_numpy()), batch["positive"].to_numpy(dtype=bool)
                got = [got[0] + run(x[positive]), got[1] + run(x)]
        if np.ndim(got[1]):
            yield pd.DataFrame({"of": [0, 1], "v": [np.ravel(g) for g in got]})

    shape = run(np.zeros((0, len(NAMES)))).shape
    added = rows.select("x", "positive").mapInPandas(part, "of int, v array<double>").select("of", F.posexplode("v").alias("i", "v")).groupBy("of", "i").agg(F.sum("v").alias("v"))
    out = np.zeros((2, int(np.prod(shape))))
    for r in added.toPandas().itertuples():
        out[r.of, r.i] = r.v
    return out[0].reshape(shape), out[1].reshape(shape)


def train(rows: DataFrame) -> Model:
    """The model of ``measured`` rows."""
    width = len(NAMES)
    d = 2 * width + 1
    (positives, *_), (n, *moments) = totals(rows, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
    if not positives:
        return Model(np.zeros(width), np.ones(width), np.array([0.0] * 2 * width + [-20.0]), 0.0)
    mean = np.array(moments[:width]) / n
    spread = np.maximum(np.sqrt(np.maximum(np.array(moments[width:]) / n - mean**2, 0)), 1e-6)
    model = Model(mean, spread, np.zeros(d), 0.0)

    def evaluate(ws: np.ndarray) -> list[tuple[Sums, Sums]]:
        p, u = totals(rows, lambda x: sums(model.standard(x), ws))
        return [(means(a, d), means(b, d)) for a, b in zip(p, u, strict=True)]

    model.weights = minimise(evaluate, contrast, d)
    scores = totals(rows, lambda x: np.histogram(model.scores(x), bins=BINS, range=(0, 1))[0].astype(float))
    model.prior = min(prior_of(*scores), 0.99)
    model.weights = minimise(evaluate, lambda p, u: risk(p, u, model.prior), d)
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label: str = "quality") -> DataFrame:
    """``held_out, score, predicted`` for every row, beside its columns other than ``text``. Same-named columns are replaced."""
    rows = measured(docs, labels, label)
    model = docs.sparkSession.sparkContext.broadcast(train(rows))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(model.value.scores(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("text", "score", "held_out", "predicted")]
    out = rows.select(*kept, run("x").alias("score"), held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
