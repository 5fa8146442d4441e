"""Labelled rows for the trained operators: folds, bounded samples and their join to texts."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that are learnt from; a larger table is thinned evenly by a hash of the id.
MAX_LABELS = 2_000_000


def remainder(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def thinned(rows: DataFrame, doc_id: str, most: int, count: int | None = None) -> DataFrame:
    """All rows if they are ``most`` at most, else about ``most`` of them by a hash of their ids, which differ."""
    count = rows.count() if count is None else count
    if count <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 30)) < int(most / count * (1 << 30)))


def sampled(rows: DataFrame, most: int, count: int | None = None) -> DataFrame:
    """All rows if they are ``most`` at most, else about ``most`` of them, each drawn by itself, with a fixed seed."""
    count = rows.count() if count is None else count
    return rows if count <= most else rows.where(F.rand(7) < most / count)


def labels_of(labels: DataFrame, label: str, folds: int, held_out: int, most: int = MAX_LABELS) -> DataFrame:
    """``doc_id, y, fold`` of the rows that may be learnt from; of several labels for one id the largest counts."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    rows = rows.withColumn("fold", remainder(F.col("doc_id"), folds).cast("int")).where(F.col("fold") != held_out)
    return thinned(rows, "doc_id", most)


def with_texts(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The labelled rows' texts. The labels are broadcast: they are ``MAX_LABELS`` rows of 16 bytes at most."""
    return docs.select("doc_id", "text").join(F.broadcast(labelled), "doc_id")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether a document's label may not be learnt from; a null id has no remainder and counts as held out."""
    return F.coalesce(remainder(doc_id, folds) == fold, F.lit(True))


def crc_remainder(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def standardised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of each column."""
    return x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
