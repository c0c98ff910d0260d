"""Labelled training rows, folds, and logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows a classifier is fitted on at most; chosen by hash of doc_id, so that the sample is the same each time.
FIT_ROWS = 12_000


def held_out(doc_id: Column) -> Column:
    """Fold 0 of crc32(doc_id as text) mod 5; a null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, text and y (0 or 1) of about ``rows`` labelled rows at most outside fold 0. An id whose labels contradict each other
    isn't learned from. The ids joined are bounded by ``rows`` and a tenth, so they are broadcast."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    n = usable.count()
    if n > rows:
        cut = int(rows / n * (1 << 30))
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < cut)
    usable = usable.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z").limit(rows + rows // 10)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(usable), "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 1500, ridge: float = 0.0, positive: bool = False) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise mean log loss + penalty * |w| (+ ridge * w.w / 2), by accelerated proximal gradient; ``positive``: without weights below 0."""
    n, d = x.shape
    w, b = np.zeros(d), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w.copy(), b, 1.0
    top = np.linalg.norm(np.hstack([x, np.ones((n, 1))]), 2) ** 2 / (4 * n) + ridge + 1e-12
    for _ in range(steps):
        r = sigmoid(x @ v + c) - y
        w2 = v - (x.T @ r / n + ridge * v) / top
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - penalty / top, 0)
        if positive:
            w2 = np.maximum(w2, 0)
        b2 = c - r.mean() / top
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b
