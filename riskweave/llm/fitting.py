"""Small fitting tools of the text classifiers: bounded samples of labelled rows, a sparse linear model, calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import crc_mod


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text and y of at most `most` labelled rows outside the held-out fold, picked by a hash of the id.

    A document with several labels takes the larger; null labels don't count.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null").where(crc_mod(F.col("doc_id"), folds) != held_out)
    of = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    picked = of.where(crc_mod(F.col("doc_id"), folds) != held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return d.join(F.broadcast(picked), "doc_id").select("text", "y")  # at most `most` rows of 12 bytes


def platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve from raw scores to label frequencies, by Newton's method."""
    if len(y) < 10 or y.min() == y.max():
        return 1.0, 0.0
    x = np.stack([raw, np.ones_like(raw)], 1)
    t = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w = np.zeros(2)
    for _ in range(30):
        p = sigmoid(x @ w)
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(h, x.T @ (p - t) + 1e-3 * w)
    return float(w[0]), float(w[1])


def logistic(rows: np.ndarray, columns: np.ndarray, n: int, width: int, y: np.ndarray, weight: np.ndarray, l2: float = 1e-4, rounds: int = 250, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on 0/1 features, (row, column) pairs, with soft labels y; Adam over all rows."""
    w, total = np.zeros(width + 1), max(1e-9, weight.sum())
    w[-1] = np.log((y @ weight + 0.5) / (total - y @ weight + 0.5))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        r = (sigmoid(np.bincount(rows, weights=w[columns], minlength=n) + w[-1]) - y) * weight / total
        g = np.append(np.bincount(columns, weights=r[rows], minlength=width), r.sum()) + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])
