"""Bounded samples of labelled rows, and probability calibration, for the classifiers fitted here."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, each: int, allowed: Column | None = None, most_bytes: int = 100_000) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels of at most ``each`` rows of either label, those with the smallest hash of ``doc_id``.

    Only the classifiers' fitting is bounded in this way. Labels other than 0 and 1, null ids and texts of
    more than ``most_bytes`` are left out.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    rows = rows.where(allowed) if allowed is not None else rows
    order = [F.xxhash64("doc_id", F.lit(11)), F.col("doc_id")]
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = rows.where("y = 0").orderBy(*order).limit(each).union(rows.where("y = 1").orderBy(*order).limit(each))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * each rows
    got = texts.where(F.octet_length("text") <= most_bytes).orderBy(*order).limit(2 * each).select("text", "y").toArrow()
    return got.column("text").combine_chunks(), np.array(got.column("y").to_pylist(), np.float64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def platt(z: np.ndarray, y: np.ndarray, balance: bool = True) -> tuple[float, float]:
    """Slope and shift that fit logits to labels by Newton's method, with smoothed targets."""
    if len(z) < 10 or y.min() == y.max():
        return 1.0, 0.0
    ones = y.sum()
    target = np.where(y > 0.5, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    weight = np.where(y > 0.5, len(y) / (2 * ones), len(y) / (2 * (len(y) - ones))) if balance else np.ones(len(y))
    x, theta = np.stack([z, np.ones(len(z))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(theta @ x)
        gradient = x @ (weight * (p - target)) + np.array([1e-3 * (theta[0] - 1), 0])
        hessian = (x * (weight * p * (1 - p))) @ x.T + np.diag([1e-3, 1e-6])
        move = np.linalg.solve(hessian, gradient)
        theta = theta - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature in [0.05, 20] that divides logits with the least log loss, by golden-section search."""
    if len(z) < 10:
        return 1.0
    loss = lambda t: float(np.mean(np.logaddexp(0, z / np.exp(t)) - y * z / np.exp(t)))
    lo, hi, golden = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))
