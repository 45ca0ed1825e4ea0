"""Small learners on bounded samples: histogram trees and lasso logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Labelled rows, at most, that a classifier is fitted on.
LABEL_SAMPLE = 20_000


def label_sample(labels: DataFrame, column: str, modulus: int = 5, most: int = LABEL_SAMPLE) -> DataFrame:
    """doc_id and y (0.0 or 1.0) of at most `most` training documents, by hash order.

    Rows held out (crc32 of doc_id as text divisible by `modulus`) and null labels are
    left out; of several labels of a document the majority counts, ties to 1.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~C.held_out(modulus))
    one = rows.groupBy("doc_id").agg((F.avg(F.col(column).cast("double")) >= 0.5).cast("double").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def grow(bins: np.ndarray, n_bins: int, grad: np.ndarray, hess: np.ndarray, depth: int, least: float = 5.0, ridge: float = 1.0) -> list[tuple[list[tuple[int, int, bool]], float]]:
    """One regression tree: every node below the root as (path of (feature, bin, above), value)."""
    out, todo = [], [(np.arange(len(bins)), [])]
    features = bins.shape[1]
    while todo:
        rows, path = todo.pop()
        g, h = grad[rows], hess[rows]
        if path:
            out.append((path, float(-g.sum() / (h.sum() + ridge))))
        if len(path) == depth or len(rows) < 2 * least:
            continue
        flat = (bins[rows] + np.arange(features) * n_bins).ravel()
        gs = np.bincount(flat, np.repeat(g, features), features * n_bins).reshape(features, n_bins).cumsum(1)
        hs = np.bincount(flat, np.repeat(h, features), features * n_bins).reshape(features, n_bins).cumsum(1)
        ns = np.bincount(flat, minlength=features * n_bins).reshape(features, n_bins).cumsum(1)
        gain = gs**2 / (hs + ridge) + (g.sum() - gs) ** 2 / (h.sum() - hs + ridge) - g.sum() ** 2 / (h.sum() + ridge)
        gain[(ns < least) | (len(rows) - ns < least)] = -1
        f, b = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[f, b] <= 1e-9:
            continue
        above = bins[rows, f] > b
        todo += [(rows[~above], [*path, (int(f), int(b), False)]), (rows[above], [*path, (int(f), int(b), True)])]
    return out


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; the intercept is free."""
    n, d = x.shape
    mean = x.mean(0)
    z = (x - mean).astype(np.float32)
    v = np.ones(d, np.float32)
    for _ in range(20):  # largest curvature by power iteration
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * float(np.linalg.norm(z.T @ (z @ v))) / n + 0.25 + 1e-9)
    w, b, wv, bv, t = np.zeros(d), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), np.zeros(d), 0.0, 1.0
    bv = b
    for _ in range(rounds):
        r = sigmoid(z @ wv.astype(np.float32) + bv) - y
        new = wv - step * (z.T @ r.astype(np.float32)) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = bv - step * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wv, bv = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return w, b - float(mean @ w)
