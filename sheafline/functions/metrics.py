"""Vector distances in single precision, and the scores made of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("COSINE", "EUCLIDEAN", "MANHATTAN")
#: Scores are distances times this, cut off to whole numbers.
SCALE = 10_000


def distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Column after column, so that sums run left to right in single precision."""
    n, d = x.shape
    zero = lambda: np.zeros(n, np.float32)
    if metric == "COSINE":
        dot, a, b = zero(), zero(), np.float32(0)
        for i in range(d):
            dot += x[:, i] * q[i]
            a += x[:, i] * x[:, i]
            b += q[i] * q[i]
        norms = np.sqrt(a) * np.sqrt(b)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.float32(1) - dot / norms
        return np.where((a == 0) | (b == 0), np.float32(0), out)
    total = zero()
    for i in range(d):
        gap = x[:, i] - q[i]
        total += np.abs(gap) if metric == "MANHATTAN" else gap * gap
    return total if metric == "MANHATTAN" else np.sqrt(total)


def score(distance: Column) -> Column:
    """Distances as whole numbers, cut off."""
    return (distance * F.lit(float(SCALE)).cast("float")).cast("float").cast("int")
