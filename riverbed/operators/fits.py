"""Linear fits by sums: the data is aggregated to a matrix of columns by columns, and only that reaches the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, cols: list[Column], target: Column, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products of all columns with each other and with the target: one aggregate with map-side combining, one row for the driver."""
    k, w = len(cols), F.lit(1.0) if weight is None else weight
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(*[F.sum(w * cols[i] * cols[j]) for i, j in pairs], *[F.sum(w * c * target) for c in cols]).first()
    a = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[: len(pairs)], strict=True):
        a[i, j] = a[j, i] = v or 0.0
    return a, np.array([v or 0.0 for v in row[len(pairs) :]])


def ridge(df: DataFrame, cols: list[str], target: str, penalty: float) -> np.ndarray:
    """Coefficients and an intercept that is not penalised; rows with a missing value don't count."""
    a, b = gram(df.dropna(subset=[*cols, target]), [*[F.col(c) for c in cols], F.lit(1.0)], F.col(target))
    if a[-1, -1] == 0:
        return np.zeros(len(cols) + 1)
    return np.linalg.solve(a + penalty * np.diag([1.0] * len(cols) + [0.0]), b)


def linear(cols: list[str], w: np.ndarray) -> Column:
    """The fitted value as a column."""
    return sum((F.col(c) * float(v) for c, v in zip(cols, w[:-1], strict=True)), F.lit(float(w[-1])))


def logistic(df: DataFrame, cols: list[str], target: str, strength: float, rounds: int = 25) -> np.ndarray:
    """Coefficients and intercept of a logistic regression of a 0/1 target with squared penalty 1 / (2 strength), by Newton steps of one aggregate each."""
    df = df.dropna(subset=[*cols, target])
    design = [*[F.col(c) for c in cols], F.lit(1.0)]
    w, hold = np.zeros(len(design)), np.append(np.full(len(cols), 1 / strength), 1e-12)
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), linear(cols, w)))))
        spread = p * (1 - p)
        a, b = gram(df, design, (p - F.col(target)) / spread, spread)
        step = np.linalg.solve(a + np.diag(hold), b + hold * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w
