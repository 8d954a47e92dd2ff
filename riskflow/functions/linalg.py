"""Least squares from sums of cross-products: one pass over the rows, a k x k solve on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Gram:
    """Cross-product matrix of the named columns plus a constant one."""

    names: list[str]
    values: np.ndarray
    n: float

    def block(self, rows: Sequence[str], cols: Sequence[str]) -> np.ndarray:
        at = {c: i for i, c in enumerate(self.names)}
        return self.values[np.ix_([at[c] for c in rows], [at[c] for c in cols])]

    def fit(self, xs: Sequence[str], y: str) -> tuple[np.ndarray, float]:
        """Coefficients (constant first) and residual sum of squares of y on a constant and xs."""
        cols = ["1", *xs]
        xty = self.block(cols, [y])[:, 0]
        beta = np.linalg.lstsq(self.block(cols, cols), xty, rcond=None)[0]
        rss = float(self.block([y], [y])[0, 0] - 2 * beta @ xty + beta @ self.block(cols, cols) @ beta)
        return beta, max(rss, 0.0)

    def total_ss(self, y: str) -> float:
        return float(self.block([y], [y])[0, 0] - self.block(["1"], [y])[0, 0] ** 2 / self.n)

    def correlation(self, cols: Sequence[str]) -> np.ndarray:
        s = self.block(["1"], cols)[0]
        cov = self.block(cols, cols) - np.outer(s, s) / self.n
        d = np.sqrt(np.diag(cov))
        return cov / np.outer(d, d)


def gram(df: DataFrame, cols: Sequence[str]) -> Gram:
    """Rows with a missing value are left out. Columns are centred on a first-pass mean, so large offsets lose nothing."""
    cols = list(cols)
    base = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    shift = base.agg(*[F.avg(c).alias(c) for c in cols]).first()
    z = {c: F.col(c) - F.lit(shift[c] or 0.0) for c in cols}
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    got = base.agg(F.count(F.lit(1)), *[F.sum(z[c]) for c in cols], *[F.sum(z[a] * z[b]) for a, b in pairs]).first()
    n, k = float(got[0]), len(cols)
    c = np.zeros((k + 1, k + 1))
    c[0, 0] = n
    for i in range(k):
        c[0, i + 1] = c[i + 1, 0] = got[1 + i] or 0.0
    for (a, b), v in zip(pairs, got[1 + k:]):
        i, j = cols.index(a) + 1, cols.index(b) + 1
        c[i, j] = c[j, i] = v or 0.0
    # back to uncentred columns: x = z + shift
    t = np.eye(k + 1)
    t[1:, 0] = [shift[x] or 0.0 for x in cols]
    return Gram(["1", *cols], t @ c @ t.T, n)
