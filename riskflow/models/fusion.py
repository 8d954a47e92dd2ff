"""Fusing model probabilities, and the whole risk system: fit, score, explain, decide."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.functions import scalars as sc
from riskflow.models import anomaly as an
from riskflow.models.supervised import Scorecard, TabularModel
from riskflow.operators import encoding as en
from riskflow.session import cut


def fuse_fit(df: DataFrame, ps: Sequence[str], y: str, rounds: int = 500, alpha: float = 1.0, tol: float = 1e-5) -> dict[str, float]:
    """Mixture weights of the models by expectation-maximisation under a Dirichlet prior: one aggregate per round.

    It ends when the weights, or the likelihood that is left to gain, change by less than ``tol``, and is an error before.
    """
    k = len(ps)
    clip = lambda p: F.greatest(F.least(F.col(p).cast("double"), F.lit(1 - 1e-6)), F.lit(1e-6))
    like = {p: F.when(F.col(y) == 1, clip(p)).otherwise(1 - clip(p)) for p in ps}
    columns = [f"l{i}" for i in range(k)]
    # equal rows add up alike: they are counted once, so that a round reads no more than the different ones
    base = cut(df.select(*[e.alias(c) for c, e in zip(columns, like.values())]).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")))
    weights = [1.0 / k] * k
    for _ in range(rounds):
        total = sum((F.col(f"l{i}") * w for i, w in enumerate(weights)), F.lit(0.0))
        got = base.agg(F.sum("n"), *[F.sum(F.col("n") * F.col(f"l{i}") * weights[i] / total) for i in range(k)]).first()
        fresh = [(got[i + 1] + alpha - 1) / (got[0] + k * alpha - k) for i in range(k)]
        # under a flat prior, this is how far the likelihood per row can be from its best
        gap = max(got[i + 1] / (got[0] * w) for i, w in enumerate(weights) if w > 0) - 1 if alpha == 1 else math.inf
        change, weights = max(abs(a - b) for a, b in zip(fresh, weights)), fresh
        if min(change, gap) < tol:
            break
    else:
        if tol > 0:
            raise RuntimeError(f"the weights did not settle in {rounds} rounds")
    return dict(zip(ps, weights))


def _simplex_step(g: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The step d that maximises g d - d h d / 2 with sum 0 and w + d >= 0: solved on the coordinates left free, until none falls below 0
    and none that is held would gain by being free."""
    free = np.ones(len(w), bool)
    for _ in range(4 * len(w) + 4):
        at = np.flatnonzero(free)
        held = np.where(free, 0.0, -w)
        rest = g[at] - h[np.ix_(at, ~free)] @ held[~free]
        n = len(at)
        system = np.block([[h[np.ix_(at, at)] + 1e-13 * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
        solved = np.linalg.lstsq(system, np.append(rest, -held.sum()), rcond=None)[0]
        d = held.copy()
        d[at] = solved[:n]
        low = free & (w + d < -1e-15)
        if low.any():
            free &= ~low
            continue
        gain = g - h @ d - solved[n]
        more = ~free & (gain > 1e-12)
        if not more.any():
            return d
        free[np.argmax(np.where(more, gain, -np.inf))] = True
    return d


def fuse_newton(df: DataFrame, ps: Sequence[str], y: str, rounds: int = 60, alpha: float = 1.0, tol: float = 1e-8) -> dict[str, float]:
    """The same mixture weights by Newton's method on the simplex: gradient and curvature of the likelihood are one small aggregate a round.

    The mean log-likelihood is concave, so ``max(gradient) - 1`` bounds how far it is from its best; it ends when that is under ``tol`` (under a prior:
    when a step promises less) and is an error before. A step that lowers the likelihood is halved. No rows leave the weights equal.
    """
    k = len(ps)
    clip = lambda p: F.greatest(F.least(F.col(p).cast("double"), F.lit(1 - 1e-6)), F.lit(1e-6))
    base = df.select(*[F.when(F.col(y) == 1, clip(p)).otherwise(1 - clip(p)).alias(f"l{i}") for i, p in enumerate(ps)])
    upper = [(i, j) for i in range(k) for j in range(i, k)]

    def measured(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
        total = sum((F.col(f"l{i}") * float(x) for i, x in enumerate(w)), F.lit(0.0))
        got = base.agg(F.count("l0"), F.avg(F.log(total)), *[F.avg(F.col(f"l{i}") / total) for i in range(k)],
                       *[F.avg(F.col(f"l{i}") * F.col(f"l{j}") / (total * total)) for i, j in upper]).first()
        n = got[0]
        if not n:
            return 0.0, np.ones(k), np.eye(k), 0
        h = np.zeros((k, k))
        for (i, j), x in zip(upper, got[2 + k :]):
            h[i, j] = h[j, i] = x
        prior = (alpha - 1) / n
        with np.errstate(divide="ignore"):
            return got[1] + prior * float(np.log(w).sum() if prior else 0.0), np.array(got[2 : 2 + k]) + (prior / w if prior else 0), h + (np.diag(prior / w**2) if prior else 0), n

    w = np.full(k, 1.0 / k)
    value, g, h, n = measured(w)
    for _ in range(rounds):
        d = _simplex_step(g, h, w)
        if not n or (max(g) - 1 if alpha == 1 else float(g @ d)) < tol:
            return dict(zip(ps, w.tolist()))
        size = 1.0 if alpha == 1 else min(1.0, *(0.99 * -a / b for a, b in zip(w, d) if b < 0))
        while True:
            trial = np.maximum(w + size * d, 0.0)
            trial /= trial.sum()
            new = measured(trial)
            if new[0] > value or size < 1e-6:
                break
            size /= 2
        w, (value, g, h, n) = trial, new
    raise RuntimeError(f"the weights did not settle in {rounds} rounds")


def fuse_score(df: DataFrame, weights: dict[str, float], threshold: float | None = None, name: str = "risk_score") -> DataFrame:
    out = df.withColumn(name, sum((F.col(p) * w for p, w in weights.items()), F.lit(0.0)))
    return out if threshold is None else out.withColumn("flagged", sc.flag(F.col(name) >= threshold))


@dataclass
class RiskSystem:
    """Scorecard, boosted trees and anomaly scores, fused and thresholded by cost."""

    columns: list[str]
    label: str = "label"
    ident: str = "transaction_id"
    rounds: int = 30
    fuse_rounds: int = 60  # of Newton's method at most; few are needed
    scorecard: Scorecard | None = None
    tabular: TabularModel | None = None
    forest: dict = field(default_factory=dict)
    ellipse: dict = field(default_factory=dict)
    bounds: dict = field(default_factory=dict)
    weights: dict = field(default_factory=dict)
    threshold: float = 0.5

    MEMBERS = ("scorecard", "tabular", "anomaly")

    def fit(self, df: DataFrame) -> RiskSystem:
        df = cut(df.select(*dict.fromkeys([self.ident, self.label, *self.columns])))  # every part reads it many times
        self.scorecard = Scorecard(self.columns, self.label, min_iv=0.0).fit(df)
        self.tabular = TabularModel(self.columns, self.label, self.ident, rounds=self.rounds).fit(df)
        self.forest = an.fit_isolation_forest(df, self.columns, self.ident)
        self.ellipse = an.fit_elliptic(df, self.columns)
        self.bounds = an.score_bounds(self._raw_anomaly(df), ["isolation", "elliptic"])
        members = cut(self.members(df).select(self.ident, self.label, *self.MEMBERS))
        self.weights = fuse_newton(members, self.MEMBERS, self.label, self.fuse_rounds)
        best = en.optimal_threshold(fuse_score(members, self.weights), self.label, "risk_score").first()
        self.threshold = float(best["threshold"])
        return self

    def _raw_anomaly(self, df: DataFrame) -> DataFrame:
        lone = an.isolation_score(df, self.forest, self.ident)
        return an.elliptic_score(df.join(lone, self.ident, "left"), self.ellipse)

    def members(self, df: DataFrame, reasons: int = 0) -> DataFrame:
        out = self.tabular.transform(self.scorecard.transform(df, reasons=reasons))
        out = an.anomaly_blend(self._raw_anomaly(out), self.bounds)
        return out.withColumn("anomaly", F.coalesce("anomaly", F.lit(0.5))).drop("isolation", "elliptic")

    def score(self, df: DataFrame, reasons: int = 5) -> DataFrame:
        return fuse_score(self.members(df, reasons), self.weights, self.threshold)

    def score_batch(self, df: DataFrame, communities: DataFrame | None = None, key: str = "payer_id") -> DataFrame:
        """Scored rows with level, priority, action and minutes; members of a known community count as linked."""
        out = self.score(df)
        linked = F.lit(False)
        if communities is not None:
            # a node has a community for each method: one row per node, or scored rows would repeat
            known = communities.groupBy(F.col("node").alias(key)).agg(F.min("community_id").alias("community_id"))
            out = out.join(known, key, "left")
            linked = F.col("community_id").isNotNull()
        spread = F.greatest(*self.MEMBERS) - F.least(*self.MEMBERS)
        return sc.with_decision(out.withColumn("confidence", 1 - spread), "risk_score", "confidence", linked)
