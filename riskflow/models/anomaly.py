"""Anomaly scores: isolation forest, local outlier factor, robust Mahalanobis distance, and their blend."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.functions.linalg import gram
from riskflow.operators import neighbours as nb
from riskflow.operators import ordered as od
from riskflow.session import cut


def _norm_length(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng, depth: int, nodes: list) -> int:
    at = len(nodes)
    spans = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) else []
    if depth == 0 or len(x) <= 1 or not len(spans):
        nodes.append((-1, 0.0, -1, -1, _norm_length(len(x))))
        return at
    f = int(rng.choice(spans))
    at_most = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    nodes.append(None)
    left = _grow(x[x[:, f] <= at_most], rng, depth - 1, nodes)
    right = _grow(x[x[:, f] > at_most], rng, depth - 1, nodes)
    nodes[at] = (f, at_most, left, right, 0.0)
    return at


def fit_isolation_forest(df: DataFrame, cols: Sequence[str], ident: str, trees: int = 100, size: int = 256, seed: int = 42) -> dict:
    """Each tree sees ``size`` rows picked by hash and is grown in its own task. The forest has a fixed size.

    A row is offered to the trees whose hash of it falls below twice their share of the table: one pass, one rule for all sizes.
    """
    cols = list(cols)
    base = df.select(ident, *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    n = base.count()
    bound = int((1 << 30) * min(1.0, 2 * size / max(1, n)))
    offered = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.col(ident), t, F.lit(seed + 1)), F.lit(1 << 30)) < bound)
    picked = base.withColumn("tree", F.explode(offered))
    order = Window.partitionBy("tree").orderBy(F.xxhash64(ident, "tree", F.lit(seed)), ident)
    sample = picked.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= size)
    depth = math.ceil(math.log2(size))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        nodes: list = []
        _grow(pdf.sort_values("_r")[cols].to_numpy(float), np.random.default_rng(seed * 100_003 + tree), depth, nodes)
        return pd.DataFrame([(tree, i, *v) for i, v in enumerate(nodes)], columns=["tree", "node", "feature", "cut", "left", "right", "extra"])

    rows = sample.select("tree", "_r", *cols).groupBy("tree").applyInPandas(
        grow, "tree int, node int, feature int, cut double, left int, right int, extra double").collect()
    forest: dict = {}
    for r in sorted(rows, key=lambda r: (r["tree"], r["node"])):
        forest.setdefault(r["tree"], []).append((r["feature"], r["cut"], r["left"], r["right"], r["extra"]))
    return {"cols": cols, "size": min(size, n), "trees": [np.array(t) for _, t in sorted(forest.items())]}


def isolation_score(df: DataFrame, forest: dict, ident: str, name: str = "isolation") -> DataFrame:
    """(id, score): near 1 for rows that are isolated after few splits."""
    cols, trees, scale = forest["cols"], forest["trees"], _norm_length(forest["size"])

    def score(batches):
        for pdf in batches:
            x = pdf[cols].to_numpy(float)
            total = np.zeros(len(x))
            for t in trees:
                feature, cut, left, right, extra = t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int), t[:, 4]
                at, length = np.zeros(len(x), int), np.zeros(len(x))
                while True:
                    inner = np.flatnonzero(feature[at] >= 0)
                    if not len(inner):
                        break
                    here = at[inner]
                    at[inner] = np.where(x[inner, feature[here]] <= cut[here], left[here], right[here])
                    length[inner] += 1
                total += length + extra[at]
            yield pd.DataFrame({ident: pdf[ident], name: 2.0 ** (-total / len(trees) / scale)})

    kind = df.schema[ident].dataType.simpleString()
    base = df.select(ident, *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    return base.mapInPandas(score, f"`{ident}` {kind}, `{name}` double")


def _scaled(df: DataFrame, cols: Sequence[str], mean: Sequence[float], std: Sequence[float]) -> DataFrame:
    """Rows without missing or not-a-number features, with a row id ``_q`` and the scaled features ``_x``."""
    x = F.array(*[(F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(cols, mean, std)])
    whole = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols]
    return df.filter(reduce(and_, whole)).withColumns({"_x": x, "_q": F.monotonically_increasing_id()})


def fit_lof(train: DataFrame, cols: Sequence[str], k: int = 20) -> dict:
    """Neighbourhood model of a training table of any size: its distinct places with their distance to the k-th other row and their
    local density, as the table ``points`` (_p, _x, kdist, lrd). Rows with missing features are left out."""
    cols = list(cols)
    clean = train.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    row = clean.agg(*[f(c) for c in cols for f in (F.avg, F.stddev_pop)]).first()
    mean, std = [x or 0.0 for x in row[::2]], [x or 1.0 for x in row[1::2]]
    rows = cut(_scaled(clean, cols, mean, std).select(F.col("_q").alias("_p"), "_x"))
    k = min(k, max(1, rows.count() - 1))
    points = cut(nb.distinct_points(rows, k + 1))
    near = cut(nb.nearest(points.select(F.col("_p").alias("_q"), "_x"), points, k, others=True))
    kdist = near.groupBy(F.col("_q").alias("_p")).agg(F.max("_d").alias("kdist"))
    lrd = near.join(kdist, "_p").groupBy("_q").agg((1 / F.greatest(F.avg(F.greatest("_d", "kdist")), F.lit(1e-10))).alias("lrd"))
    return {"cols": cols, "mean": mean, "std": std, "k": k, "points": cut(points.join(kdist, "_p").join(lrd.withColumnRenamed("_q", "_p"), "_p"))}


def lof_score(df: DataFrame, model: dict, ident: str, name: str = "lof") -> DataFrame:
    """(id, factor): density around the row's neighbours over its own, against the training table; a row that is in that
    table counts among its own neighbours. One row for each without missing features."""
    rows = cut(_scaled(df, model["cols"], model["mean"], model["std"]).select(F.col(ident).alias("_id"), "_q", "_x"))
    points = model["points"]
    places = cut(rows.groupBy("_x").agg(F.min("_q").alias("_q")))  # rows in one place have the same neighbours
    near = nb.nearest(places.select("_q", "_x"), points.select("_p", "_x"), model["k"])
    reach = F.greatest(F.avg(F.greatest("_d", "kdist")), F.lit(1e-10))
    factor = near.join(points.select("_p", "kdist", "lrd"), "_p").groupBy("_q").agg((F.avg("lrd") * reach).alias(name))
    return rows.select("_x", F.col("_id").alias(ident)).join(places.join(factor, "_q"), "_x").select(ident, name)


def mahalanobis(cols: Sequence[str], mean: np.ndarray, precision: np.ndarray):
    """Squared distance as an expression."""
    d = [F.col(c).cast("double") - float(m) for c, m in zip(cols, mean)]
    return sum((d[i] * d[j] * float(precision[i, j]) for i in range(len(d)) for j in range(len(d))), F.lit(0.0))


def fit_elliptic(df: DataFrame, cols: Sequence[str], support: float = 0.8, rounds: int = 100) -> dict:
    """Robust centre and scatter: keep the closest share of the rows, refit, until that changes nothing; an error if it always does."""
    cols, last = list(cols), None
    part = base = cut(df.select(*cols))  # read three times a round
    for _ in range(rounds):
        g = gram(part, cols)
        s = g.block(["1"], cols)[0]
        cov = (g.block(cols, cols) - np.outer(s, s) / g.n) / g.n
        mean, precision = s / g.n, np.linalg.pinv(cov)
        if last is not None and abs(np.linalg.det(cov) - last) <= 1e-9 * abs(last):
            break
        last = np.linalg.det(cov)
        far = base.select(*cols, mahalanobis(cols, mean, precision).alias("_d"))
        bound = od.quantiles(far, "_d", [support])[0]
        part = far.filter(F.col("_d") <= bound)
    else:
        raise RuntimeError(f"the ellipse did not settle in {rounds} rounds")
    return {"cols": cols, "mean": mean, "precision": precision}


def elliptic_score(df: DataFrame, model: dict, name: str = "elliptic") -> DataFrame:
    return df.withColumn(name, mahalanobis(model["cols"], model["mean"], model["precision"]))


def score_bounds(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest training value of each score."""
    row = df.agg(*[f(n).alias(f"{n}_{f.__name__}") for n in names for f in (F.min, F.max)]).first()
    return {n: (float(row[f"{n}_min"]), float(row[f"{n}_max"])) for n in names}


def anomaly_blend(df: DataFrame, bounds: dict[str, tuple[float, float]], inverted: Sequence[str] = (), name: str = "anomaly") -> DataFrame:
    """Mean of the scores scaled to [0, 1] by training bounds; ``inverted`` ones count as larger = more normal."""
    parts = []
    for n, (lo, hi) in bounds.items():
        unit = F.lit(0.5) if hi <= lo else F.least(F.greatest((F.col(n) - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
        parts.append(1 - unit if n in inverted else unit)
    return df.withColumn(name, sum(parts[1:], parts[0]) / len(parts))


def garch_moments(df: DataFrame, key: str, order: Sequence[str], col: str, minimum: int = 30) -> DataFrame:
    """GARCH(1,1) per key in closed form: squared returns follow an ARMA(1,1), so their autocorrelations at lags one and
    two give persistence and parameters. Also the conditional volatility after the last row.

    Everything is a grouped sum, so a long series of one key is never gathered in one task.
    """
    order = list(order)
    hot = od.find_hot(df, [key])
    sq = df.select(key, *order, F.pow(F.col(col).cast("double"), 2.0).alias("_s"))
    lagged = od.shifted(sq, [key], order, {"_s1": ("_s", 1), "_s2": ("_s", 2)}, hot)
    stat = lagged.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("_s").alias("var"), F.var_pop("_s").alias("_v"),
                                   F.corr("_s", "_s1").alias("_r1"), F.corr("_s", "_s2").alias("_r2")).filter(F.col("n") >= minimum)
    r1, r2 = F.greatest(F.coalesce("_r1", F.lit(0.0)), F.lit(1e-4)), F.coalesce("_r2", F.lit(0.0))
    phi = F.least(F.greatest(r2 / r1, F.lit(1e-3)), F.lit(0.999))
    b = F.try_divide(phi * phi + 1 - 2 * r1 * phi, phi - r1)
    beta = F.when((phi > r1) & (b >= 2), (b - F.sqrt(F.greatest(b * b - 4, F.lit(0.0)))) / 2).otherwise(0.0)
    fit = stat.select(key, "n", "var", phi.alias("persistence"), F.least(beta, phi).alias("beta")).withColumns({
        "alpha": F.col("persistence") - F.col("beta"), "omega": F.col("var") * (1 - F.col("persistence"))})
    # all rows of a key count, however far back: their places are running counts, which hot keys split
    placed = od.running(sq, [key], order[0], {"_at": F.lit(1).cast("long")}, hot, tie=order[1:])
    ends = placed.groupBy(key).agg(F.max("_at").alias("_end"))
    decay = F.pow(F.col("beta"), F.col("_end") - F.col("_at"))
    last = placed.join(fit, key).join(ends, key).groupBy(key).agg(F.sqrt(F.max(F.col("omega") / (1 - F.col("beta"))) + F.sum(
        F.col("alpha") * decay * F.col("_s"))).alias("last_volatility"))
    return fit.join(last, key)
