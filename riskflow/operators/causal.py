"""Causal estimates: propensity, treatment effects, balance, sensitivity, instruments, precedence, mediation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.functions import special as sp
from riskflow.functions.linalg import gram
from riskflow.operators import drift as dr
from riskflow.operators import encoding as en
from riskflow.operators import ordered as od

Z95 = 1.959963984540054


def propensity(df: DataFrame, xs: Sequence[str], t: str, method: str = "logistic", seed: int = 42) -> DataFrame:
    """Add ``propensity``, the clipped chance of treatment given the covariates."""
    n, treated = df.agg(F.count(F.lit(1)), F.sum(F.col(t).cast("double"))).first()
    if not treated or treated == n:
        raise ValueError("propensities need rows of both arms")
    weight = F.when(F.col(t) == 1, n / (2 * treated)).otherwise(n / (2 * (n - treated)))
    base = df.withColumns({"_label": F.col(t).cast("double"), "_weight": weight})
    steps = [VectorAssembler(inputCols=list(xs), outputCol="_raw"),
             StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True)]
    common = dict(featuresCol="_x", labelCol="_label", weightCol="_weight", predictionCol="_pred", probabilityCol="_prob",
                  rawPredictionCol="_score")
    if method == "logistic":
        steps.append(LogisticRegression(regParam=1.0 / n, **common))
    else:
        steps.append(RandomForestClassifier(numTrees=100, maxDepth=10, seed=seed, **common))
    out = Pipeline(stages=steps).fit(base).transform(base)
    p = vector_to_array("_prob")[1]
    clipped = F.least(F.greatest(p, F.lit(0.01)), F.lit(0.99))
    return out.withColumn("propensity", clipped).select(*df.columns, "propensity")


def _effect(ate, se):
    return {"ate": ate, "se": se, "ci_low": ate - Z95 * se, "ci_high": ate + Z95 * se}


def _over(value, share, chance):
    """value / chance where the row has a share in the arm."""
    return F.when(share != 0, F.try_divide(value, chance)).otherwise(F.when(value.isNotNull(), 0.0))


def ate_ipw(df: DataFrame, t: str, y: str, e: str) -> DataFrame:
    """Inverse-propensity-weighted average effect with its standard error and interval. All are null if a row has an arm of no
    propensity, whose weight would be infinite, or if an arm has no rows."""
    tt, yy, ee = F.col(t).cast("double"), F.col(y).cast("double"), F.col(e)
    one, zero = _over(tt * yy, tt, ee), _over((1 - tt) * yy, 1 - tt, 1 - ee)
    sure = F.coalesce(F.count_if((tt > 0) & (ee == 0) | (tt < 1) & (ee == 1)) == 0, F.lit(True))
    got = df.agg(F.when(sure, F.avg(one) - F.avg(zero)).alias("ate"),
                 F.when(sure, F.sqrt(F.try_divide(F.var_pop(one), F.sum(tt)) + F.try_divide(F.var_pop(zero), F.sum(1 - tt)))).alias("se"))
    both = F.col("ate").isNotNull() & F.col("se").isNotNull()
    got = got.select(F.when(both, F.col("ate")).alias("ate"), "se")
    return got.select("ate", "se", (F.col("ate") - Z95 * F.col("se")).alias("ci_low"), (F.col("ate") + Z95 * F.col("se")).alias("ci_high"))


def outcome_models(df: DataFrame, xs: Sequence[str], t: str, y: str, seed: int = 42) -> DataFrame:
    """Add ``mu0`` and ``mu1``: outcome forests fitted on each arm and applied to every row."""
    out = VectorAssembler(inputCols=list(xs), outputCol="_x").transform(df.withColumn("_y", F.col(y).cast("double")))
    for arm in (0, 1):
        forest = RandomForestRegressor(featuresCol="_x", labelCol="_y", predictionCol=f"mu{arm}", numTrees=50, seed=seed)
        out = forest.fit(out.filter(F.col(t) == arm)).transform(out)
    return out.drop("_x", "_y")


def ate_dr(df: DataFrame, t: str, y: str, e: str, mu0: str = "mu0", mu1: str = "mu1") -> DataFrame:
    """Doubly robust effect from outcome predictions; the standard error comes from the influence values."""
    tt, yy, ee = F.col(t).cast("double"), F.col(y).cast("double"), F.col(e)
    score = (F.col(mu1) - F.col(mu0) + tt * (yy - F.col(mu1)) / ee - (1 - tt) * (yy - F.col(mu0)) / (1 - ee))
    got = df.agg(F.avg(score).alias("ate"), (F.stddev_pop(score) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return got.select("ate", "se", (F.col("ate") - Z95 * F.col("se")).alias("ci_low"), (F.col("ate") + Z95 * F.col("se")).alias("ci_high"))


def balance(df: DataFrame, xs: Sequence[str], t: str) -> DataFrame:
    """Standardised mean difference per covariate."""
    long = en.to_long(df.withColumn("_t", F.col(t)), {x: F.col(x).cast("double") for x in xs}, ["_t"], "covariate", "v")
    arm = lambda f, a: f(F.when(F.col("_t") == a, F.col("v")))
    stats = long.groupBy("covariate").agg(
        arm(F.avg, 1).alias("treated_mean"), arm(F.avg, 0).alias("control_mean"),
        F.sqrt((arm(F.var_samp, 1) + arm(F.var_samp, 0)) / 2).alias("pooled"))
    smd = F.coalesce(F.abs(F.try_divide(F.col("treated_mean") - F.col("control_mean"), "pooled")), F.lit(0.0))
    return stats.withColumn("smd", smd).withColumn("unbalanced", F.col("smd") > 0.1).drop("pooled")


def overlap(df: DataFrame, t: str, e: str) -> DataFrame:
    """Common range of the scores of both arms and their KS distance."""
    arm = lambda f, a: f(F.when(F.col(t) == a, F.col(e)))
    span = df.agg(F.greatest(arm(F.min, 1), arm(F.min, 0)).alias("overlap_low"), F.least(arm(F.max, 1), arm(F.max, 0)).alias("overlap_high"))
    ks = dr.ks_2samp(df.filter(F.col(t) == 1).select(e), df.filter(F.col(t) == 0).select(e), e)
    return span.crossJoin(ks.select(F.col("statistic").alias("ks"), F.col("p_value").alias("ks_p")))


def rosenbaum(df: DataFrame, t: str, y: str, e: str, tie: str, gammas: Sequence[float] = (1.0, 1.25, 1.5, 2.0, 3.0)) -> DataFrame:
    """Pairs the k-th treated with the k-th control by score, then bounds the signed-rank test for hidden bias."""
    base = df.select(F.col(t).alias("_t"), F.col(y).cast("double").alias("_y"), F.col(e).cast("double").alias("_e"), F.col(tie).alias("_id"))
    # place within the arm: two keys hold all rows, so this is a segmented running count
    placed = od.running(base, ["_t"], "_e", {"_k": F.lit(1).cast("long")}, tie=["_id"])
    treated = placed.filter("_t = 1").select("_k", F.col("_y").alias("y1"))
    control = placed.filter("_t = 0").select("_k", F.col("_y").alias("y0"))
    d = treated.join(control, "_k").select((F.round(F.col("y1") - F.col("y0"), 9)).alias("d")).filter("d <> 0")
    ranks = od.ranked_totals(d.withColumn("a", F.abs("d")), "a", {"n": F.lit(1).cast("long"), "up": (F.col("d") > 0).cast("long")})
    rank = F.col("n_cum") - (F.col("n") - 1) / 2
    w, s1, s2, n = ranks.agg(F.sum(rank * F.col("up")), F.sum(rank * F.col("n")), F.sum(rank * rank * F.col("n")), F.sum("n")).first()
    rows = []
    for g in gammas:
        hi, lo = g / (1 + g), 1 / (1 + g)
        z = [(w - p * s1) / math.sqrt(p * (1 - p) * s2) for p in (hi, lo)]
        rows.append((float(g), int(n), float(w), z[0], z[1], sp.normal_sf(z[0]), sp.normal_sf(z[1])))
    return df.sparkSession.createDataFrame(rows, "gamma double, pairs long, w_plus double, z_upper double, z_lower double, p_upper double, p_lower double")


def iv_2sls(df: DataFrame, xs: Sequence[str], t: str, y: str, z: str) -> DataFrame:
    """Two-stage least squares with whole-model and partial first-stage F, reduced form, and both standard errors."""
    g = gram(df, [*xs, t, y, z])
    n, k = g.n, len(xs)
    first, rss1 = g.fit([*xs, z], t)
    _, rss0 = g.fit(xs, t)
    f_all = (g.total_ss(t) - rss1) / (rss1 / (n - k - 2))
    f_partial = (rss0 - rss1) / (rss1 / (n - k - 2))
    reduced, _ = g.fit([*xs, z], y)
    inst, endo = ["1", *xs, z], ["1", *xs, t]
    beta = np.linalg.solve(g.block(inst, endo), g.block(inst, [y])[:, 0])
    # residuals on the predicted treatment (simple) and on the treatment itself (standard)
    h = np.zeros((k + 2, k + 2))
    h[: k + 1, : k + 1] = np.eye(k + 1)
    h[:, k + 1] = first
    a = g.block(inst, inst)
    hat = h @ beta
    rss_hat = float(g.block([y], [y])[0, 0] - 2 * hat @ g.block(inst, [y])[:, 0] + hat @ a @ hat)
    rss = float(g.block([y], [y])[0, 0] - 2 * beta @ g.block(endo, [y])[:, 0] + beta @ g.block(endo, endo) @ beta)
    cov = rss / (n - k - 2) * np.linalg.inv(h.T @ a @ h)
    est, se = float(beta[-1]), math.sqrt(max(cov[-1, -1], 0.0))
    row = (f_all, f_partial, bool(f_all > 10), float(reduced[-1]), est, math.sqrt(max(rss_hat, 0) / n / n), se, est - Z95 * se, est + Z95 * se)
    return df.sparkSession.createDataFrame([row], "first_stage_f double, partial_f double, relevant boolean, reduced_form double, "
                                           "iv_estimate double, se_simple double, se double, ci_low double, ci_high double")


def granger(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, y: str, lags: int = 5) -> DataFrame:
    """Does x help to predict y: F and p per lag length, and which one has the smallest p."""
    cols = {f"{c}_{i}": (c, i) for c in (x, y) for i in range(1, lags + 1)}
    base = od.shifted(df.select(*keys, *order, x, y), keys, order, cols, od.find_hot(df, keys))
    rows = []
    for lag in range(1, lags + 1):
        ys, xs = [f"{y}_{i}" for i in range(1, lag + 1)], [f"{x}_{i}" for i in range(1, lag + 1)]
        g = gram(base, [y, *ys, *xs])
        _, rss_r = g.fit(ys, y)
        _, rss_u = g.fit(ys + xs, y)
        dof = g.n - 2 * lag - 1
        if dof <= 0 or rss_r <= 0:
            f = None
        elif rss_u <= 1e-12 * rss_r:
            f = math.inf
        else:
            f = ((rss_r - rss_u) / lag) / (rss_u / dof)
        rows.append((lag, int(g.n), f, sp.f_sf(f, lag, dof) if f is not None else None))
    best = min((r for r in rows if r[3] is not None), key=lambda r: r[3], default=(None,))[0]
    return df.sparkSession.createDataFrame([r + (r[0] == best,) for r in rows], "lag int, n long, f double, p_value double, best boolean")


def mediation(df: DataFrame, xs: Sequence[str], t: str, m: str, y: str) -> DataFrame:
    """Paths a (t to m), b (m to y), total c, direct c', and the mediated share, from one matrix of cross-products."""
    g = gram(df, [*xs, t, m, y])
    a = g.fit([*xs, t], m)[0][-1]
    c = g.fit([*xs, t], y)[0][-1]
    full = g.fit([*xs, t, m], y)[0]
    direct, b = full[-2], full[-1]
    share = a * b / c if abs(c) > 1e-12 else None
    row = tuple(None if v is None else float(v) for v in (a, b, c, direct, a * b, share))
    return df.sparkSession.createDataFrame([row], "a double, b double, total double, direct double, indirect double, proportion double")


def causal_diagnostics(df: DataFrame, t: str, y: str, e: str, bins: int = 5) -> DataFrame:
    """Rows, mean outcome and mean score per arm and score quantile, with the effect in each quantile."""
    edges = od.quantiles(df, e, [i / bins for i in range(1, bins)])
    marks = F.array(*[F.lit(v) for v in edges])
    stratum = F.size(F.filter(marks, lambda v: v < F.col(e)))
    arm = lambda a, c: F.avg(F.when(F.col(t) == a, F.col(c).cast("double")))
    return df.groupBy(stratum.cast("long").alias("stratum")).agg(
        F.count_if(F.col(t) == 1).alias("treated"), F.count_if(F.col(t) == 0).alias("control"), arm(1, y).alias("treated_mean"),
        arm(0, y).alias("control_mean"), (arm(1, y) - arm(0, y)).alias("effect"), F.avg(e).alias("mean_score"))


def score_histogram(df: DataFrame, t: str, e: str, bins: int = 30) -> DataFrame:
    """Score density by arm over equal bins of [0, 1]."""
    at = F.least(F.floor(F.col(e) * bins), F.lit(bins - 1)).cast("long")
    return df.groupBy(F.col(t).alias("arm"), at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
