"""Resampling and stress analysis on tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.functions import special as sp
from riskflow.functions.linalg import gram
from riskflow.operators import ordered as od

# cumulative Poisson(1) probabilities: 0, 1, 2, ... copies
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)]).tolist()


def _uniform(*cols) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def weighted_mean(x: Column, weight: Column) -> Column:
    return F.sum(x * weight) / F.sum(weight)


def mean_difference(x: Column, first: Column) -> Column:
    """Mean of the rows where ``first`` holds less that of the others."""
    return F.avg(F.when(first, x)) - F.avg(F.when(~first, x))


def bootstrap_replicates(df: DataFrame, row_id: str, value: str, rounds: int = 200, seed: int = 42, chunk: int = 100,
                         statistic: Callable[[Column, Column], Column] = weighted_mean) -> DataFrame:
    """``statistic`` of ``value`` per replicate: an aggregate of (value, weight). Every row gets a Poisson(1) weight from a hash of
    its id and the replicate.

    Rows are exploded to ``chunk`` replicates at a time and summed in the same task, so only sums are shuffled.
    """
    x = F.col(value).cast("double")
    out = None
    for lo in range(0, rounds, chunk):
        b = F.explode(F.sequence(F.lit(lo), F.lit(min(lo + chunk, rounds) - 1)))
        rows = df.select(F.col(row_id).alias("_id"), x.alias("_x"), b.alias("b"))
        u = _uniform("_id", "b", F.lit(seed))
        weight = F.size(F.filter(F.array(*[F.lit(p) for p in _POISSON]), lambda p: p < u))
        sums = rows.select("b", "_x", weight.alias("w")).filter("w > 0").groupBy("b").agg(
            statistic(F.col("_x"), F.col("w")).alias("estimate"))
        out = sums if out is None else out.unionByName(sums)
    return out


def bootstrap_ci(df: DataFrame, row_id: str, value: str, rounds: int = 200, method: str = "bca", level: float = 0.95, seed: int = 42,
                 statistic: Callable[[Column, Column], Column] = weighted_mean) -> DataFrame:
    """Interval for a statistic of (value, weight), a mean by default: ``percentile``, ``bc`` (bias-corrected) or, for means, ``bca``.

    For other statistics ``bca`` is taken as ``bc``: their acceleration would need a value for each row left out.
    """
    x = F.col(value).cast("double")
    point, sd3, var, n = df.select(x.alias("x")).agg(
        statistic(F.col("x"), F.lit(1)), F.skewness("x"), F.var_pop("x"), F.count("x")).first()
    boot = np.array([r[0] for r in bootstrap_replicates(df, row_id, value, rounds, seed, statistic=statistic).select("estimate").collect()])
    tails = ((1 - level) / 2, (1 + level) / 2)
    z0, acc = 0.0, 0.0
    if method in ("bc", "bca"):
        z0 = sp.normal_ppf(float(np.clip((boot < point).mean(), 1 / (2 * rounds), 1 - 1 / (2 * rounds))))
    if method == "bca" and statistic is weighted_mean:
        # the jackknife means of a mean have the sample's own skewness, so no second pass is needed
        acc = (sd3 or 0.0) / (6 * math.sqrt(n))
    if method == "percentile":
        shares = tails
    else:
        shares = []
        for p in tails:
            z = z0 + sp.normal_ppf(p)
            shares.append(1 - sp.normal_sf(z0 + z / (1 - acc * z)))
    low, high = np.quantile(boot, shares)
    row = (float(point), float(low), float(high), float(boot.std(ddof=1)), float(boot.mean() - point), z0, acc)
    return df.sparkSession.createDataFrame([row], "estimate double, ci_low double, ci_high double, se double, bias double, z0 double, acceleration double")


def permutation_test(df: DataFrame, row_id: str, group: str, value: str, rounds: int = 200, alternative: str = "two-sided", seed: int = 42,
                     statistic: Callable[[Column, Column], Column] = mean_difference) -> DataFrame:
    """A statistic of (value, is in the first group), the difference of means by default, against hash-shuffled group labels (each row keeps the group-1 share as its chance)."""
    x, g = F.col(value).cast("double"), F.col(group)
    n, n1, real = df.agg(F.count(F.lit(1)), F.sum(g.cast("long")), statistic(x, g == 1)).first()
    rows = df.select(F.col(row_id).alias("_id"), x.alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("b"))
    one = _uniform("_id", "b", F.lit(seed)) < F.lit(n1 / n)
    sums = rows.groupBy("b").agg(statistic(F.col("_x"), one).alias("d"))
    far = {"two-sided": F.abs("d") >= abs(real), "greater": F.col("d") >= real, "less": F.col("d") <= real}[alternative]
    hits, mean, sd = sums.agg(F.count_if(far), F.avg("d"), F.stddev("d")).first()
    row = (float(real), (hits + 1) / (rounds + 1), float(mean), float(sd))
    return df.sparkSession.createDataFrame([row], "statistic double, p_value double, null_mean double, null_std double")


def bayes_linreg(df: DataFrame, xs: Sequence[str], y: str, tau: float = 1.0, sigma2: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Posterior (term, mean, sd) of a linear model with a normal prior, and rows with predictive mean, sd and quantiles."""
    g = gram(df, [*xs, y])
    if sigma2 is None:
        sigma2 = g.fit(xs, y)[1] / max(g.n - len(xs) - 1, 1)
    cols = ["1", *xs]
    cov = np.linalg.inv(tau * np.eye(len(cols)) + g.block(cols, cols) / sigma2)
    mean = cov @ g.block(cols, [y])[:, 0] / sigma2
    spark = df.sparkSession
    names = ["intercept", *xs]
    post = spark.createDataFrame([(c, float(m), math.sqrt(v)) for c, m, v in zip(names, mean, np.diag(cov))], "term string, mean double, sd double")
    terms = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    center = sum((t * float(m) for t, m in zip(terms, mean)), F.lit(0.0))
    form = sum((terms[i] * terms[j] * float(cov[i, j]) for i in range(len(cols)) for j in range(len(cols))), F.lit(0.0))
    pred = df.withColumns({"pred_mean": center, "pred_sd": F.sqrt(F.greatest(form, F.lit(0.0)))})
    return post, pred.withColumns({"pred_low": F.col("pred_mean") - 1.959963984540054 * F.col("pred_sd"),
                                   "pred_high": F.col("pred_mean") + 1.959963984540054 * F.col("pred_sd")})


def stress(df: DataFrame, scenarios: dict[str, dict[str, float]], score: Callable[[DataFrame], DataFrame], high: float = 0.7) -> DataFrame:
    """Scale features by each scenario's multipliers, rescore, and summarise. The scenario list is a literal array."""
    cols = sorted({c for s in scenarios.values() for c in s})
    table = F.array(*[F.struct(F.lit(n).alias("scenario"), *[F.lit(float(s.get(c, 1.0))).alias(f"_x_{c}") for c in cols]) for n, s in scenarios.items()])
    rows = df.withColumn("_s", F.explode(table)).select(*[
        (F.col(c).cast("double") * F.col(f"_s._x_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns], "_s.scenario")
    return score(rows).groupBy("scenario").agg(
        F.avg("risk_score").alias("mean_score"), F.stddev_pop("risk_score").alias("std_score"), F.max("risk_score").alias("max_score"),
        F.avg((F.col("risk_score") > high).cast("double")).alias("high_share"))


def var_es(df: DataFrame, key: str, col: str, levels: Sequence[float] = (0.95, 0.99, 0.999)) -> DataFrame:
    """Historical and normal value at risk and expected shortfall per key and level."""
    counts = df.groupBy(key, F.col(col).cast("double").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    sums = df.groupBy(key).agg(F.avg(F.col(col).cast("double")).alias("mu"), F.stddev_samp(F.col(col).cast("double")).alias("sd"))
    out = None
    for c in levels:
        q = od.group_quantile(df.withColumn("_r", F.col(col).cast("double")), [key], "_r", 1 - c, "q")
        tail = counts.join(q, key).filter(F.col("r") <= F.col("q")).groupBy(key).agg(
            (-F.max("q")).alias("var"), (-F.sum(F.col("r") * F.col("n")) / F.sum("n")).alias("es"))
        z = sp.normal_ppf(c)
        density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        part = tail.join(sums, key).select(
            key, F.lit(float(c)).alias("level"), "var", "es", (-(F.col("mu") - z * F.col("sd"))).alias("normal_var"),
            (-(F.col("mu") - F.col("sd") * (density / (1 - c)))).alias("normal_es"))
        out = part if out is None else out.unionByName(part)
    return out


def ensemble_uncertainty(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Mean and bootstrap deviation over model columns per row, exact; for up to four models also exact bootstrap quantiles."""
    k = len(models)
    xs = [F.col(m).cast("double") for m in models]
    mean = sum(xs[1:], xs[0]) / k
    var = sum(((x - mean) * (x - mean) for x in xs[1:]), (xs[0] - mean) * (xs[0] - mean)) / k
    out = {"ensemble_mean": mean, "ensemble_std": F.sqrt(var / k)}
    if k <= 4:
        draws = np.array(np.meshgrid(*[range(k)] * k)).reshape(k, -1).T
        sets = F.array(*[sum((xs[i] for i in d[1:]), xs[d[0]]) / k for d in draws.tolist()])
        ordered = F.array_sort(sets)
        for name, p in (("ensemble_low", 0.025), ("ensemble_high", 0.975)):
            spot = p * (len(draws) - 1)
            lo = math.floor(spot)
            out[name] = ordered[lo] + (ordered[min(lo + 1, len(draws) - 1)] - ordered[lo]) * (spot - lo)
    return df.withColumns(out)


def normal_score_corr(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Correlation of normal scores of the ranks (a, b, correlation). Scores are made per distinct value and joined back."""
    out = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    n = out.count()
    for c in cols:
        t = od.ranked_totals(out, c, {"_n": F.lit(1).cast("long")})
        mid = (F.col("_n_cum") - (F.col("_n") - 1) / 2) / F.lit(n + 1.0)
        out = out.join(t.select(c, sp.normal_ppf_col(mid).alias(f"_z_{c}")), c)
    m = gram(out, [f"_z_{c}" for c in cols]).correlation([f"_z_{c}" for c in cols])
    rows = [(a, b, float(m[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, correlation double")
