"""Distribution, drift and model-validation tests. Row-sized work is Spark; p-values come from a few sums."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.functions import scalars as sc
from riskflow.functions import special as sp
from riskflow.functions.linalg import gram
from riskflow.operators import encoding as en
from riskflow.operators import ordered as od
from riskflow.operators.profiles import tagged_union
from riskflow.session import cut

RESULT = ("test string, statistic double, p_value double, conclusion string, effect_size double, ci_low double, "
          "ci_high double, info map<string,double>")


def result(spark, test, statistic, p=None, conclusion=None, effect=None, ci=(None, None), **info) -> DataFrame:
    clean = lambda v: None if v is None else float(v)
    row = (test, clean(statistic), clean(p), conclusion, clean(effect), clean(ci[0]), clean(ci[1]),
           {k: clean(v) for k, v in info.items()})
    return spark.createDataFrame([row], RESULT)


# ---- two samples

def bin_shares(expected: DataFrame, actual: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Rows (feature, bin, e, a): counts of both samples in quantile bins of the expected one, all columns in one job."""
    tests = {}
    for c in cols:
        edges = sorted(set(od.quantiles(expected, c, [i / bins for i in range(1, bins)])))
        tests[c] = sc.edge_bin(F.col(c).cast("double"), edges)
    both = tagged_union(expected.select(*cols), actual.select(*cols))
    long = en.to_long(both, tests, ["grp"], value="bin").filter(F.col("bin").isNotNull())
    grid = long.groupBy("feature", "bin").agg(F.count_if(F.col("grp") == 0).alias("e"), F.count_if(F.col("grp") == 1).alias("a"))
    return grid


def _divergences(grid: DataFrame) -> DataFrame:
    per = Window.partitionBy("feature")  # a handful of bins per feature
    pe, pa = F.try_divide("e", F.sum("e").over(per)), F.try_divide("a", F.sum("a").over(per))
    shares = grid.select("feature", pe.alias("pe"), pa.alias("pa"))
    floor = lambda c, x: F.greatest(c, F.lit(x))
    e8, a8 = floor(F.col("pe"), 1e-8), floor(F.col("pa"), 1e-8)
    e10, a10 = floor(F.col("pe"), 1e-10), floor(F.col("pa"), 1e-10)
    m = floor((F.col("pe") + F.col("pa")) / 2, 1e-10)
    return shares.groupBy("feature").agg(
        F.sum((a8 - e8) * F.log(a8 / e8)).alias("psi"),
        F.sum(0.5 * e10 * F.log(e10 / m) + 0.5 * a10 * F.log(a10 / m)).alias("jsd"))


def psi(expected: DataFrame, actual: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    table = _divergences(bin_shares(expected, actual, cols, bins))
    return table.select("feature", "psi", sc.bin_col("psi", (0.1, 0.25), ("STABLE", "MINOR", "MAJOR")).alias("verdict"))


def js_divergence(expected: DataFrame, actual: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    table = _divergences(bin_shares(expected, actual, cols, bins))
    return table.select("feature", "jsd", F.when(F.col("jsd") < 0.1, "SIMILAR").otherwise("DIFFERENT").alias("verdict"))


def psi_interval(expected: DataFrame, actual: DataFrame, col: str, bins: int = 10, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """PSI with a bootstrap interval. Resampling rows only changes the bin counts, so the draws are multinomial."""
    rows = bin_shares(expected, actual, [col], bins).collect()
    e, a = np.array([r["e"] for r in rows], float), np.array([r["a"] for r in rows], float)

    def value(p, q):
        p, q = np.maximum(p, 1e-8), np.maximum(q, 1e-8)
        return ((q - p) * np.log(q / p)).sum(axis=-1)

    pe, pa = e / e.sum(), a / a.sum()
    draws = np.random.default_rng(seed).multinomial(int(a.sum()), pa, rounds) / a.sum()
    boot = value(pe, draws)
    point = float(value(pe, pa))
    verdict = "STABLE" if point < 0.1 else "MINOR" if point < 0.25 else "MAJOR"
    return result(expected.sparkSession, "psi", point, None, verdict, ci=tuple(np.percentile(boot, [2.5, 97.5])))


def ks_2samp(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance over distinct values, asymptotic p, pooled effect size. Nulls and NaN are no values; without
    values in either sample nothing is concluded."""
    both = tagged_union(a.select(F.col(col).cast("double").alias("x")), b.select(F.col(col).cast("double").alias("x")))
    both = both.filter(F.col("x").isNotNull() & ~F.isnan("x"))
    steps = od.ranked_totals(both, "x", {"na": (F.col("grp") == 0).cast("long"), "nb": (F.col("grp") == 1).cast("long")})
    tot = both.groupBy("grp").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")).collect()
    sides = {r["grp"]: (r["n"], r["m"], r["v"]) for r in tot}
    (n, ma, va), (m, mb, vb) = (sides.get(g, (0, None, None)) for g in (0, 1))
    if not n or not m:
        return result(a.sparkSession, "ks_2samp", None, None, None, None, n=n, m=m)
    d = steps.agg(F.max(F.abs(F.col("na_cum") / F.lit(n) - F.col("nb_cum") / F.lit(m)))).first()[0]
    p = sp.kolmogorov_sf(d * math.sqrt(n * m / (n + m)))
    pooled = math.sqrt((va + vb) / 2)
    return result(a.sparkSession, "ks_2samp", d, p, "DIFFERENT" if p < 0.05 else "SIMILAR",
                  (ma - mb) / pooled if pooled else 0.0, n=n, m=m)


def drift_report(reference: DataFrame, current: DataFrame, cols: Sequence[str], day: str = "day", bins: int = 10,
                 warn: float = 0.1, critical: float = 0.25) -> DataFrame:
    """PSI, JSD and KS distance per feature and day of the current sample, with an alert level. One job for all days."""
    edges = {c: sorted(set(od.quantiles(reference, c, [i / bins for i in range(1, bins)]))) for c in cols}
    tests = {c: sc.edge_bin(F.col(c).cast("double"), e) for c, e in edges.items()}
    ref = en.to_long(reference, tests, [], value="bin").filter("bin is not null").groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("e"))
    cur = en.to_long(current, tests, [day], value="bin").filter("bin is not null").groupBy(day, "feature", "bin").agg(F.count(F.lit(1)).alias("a"))
    days = cur.select(day, "feature").distinct()
    bins_seen = ref.select("feature", "bin").union(cur.select("feature", "bin")).distinct()  # also those that one sample lacks
    grid = (days.join(bins_seen, "feature").join(ref, ["feature", "bin"], "left").join(cur, [day, "feature", "bin"], "left")
            .fillna(0, ["e", "a"]))
    per = Window.partitionBy(day, "feature")
    pe, pa = F.try_divide("e", F.sum("e").over(per)), F.try_divide("a", F.sum("a").over(per))
    upto = per.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    shares = grid.select(day, "feature", pe.alias("pe"), pa.alias("pa"), F.abs(
        F.try_divide(F.sum("e").over(upto), F.sum("e").over(per)) - F.try_divide(F.sum("a").over(upto), F.sum("a").over(per))).alias("gap"))
    e8, a8 = F.greatest("pe", F.lit(1e-8)), F.greatest("pa", F.lit(1e-8))
    m = (e8 + a8) / 2
    out = shares.groupBy(day, "feature").agg(
        F.sum((a8 - e8) * F.log(a8 / e8)).alias("psi"),
        F.sum(0.5 * e8 * F.log(e8 / m) + 0.5 * a8 * F.log(a8 / m)).alias("jsd"), F.max("gap").alias("ks_binned"))
    return out.withColumn("alert", sc.bin_col("psi", (warn, critical), ("OK", "WARN", "CRITICAL")))


# ---- series

def arch_lm(df: DataFrame, key: str, order: Sequence[str], col: str) -> DataFrame:
    """Per key, n x R2 of squared values on the previous squared value, with its chi-square p."""
    sq = df.select(key, *order, F.pow(F.col(col).cast("double"), 2.0).alias("_y"))
    lagged = od.shifted(sq, [key], order, {"_x": ("_y", 1)}, od.find_hot(df, [key]))
    stat = lagged.filter(F.col("_x").isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.regr_r2("_y", "_x").alias("r2"))
    return stat.withColumn("lm", F.col("n") * F.col("r2")).withColumn("p_value", sp.chi2_sf_col("lm", F.lit(1.0)))


def burst_test(df: DataFrame, key: str = "payer_id", at: str = "s") -> DataFrame:
    """Dispersion of the gaps per key, two-sided chi-square p, Clark-Evans index and verdict."""
    order = [at, "transaction_id"]
    gaps = od.shifted(df.select(key, *order), [key], order, {"_p": (at, 1)}, od.find_hot(df, [key]))
    g = (F.col(at) - F.col("_p")).cast("double")
    sums = gaps.groupBy(key).agg(F.count(g).alias("n"), F.avg(g).alias("mean_interval"), F.var_pop(g).alias("var_interval"),
                                 F.count(F.lit(1)).alias("rows"), (F.max(at) - F.min(at)).alias("span"))
    fano = F.try_divide("var_interval", "mean_interval")
    out = sums.withColumn("fano", fano).withColumns({
        "chi2": (F.col("n") - 1) * F.col("fano"),
        "clark_evans": F.try_divide(F.col("mean_interval"), F.try_divide("span", 2 * F.col("rows"))),
        "verdict": F.when(F.col("fano") > 1.5, "BURSTY").when(F.col("fano") < 0.67, "REGULAR").otherwise("POISSON"),
    }).drop("rows", "span")
    upper = sp.chi2_sf_col("chi2", (F.col("n") - 1).cast("double"))
    return out.withColumn("p_value", upper).withColumn("p_value", 2 * F.least(F.col("p_value"), 1 - F.col("p_value")))


def runs_test(df: DataFrame, order: Sequence[str], y: str, p: str) -> DataFrame:
    """Runs of Pearson residuals above their median, in order over the whole table."""
    prob = F.col(p).cast("double")
    base = df.select(F.lit(0).alias("_all"), *order, ((F.col(y) - prob) / F.sqrt(prob * (1 - prob))).alias("_r"))
    median = od.quantiles(base, "_r", [0.5])[0]
    signs = base.withColumn("_up", (F.col("_r") > F.lit(median)).cast("int"))
    lagged = od.shifted(signs, ["_all"], order, {"_was": ("_up", 1)})
    n1, n, changes = lagged.agg(F.sum("_up"), F.count(F.lit(1)), F.count_if(F.col("_was") != F.col("_up"))).first()
    n2 = n - n1
    runs = changes + 1
    mean = 2 * n1 * n2 / n + 1
    var = 2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1)) if n > 1 else 0
    z = (runs - mean) / math.sqrt(var) if var > 0 else 0.0
    pv = 2 * sp.normal_sf(abs(z))
    return result(df.sparkSession, "runs_test", z, pv, "RANDOM" if pv >= 0.05 else "PATTERN", runs=runs, n1=n1, n2=n2, expected=mean)


# ---- tails

def exceedances(df: DataFrame, keys: Sequence[str], col: str, q: float = 0.95) -> DataFrame:
    """Distinct excesses over each key's quantile, with their multiplicity."""
    cut = od.group_quantile(df, keys, col, q, "threshold")
    counts = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("m"))
    y = F.col(col).cast("double") - F.col("threshold")
    return counts.join(cut, list(keys)).filter(y > 0).select(*keys, "threshold", F.col(col).alias("_x"), y.alias("y"), "m")


def gpd_fit(df: DataFrame, keys: Sequence[str], col: str, q: float = 0.95, minimum: int = 10) -> DataFrame:
    """Generalised Pareto fit of the excesses per key by probability-weighted moments, with its KS distance."""
    keys = list(keys)
    hot = od.find_hot(df, keys)
    ranked = od.running(exceedances(df, keys, col, q), keys, "_x", {"c": F.col("m")}, hot)
    totals = ranked.groupBy(*keys).agg(F.sum("m").alias("n"), F.max("threshold").alias("threshold"))
    c, m, n = F.col("c"), F.col("m"), F.col("n")
    # a value holding ranks c-m+1..c: sum of (n - rank)
    weight = m * n - (m * (2 * c - m + 1)) / 2
    rows = ranked.drop("threshold").join(totals, keys)
    moments = rows.groupBy(*keys).agg(
        (F.sum(F.col("y") * m) / F.sum(m)).alias("a0"),
        F.try_divide(F.sum(weight * F.col("y")), F.max(n) * (F.max(n) - 1)).alias("a1"))
    gap = F.col("a0") - 2 * F.col("a1")
    fit = totals.join(moments, keys).filter(n >= minimum).withColumns({
        "xi": 2 - F.try_divide("a0", gap), "sigma": F.try_divide(2 * F.col("a0") * F.col("a1"), gap)})
    scored = rows.drop("n").join(fit.select(*keys, "xi", "sigma", "n"), keys).withColumn(
        "cdf", 1 - gpd_tail(F.col("y"), F.col("xi"), F.col("sigma")))
    ks = scored.groupBy(*keys).agg(F.max(F.greatest(F.abs(c / n - F.col("cdf")), F.abs(F.col("cdf") - (c - m) / n))).alias("ks"))
    return fit.join(ks, keys).drop("a0", "a1")


def gpd_tail(y, xi, sigma):
    """Probability of a larger excess."""
    base = F.greatest(1 + xi * y / sigma, F.lit(0.0))
    return F.when(F.abs(xi) < 1e-9, F.exp(-y / sigma)).when(base <= 0, 0.0).otherwise(F.pow(base, -1 / xi))


def gpd_score(df: DataFrame, fit: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Tail probability of each row beyond its key's threshold (1 below it)."""
    fit = cut(fit.select(*keys, "threshold", "xi", "sigma"))
    # few keys hold many rows each, which a shuffled join would deal to as few tasks
    joined = df.join(F.broadcast(fit) if fit.count() <= od.MAX_HOT else fit, list(keys), "left")
    y = F.col(col).cast("double") - F.col("threshold")
    return joined.withColumn("tail_probability", F.when(y > 0, gpd_tail(y, F.col("xi"), F.col("sigma"))).otherwise(1.0)).drop("threshold", "xi", "sigma")


def gpd_var(fit: DataFrame, totals: DataFrame, keys: Sequence[str], p: float = 0.99) -> DataFrame:
    """Tail quantile per key; ``totals`` brings ``total`` rows per key."""
    ratio = F.col("total") / F.col("n") * (1 - p)
    heavy = F.col("threshold") + F.col("sigma") / F.col("xi") * (F.pow(ratio, -F.col("xi")) - 1)
    light = F.col("threshold") - F.col("sigma") * F.log(ratio)
    return fit.join(totals, list(keys)).withColumn("tail_var", F.when(F.abs("xi") < 1e-9, light).otherwise(heavy))


def mean_excess(df: DataFrame, col: str, qs: Sequence[float]) -> DataFrame:
    """Mean excess over each quantile threshold. Rows are counted by how many thresholds they pass."""
    cuts = od.quantiles(df, col, qs)
    marks = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.lit(c).alias("threshold")) for q, c in zip(qs, cuts)])
    x = F.col(col).cast("double")
    passed = F.filter(marks, lambda t: t.threshold < x)
    # at most len(qs) + 1 groups leave the scan
    groups = df.groupBy(F.size(passed).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"))
    each = groups.select("g", "n", "s", F.posexplode(marks)).filter(F.col("g") > F.col("pos"))
    return each.groupBy("col.q", "col.threshold").agg(
        F.sum("n").alias("n"), (F.sum("s") / F.sum("n") - F.first("col.threshold")).alias("mean_excess"))


# ---- classifiers

def mcnemar(df: DataFrame, y: str, p1: str, p2: str, threshold: float = 0.5) -> DataFrame:
    """Disagreements of two classifiers: exact binomial below ten, corrected chi-square from there."""
    right = lambda p: (F.col(p) >= threshold).cast("int") == F.col(y)
    a, b, c, d = df.agg(F.count_if(right(p1) & right(p2)), F.count_if(right(p1) & ~right(p2)),
                        F.count_if(~right(p1) & right(p2)), F.count_if(~right(p1) & ~right(p2))).first()
    exact = b + c < 10
    stat = float(min(b, c)) if exact else (abs(b - c) - 1) ** 2 / (b + c)
    p = sp.binomial_two_sided(b, b + c) if exact else sp.chi2_sf(stat, 1)
    return result(df.sparkSession, "mcnemar", stat, p, "DIFFERENT" if p < 0.05 else "SIMILAR", n11=a, n10=b, n01=c, n00=d)


def importance_stability(long: DataFrame) -> DataFrame:
    """Variation of each feature's importance over folds, Friedman's test and Kendall's W. Input: feature, fold, importance."""
    mine = Window.partitionBy("fold").orderBy(F.desc("importance"))
    ties = Window.partitionBy("fold", "importance")
    # a row per feature and fold: the windows are as small as the feature list
    ranked = long.withColumn("r", F.rank().over(mine) + (F.count(F.lit(1)).over(ties) - 1) / 2)
    per = ranked.groupBy("feature").agg(F.sum("r").alias("rs"), F.count(F.lit(1)).alias("folds"),
                                        (F.stddev_pop("importance") / F.avg("importance")).alias("cv"))
    k, n, cv, s2, best, worst = per.agg(
        F.count(F.lit(1)), F.max("folds"), F.avg("cv"), F.sum(F.col("rs") * F.col("rs")), F.min_by("feature", "cv"),
        F.max_by("feature", "cv")).first()
    s = s2 - k * (n * (k + 1) / 2) ** 2
    w = 12 * s / (n * n * (k ** 3 - k))
    friedman = n * (k - 1) * w
    text = f"most stable {best}, least stable {worst}"
    return result(long.sparkSession, "importance_stability", w, sp.chi2_sf(friedman, k - 1), text, mean_cv=cv, friedman=friedman)


def hosmer_lemeshow(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Observed against expected positives by bin. A bin sure of its outcome adds nothing if right, and makes the statistic infinite if not; no
    rows give no statistic."""
    base = df.select(F.col(p).cast("double").alias("p"), F.col(y).cast("double").alias("y"))
    edges = od.quantiles(base, "p", [i / bins for i in range(1, bins)])
    marks = F.array(*[F.lit(e) for e in edges])
    groups = base.groupBy(F.size(F.filter(marks, lambda e: e <= F.col("p"))).alias("bin")).agg(
        F.sum("y").alias("o"), F.sum("p").alias("e"), F.count(F.lit(1)).alias("n"))
    off, spread = F.pow(F.col("o") - F.col("e"), 2.0), F.col("e") * (1 - F.col("e") / F.col("n"))
    part = F.when(spread > 0, F.try_divide(off, spread)).when(off > 0, F.lit(float("inf"))).otherwise(0.0)
    stat, used = groups.agg(F.sum(part), F.count(F.lit(1))).first()
    pv = (0.0 if math.isinf(stat) else sp.chi2_sf(stat, used - 2)) if used > 2 else None
    return result(df.sparkSession, "hosmer_lemeshow", stat, pv, "CALIBRATED" if pv is None or pv >= 0.05 else "MISCALIBRATED", bins=used)


def _auc_parts(df: DataFrame, y: str, p: str):
    """AUC, class sizes, and the placement variances of DeLong's estimate."""
    t = en.score_totals(df, y, p)
    tot = t.agg(F.sum("pos").alias("n1"), F.sum("n").alias("n")).first()
    n1, n0 = tot["n1"] or 0, (tot["n"] or 0) - (tot["n1"] or 0)
    if not n1 or not n0:
        return None, n1, n0, None, None
    neg = F.col("n") - F.col("pos")
    neg_below = F.col("n_cum") - F.col("pos_cum") - neg
    v10 = (neg_below + neg / 2) / F.lit(n0)                       # share of negatives below a positive
    v01 = 1 - (F.col("pos_cum") - F.col("pos") / 2) / F.lit(n1)   # share of positives above a negative
    auc, q1, q0 = t.agg(F.sum(F.col("pos") * v10) / n1, F.sum(F.col("pos") * v10 * v10) / n1, F.sum(neg * v01 * v01) / n0).first()
    return auc, n1, n0, (q1 - auc * auc) * n1 / max(n1 - 1, 1), (q0 - auc * auc) * n0 / max(n0 - 1, 1)


def auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """Area under the curve with its interval; without rows of both classes there is none."""
    value, n1, n0, v1, v0 = _auc_parts(df, y, p)
    if value is None:
        return result(df.sparkSession, "auc", None, None, None, n1=n1, n0=n0)
    se = math.sqrt(v1 / n1 + v0 / n0)
    return result(df.sparkSession, "auc", value, None, None, ci=(value - 1.959963985 * se, value + 1.959963985 * se), n1=n1, n0=n0, se=se)


def auc_compare(df: DataFrame, y: str, p1: str, p2: str) -> DataFrame:
    """Difference of two AUCs with the simple standard error, and with DeLong's paired one."""
    a1, n1, n0, v1, w1 = _auc_parts(df, y, p1)
    a2, _, _, v2, w2 = _auc_parts(df, y, p2)
    if a1 is None:
        return result(df.sparkSession, "auc_compare", None, None, None)
    se = math.sqrt(a1 * (1 - a1) / n1 + a2 * (1 - a2) / n0)
    z = (a1 - a2) / se if se > 0 else 0.0
    # paired: variance of the difference of placements, from both scores' placements per row
    parts = []
    for p, name in ((p1, "a"), (p2, "b")):
        t = en.score_totals(df, y, p)
        neg = F.col("n") - F.col("pos")
        parts.append(t.select(F.col("score").alias(f"s{name}"),
                              ((F.col("n_cum") - F.col("pos_cum") - neg / 2) / F.lit(n0)).alias(f"u{name}"),
                              (1 - (F.col("pos_cum") - F.col("pos") / 2) / F.lit(n1)).alias(f"v{name}")))
    rows = df.select(F.col(y).alias("y"), F.col(p1).cast("double").alias("sa"), F.col(p2).cast("double").alias("sb"))
    rows = rows.join(parts[0], "sa").join(parts[1], "sb")
    s1, s0 = rows.agg(F.var_samp(F.when(F.col("y") == 1, F.col("ua") - F.col("ub"))), F.var_samp(F.when(F.col("y") == 0, F.col("va") - F.col("vb")))).first()
    paired = math.sqrt((s1 or 0) / n1 + (s0 or 0) / n0)
    zp = (a1 - a2) / paired if paired > 0 else 0.0
    pv = 2 * sp.normal_sf(abs(z))
    return result(df.sparkSession, "auc_compare", z, pv, "DIFFERENT" if pv < 0.05 else "SIMILAR", a1 - a2,
                  auc1=a1, auc2=a2, z_delong=zp, p_delong=2 * sp.normal_sf(abs(zp)))


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Variance inflation per feature: diagonal of the inverse correlation matrix."""
    values = np.diag(np.linalg.pinv(gram(df, cols).correlation(list(cols))))
    rows = [(c, float(v)) for c, v in zip(cols, values)]
    out = df.sparkSession.createDataFrame(rows, "feature string, vif double")
    return out.withColumn("verdict", sc.bin_col("vif", (5, 10), ("LOW", "MODERATE", "HIGH")))


def breusch_pagan(df: DataFrame, y: str, p: str) -> DataFrame:
    e2 = F.pow(F.col(y) - F.col(p).cast("double"), 2.0)
    n, r2 = df.select(e2.alias("e2"), F.col(p).cast("double").alias("p")).agg(F.count(F.lit(1)), F.regr_r2("e2", "p")).first()
    stat = n * r2
    pv = sp.chi2_sf(stat, 1)
    return result(df.sparkSession, "breusch_pagan", stat, pv, "HETEROSCEDASTIC" if pv < 0.05 else "HOMOSCEDASTIC", n=n)


def validate_model(df: DataFrame, order: Sequence[str], y: str, p: str, features: Sequence[str], run_at: dt.datetime | None = None) -> DataFrame:
    """All single-model checks as one table of results."""
    spark = df.sparkSession
    parts = [hosmer_lemeshow(df, y, p), auc(df, y, p), runs_test(df, order, y, p), breusch_pagan(df, y, p)]
    worst = vif(df, features).agg(F.max("vif")).first()[0]
    parts.append(result(spark, "vif", worst, None, "HIGH" if worst > 10 else "MODERATE" if worst > 5 else "LOW"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.withColumn("run_at", F.lit(run_at) if run_at else F.current_timestamp())
