"""Closed-form and published values for tests, regressions and resampling."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.functions import special as sp
from riskflow.models import anomaly as an
from riskflow.models import fusion as fu
from riskflow.models import supervised as sv
from riskflow.operators import causal as ca
from riskflow.operators import drift as dr
from riskflow.operators import encoding as en
from riskflow.operators import resample as rs


def test_tails():
    assert sp.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert sp.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05)
    assert sp.normal_sf(1.959963984540054) == pytest.approx(0.025)
    assert sp.t_sf2(2.2281388519649385, 10) == pytest.approx(0.05)
    assert sp.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05)
    assert sp.kolmogorov_sf(1.3580986393225507) == pytest.approx(0.05, abs=1e-4)
    assert sp.binomial_two_sided(1, 6) == pytest.approx(14 / 64)


def numbers(spark, n=2000):
    u = (F.col("id") + 0.5) / n
    return spark.range(n).select("id", u.alias("u"), F.log(1 / (1 - u)).alias("expo"))


def test_gpd_recovers_shape(spark):
    n, xi, sigma = 20000, 0.2, 2.0
    u = (F.col("id") + 0.5) / n
    df = spark.range(n).select(F.lit("a").alias("k"), ((sigma / xi) * (F.pow(1 - u, F.lit(-xi)) - 1)).alias("x"))
    fit = dr.gpd_fit(df, ["k"], "x", 0.0).first()
    assert fit["xi"] == pytest.approx(xi, abs=0.02) and fit["sigma"] == pytest.approx(sigma, rel=0.02) and fit["ks"] < 0.01


def test_identical_samples(spark):
    df = numbers(spark)
    assert dr.psi(df, df, ["expo"]).first()["psi"] == pytest.approx(0)
    assert dr.js_divergence(df, df, ["expo"]).first()["jsd"] == pytest.approx(0)
    ks = dr.ks_2samp(df, df.withColumn("expo", F.col("expo") + 10), "expo").first()
    assert ks["statistic"] == pytest.approx(1.0) and ks["p_value"] < 1e-6


def test_exact_fit_instrument(spark):
    df = spark.range(200).select((F.col("id") % 7).alias("z"), ((F.col("id") % 7) * 2.0 + (F.col("id") % 3)).alias("t"))
    df = df.withColumn("y", 3 * F.col("t") + 1)
    row = ca.iv_2sls(df, [], "t", "y", "z").first()
    assert row["iv_estimate"] == pytest.approx(3.0) and row["se"] < 1e-4


def test_mediation_with_covariate(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 11).cast("double").alias("x"), (F.col("id") % 2).alias("t"), ((F.col("id") * 13) % 5).alias("e"))
    df = df.withColumn("m", 2.0 * F.col("t") + F.col("x") + F.col("e")).withColumn("y", 1.5 * F.col("m") + 0.5 * F.col("t"))
    row = ca.mediation(df, ["x"], "t", "m", "y").first()
    assert row["b"] == pytest.approx(1.5) and row["direct"] == pytest.approx(0.5) and row["total"] == pytest.approx(row["direct"] + row["indirect"])


def test_propensity_and_effects(spark):
    df = spark.range(3000).select(F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0).alias("x"))
    df = df.withColumn("t", (F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1000)) / 1000.0 < 0.3 + 0.4 * F.col("x")).cast("int"))
    df = df.withColumn("y", 2.0 * F.col("t") + 3 * F.col("x"))
    scored = ca.propensity(df, ["x"], "t")
    row = ca.ate_dr(ca.outcome_models(scored, ["x"], "t", "y"), "t", "y", "propensity").first()
    assert row["ate"] == pytest.approx(2.0, abs=0.15)


def test_granger_finds_the_lag(spark):
    df = spark.range(1, 800).select(F.lit(0).alias("k"), F.col("id").alias("i"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 10.0).alias("x"))
    df = df.withColumn("y", F.pmod(F.xxhash64(F.col("i") - 2), F.lit(100)) / 10.0)
    rows = {r["lag"]: r for r in ca.granger(df, ["k"], ["i"], "x", "y", 3).collect()}
    assert rows[1]["p_value"] > 0.001 and rows[2]["p_value"] < 1e-6


def test_bootstrap_and_permutation(spark):
    df = numbers(spark).withColumn("g", (F.col("id") % 2).cast("int"))
    row = rs.bootstrap_ci(df, "id", "expo", 100).first()
    assert row["ci_low"] < row["estimate"] < row["ci_high"] and row["se"] == pytest.approx(1 / math.sqrt(2000), rel=0.35)
    assert rs.permutation_test(df, "id", "g", "expo", 60).first()["p_value"] > 0.2
    shifted = df.withColumn("expo", F.col("expo") + F.col("g"))
    assert rs.permutation_test(shifted, "id", "g", "expo", 60).first()["p_value"] < 0.05


def test_woe_sign_flips_with_label(spark):
    df = numbers(spark).withColumn("y", (F.col("u") > 0.6).cast("int")).withColumn("n", 1 - F.col("y"))
    value = lambda y: {r["bin"]: r["woe"] for r in en.woe_fit(df, ["expo"], y)[1].collect()}
    a, b = value("y"), value("n")
    assert all(a[k] == pytest.approx(-b[k]) for k in a)


def test_isolation_and_ellipse_find_the_outlier(spark):
    df = spark.range(600).select("id", (F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0).alias("a"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 100.0).alias("b"))
    df = df.unionByName(spark.createDataFrame([(9999, 8.0, 8.0)], "id long, a double, b double"))
    for scored, name in ((an.isolation_score(df, an.fit_isolation_forest(df, ["a", "b"], "id", 50), "id"), "isolation"),
                         (an.elliptic_score(df, an.fit_elliptic(df, ["a", "b"])), "elliptic")):
        assert scored.orderBy(F.desc(name)).first()["id"] == 9999


def test_lof_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 2))
    x[0] = [6, 6]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    model = an.fit_lof(df, ["a", "b"], 5)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    near = np.argsort(d, axis=1)[:, 1:6]
    kd = np.take_along_axis(d, near, 1)[:, -1]
    lrd = 1 / np.maximum(np.take_along_axis(d, near, 1), kd[near]).mean(axis=1)
    points = {r["_p"]: r for r in model["points"].collect()}
    assert np.allclose(sorted(r["lrd"] for r in points.values()), sorted(lrd))
    assert np.allclose(sorted(r["kdist"] for r in points.values()), sorted(kd))
    scores = {r["id"]: r["lof"] for r in an.lof_score(df, model, "id").collect()}
    assert max(scores, key=scores.get) == 0


def test_models_round_trip(spark, scratch):
    df = spark.range(1200).select("id", (F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0).alias("a"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 100.0).alias("b"))
    df = df.withColumn("label", (F.col("a") + 0.3 * F.col("b") > 0.8).cast("int"))
    card = sv.Scorecard(["a", "b"], "label", c=1.0).fit(df)
    card.save(scratch)
    again = sv.Scorecard.load(spark, scratch)
    x, y = (m.transform(df).agg(F.sum("scorecard")).first()[0] for m in (card, again))
    assert x == pytest.approx(y)
    model = sv.TabularModel(["a", "b"], "label", "id", rounds=5, depth=3, gamma=2.0).fit(df)
    assert en.evaluate(model.transform(df), "label", "tabular", 0.5).first()["average_precision"] > 0.9
    parts = sv.tree_contributions(df, model.model, ["a", "b"], "id")
    gap = parts.select(F.abs(F.col("a") + F.col("b") + F.col("bias") - F.col("margin")).alias("d")).agg(F.max("d")).first()[0]
    assert gap < 1e-9
    margin = model.model.transform(sv.VectorAssembler(inputCols=["a", "b"], outputCol="_x").transform(df))
    joined = parts.join(margin.select("id", sv.vector_to_array("rawPrediction")[1].alias("raw")), "id")
    # Spark's raw score is twice the summed trees
    worst = joined.select(F.least(F.abs(F.col("raw") - F.col("margin")), F.abs(F.col("raw") - 2 * F.col("margin"))).alias("d")).agg(F.max("d")).first()[0]
    assert worst < 1e-9


def test_fusion_prefers_the_right_model(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("y"))
    df = df.withColumns({"good": F.when(F.col("y") == 1, 0.9).otherwise(0.1), "bad": F.lit(0.5)})
    w = fu.fuse_fit(df, ["good", "bad"], "y")
    assert w["good"] > 0.95 and sum(w.values()) == pytest.approx(1)


def test_time_series_cv(spark):
    df = spark.range(300).select("id", (F.pmod(F.xxhash64("id"), F.lit(2))).cast("int").alias("label"))
    fit = lambda train, shift: (lambda test: test.withColumn("score", F.col("label") * 0.5 + shift))
    rows = sv.time_series_cv(df, "id", "label", fit, [{"shift": 0.1}], 2).collect()
    assert len(rows) == 2 and all(r["average_precision"] == pytest.approx(1.0) for r in rows)


def test_garch_on_constant_variance(spark):
    df = spark.range(2000).select(F.lit("a").alias("k"), F.col("id").alias("i"), sp.normal_ppf_col(F.pmod(F.xxhash64("id"), F.lit(9973)) / 9973.0 * 0.999 + 0.0005).alias("r"))
    row = an.garch_moments(df, "k", ["i"], "r").first()
    assert row["alpha"] < 0.1 and row["last_volatility"] == pytest.approx(1.0, abs=0.25)


def test_missing_values_have_no_bin(spark):
    from riskflow.operators import drift as dr
    from riskflow.operators import encoding as en

    df = spark.range(400).select(F.col("id"), (F.col("id") % 2).alias("y"), F.when(F.col("id") % 4 > 0, F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).otherwise(float("nan"))).alias("v"))
    edges, table = en.woe_fit(df, ["v"], "y", min_iv=0.0)
    assert table.agg(F.sum(F.col("good") + F.col("bad"))).first()[0] == df.filter("v is not null and not isnan(v)").count()
    assert en.woe_transform(df, edges, table).filter("v is null or isnan(v)").filter("woe_v <> 0").count() == 0
    clean = df.filter("v is not null and not isnan(v)")
    assert dr.psi(df, df.filter("id < 200"), ["v"]).first()["psi"] == pytest.approx(dr.psi(clean, clean.filter("id < 200"), ["v"]).first()["psi"])


def test_one_class_and_empty_samples_do_not_raise(spark):
    from riskflow.operators import drift as dr
    from riskflow.operators import encoding as en

    df = spark.range(50).select(F.lit(0).alias("y"), F.col("id").cast("double").alias("v"), F.lit(1).alias("day"))
    assert all(r["iv"] == 0 for r in en.woe_fit(df, ["v"], "y", min_iv=-1.0)[1].collect())
    assert dr.psi(df, df.limit(0), ["v"]).count() == 1
    assert dr.drift_report(df, df.filter("v > 1000"), ["v"]).count() == 0


def test_a_node_in_two_community_tables_is_scored_once(spark):
    from riskflow.models import fusion as fu

    class Members(fu.RiskSystem):
        def score(self, df, reasons=5):
            return df.withColumns({m: F.lit(0.5) for m in self.MEMBERS}).withColumn("risk_score", F.lit(0.7))

    df = spark.createDataFrame([(1, "a"), (2, "b")], "transaction_id int, payer_id string")
    known = spark.createDataFrame([("louvain", "a", 1), ("labels", "a", 9)], "method string, node string, community_id int")
    assert Members([]).score_batch(df, known).count() == 2


def test_statistics_of_the_callers_choice(spark):
    from riskflow.operators import resample as rs

    df = spark.range(2000).select(F.col("id"), (F.col("id") % 2).alias("g"), (F.xxhash64("id") % 1000).cast("double").alias("v"))
    spread = lambda x, w: F.sqrt(F.sum(x * x * w) / F.sum(w) - F.pow(F.sum(x * w) / F.sum(w), 2))
    row = rs.bootstrap_ci(df, "id", "v", 60, statistic=spread).first()
    assert row["estimate"] == pytest.approx(df.agg(F.stddev_pop("v")).first()[0]) and row["ci_low"] < row["estimate"] < row["ci_high"]
    assert row["acceleration"] == 0
    most = lambda x, first: F.max(F.when(first, x)) - F.max(F.when(~first, x))
    assert 0 < rs.permutation_test(df, "id", "g", "v", 40, statistic=most).first()["p_value"] <= 1
