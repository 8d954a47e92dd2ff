"""What must not grow with rounds, keys or columns: reads of the input, shuffles, rows of one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.models import anomaly as an
from riskflow.models import fusion as fu
from riskflow.models import volatility as vo
from riskflow.operators import drift as dr
from riskflow.operators import pointintime as pt
from riskflow.operators import windows as wn


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("fit", [
    lambda df: fu.fuse_fit(df, ["a", "b"], "y", rounds=5, tol=0.0),
    lambda df: an.fit_elliptic(df, ["a", "b"])], ids=["fusion", "ellipse"])
def test_rounds_read_the_input_once(spark, fit):
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    rows = [(float(np.sin(i)) / 3 + 0.5, float(np.cos(3 * i)) / 3 + 0.5, i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, y int").withColumn("a", F.udf(seen, "double")("a"))
    fit(df)
    assert read.value <= 2 * len(rows)  # an expression may name a column twice


def test_trailing_windows_shuffle_the_rows_once(tx):
    assert shuffles(pt.pit_24h(tx)) == 1 and shuffles(wn.velocity(tx)) == 1


def test_tail_scores_leave_the_rows_of_a_key_where_they_are(spark):
    fit = spark.createDataFrame([("a", 1.0, 0.1, 2.0)], "c string, threshold double, xi double, sigma double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = dr.gpd_score(spark.createDataFrame([("a", 3.0), ("b", 3.0)], "c string, x double"), fit, ["c"], "x")
        assert shuffles(out) == 0
        assert {r["c"]: round(r["tail_probability"], 4) for r in out.collect()} == {"a": 0.3855, "b": 1.0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_settled_series_are_not_climbed_on():
    rng = np.random.default_rng(1)
    e2 = np.concatenate([rng.normal(0, 1, 40) ** 2 for _ in range(30)])
    series, asked = vo.Series(e2, np.arange(30) * 40), []

    def some(par, at):
        asked.append(len(at))
        return series.some(at).evaluate(par[at])[0]

    par, value, settled = vo.climb(series.var, lambda p: series.evaluate(p)[0], some=some)
    assert sum(asked) < 0.8 * len(asked) * 30
    one = vo.Series(e2[200:240], np.zeros(1, int))
    alone = vo.climb(one.var, lambda p: one.evaluate(p)[0])
    assert np.allclose(par[5], alone[0][0], rtol=1e-9) and np.isclose(value[5], alone[1][0]) and settled[5] == alone[2][0]
