"""What tests and estimates say of empty, one-class, not-a-number and zero-expectation input."""

import math

import pytest

from riskflow.operators import causal as ca
from riskflow.operators import drift as dr


def frame(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


@pytest.mark.parametrize("a,b", [([], [1.0]), ([1.0, 2.0], []), ([], []), ([float("nan")], [1.0])])
def test_ks_without_a_sample(spark, a, b):
    row = dr.ks_2samp(frame(spark, [(x,) for x in a], "v double"), frame(spark, [(x,) for x in b], "v double"), "v").first()
    assert row["statistic"] is None and row["p_value"] is None


def test_ks_leaves_out_nan(spark):
    clean, more = [(float(i),) for i in range(50)], [(float("nan"),)] * 25 + [(None,)]
    other = frame(spark, [(float(i) + 3,) for i in range(50)], "v double")
    with_nan = dr.ks_2samp(frame(spark, clean + more, "v double"), other, "v").first()
    assert with_nan["statistic"] == dr.ks_2samp(frame(spark, clean, "v double"), other, "v").first()["statistic"]


@pytest.mark.parametrize("rows", [[(1, 0.5), (1, 0.7)], [(0, 0.5)], []])
def test_auc_of_one_class(spark, rows):
    df = frame(spark, rows, "y int, p double")
    assert dr.auc(df, "y", "p").first()["statistic"] is None
    assert dr.auc_compare(frame(spark, [(*r, 0.1) for r in rows], "y int, p double, q double"), "y", "p", "q").first()["statistic"] is None


def test_calibration_of_bins_that_are_sure(spark):
    mixed = [(i % 2, 0.2 + 0.05 * (i % 12)) for i in range(60)]
    right = dr.hosmer_lemeshow(frame(spark, mixed + [(0, 0.0)] * 20 + [(1, 1.0)] * 20, "y int, p double"), "y", "p").first()
    assert math.isfinite(right["statistic"])
    wrong = dr.hosmer_lemeshow(frame(spark, mixed + [(1, 0.0)] * 20, "y int, p double"), "y", "p").first()
    assert math.isinf(wrong["statistic"]) and wrong["p_value"] == 0


def test_effect_with_sure_propensities(spark):
    kind = "t int, y double, e double"
    assert ca.ate_ipw(frame(spark, [(1, 2.0, 0.5), (0, 1.0, 0.5), (1, 2.0, 0.0)], kind), "t", "y", "e").first()["ate"] is None
    assert ca.ate_ipw(frame(spark, [(1, 2.0, 1.0), (0, 1.0, 0.0)], kind), "t", "y", "e").first()["ate"] == pytest.approx(0.5)
    assert ca.ate_ipw(frame(spark, [], kind), "t", "y", "e").first()["ate"] is None
    with pytest.raises(ValueError):
        ca.propensity(frame(spark, [(1, 2.0, 0.5)], kind), ["y"], "t")
