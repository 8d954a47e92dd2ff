"""GARCH likelihoods, gradients and fits, whole and in segments."""

import numpy as np
import pytest

from riskflow.models import volatility as vo


def simulated(rng, n, om, al, be):
    e, v = np.empty(n), om / (1 - al - be)
    for i in range(n):
        e[i] = rng.normal() * np.sqrt(v)
        v = om + al * e[i] ** 2 + be * v
    return e


def slow(p, e2):
    v = e2.mean()
    value = 0.0
    for i in range(len(e2)):
        if i:
            v = p[0] + p[1] * e2[i - 1] + p[2] * v
        value -= 0.5 * (vo.LOG_2PI + np.log(v) + e2[i] / v)
    return value, v


def test_pieces_give_likelihood_and_gradient(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(vo, "PIECE", 7)
    parts = [simulated(rng, n, 0.1, 0.1, 0.8) ** 2 for n in (100, 7, 8, 1, 53)]
    series = vo.Series(np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts[:-1]]))
    par = np.array([[0.1 + 0.01 * i, 0.15, 0.7 - 0.02 * i] for i in range(5)])
    total, end = series.evaluate(par)
    for i, e2 in enumerate(parts):
        assert np.allclose((total[i, 0], end[i, 0]), slow(par[i], e2))
        for j, step in enumerate(1e-6 * np.eye(3)):
            assert total[i, 1 + j] == pytest.approx((slow(par[i] + step, e2)[0] - slow(par[i] - step, e2)[0]) / 2e-6, rel=1e-4, abs=1e-4)


def test_simulated_parameters_are_found_and_no_neighbour_is_likelier():
    rng = np.random.default_rng(2)
    parts = [simulated(rng, 6000, 0.1, 0.1, 0.8) ** 2, simulated(rng, 4000, 0.05, 0.3, 0.5) ** 2, rng.normal(size=300) ** 2]
    series = vo.Series(np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts[:-1]]))
    par, value, settled = vo.climb(series.var, lambda p: series.evaluate(p)[0])
    assert settled.all()
    assert np.allclose(par[0], [0.1, 0.1, 0.8], atol=0.04) and np.allclose(par[1], [0.05, 0.3, 0.5], atol=0.06)
    for i, e2 in enumerate(parts):
        for j in range(3):
            for step in (0.98, 1.02):
                near = par[i].copy()
                near[j] *= step
                assert slow(near, e2)[0] <= value[i] + 1e-6


def test_hot_keys_equal_ordinary_ones(spark):
    rng = np.random.default_rng(3)
    data = [(k, i, float(x)) for k, n in ((1, 400), (2, 60), (3, 31), (4, 5)) for i, x in enumerate(simulated(rng, n, 0.1, 0.15, 0.75))]
    df = spark.createDataFrame([*data, (2, 1000, None), (2, 1001, float("nan")), (None, 1, 1.0), *[(5, i, 1.0) for i in range(40)]], "k long, t long, r double")
    plain = {r["k"]: r for r in vo.garch_fit(df, "k", ["t"], "r", given=(0.1, 0.8)).collect()}
    fitted = {r["k"]: r for r in vo.garch_fit(df, "k", ["t"], "r").collect()}
    assert set(plain) == set(fitted) == {1, 2, 3} and [plain[k]["n"] for k in (1, 2, 3)] == [400, 60, 31]
    spark.conf.set("spark.riskflow.segmentRows", "150")
    try:
        hot = {r["k"]: r for r in vo.garch_fit(df, "k", ["t"], "r", given=(0.1, 0.8)).collect()}
    finally:
        spark.conf.unset("spark.riskflow.segmentRows")
    for k in plain:
        assert np.allclose([hot[k][c] for c in ("omega", "log_likelihood", "last_volatility")], [plain[k][c] for c in ("omega", "log_likelihood", "last_volatility")])
        assert fitted[k]["log_likelihood"] >= plain[k]["log_likelihood"] and fitted[k]["settled"]
    assert vo.garch_fit(df.limit(0), "k", ["t"], "r").count() == 0
