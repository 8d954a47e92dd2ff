"""Mixture weights by Newton's method: optimal, at the border too, and settled."""

import numpy as np
import pytest

from riskflow.models import fusion as fu


def best(like):
    w = np.full(like.shape[1], 1 / like.shape[1])
    for _ in range(200_000):
        new = (like * w / (like @ w)[:, None]).mean(axis=0)
        if abs(new - w).max() < 1e-13:
            break
        w = new
    return w


@pytest.mark.parametrize("kind", ["inside", "border", "alike"])
def test_weights_are_the_likeliest(spark, kind):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 800)
    good = np.clip(0.5 + (y - 0.5) * 0.5 + rng.normal(0, 0.25, 800), 0.01, 0.99)
    other = np.clip(0.5 + (y - 0.5) * 0.4 + rng.normal(0, 0.3, 800), 0.01, 0.99)
    third = {"inside": np.clip(0.5 + (y - 0.5) * 0.3 + rng.normal(0, 0.1, 800), 0.01, 0.99), "border": 1 - good, "alike": good + 1e-9}[kind]
    df = spark.createDataFrame([(int(a), float(b), float(c), float(d)) for a, b, c, d in zip(y, good, other, third)], "y int, a double, b double, c double")
    w = np.array(list(fu.fuse_newton(df, ["a", "b", "c"], "y").values()))
    like = np.where(y[:, None] == 1, np.column_stack([good, other, third]), 1 - np.column_stack([good, other, third]))
    assert w.min() >= 0 and w.sum() == pytest.approx(1)
    assert np.log(like @ w).mean() >= np.log(like @ best(like)).mean() - 1e-8
    if kind != "alike":
        assert np.allclose(w, best(like), atol=1e-4)


def test_no_rows_and_prior(spark):
    df = spark.createDataFrame([(1, 0.9, 0.2), (0, 0.3, 0.6)] * 20, "y int, a double, b double")
    assert fu.fuse_newton(df.limit(0), ["a", "b"], "y") == {"a": 0.5, "b": 0.5}
    prior = fu.fuse_newton(df, ["a", "b"], "y", alpha=3.0)
    assert prior["b"] > 0 and prior["a"] == pytest.approx(fu.fuse_fit(df, ["a", "b"], "y", rounds=5000, alpha=3.0, tol=1e-9)["a"], abs=1e-4)
    with pytest.raises(RuntimeError):
        fu.fuse_newton(df, ["a", "b"], "y", rounds=0)
