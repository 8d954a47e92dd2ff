"""Exact nearest neighbours and local outlier factors against all pairs."""

import numpy as np
import pytest

from riskflow.models import anomaly as an
from riskflow.operators import neighbours as nb


def brute(q, points, k, others):
    out = {}
    ids = sorted(points)
    there = np.array([points[i] for i in ids])
    for i, x in q.items():
        d = np.sqrt(((there - np.array(x)) ** 2).sum(axis=1))
        out[i] = [(ids[j], d[j]) for j in np.argsort(d, kind="stable") if not (others and ids[j] == i)][:k]
    return out


@pytest.mark.parametrize("others", [True, False])
def test_equals_all_pairs_with_hot_places_and_small_blocks(spark, monkeypatch, others):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(150, 3)), np.round(rng.normal(size=(60, 3))), np.tile([[0.5, 0.5, 0.5]], (100, 1)), rng.normal(8, 0.01, size=(90, 3))])
    monkeypatch.setattr(nb, "BLOCK", 32)
    points = {i: v.tolist() for i, v in enumerate(x)}
    q = points if others else {1000 + i: v.tolist() for i, v in enumerate(np.concatenate([x[::7], [[50, 50, 50]]]))}
    got = {}
    for r in nb.nearest(spark.createDataFrame(list(q.items()), "_q long, _x array<double>"), spark.createDataFrame(list(points.items()), "_p long, _x array<double>"),
                        6, others=others, pivots=12).collect():
        got.setdefault(r["_q"], []).append((r["_d"], r["_p"]))
    for i, want in brute(q, points, 6, others).items():
        mine = sorted(got[i])
        assert np.allclose([d for d, _ in mine], [d for _, d in want], atol=1e-12), i
        if not others:
            assert [p for _, p in mine] == [p for p, _ in want]


def test_few_or_no_points(spark):
    rows = spark.createDataFrame([(1, [0.0]), (2, [3.0])], "_q long, _x array<double>")
    points = spark.createDataFrame([(1, [0.0]), (7, [1.0])], "_p long, _x array<double>")
    assert {(r["_q"], r["_p"]) for r in nb.nearest(rows, points, 5).collect()} == {(1, 1), (1, 7), (2, 1), (2, 7)}
    assert {(r["_q"], r["_p"]) for r in nb.nearest(rows, points, 5, others=True).collect()} == {(1, 7), (2, 1), (2, 7)}
    assert nb.nearest(rows, points.limit(0), 5).count() == 0 == nb.nearest(rows.limit(0), points, 5).count()


def test_factors_leave_out_missing_features_and_keep_repeated_rows(spark):
    rows = [(i, float(i % 10), float(i // 10)) for i in range(100)] + [(100, 50.0, 50.0), (100, 50.0, 50.0), (101, None, 1.0), (102, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = an.lof_score(df, an.fit_lof(df, ["a", "b"], 5), "id").collect()
    assert len(got) == 102 and {r["id"] for r in got} == set(range(101))
    assert max(got, key=lambda r: r["lof"])["id"] == 100
    assert an.lof_score(df.limit(0), an.fit_lof(df, ["a", "b"], 5), "id").count() == 0


def test_a_place_is_searched_once_for_all_its_rows(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 10), float(i % 5)) for i in range(400)], "id long, a double, b double")
    model, asked, plain = an.fit_lof(df, ["a", "b"], 5), [], an.nb.nearest
    monkeypatch.setattr(an.nb, "nearest", lambda rows, *rest, **more: asked.append(rows.count()) or plain(rows, *rest, **more))
    out = an.lof_score(df, model, "id").collect()
    assert asked == [10] and sorted(r["id"] for r in out) == list(range(400))


def test_a_row_visits_few_cells(spark, monkeypatch):
    x = np.random.default_rng(4).uniform(size=(3000, 3)).tolist()
    made, plain = [], nb.cut
    monkeypatch.setattr(nb, "cut", lambda df: made.append(plain(df)) or made[-1])
    rows, points = (spark.createDataFrame(list(enumerate(x)), f"{i} long, _x array<double>") for i in ("_q", "_p"))
    assert nb.nearest(rows, points, 5, pivots=50).count() == 5 * len(x)
    assert sum(df.count() for df in made if {"_q", "_cell"} <= set(df.columns)) < 8 * len(x)
