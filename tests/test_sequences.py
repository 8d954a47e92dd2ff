"""Most likely paths against all paths, whole and in segments."""

import itertools
import random

import numpy as np
import pytest

from riskflow.operators import sequences as sq


def best(model, seen):
    """Greatest score; of equal ones the path whose last states come first."""
    n, out = len(model.states), None
    for path in itertools.product(range(n), repeat=len(seen)):
        score = model.start[path[0]] + model.emit[seen[0], path[0]]
        for i in range(1, len(seen)):
            score += model.move[path[i - 1], path[i]] + model.emit[seen[i], path[i]]
        entry = (-score, path[::-1])
        out = entry if out is None or entry < out else out
    return [model.states[i] for i in out[1][::-1]]


@pytest.mark.parametrize("rows", [None, 20])
def test_equals_all_paths(spark, rows):
    rng = random.Random(4)
    model = sq.PathModel(["a", "b", "c"], ["x", "y"], np.array([-1, -1, -2]), np.array([[-1, -2, -2], [-2, -1, -2], [-1, -1, -1]]), np.array([[-1, -1, -2], [-2, -1, -1], [-2, -2, -2]]))
    seqs = {k: [rng.choice(["x", "y", None, "new"]) for _ in range(n)] for k, n in enumerate([1, 2, 3, 5, 7, 8, 7, 1])}
    if rows:  # one entity much longer than a segment: held against the plain recursion, which the short ones hold against all paths
        seqs[99] = [rng.choice(["x", "y"]) for _ in range(300)]
    data = [(k, t, k * 1000 + t, o) for k, s in seqs.items() for t, o in enumerate(s)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k long, t long, id long, o string")
    if rows:
        spark.conf.set("spark.riskflow.segmentRows", str(rows))
    try:
        got = {r["id"]: r["path_state"] for r in sq.likely_path(df, model, "k", ["t"], "o", "id").collect()}
    finally:
        spark.conf.unset("spark.riskflow.segmentRows")
    code = {"x": 0, "y": 1}
    for k, s in seqs.items():
        seen = [code.get(o, 2) for o in s]
        want = best(model, seen) if len(s) < 9 else [model.states[i] for i in sq._many(model, np.array(seen), np.zeros(1, np.int64))]
        assert [got[k * 1000 + t] for t in range(len(s))] == want, k
    assert len(got) == len(data)


def test_fit_counts_and_edges(spark):
    df = spark.createDataFrame([(1, 0, "s", "o"), (1, 1, None, "o"), (1, 2, "t", "p"), (None, 0, "s", None), (2, 0, "t", "o")], "k long, t long, state string, o string")
    m = sq.fit_path(df, "k", ["t"], "state", "o")
    assert m.states == ["s", "t"] and m.observations == ["o", "p"]
    unit = lambda a, b: int(np.floor(1_000_000 * np.log(a / b)))
    assert m.start.tolist() == [unit(3, 5), unit(2, 5)]
    assert m.move.tolist() == [[unit(1, 3), unit(2, 3)], [unit(1, 2), unit(1, 2)]]
    assert m.emit[:, 0].tolist() == [unit(2, 4), unit(1, 4), unit(1, 4)]
    assert sq.likely_path(df.limit(0), m, "k", ["t"], "o", "t").count() == 0
    assert sq.likely_path(df, m, "k", ["t"], "o", "t").count() == 5
    with pytest.raises(ValueError):
        sq.fit_path(df.limit(0), "k", ["t"], "state", "o")
