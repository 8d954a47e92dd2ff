"""Graph measures on graphs with known answers."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.operators import community as cm
from riskflow.operators import edges as eg
from riskflow.operators import graph as gr
from riskflow.operators import tiles as tl
from riskflow.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def ued(spark, pairs):
    return spark.createDataFrame([(min(a, b), max(a, b), 1.0) for a, b in pairs], "a long, b long, w double")


def directed(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double")


PATH = [(1, 2), (2, 3), (3, 4), (4, 5)]
STAR = [(0, i) for i in range(1, 6)]
BARBELL = [(a, b) for o in (0, 5) for a in range(o, o + 5) for b in range(a + 1, o + 5)] + [(4, 5)]


def values(df, col):
    return {r["id"]: round(r[col], 6) for r in df.collect()}


@pytest.mark.parametrize("distance", ["hop", "weight"])
def test_betweenness(spark, distance):
    got = values(gr.betweenness(ued(spark, PATH), None, distance), "betweenness")
    assert got == {1: 0, 2: 0.5, 3: round(4 / 6, 6), 4: 0.5, 5: 0}
    assert values(gr.betweenness(ued(spark, STAR), None, distance), "betweenness")[0] == 1.0


def test_closeness(spark):
    got = values(gr.closeness(ued(spark, PATH)), "closeness")
    assert got[3] == round(4 / 6, 6) and got[1] == round(4 / 10, 6)
    two = values(gr.closeness(ued(spark, [(1, 2), (3, 4)])), "closeness")
    assert two[1] == round(1 / 3, 6)


def test_paths_over_edges_of_no_length_end(spark):
    """Between the ends of such an edge paths could go to and fro without end."""
    u = spark.createDataFrame([(1, 2, 0.0), (2, 3, 1.0), (3, 4, 0.0), (4, 5, 2.0)], "a long, b long, w double")
    assert values(gr.betweenness(u, None, "weight", max_rounds=20), "betweenness") == {1: 0, 2: 0.5, 3: round(4 / 6, 6), 4: 0.5, 5: 0}


def test_centralities_of_more_nodes_and_sources_than_a_tile_holds(spark):
    n, rng = 1100, np.random.default_rng(1)
    assert n > tl.NODES and n > tl.SOURCES
    pairs = sorted({(int(h), i) for i in range(20, n) for h in rng.integers(0, 20, 3)})  # payees and payers
    a, b = np.array(pairs).T
    w = rng.integers(1, 9, len(a)).astype(float)
    d = np.full((n, n), np.inf)
    d[a, b] = d[b, a] = w
    np.fill_diagonal(d, 0)
    edge = np.where(d > 0, d, np.inf)
    for k in range(n):
        np.minimum(d, d[:, k, None] + d[None, k], out=d)
    u = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), w.tolist())), "a long, b long, w double")
    k, share = tl.SOURCES + 12, np.zeros(n)
    for s in (r["source"] for r in gr.pivots(u, k).collect()):
        far, sigma, below = np.argsort(d[s], kind="stable"), np.zeros(n), np.zeros(n)
        sigma[s] = 1
        on = d[s][:, None] + edge == d[s][None]
        for v in far[1:]:
            sigma[v] = sigma[on[:, v]].sum()
        for v in far[::-1]:
            below[v] = 1 / sigma[v] + below[on[v]].sum()
        share += np.where(np.arange(n) == s, 0, below * sigma - 1)
    got = {r["id"]: r["betweenness"] for r in gr.betweenness(u, k, "weight").collect()}
    assert [got[i] for i in range(n)] == pytest.approx(share * n / k / (n - 1) / (n - 2))
    got = {r["id"]: r["closeness"] for r in gr.closeness(u).collect()}
    assert [got[i] for i in range(n)] == pytest.approx((n - 1) / d.sum(axis=0))


def test_components_and_pagerank(spark):
    e = directed(spark, PATH + [(10, 11), (11, 12), (20, 20)])
    got = {r["id"]: r["component"] for r in gr.components(e).collect()}
    assert {got[i] for i in range(1, 6)} == {1} and {got[i] for i in (10, 11, 12)} == {10} and got[20] == 20
    ranks = values(gr.pagerank(directed(spark, PATH)), "pagerank")
    assert abs(sum(ranks.values()) - 1) < 1e-4 and ranks[5] == max(ranks.values())
    seeds = spark.createDataFrame([(1, 2.0)], "id long, weight double")
    assert abs(sum(values(gr.propagate_risk(directed(spark, PATH), seeds), "risk").values()) - 1) < 1e-4


@pytest.mark.parametrize("method", [cm.louvain, cm.greedy_modularity])
def test_communities_of_barbell(spark, method):
    u = ued(spark, BARBELL)
    state = method(u)
    labels = {r["id"]: r["label"] for r in state.collect()}
    assert len({labels[i] for i in range(5)}) == 1 and len({labels[i] for i in range(5, 10)}) == 1 and labels[0] != labels[9]
    assert cm.modularity(u, state) == pytest.approx(2 * (10 / 21 - (21 / 42) ** 2))


def test_labels_settle(spark):
    """A long path, on which labels move one hop a round, and a star, which swaps its labels if all nodes move at once."""
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 106)] + [(200, 201)]
    label = {r["id"]: r["label"] for r in cm.label_propagation(ued(spark, pairs)).collect()}
    for node in label:
        near = [label[b if a == node else a] for a, b in pairs if node in (a, b)]
        assert near.count(label[node]) == max(near.count(x) for x in near)
    with pytest.raises(RuntimeError):
        cm.label_propagation(ued(spark, pairs), 3)


def test_louvain_settles(spark):
    """On a ring no two neighbouring communities gain by merging, and limits that are too low raise."""
    n = 40
    pairs = [(i, (i + 1) % n) for i in range(n)]
    u = ued(spark, pairs)
    label = {r["id"]: r["label"] for r in cm.louvain(u).collect()}
    size = {c: list(label.values()).count(c) for c in label.values()}
    ends = [tuple(sorted((label[a], label[b]))) for a, b in pairs if label[a] != label[b]]
    assert ends and all(ends.count(e) / n - 2 * (2 * size[e[0]]) * (2 * size[e[1]]) / (2 * n) ** 2 < 1e-4 for e in ends)
    for limit in ({"rounds": 2}, {"levels": 1}):
        with pytest.raises(RuntimeError):
            cm.louvain(u, **limit)


def test_shared_neighbours(spark):
    e = directed(spark, [(1, 2), (2, 3), (1, 3), (4, 5)]).select("src", "dst")
    got = gr and eg.shared_neighbours(e, e).collect()
    assert [(r["src"], r["dst"], r["common"], r["jaccard"]) for r in got] == [(1, 2, 1, 0.5)]


def test_neighbour_list_and_timing(spark):
    from riskflow.functions.scalars import timing_score

    day = 86_400_000_000
    df = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (0, day, 5), (0, day, 50)], "f long, l long, n long")
    assert [r[0] for r in df.select(timing_score("f", "l", "n")).collect()] == [0.0, 1.0, 0.5, 1.0]
    assert gr.entity_neighbours(directed(spark, PATH)).filter(F.col("id") == 3).count() == 2


def test_eigenvector_settles_where_payers_and_payees_never_mix(spark):
    # largest eigenvalue about 500, and one of minus that: with a shift of 1 a round leaves 99.6% of the change
    pairs = [(i, 1000 + j, 10.0 + (i * j) % 7) for i in range(60) for j in range(30)]
    got = values(gr.eigenvector(spark.createDataFrame(pairs, "a long, b long, w double"), tol=1e-10), "eigenvector")
    full = np.zeros((90, 90))
    for a, b, w in pairs:
        full[a, b - 940] = full[b - 940, a] = w
    want = np.abs(np.linalg.eigh(full)[1][:, -1])
    assert np.allclose([got[i] for i in range(60)] + [got[1000 + j] for j in range(30)], want, atol=1e-6)


def test_eigenvector_of_a_few_heavy_nodes_among_many_settles(spark):
    # 3 nodes hold most of the vector: over 3,003 nodes a mean change of 1e-5 is one of 0.03 in them
    pairs = [(1, 2, 5.0), (2, 3, 3.0), (1, 3, 1.0)] + [(1 + i % 3, 10 + i, 0.01) for i in range(3000)]
    got = {r["id"]: r["eigenvector"] for r in gr.eigenvector(spark.createDataFrame(pairs, "a long, b long, w double"), tol=1e-5).collect()}
    spot = {i: j for j, i in enumerate(sorted(got))}
    a, b = np.array([(spot[a], spot[b]) for a, b, _ in pairs]).T
    w, x = np.array([w for *_, w in pairs]), np.ones(len(spot))
    for _ in range(1000):
        x = 2 * x + np.bincount(a, w * x[b], len(x)) + np.bincount(b, w * x[a], len(x))
        x /= np.linalg.norm(x)
    assert max(abs(got[i] - x[j]) for i, j in spot.items()) < 1e-5


def test_sources_pass_in_parts_and_leave_no_files_of_earlier_rounds(spark, monkeypatch):
    from riskflow.session import checkpoint_dir

    folder = checkpoint_dir(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)
    monkeypatch.setattr(tl, "ENTRIES", 1)  # a part is one tile of sources
    before, n = size(), 2 * tl.SOURCES + 10
    got = {r["id"]: r["closeness"] for r in gr.closeness(ued(spark, [(0, i) for i in range(1, n)])).collect()}
    assert got == {i: pytest.approx(1.0 if i == 0 else (n - 1) / (1 + 2 * (n - 2))) for i in range(n)}
    assert size() - before < 1 << 20  # a tile has 1 MB


def test_queries_start_from_all_nodes(spark, monkeypatch):
    def sources(uedges, k=None):
        raise InterruptedError(k)

    monkeypatch.setattr(gr, "pivots", sources)
    for name in ("betweenness", "betweenness_weighted", "closeness"):
        with pytest.raises(InterruptedError, match="None"):
            QUERIES[name](spark, SF)


def test_contracted_edges_keep_components_and_rounds_leave_no_files(spark, monkeypatch):
    from riskflow.session import checkpoint_dir

    folder = checkpoint_dir(spark).removeprefix("file:")
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 3000, (2000, 2))] + [(9000 + i, 9001 + i) for i in range(200)] + [(9900, 9900)]
    edges = directed(spark, pairs).select("src", "dst").unionByName(spark.createDataFrame([(7, None)], "src long, dst long"))
    monkeypatch.setattr(gr, "CHUNK", 300)
    less = gr.contracted(edges.coalesce(2))
    whole, got = ({(r["id"], r["component"]) for r in gr.components(e).collect()} for e in (edges, less))
    assert got == whole and {c for i, c in got if i and i >= 9000} == {9000, 9900}
    before = set(os.listdir(folder))
    gr.components(edges).collect()
    left = [d for d in set(os.listdir(folder)) - before if os.path.isdir(os.path.join(folder, d))]
    assert len(left) == 1  # the last round's
