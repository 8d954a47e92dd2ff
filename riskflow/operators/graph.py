"""Graph measures by iterated joins.

Node-sized state is checkpointed once per round, so a lost executor costs one round and plans stay short. Each round is
a join on the node key and a pre-aggregated sum; hub nodes are handled by the skew join of adaptive execution.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.operators import tiles as tl
from riskflow.operators.edges import both_ways, node_metadata
from riskflow.session import cut, forget, sweep


CHUNK, SWEEP = 1 << 21, 1 << 17  # rows that are contracted at once; pairs from which a round's shuffle files are worth collecting garbage


def node_ids(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


# ---- components

def contracted(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) with the same components, for ids that are longs: each node of ``CHUNK`` rows with the least one that these rows link it to.

    Rows that lie together often have nodes in common, and then far fewer edges are left than there were. Rows with a null stay as they are.
    """
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def least(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = np.concatenate([np.concatenate([b.column(0).to_numpy(), b.column(1).to_numpy()]).reshape(2, -1) for b in rows], axis=1)
        ids, place = np.unique(ends, return_inverse=True)
        a, b = place.reshape(2, -1)
        root = np.arange(len(ids))
        while len(a):
            np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            whole = batch.drop_null()
            if whole.num_rows < batch.num_rows:
                yield batch.filter(pa.compute.invert(pa.compute.and_(batch.column(0).is_valid(), batch.column(1).is_valid())))
            held, n = [*held, whole], n + whole.num_rows
            if n >= CHUNK:
                yield least(held)
                held, n = [], 0
        if n:
            yield least(held)

    return edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).mapInArrow(work, "src long, dst long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Weak components as (id, component = smallest id), by alternating large-star and small-star rounds.

    Every round is linear in the edges: neighbours are attached to the smallest one, never paired with each other. The files of a round go once the
    next one is there, so disk holds those of one round.
    """
    ids = node_ids(edges)
    pairs = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct())
    last = None
    for _ in range(max_rounds):
        near = pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = near.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        spread = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        pairs, old = cut(spread.filter("u <> v").distinct()), pairs
        forget(old)
        del near, low, large, spread, old
        state = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state[0] > SWEEP:
            sweep(edges.sparkSession)
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return ids.join(pairs.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component"))


# ---- centrality

def pagerank(edges: DataFrame, alpha: float = 0.85, iters: int = 100, tol: float | None = 1e-6,
             seeds: DataFrame | None = None) -> DataFrame:
    """Weighted PageRank as (id, pagerank). ``seeds`` (id, weight) makes it personalised. ``tol=None`` runs all rounds.

    The rank of nodes without out-edges is handed out like the jump probability.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("_w"))
    links = cut(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_w")).alias("share")))
    nodes = node_ids(edges).join(out.select(F.col("src").alias("id"), F.lit(False).alias("dangling")), "id", "left")
    nodes = nodes.withColumn("dangling", F.coalesce("dangling", F.lit(True)))
    if seeds is None:
        nodes = nodes.withColumn("jump", F.lit(1.0))
    else:
        nodes = nodes.join(seeds.select("id", F.col("weight").cast("double").alias("jump")), "id", "left").fillna(0.0, ["jump"])
    nodes = cut(nodes)
    n, jump = nodes.agg(F.count(F.lit(1)), F.sum("jump")).first()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("pagerank"))
    if not jump:
        raise ValueError("no seed is a node of the graph")
    nodes = nodes.withColumn("jump", F.col("jump") / F.lit(jump))
    state = nodes.withColumn("x", F.lit(1.0 / n))
    loose = nodes.agg(F.count_if("dangling")).first()[0] / n
    for _ in range(iters):
        into = links.join(state.select(F.col("id").alias("src"), "x"), "src").groupBy("dst").agg(
            F.sum(F.col("x") * F.col("share")).alias("got")).withColumnRenamed("dst", "id")
        fresh = alpha * (F.coalesce("got", F.lit(0.0)) + F.lit(loose) * F.col("jump")) + (1 - alpha) * F.col("jump")
        state = cut(state.join(into, "id", "left").select("id", "dangling", "jump", F.col("x").alias("old"), fresh.alias("x")))
        loose, change = state.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("x"))), F.lit(0.0)),
                                  F.sum(F.abs(F.col("x") - F.col("old")))).first()
        if tol is not None and change < n * tol:
            break
        state = state.drop("old")
    else:
        if tol is not None:
            raise RuntimeError(f"ranks did not settle in {iters} rounds")
    return state.select("id", F.col("x").alias("pagerank"))


def propagate_risk(edges: DataFrame, seeds: DataFrame, damp: float = 0.85, iters: int = 1000, tol: float | None = 1e-6) -> DataFrame:
    """Risk spreading from seed nodes (id, weight) along edges, damped at every hop, until it changes by less than ``tol``; an error if it does not in time."""
    return pagerank(edges, damp, iters, tol, seeds).withColumnRenamed("pagerank", "risk")


def eigenvector(uedges: DataFrame, iters: int = 100, tol: float | None = 1e-6) -> DataFrame:
    """Weighted eigenvector centrality by power iteration on A + shift, scaled to unit length each round.

    The shift is 1 at first. A graph of payers and payees has an eigenvalue near -l for its largest one l, against which 1 is little; where a
    round leaves over half of the last change, the shift becomes l / 2. No shift changes the vector. It has settled once no node changes by ``tol``: a
    mean over the nodes would let a few hubs be off by more, the larger the graph the more.
    """
    links = cut(both_ways(uedges))
    state = cut(links.select(F.col("src").alias("id")).distinct().withColumn("x", F.lit(1.0)))
    n = state.count()
    scale, shift, before = float(n), 1.0, math.inf
    for _ in range(iters):
        old = state.select("id", (F.col("x") / F.lit(scale)).alias("x"))
        got = links.join(old.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(
            F.sum(F.col("x") * F.col("w")).alias("got")).withColumnRenamed("dst", "id")
        state = cut(old.join(got, "id").select("id", F.col("x").alias("old"), (F.lit(shift) * F.col("x") + F.col("got")).alias("x")))
        squares, along, size = state.agg(F.sum(F.col("x") * F.col("x")), F.sum(F.col("x") * F.col("old")), F.sum(F.col("old") * F.col("old"))).first()
        scale = math.sqrt(squares or 0.0) or 1.0
        if tol is not None:
            change = state.agg(F.max(F.abs(F.col("x") / F.lit(scale) - F.col("old")))).first()[0] or 0.0
            if change < tol or not n:
                break
            if change > before / 2:
                shift = max(shift, (along / size - shift) / 2)
            before = change
    else:
        if tol is not None:
            raise RuntimeError(f"centralities did not settle in {iters} rounds")
    return state.select("id", (F.col("x") / F.lit(scale)).alias("eigenvector"))


def pivots(uedges: DataFrame, k: int | None = None) -> DataFrame:
    """``k`` nodes in hash order (all when k is None): a repeatable sample."""
    ids = uedges.select(F.explode(F.array("a", "b")).alias("source")).distinct()
    return ids if k is None else ids.orderBy(F.xxhash64("source"), "source").limit(k)


def _tiled(uedges: DataFrame, distance: str) -> tuple[DataFrame, DataFrame]:
    """(node tiles, edge tiles); ``distance``: edge ``weight`` as length, ``inverse`` weight, or ``hop``."""
    length = {"weight": F.col("w"), "inverse": 1 / F.col("w"), "hop": F.lit(1.0)}[distance]
    links = cut(both_ways(uedges).select("src", "dst", length.cast("double").alias("len")))
    nodes = tl.node_tiles(links)
    return nodes, tl.edge_tiles(links, nodes)


def _added(total: DataFrame | None, part: DataFrame) -> DataFrame:
    """The sums by node of a part of the sources, added to those of the parts before."""
    if total is not None:
        part = total.unionByName(part)
    out = cut(part.groupBy("id").agg(*[F.sum(c).alias(c) for c in part.columns if c != "id"]))
    if total is not None:
        forget(total)
    return out


def closeness(uedges: DataFrame, k: int | None = None, distance: str = "weight") -> DataFrame:
    """Closeness centrality as (id, closeness). With ``k`` landmarks, distances to them stand in for all distances."""
    nodes, edges = _tiled(uedges, distance)
    sources = cut(pivots(uedges, k).withColumnRenamed("source", "id"))
    n, count = nodes.count(), sources.count()
    scale, total = n / max(count, 1), None

    def measure(x):
        reached = np.isfinite(x)
        return reached.sum(axis=1).astype(float), np.where(reached, x, 0.0).sum(axis=1)

    for placed in tl.batches(sources, nodes):
        starts = tl.source_tiles(placed, 0.0, math.inf)
        dist = tl.distances(edges, starts)
        total = _added(total, tl.by_node(dist, nodes, measure, "r", "far"))
        forget(starts, dist)
        sweep(uedges.sparkSession)
    if total is None:
        return nodes.select("id", F.lit(0.0).alias("closeness"))
    reach = total.filter("r > 0").select("id", F.col("r") * F.lit(scale) - 1, F.col("far") * F.lit(scale)).toDF("id", "r", "far")
    return reach.select("id", F.coalesce(F.try_divide("r", "far") * F.col("r") / F.lit(max(n - 1, 1)), F.lit(0.0)).alias("closeness"))


def betweenness(uedges: DataFrame, k: int | None = None, distance: str = "weight", max_rounds: int = 1000) -> DataFrame:
    """Betweenness centrality as (id, betweenness), from all nodes; with ``k``, an estimate from so many pivots.

    Shortest-path edges of each source form an acyclic table. Path counts and dependencies are sums over the paths of
    1, 2, ... edges, each length one join further. See ``tiles.shortest_edges`` for edges of no length.
    """
    nodes, edges = _tiled(uedges, distance)
    sources = cut(pivots(uedges, k).withColumnRenamed("source", "id"))
    n, count = nodes.count(), sources.count()
    scale = n / max(count, 1) / max((n - 1) * (n - 2), 1)

    def measure(x, s):
        return (np.where(s > 0, x * s - 1, 0.0).sum(axis=1),)

    def source_itself(x, s, o):
        return (np.where(o > 0, 1 - x * s, 0.0).sum(axis=1),)

    total = None
    for placed in tl.batches(sources, nodes):
        starts, own = tl.source_tiles(placed, 0.0, math.inf), tl.source_tiles(placed, 1.0, 0.0)
        dist = tl.distances(edges, starts, max_rounds)
        paths = tl.shortest_edges(edges, dist, starts)
        forget(starts, dist)
        sigma = tl.path_sums(own, paths, max_rounds=max_rounds)
        over = tl.inverse(sigma)
        below = tl.path_sums(over, paths, True, max_rounds)
        forget(paths, over)
        both = sigma.join(below.withColumnRenamed("_x", "_b"), ["_s", "_v"]).select("_s", "_v", "_b", "_x")
        ends = both.join(own.withColumnRenamed("_x", "_o"), ["_s", "_v"])
        total = _added(total, tl.by_node(both, nodes, measure, "d").unionByName(tl.by_node(ends, nodes, source_itself, "d")))
        forget(sigma, below, own)
        del dist, paths, starts, sigma, over, below, own, both, ends
        sweep(uedges.sparkSession)
    if total is None:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    return nodes.select("id").join(total, "id", "left").select("id", (F.coalesce("d", F.lit(0.0)) * F.lit(scale)).alias("betweenness"))


# ---- reports

def khop_features(edges: DataFrame, feats: DataFrame, hops: int = 3) -> DataFrame:
    """Mean of each feature over in-neighbours, repeated ``hops`` times: columns ``<feature>_hop<i>``."""
    if not 1 <= hops <= 3:
        raise ValueError("hops must be 1, 2 or 3")
    names = [c for c in feats.columns if c != "id"]
    links, last, out = edges.select("src", "dst"), feats, feats
    for i in range(1, hops + 1):
        last = links.join(last.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(
            *[F.avg(c).alias(c) for c in names])
        last = cut(last)
        out = out.join(last.select("id", *[F.col(c).alias(f"{c}_hop{i}") for c in names]), "id", "left")
    return out


def entity_risk(meta: DataFrame, cent: DataFrame | None = None) -> DataFrame:
    """Five risk components per node and their weighted sum. ``cent`` may bring betweenness and pagerank."""
    base = meta if cent is None else meta.join(cent, "id", "left")
    get = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in base.columns else F.lit(0.0)
    flow, tx = F.col("total_flow"), F.col("total_transactions")
    ratio = F.col("out_degree") / F.greatest(F.col("in_degree"), F.lit(1))
    parts = {
        "centrality_risk": F.least(get("degree_centrality") * 2 + get("betweenness") * 3 + get("pagerank") * 100, F.lit(1.0)),
        "volume_risk": F.when(flow > 0, F.greatest(F.least(F.log10(flow) / 6, F.lit(1.0)), F.lit(0.0))).otherwise(0.0),
        "imbalance_risk": F.col("flow_imbalance"),
        "velocity_risk": F.when(tx > 0, F.least(tx / 30 / 50, F.lit(1.0))).otherwise(0.0),
        "structural_risk": F.when((ratio > 10) | (ratio < 0.1), 0.8).otherwise(0.1),
    }
    # Weights of the components in the order above.
    weights = dict(zip(parts, (0.25, 0.25, 0.20, 0.20, 0.10)))
    total = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    return base.withColumns(parts).withColumn("composite_risk", F.least(total, F.lit(1.0)))


def community_sizes(communities: DataFrame) -> DataFrame:
    return communities.groupBy("method", "community_id").agg(F.count(F.lit(1)).alias("size"))


def entity_patterns(meta: DataFrame, uedges: DataFrame, betweenness_df: DataFrame | None = None,
                    communities: DataFrame | None = None, hub: int = 100, bridge: float = 0.01, busy: int = 1000,
                    imbalance: float = 0.8, small: int = 5) -> DataFrame:
    """Suspicious patterns as rows (id, pattern, severity, score)."""
    neighbours = both_ways(uedges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("neighbours"))
    base = meta.join(neighbours, "id", "left").fillna(0, ["neighbours"])
    base = base.join(betweenness_df, "id", "left") if betweenness_df is not None else base.withColumn("betweenness", F.lit(0.0))
    if communities is not None:
        sized = communities.join(community_sizes(communities), ["method", "community_id"]).filter(F.col("size") < small)
        first = sized.groupBy(F.col("node").alias("id")).agg(F.min_by("size", "method").alias("small_size"))
        base = base.join(first, "id", "left")
    else:
        base = base.withColumn("small_size", F.lit(None).cast("long"))
    c = F.col

    def item(cond, name, severity, score):
        return F.when(cond, F.struct(F.lit(name).alias("pattern"), severity.alias("severity"), score.cast("double").alias("score")))

    medium, high = F.lit("medium"), F.lit("high")
    items = F.array(
        item(c("neighbours") > hub, "hub", F.when(c("neighbours") < 5 * hub, medium).otherwise(high),
             F.least(c("neighbours") / (10.0 * hub), F.lit(1.0))),
        item(c("betweenness") > bridge, "bridge", high, c("betweenness")),
        item(c("total_transactions") > busy, "high_velocity", medium, F.least(c("total_transactions") / (5.0 * busy), F.lit(1.0))),
        item(c("flow_imbalance") > imbalance, "flow_imbalance", medium, c("flow_imbalance")),
        item(c("small_size").isNotNull(), "isolated_community", F.lit("low"), 1 / c("small_size")))
    return base.select("id", F.explode(F.filter(items, lambda i: i.isNotNull())).alias("i")).select("id", "i.*")


def community_report(communities: DataFrame, meta: DataFrame, cent: DataFrame | None = None, shown: int = 10) -> DataFrame:
    """Size, first members, flows, counts and mean centralities per method and community."""
    base = communities.join(meta, F.col("node") == F.col("id"), "left")
    measures = []
    if cent is not None:
        measures = [m for m in cent.columns if m != "id"]
        base = base.drop("id").join(cent.withColumnRenamed("id", "node"), "node", "left")
    size, flow, txs = F.count(F.lit(1)), F.coalesce(F.sum("total_flow"), F.lit(0.0)), F.coalesce(F.sum("total_transactions"), F.lit(0))
    report = base.groupBy("method", "community_id").agg(
        size.alias("size"), flow.alias("total_flow"), (flow / size).alias("avg_flow_per_member"),
        txs.alias("total_transactions"), (txs / size).alias("avg_transactions_per_member"),
        *[F.sum(F.coalesce(F.col(m), F.lit(0.0))).alias(f"_{m}") for m in measures])
    report = report.select(*[c for c in report.columns if not c.startswith("_")],
                           *[(F.col(f"_{m}") / F.col("size")).alias(f"avg_{m}") for m in measures])
    # Spark keeps the first rows per group before the shuffle, so a giant community costs no more than a small one
    rank = F.row_number().over(Window.partitionBy("method", "community_id").orderBy("node"))
    first = communities.withColumn("_r", rank).filter(F.col("_r") <= shown).groupBy("method", "community_id").agg(
        F.array_sort(F.collect_list("node")).alias("members"))
    return report.join(first, ["method", "community_id"])


def network_summary(edges: DataFrame, parts: DataFrame, risk: DataFrame, communities: DataFrame | None = None) -> DataFrame:
    """One row: size, density, components, largest share, risk distribution, and communities per method as a map."""
    nodes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")).agg(
        F.sum("size").alias("nodes"), F.count(F.lit(1)).alias("components"), F.max("size").alias("largest_component"))
    links = edges.agg(F.count(F.lit(1)).alias("edges"))
    r = F.col("composite_risk")
    spread = risk.agg(F.avg(r).alias("mean_risk"), F.stddev_pop(r).alias("std_risk"),
                      F.count_if(r > 0.7).alias("high_risk_entities"), F.count_if(r < 0.3).alias("low_risk_entities"))
    out = nodes.crossJoin(links).crossJoin(spread)
    out = out.withColumns({
        "density": F.coalesce(F.try_divide(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)), F.lit(0.0)),
        "connectivity_ratio": F.try_divide("largest_component", "nodes")})
    if communities is not None:
        per = community_sizes(communities).groupBy("method").agg(
            F.count(F.lit(1)).alias("n_communities"), F.avg("size").alias("avg_community_size"))
        table = per.agg(F.map_from_entries(F.collect_list(F.struct("method", F.struct("n_communities", "avg_community_size")))).alias("communities"))
        out = out.crossJoin(table)
    return out


def entity_neighbours(edges: DataFrame) -> DataFrame:
    """Neighbours as rows (id, direction, neighbour): a hub's list is never gathered in one place."""
    return edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit("out").alias("direction"), F.col("dst").alias("neighbour")),
        F.struct(F.col("dst").alias("id"), F.lit("in").alias("direction"), F.col("src").alias("neighbour")))).alias("e")).select("e.*")


def entity_profiles(edges: DataFrame, uedges: DataFrame, cent: DataFrame, communities: DataFrame) -> DataFrame:
    """Everything known about each node: metadata, centralities, community per method, risk and patterns."""
    meta = node_metadata(edges)
    risk = entity_risk(meta, cent)
    between = cent.select("id", "betweenness") if "betweenness" in cent.columns else None
    found = entity_patterns(meta, uedges, between, communities).groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("pattern", "severity", "score"))).alias("patterns"))
    member = communities.groupBy(F.col("node").alias("id")).agg(
        F.map_from_entries(F.collect_list(F.struct("method", "community_id"))).alias("communities"))
    return risk.join(member, "id", "left").join(found, "id", "left")
