"""Community detection by rounds of joins: label propagation, Louvain and greedy modularity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.operators.edges import both_ways
from riskflow.session import cut


def as_communities(df: DataFrame, method: str, node: str, label: str) -> DataFrame:
    return df.select(F.lit(method).alias("method"), F.col(node).alias("node"), F.col(label).alias("community_id"))


def label_propagation(uedges: DataFrame, iters: int = 1000) -> DataFrame:
    """Each round every node takes the label most of its neighbours hold, ties going to the smallest label, until none changes.

    Rounds of all nodes may end in two states by turns. From then on a hash picks half of the nodes a round, and a node keeps a label
    that no other beats. Raises if labels still change after ``iters`` rounds.
    """
    links = cut(both_ways(uedges).select("src", "dst"))
    state = cut(links.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")).withColumn("old", F.col("id")))
    halves = False
    for r in range(iters):
        votes = links.join(state.select(F.col("id").alias("src"), "label"), "src").groupBy("dst", "label").agg(F.count(F.lit(1)).alias("n"))
        chosen = votes.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b"))
        options = state.join(chosen, "id")
        if halves:
            held = votes.select(F.col("dst").alias("id"), "label", "n")
            options = options.join(held, ["id", "label"], "left")
            wants = F.coalesce("n", F.lit(0)) < -F.col("b.n")
            turn = F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0
        else:
            wants, turn = F.col("label") != F.col("b.label"), F.lit(True)
        fresh = cut(options.select("id", F.when(wants & turn, F.col("b.label")).otherwise(F.col("label")).alias("label"), F.col("label").alias("old"),
                                   F.col("old").alias("older"), wants.alias("wants")))
        state = fresh.select("id", "label", "old")
        if fresh.filter("wants").isEmpty():
            return state.select("id", "label")
        if not halves and r and fresh.filter("label <> older").isEmpty():
            halves = True
    raise RuntimeError(f"labels still change after {iters} rounds")


def modularity(uedges: DataFrame, state: DataFrame) -> float:
    """Weighted modularity of (id, label); edges with equal ends are self-loops."""
    la = state.select(F.col("id").alias("a"), F.col("label").alias("la"))
    lb = state.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    tagged = uedges.join(la, "a").join(lb, "b")
    ends = tagged.select(F.explode(F.array(
        F.struct(F.col("la").alias("c"), F.col("w").alias("k"), F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0).alias("inside")),
        F.struct(F.col("lb").alias("c"), F.col("w").alias("k"), F.lit(0.0).alias("inside")))).alias("e")).select("e.*")
    per = ends.groupBy("c").agg(F.sum("k").alias("k"), F.sum("inside").alias("inside"))
    k2, inside, total = per.agg(F.sum(F.col("k") * F.col("k")), F.sum("inside"), F.sum("k")).first()
    return inside / (total / 2) - k2 / (total * total) if total else 0.0


def _contract(uedges: DataFrame, state: DataFrame) -> DataFrame:
    la = state.select(F.col("id").alias("a"), F.col("label").alias("la"))
    lb = state.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    return cut(uedges.join(la, "a").join(lb, "b").groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(
        F.sum("w").alias("w")))


def _strengths(uedges: DataFrame) -> DataFrame:
    return uedges.select(F.explode(F.array("a", "b")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("k"))


def _local_moves(uedges: DataFrame, rounds: int, seed: int, step: float) -> tuple[DataFrame, float, bool]:
    """Move nodes to the neighbouring community with the best gain, until all that nodes would gain adds up to less than ``step``.

    Each round a hash picks a share of the nodes that want to move, at first half of them. The share doubles after moves that raise modularity
    together, and falls to a quarter after moves that don't, which are taken back. When it comes to less than one node, those move whose
    gain is the best of both communities they touch: such moves don't affect each other's gains, so modularity rises by their sum.
    """
    links = cut(both_ways(uedges.filter("a <> b")))
    nodes = cut(_strengths(uedges))
    m = nodes.agg(F.sum("k")).first()[0] / 2
    state = cut(nodes.withColumn("label", F.col("id")))
    score, moved, share = modularity(uedges, state.select("id", "label")), False, 0.5
    for r in range(rounds):
        sizes = state.groupBy("label").agg(F.sum("k").alias("tot"))
        toward = links.join(state.select(F.col("id").alias("dst"), F.col("label").alias("to")), "dst").groupBy(
            F.col("src").alias("id"), "to").agg(F.sum("w").alias("kc"))
        own = state.select("id", F.col("label").alias("to"), F.lit(0.0).alias("kc"))
        options = toward.unionByName(own).groupBy("id", "to").agg(F.sum("kc").alias("kc")).join(
            state.select("id", "k", "label"), "id").join(sizes.withColumnRenamed("label", "to"), "to")
        rest = F.col("tot") - F.when(F.col("to") == F.col("label"), F.col("k")).otherwise(0.0)
        gain = F.col("kc") / F.lit(m) - F.col("k") * rest / F.lit(2 * m * m)
        best = options.withColumn("gain", F.round(gain, 12)).groupBy("id").agg(
            F.min(F.struct((-F.col("gain")).alias("g"), "to")).alias("b"),
            F.max(F.when(F.col("to") == F.col("label"), F.col("gain"))).alias("stay"))
        wants = -F.col("b.g") > F.col("stay") + 1e-12
        draw = F.pmod(F.xxhash64("id", F.lit(seed + r)), F.lit(1 << 30)) / float(1 << 30)
        fresh = cut(state.join(best, "id").select("id", "k", F.col("label").alias("old"), F.col("b.to").alias("to"), wants.alias("wants"), draw.alias("draw"),
                                                  (-F.col("b.g") - F.col("stay")).alias("rise")))
        hope, wanting = fresh.filter("wants").agg(F.sum("rise"), F.count(F.lit(1))).first()
        if hope is None or hope < step:
            return state.select("id", "label"), score, moved
        to = lambda go: F.when(go, F.col("to")).otherwise(F.col("old")).alias("label")
        while True:
            if single := share * wanting < 1:
                key = F.struct((-F.col("rise")).alias("g"), "id")
                offers = fresh.filter("wants").select(F.explode(F.array("old", "to")).alias("c"), key.alias("key"))
                free = offers.groupBy("c").agg(F.min("key").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
                trial = cut(fresh.join(free.select(F.col("key.id").alias("id"), F.lit(True).alias("go")), "id", "left").select(
                    "id", "k", to(F.coalesce("go", F.lit(False)))))
            else:
                trial = fresh.select("id", "k", to(F.col("wants") & (F.col("draw") < share)))
            reached = modularity(uedges, trial.select("id", "label"))
            if reached > score:
                share, score, moved, state = min(0.5, 2 * max(share, 1 / wanting)), reached, True, trial
                break
            if single:
                break
            share /= 4
    raise RuntimeError(f"nodes still gain by moving after {rounds} rounds")


def louvain(uedges: DataFrame, seed: int = 42, levels: int = 100, rounds: int = 1000, step: float = 1e-4) -> DataFrame:
    """Louvain communities as (id, label): local moves, contraction, repeat until no community moves. Modularity never falls between levels.

    ``step``: a level ends when what all of its nodes would gain by moving adds up to less. Raises if ``levels`` levels or ``rounds``
    rounds of a level are not enough.
    """
    graph = cut(uedges.select("a", "b", "w"))
    result, score = None, None
    for level in range(levels):
        state, trial, moved = _local_moves(graph, rounds, seed + 1000 * level, step)
        if result is None:
            result = state
        elif moved:
            result = cut(result.join(state.select(F.col("id").alias("label"), F.col("label").alias("up")), "label").select(
                "id", F.col("up").alias("label")))
        if not moved or (score is not None and trial <= score + 1e-7):
            return result
        score = trial
        graph = _contract(graph, state)
    raise RuntimeError(f"communities still move after {levels} levels")


def greedy_modularity(uedges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Agglomerate: every round merges the pairs of communities that are each other's best merge with a positive gain."""
    graph = cut(uedges.select("a", "b", "w"))
    result = _strengths(graph).select("id", F.col("id").alias("label"))
    for _ in range(max_rounds):
        k = cut(_strengths(graph))
        two_m = k.agg(F.sum("k")).first()[0]
        ka, kb = k.select(F.col("id").alias("a"), F.col("k").alias("ka")), k.select(F.col("id").alias("b"), F.col("k").alias("kb"))
        gain = 2 * (F.col("w") / F.lit(two_m) - F.col("ka") * F.col("kb") / F.lit(two_m * two_m))
        pairs = graph.filter("a <> b").join(ka, "a").join(kb, "b").withColumn("gain", F.round(gain, 14)).filter("gain > 0")
        key = F.struct((-F.col("gain")).alias("g"), "a", "b")
        offers = pairs.select(F.explode(F.array("a", "b")).alias("id"), key.alias("key"))
        best = offers.groupBy("id").agg(F.min("key").alias("key"))
        mutual = best.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("key.a", "key.b")
        merges = cut(mutual)
        if merges.isEmpty():
            return result
        onto = merges.select(F.col("b").alias("label"), F.col("a").alias("up"))
        result = cut(result.join(onto, "label", "left").select("id", F.coalesce("up", "label").alias("label")))
        ids = k.select("id").join(onto.withColumnRenamed("label", "id"), "id", "left").select("id", F.coalesce("up", "id").alias("label"))
        graph = _contract(graph, ids)
    raise RuntimeError(f"communities still merge after {max_rounds} rounds")
