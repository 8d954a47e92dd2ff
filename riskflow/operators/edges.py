"""The payment graph as tables: edges, their undirected form, node metadata, and the flagged edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.functions import scalars as sc
from riskflow.operators import ordered as od


def build_edges(tx: DataFrame) -> DataFrame:
    """One row per ordered pair, self-loops dropped, with amount, count, time and concentration measures."""
    x = F.col("amount")
    sums = tx.filter(F.col("payer_id") != F.col("payee_id")).groupBy(
        F.col("payer_id").alias("src"), F.col("payee_id").alias("dst")).agg(
        F.sum(x).alias("_sx"), F.sum(sc.squared(x)).alias("_sxx"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.min("us").alias("first_transaction"), F.max("us").alias("last_transaction"))
    n = F.col("transaction_count")
    out = sums.withColumns({
        "total_amount": F.col("_sx").cast("double"),
        "avg_amount": F.col("_sx").cast("double") / n,
        "amount_std": F.coalesce(sc.sample_std(n, "_sx", "_sxx"), F.lit(0.0)),
    }).drop("_sx", "_sxx")
    return out.withColumns({
        "weight": F.log1p("total_amount"),
        "velocity_score": n / F.lit(30.0),
        "amount_concentration": F.col("amount_std") / (F.col("avg_amount") + 1e-6),
        "suspicious_timing": sc.timing_score("first_transaction", "last_transaction", "transaction_count"),
    })


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of a pair merged; weights and amounts add up."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.sum("weight").alias("w"), F.sum("total_amount").alias("total_amount"))


def both_ways(uedges: DataFrame) -> DataFrame:
    """Each undirected edge as two rows (src, dst, w)."""
    return uedges.select(F.explode(F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "w"),
        F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))).alias("e")).select("e.*")


def node_metadata(edges: DataFrame) -> DataFrame:
    """Degrees, flows and averages for every node."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("dst").alias("id"), F.lit(True).alias("incoming")),
        F.struct(F.col("src").alias("id"), F.lit(False).alias("incoming")))).alias("e"),
        F.col("total_amount").alias("amt"), F.col("transaction_count").alias("n")).select("e.*", "amt", "n")
    into = F.col("incoming")
    cents = F.col("amt").cast("decimal(28,2)")
    pick = lambda cond, c: F.coalesce(F.sum(F.when(cond, c)), F.lit(0))
    nodes = ends.groupBy("id").agg(
        F.count_if(into).alias("in_degree"), F.count_if(~into).alias("out_degree"),
        pick(into, cents).cast("double").alias("in_amount"), pick(~into, cents).cast("double").alias("out_amount"),
        pick(into, F.col("n")).alias("in_transactions"), pick(~into, F.col("n")).alias("out_transactions"))
    total = nodes.agg(F.count(F.lit(1)).alias("_nodes"))
    c = F.col
    return nodes.crossJoin(F.broadcast(total)).withColumns({
        "total_degree": c("in_degree") + c("out_degree"),
        "net_flow": c("in_amount") - c("out_amount"),
        "total_flow": c("in_amount") + c("out_amount"),
        "total_transactions": c("in_transactions") + c("out_transactions"),
        "flow_imbalance": F.abs(c("in_amount") - c("out_amount")) / (c("in_amount") + c("out_amount") + 1e-6),
        "degree_centrality": F.try_divide(c("in_degree") + c("out_degree"), c("_nodes") - 1),
        "avg_in_amount": c("in_amount") / (c("in_transactions") + 1e-6),
        "avg_out_amount": c("out_amount") / (c("out_transactions") + 1e-6),
    }).drop("_nodes")


def degree_centrality(edges: DataFrame) -> DataFrame:
    meta = node_metadata(edges)
    total = meta.agg((F.count(F.lit(1)) - 1).alias("_m"))
    share = lambda c: F.try_divide(c, "_m")
    return meta.crossJoin(F.broadcast(total)).select(
        "id", share("total_degree").alias("degree"), share("in_degree").alias("in_degree"),
        share("out_degree").alias("out_degree"))


def shared_neighbours(edges: DataFrame, links: DataFrame) -> DataFrame:
    """Per edge (src, dst) in ``edges``: how many targets both ends pay in ``links``, and the Jaccard similarity.

    The shorter neighbour list of the two is expanded and looked up in the other, which keeps the intermediate rows
    within edges x sqrt(edges) whatever the hubs.
    """
    links = links.select("src", "dst")
    degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    d1, d2 = degree.select(F.col("src"), F.col("deg").alias("da")), degree.select(F.col("src").alias("dst"), F.col("deg").alias("db"))
    sized = edges.select("src", "dst").join(d1, "src").join(d2, "dst")
    short = F.col("da") <= F.col("db")
    probes = sized.select("src", "dst", F.when(short, F.col("src")).otherwise(F.col("dst")).alias("small"),
                          F.when(short, F.col("dst")).otherwise(F.col("src")).alias("large"))
    spread = probes.join(links.select(F.col("src").alias("small"), F.col("dst").alias("via")), "small")
    common = spread.join(links.select(F.col("src").alias("large"), F.col("dst").alias("via")), ["large", "via"]).groupBy(
        "src", "dst").agg(F.count(F.lit(1)).alias("common"))
    return sized.join(common, ["src", "dst"]).select(
        "src", "dst", "common", (F.col("common") / (F.col("da") + F.col("db") - F.col("common"))).alias("jaccard"))


def graph_edges(tx: DataFrame, minimum: int = 2) -> DataFrame:
    """Pairs seen at least ``minimum`` times, with risk category, structuring and bridge flags."""
    pairs = tx.groupBy(F.col("payer_id").alias("src"), F.col("payee_id").alias("dst")).agg(
        F.sum("amount").alias("total_amount"), F.count(F.lit(1)).alias("transaction_count"))
    strong = pairs.filter(F.col("transaction_count") >= minimum).withColumns({
        "avg_amount": F.col("total_amount").cast("double") / F.col("transaction_count"),
        # the running count of a pair peaks at its total
        "max_edge_weight": F.col("transaction_count"),
    })
    strong.persist()  # read three times for the thresholds
    high_total, high_count, high_mean = [
        od.quantiles(strong, c, [p])[0] for c, p in (("total_amount", 0.9), ("transaction_count", 0.9), ("avg_amount", 0.8))]
    strong.unpersist()
    shared = shared_neighbours(strong, pairs)
    out = strong.join(shared, ["src", "dst"], "left")
    heavy = (F.col("total_amount").cast("double") > high_total) & (F.col("transaction_count") > high_count)
    bridge = sc.flag(F.coalesce("common", F.lit(0)) > 0)
    return out.select(
        F.col("src").alias("source_node"), F.col("dst").alias("target_node"),
        F.col("total_amount").cast("double").alias("total_amount"), "transaction_count", "avg_amount", "max_edge_weight",
        bridge.alias("bridge_indicator"), F.coalesce("jaccard", F.lit(0.0)).alias("jaccard_similarity"),
        F.when(heavy, "HIGH_RISK").when(F.col("avg_amount") > high_mean, "MEDIUM_RISK").otherwise("LOW_RISK")
        .alias("edge_risk_category"),
        sc.flag((F.col("transaction_count") > 50) & (F.col("max_edge_weight") > 100)).alias("potential_structuring"),
        bridge.alias("community_bridge"))
