"""Named queries: each takes (spark, folder of parquet tables) and returns a DataFrame over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.functions import scalars as sc
from riskflow.models import anomaly as an
from riskflow.models import fusion as fu
from riskflow.models import supervised as sv
from riskflow.models import volatility as vo
from riskflow.operators import causal as ca
from riskflow.operators import community as cm
from riskflow.operators import drift as dr
from riskflow.operators import edges as eg
from riskflow.operators import encoding as en
from riskflow.operators import graph as gr
from riskflow.operators import pointintime as pt
from riskflow.operators import profiles as pf
from riskflow.operators import resample as rs
from riskflow.operators import sequences as sq
from riskflow.operators import windows as wn
from riskflow.plans import features as ft
from riskflow.plans.common import tidy
from riskflow.session import cut
from riskflow.sources import quality as ql
from riskflow.sources import transactions as sx
from riskflow.streaming import streams as st

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BAND, BASES, HIGH = (98, 99.99), (100, 50, 10), 100


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


tx = sx.tx_from_events
tx_large = sx.tx_from_orders


# ---- row-level features

@query
def basic_features(spark, d):
    out = sc.basic_features(tx(spark, d), ("click", "view", "purchase"))
    return tidy(out.select("transaction_id", "amount", "amount_log", "hour_of_day", "day_of_week", "is_weekend", "is_night",
                           "channel_click", "channel_view", "channel_purchase", "has_geo",
                           sc.is_multiple("amount", 100).alias("is_round_100"), sc.is_multiple("amount", 5).alias("is_round_5")))


@query
def amount_pattern(spark, d):
    out = tx_large(spark, d).select("transaction_id", sc.amount_pattern("amount").alias("amount_pattern"),
                                    sc.bin_col("amount", (1000, 10000, 50000), ("A", "B", "C", "D")).alias("amount_bin"))
    return tidy(out)


@query
def geo_hops(spark, d):
    t = tx(spark, d)
    far = sc.haversine_km("geo_lat", "geo_lng", F.lit(0.0), F.lit(0.0))
    return tidy(t.select("transaction_id", sc.geo_cell().alias("cell"), far.alias("km_from_origin")), 4)


@query
def decisions(spark, d):
    t = tx(spark, d).withColumn("score", F.col("amount").cast("double") / (F.col("amount").cast("double") + 50.0))
    t = t.withColumn("confidence", F.col("payee_id") / F.lit(100.0))
    out = sc.with_decision(t, "score", "confidence", F.col("payee_id") < 10)
    return tidy(out.select("transaction_id", "score", "risk_level", "alert_priority", "recommended_action",
                           "investigation_minutes", sc.assign_arm("transaction_id", 10).alias("arm")))


@query
def focal_loss(spark, d):
    t = tx(spark, d)
    p = F.col("amount").cast("double") / (F.col("amount").cast("double") + 50.0)
    return tidy(t.groupBy("channel").agg(F.avg(sc.focal_loss(p, "is_sar")).alias("focal_loss")))


# ---- windows

@query
def velocity(spark, d):
    out = wn.velocity(tx(spark, d))
    return tidy(out.select("transaction_id", "payer_id", "tx_count_24h", "tx_count_7d", "tx_count_30d", "total_amount_24h",
                           "unique_payees_24h", "unique_channels_24h", "velocity_ratio_24h_7d"))


@query
def velocity_large(spark, d):
    out = wn.velocity(tx_large(spark, d))
    return tidy(out.select("transaction_id", "tx_count_24h", "tx_count_7d", "tx_count_30d", "total_amount_24h",
                           "unique_payees_24h", "unique_channels_24h"))


@query
def velocity_1h(spark, d):
    out = wn.velocity(tx(spark, d), {"1h": wn.HOUR}, distinct=())
    return tidy(out.select("transaction_id", "tx_count_1h"))


@query
def high_velocity(spark, d):
    out = wn.high_velocity_flag(wn.velocity(tx(spark, d), {"24h": wn.DAY}, distinct=()))
    return tidy(out.select("transaction_id", "tx_count_24h", "high_velocity_flag"))


@query
def edge_running(spark, d):
    out = wn.edge_running(tx(spark, d))
    return tidy(out.select("transaction_id", "edge_weight", "cumulative_amount", "rapid_sequence_signal", "high_amount_signal"))


@query
def sequence_base(spark, d):
    out = wn.sequence_base(tx(spark, d), BASES)
    return tidy(out.select("transaction_id", "seq_position", "prev_amount_1", "prev_amount_2", "prev_amount_3",
                           "time_gap_minutes", "amount_pattern", "payee_diversity_5tx"))


@query
def smurfing(spark, d):
    return tidy(wn.smurfing(tx_large(spark, d)).select("transaction_id", "potential_smurfing"))


@query
def smurfing_strict(spark, d):
    return tidy(wn.smurfing(tx(spark, d), BAND, k=2, strict=True).select("transaction_id", "potential_smurfing"))


@query
def velocity_spike(spark, d):
    out = wn.velocity_spike(wn.sequence_base(tx(spark, d), BASES), gap=240)
    return tidy(out.select("transaction_id", "velocity_spike"))


@query
def layering(spark, d):
    out = wn.layering(wn.sequence_base(tx(spark, d), BASES), gap=600)
    return tidy(out.select("transaction_id", "potential_layering"))


@query
def run_lengths(spark, d):
    return tidy(wn.run_lengths(tx(spark, d), BASES))


@query
def run_lengths_large(spark, d):
    return tidy(wn.run_lengths(tx_large(spark, d)))


@query
def amount_zscore(spark, d):
    return tidy(wn.amount_zscore(tx(spark, d)).select("transaction_id", "amount_zscore"))


@query
def sequence_features(spark, d):
    out = wn.sequence_features(tx(spark, d), BAND, BASES, limit=HIGH)
    return tidy(out.select("transaction_id", "seq_position", "time_gap_minutes", "amount_pattern", "payee_diversity_5tx",
                           "potential_smurfing", "velocity_spike", "potential_layering", "max_run_length", "pattern_count",
                           "sequence_risk_pattern", "amount_zscore"))


@query
def latest_n(spark, d):
    return tidy(wn.latest_n(tx(spark, d), ["payer_id"], "us", 50, "transaction_id").select("transaction_id", "payer_id", "rn"))


# ---- profiles

@query
def evt_profile(spark, d):
    return tidy(pf.evt_profile(tx(spark, d)))


@query
def burst_profile(spark, d):
    return tidy(pf.burst_profile(tx(spark, d)), 5, fano_interval=3, mean_interval=4, std_interval=4)


@query
def geo_profile(spark, d):
    return tidy(pf.geo_profile(tx(spark, d)), max_geo_distance=4)


@query
def network_profile(spark, d):
    return tidy(pf.network_profile(tx(spark, d)), pagerank_proxy=3)


@query
def entity_stats(spark, d):
    return tidy(pf.entity_stats(tx(spark, d), HIGH, "error"))


@query
def behavioral_features(spark, d):
    out = ft.behavioral_features(tx(spark, d))
    return tidy(out.select("transaction_id", "tx_count_24h", "evt_threshold_p95", "extreme_count", "tail_index_proxy",
                           "fano_interval", "geo_entropy", "unique_locations", "out_degree", "amount_evt_ratio",
                           "burstiness_pattern", "high_velocity_flag", "extreme_amount_flag", "geo_dispersion_flag"),
                fano_interval=3)


# ---- encodings and edges

@query
def woe_fixed(spark, d):
    t = tx(spark, d)
    out = en.entity_woe(pf.entity_stats(t, HIGH), sx.labels_from(t))
    return tidy(out.select("payer_id", "is_sar", "woe_amount", "woe_volume", "woe_diversity", "iv_amount", "iv_volume", "iv_diversity"))


@query
def woe_quantile(spark, d):
    t = tx(spark, d).withColumn("y", (F.col("channel") == "error").cast("long")).withColumn("k", F.col("payee_id"))
    _, table = en.woe_fit(t, ["amount", "k", "geo_lat"], "y", min_iv=0.0)
    return tidy(table.select("feature", "bin", "good", "bad", "woe", "iv", "rank", sc.iv_strength("iv").alias("strength")))


@query
def woe_applied(spark, d):
    t = tx(spark, d).withColumn("y", (F.col("channel") == "error").cast("long")).withColumn("k", F.col("payee_id"))
    edges, table = en.woe_fit(t, ["amount", "k"], "y", min_iv=0.0)
    return tidy(en.woe_transform(t, edges, table).select("transaction_id", "woe_amount", "woe_k"))


@query
def build_edges(spark, d):
    return tidy(eg.build_edges(tx(spark, d)))


@query
def graph_edges(spark, d):
    return tidy(eg.graph_edges(tx(spark, d)))


@query
def node_metadata(spark, d):
    return tidy(eg.node_metadata(eg.build_edges(tx(spark, d))))


@query
def degree_centrality(spark, d):
    return tidy(eg.degree_centrality(eg.build_edges(tx(spark, d))))


@query
def undirected_edges(spark, d):
    return tidy(eg.undirected(eg.build_edges(tx(spark, d))))


@query
def ml_features(spark, d):
    t = tx(spark, d)
    out = ft.ml_features(t, sx.labels_from(t), band=BAND, bases=BASES, high_amount=HIGH)
    return tidy(out, fano_interval=3, pagerank_proxy=3, max_geo_distance=4)


# ---- data preparation

def dirty(spark, d):
    """Transactions with some fields broken by rule, to validate and profile."""
    t = tx(spark, d)
    i = F.col("transaction_id")
    return t.withColumns({
        "amount": F.when(i % 50 == 7, -F.col("amount")).otherwise(F.col("amount")),
        "geo_lat": F.when(i % 40 == 3, F.col("geo_lat") + 100).otherwise(F.col("geo_lat")),
        "channel": F.when(i % 30 == 1, F.lit(None)).otherwise(F.col("channel")),
    })


@query
def recent_scan(spark, d):
    return tidy(sx.recent(tx(spark, d), 7).select("transaction_id"))


@query
def validate_tx(spark, d):
    checked = ql.failed_rules(dirty(spark, d))
    return tidy(checked.select("transaction_id", F.concat_ws(",", "failed").alias("failed")))


@query
def dq_profile(spark, d):
    out = ql.dq_profile(dirty(spark, d).select("transaction_id", "payer_id", "channel", "us"))
    return tidy(out)


@query
def scd2(spark, d):
    out = ql.scd2(tx(spark, d), "payer_id", ["channel"], "us", "transaction_id")
    return tidy(out)


@query
def screen(spark, d):
    t = tx(spark, d)
    # every payee ever paid over 300 is listed
    listed = t.filter(F.col("amount") > 300).select(F.col("payee_id").alias("entity_id"), F.col("channel").alias("list_type"))
    return tidy(ql.screen(t, listed).select("transaction_id", "payer_list", "payee_list", "watchlist_hit"))


@query
def dedup_requests(spark, d):
    out = ql.dedup_requests(tx(spark, d), ["payer_id", "payee_id", "channel"], "us", 72 * 3_600_000_000, "transaction_id")
    return tidy(out.select("transaction_id", "request_hash", "reused"))


@query
def resolve_entities(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(
        "c_custkey", F.concat_ws("-", "c_nationkey", F.floor(F.col("c_acctbal") / 20)).alias("tax_id"),
        F.concat_ws(".", "c_mktsegment", F.floor(F.col("c_acctbal") / 5)).alias("device"))
    return tidy(ql.resolve_entities(c, "c_custkey", ["tax_id", "device"]).select("c_custkey", "entity_id"))


# ---- point in time

@query
def pit_24h(spark, d):
    out = pt.pit_24h(tx(spark, d))
    return tidy(out.select("transaction_id", "tx_count_24h", "total_amount_24h", "unique_payees_24h", "amount_std_24h",
                           "amount_mean_24h", "amount_vs_mean_ratio"))


@query
def pit_24h_large(spark, d):
    out = pt.pit_24h(tx_large(spark, d))
    return tidy(out.select("transaction_id", "tx_count_24h", "total_amount_24h", "unique_payees_24h", "amount_mean_24h"))


TAIL = ["evt_p95_threshold", "amount_above_evt", "evt_excess_zscore", "amount_dispersion", "amount_percentile", "amount_zscore"]
HABITS = ["recent_tx_count", "round_amount_ratio", "rapid_sequence_ratio", "similar_amount_ratio", "channel_diversity"]
LINKS = ["payer_out_degree", "payee_in_degree", "max_tx_to_counterparty", "is_repeated_counterparty", "previous_tx_count",
         "network_centrality_proxy"]


@query
def pit_tail(spark, d):
    return tidy(pt.pit_tail(tx(spark, d)).select("transaction_id", *TAIL), 5, evt_excess_zscore=2)


@query
def pit_tail_short(spark, d):
    """History capped at 20 rows: the cap bites."""
    return tidy(pt.pit_tail(tx(spark, d), max_hist=20).select("transaction_id", *TAIL), 5, evt_excess_zscore=2)


@query
def pit_behaviour(spark, d):
    out = pt.pit_behaviour(tx(spark, d), 20, bases=(10, 5), rapid=600, near=20, above=30)
    return tidy(out.select("transaction_id", *HABITS, "amount_is_round_10", "amount_is_round_5"))


@query
def pit_network(spark, d):
    return tidy(pt.pit_network(tx(spark, d)).select("transaction_id", *LINKS))


@query
def online_features(spark, d):
    out = pt.online_features(tx(spark, d), ("click", "view", "purchase"), (10, 5), 20, 30, 600)
    return tidy(out.select("transaction_id", *pt.online_names(("click", "view", "purchase"), (10, 5))), 5, evt_excess_zscore=2)


@query
def asof_interval(spark, d):
    t = tx(spark, d)
    errors = t.filter(F.col("channel") == "error").select("payer_id", F.col("us").alias("err_us"), "amount")
    met = pt.asof_interval(t.select("transaction_id", "payer_id", "us"), errors, "payer_id", 86_400_000_000, "us", "err_us",
                           {"errors_24h": F.lit(1).cast("long"), "error_amount_24h": F.col("amount")})
    return tidy(met.select("transaction_id", "errors_24h", "error_amount_24h"))


# ---- graph

def edges_of(spark, d):
    return eg.build_edges(tx(spark, d))


def label_communities(spark, d):
    labels = cm.label_propagation(eg.undirected(edges_of(spark, d)))
    return cm.as_communities(labels, "label_propagation", "id", "label")


@query
def pagerank(spark, d):
    return tidy(gr.pagerank(edges_of(spark, d), tol=1e-11), 9)


@query
def pagerank_converged(spark, d):
    return tidy(gr.pagerank(edges_of(spark, d)), 6)


@query
def eigenvector(spark, d):
    return tidy(gr.eigenvector(eg.undirected(edges_of(spark, d)), tol=1e-10), 8)


@query
def components(spark, d):
    return tidy(gr.components(edges_of(spark, d)))


@query
def order_components(spark, d):
    """Parts and orders linked by order lines."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    links = cut(gr.contracted(lines.select((F.col("l_partkey") * 2).alias("src"), (F.col("l_orderkey") * 2 + 1).alias("dst"))))
    name = F.concat(F.when(F.col("id").bitwiseAND(F.lit(1)) == 1, "o").otherwise("p"), F.shiftright("id", 1))
    named = cut(gr.components(links).select(name.alias("id"), F.col("component").alias("_c")))
    least = named.groupBy("_c").agg(F.min("id").alias("component"))
    return tidy(named.join(least, named["_c"].eqNullSafe(least["_c"])).select("id", "component"))


@query
def label_propagation(spark, d):
    return tidy(label_communities(spark, d))


@query
def louvain(spark, d):
    return tidy(cm.louvain(eg.undirected(edges_of(spark, d))))


@query
def betweenness(spark, d):
    return tidy(gr.betweenness(eg.undirected(edges_of(spark, d)), distance="hop"))


@query
def betweenness_weighted(spark, d):
    return tidy(gr.betweenness(eg.undirected(edges_of(spark, d)), distance="weight"))


@query
def closeness(spark, d):
    return tidy(gr.closeness(eg.undirected(edges_of(spark, d))), 7)


@query
def community_report(spark, d):
    out = gr.community_report(label_communities(spark, d), eg.node_metadata(edges_of(spark, d)), eg.degree_centrality(edges_of(spark, d)).select("id", "degree"))
    return tidy(out.withColumn("members", F.concat_ws(",", F.transform("members", lambda m: m.cast("string")))), 4)


@query
def network_summary(spark, d):
    e = edges_of(spark, d)
    return tidy(gr.network_summary(e, gr.components(e), gr.entity_risk(eg.node_metadata(e))))


@query
def entity_risk(spark, d):
    e = edges_of(spark, d)
    out = gr.entity_risk(eg.node_metadata(e), gr.pagerank(e, tol=1e-11))
    return tidy(out.select("id", "centrality_risk", "volume_risk", "imbalance_risk", "velocity_risk", "structural_risk", "composite_risk"))


@query
def entity_patterns(spark, d):
    e = edges_of(spark, d)
    u = eg.undirected(e)
    out = gr.entity_patterns(eg.node_metadata(e), u, None, label_communities(spark, d), hub=60, busy=150, imbalance=0.5)
    return tidy(out)


@query
def entity_profiles(spark, d):
    e = edges_of(spark, d)
    cent = gr.pagerank(e, tol=1e-11)
    out = gr.entity_profiles(e, eg.undirected(e), cent, label_communities(spark, d))
    return out.withColumn("patterns", F.to_json("patterns")).withColumn("communities", F.to_json("communities"))


@query
def entity_neighbours(spark, d):
    return tidy(gr.entity_neighbours(edges_of(spark, d)))


@query
def khop(spark, d):
    e = edges_of(spark, d)
    feats = eg.node_metadata(e).select("id", "avg_out_amount", "out_degree")
    return tidy(gr.khop_features(e, feats.withColumn("out_degree", F.col("out_degree").cast("double")), 2))


@query
def propagate_risk(spark, d):
    t = tx(spark, d)
    seeds = sx.labels_from(t).filter("is_sar = 1").select(F.col("payer_id").alias("id"), F.lit(1.0).alias("weight"))
    return tidy(gr.propagate_risk(edges_of(spark, d), seeds, iters=100, tol=1e-11), 9)


# ---- validation and drift

def scored(spark, d):
    """Transactions with two scores, an outcome, a treatment, an instrument and a fixed propensity."""
    t = tx(spark, d)
    amt = F.col("amount").cast("double")
    return t.withColumns({
        "amt": amt, "k": F.col("payee_id").cast("double"), "p1": amt / (amt + 50.0), "p2": (F.col("payee_id") + 1) / 102.0,
        "y": (F.col("channel") == "error").cast("long"), "t": (F.col("channel") == "click").cast("long"),
        "z": (F.col("transaction_id") % 2), "e": (F.col("payee_id") + 10) / 120.0,
        "h": F.hour("ts").cast("double"), "day": F.dayofmonth("ts").cast("long")})


def halves(spark, d):
    s = scored(spark, d)
    return s.filter(F.col("day") <= 15), s.filter(F.col("day") > 15)


def facts(df, *names, digits=6):
    """The statistic and chosen info entries of a test result."""
    return tidy(df.select("test", "statistic", *[F.element_at("info", n).alias(n) for n in names]), digits)


@query
def psi(spark, d):
    return tidy(dr.psi(*halves(spark, d), ["amt", "k"]))


@query
def js_divergence(spark, d):
    return tidy(dr.js_divergence(*halves(spark, d), ["amt", "k"]))


@query
def psi_interval(spark, d):
    return tidy(dr.psi_interval(*halves(spark, d), "amt").drop("info"))


@query
def ks_2samp(spark, d):
    out = dr.ks_2samp(*halves(spark, d), "amt")
    return tidy(out.select("test", "statistic", "effect_size"))


def gappy_halves(spark, d):
    """Both samples, with every seventh value missing and every eleventh not a number."""
    amt = F.when(F.col("transaction_id") % 7 != 0, F.when(F.col("transaction_id") % 11 != 0, F.col("amt")).otherwise(F.lit(float("nan"))))
    return tuple(x.withColumn("amt", amt) for x in halves(spark, d))


@query
def psi_nulls(spark, d):
    return tidy(dr.psi(*gappy_halves(spark, d), ["amt", "k"]))


@query
def drift_nulls(spark, d):
    return tidy(dr.drift_report(*gappy_halves(spark, d), ["amt", "k"]))


@query
def drift_report(spark, d):
    return tidy(dr.drift_report(*halves(spark, d), ["amt", "k"]))


@query
def arch_lm(spark, d):
    s = scored(spark, d)
    return tidy(dr.arch_lm(s, "payer_id", ["us", "transaction_id"], "p1").drop("p_value"))


@query
def burst_test(spark, d):
    return tidy(dr.burst_test(tx(spark, d)).drop("p_value"), 4, chi2=2, var_interval=2)


@query
def gpd_moments(spark, d):
    return tidy(dr.gpd_fit(scored(spark, d), ["channel"], "amt"))


@query
def gpd_score(spark, d):
    s = scored(spark, d)
    return tidy(dr.gpd_score(s, dr.gpd_fit(s, ["channel"], "amt"), ["channel"], "amt").select("transaction_id", "tail_probability"))


@query
def gpd_var(spark, d):
    s = scored(spark, d)
    out = dr.gpd_var(dr.gpd_fit(s, ["channel"], "amt"), s.groupBy("channel").agg(F.count("*").alias("total")), ["channel"])
    return tidy(out.select("channel", "tail_var"), 5)


@query
def mean_excess(spark, d):
    return tidy(dr.mean_excess(scored(spark, d), "amt", [0.5, 0.75, 0.9, 0.95, 0.99]))


@query
def mcnemar(spark, d):
    return facts(dr.mcnemar(scored(spark, d), "y", "p1", "p2"), "n11", "n10", "n01", "n00")


@query
def importance_stability(spark, d):
    s = scored(spark, d)
    long = en.to_long(s.withColumn("fold", F.col("day") % 5), {c: F.col(c) for c in ("p1", "p2", "e", "h")}, ["fold"], value="v")
    return facts(dr.importance_stability(long.groupBy("feature", "fold").agg(F.avg("v").alias("importance"))), "mean_cv", "friedman")


@query
def hosmer_lemeshow(spark, d):
    return facts(dr.hosmer_lemeshow(scored(spark, d), "y", "p1"), "bins", digits=4)


@query
def auc(spark, d):
    return facts(dr.auc(scored(spark, d), "y", "p1"), "n1", "n0")


@query
def auc_compare(spark, d):
    return facts(dr.auc_compare(scored(spark, d), "y", "p1", "p2"), "auc1", "auc2")


@query
def runs_test(spark, d):
    return facts(dr.runs_test(scored(spark, d), ["us", "transaction_id"], "y", "p2"), "runs", "n1", "n2")


@query
def vif(spark, d):
    return tidy(dr.vif(scored(spark, d), ["amt", "h"]))


@query
def breusch_pagan(spark, d):
    return facts(dr.breusch_pagan(scored(spark, d), "y", "p1"), "n")


@query
def pr_curve(spark, d):
    return tidy(en.pr_curve(scored(spark, d), "y", "p2"))


@query
def evaluate(spark, d):
    return tidy(en.evaluate(scored(spark, d), "y", "p2", 0.6))


@query
def optimal_threshold(spark, d):
    return tidy(en.optimal_threshold(scored(spark, d), "y", "p1"))


@query
def roc_threshold(spark, d):
    return tidy(en.roc_threshold(scored(spark, d), "y", "p2"))


@query
def validation_suite(spark, d):
    out = dr.validate_model(scored(spark, d), ["us", "transaction_id"], "y", "p2", ["amt", "h", "k"])
    return tidy(out.drop("info", "run_at"))


@query
def batch_summary(spark, d):
    s = scored(spark, d).withColumn("risk_score", F.col("p1")).withColumn("risk_level", sc.risk_level("risk_score"))
    return tidy(pf.batch_summary(s))


@query
def risk_rollup(spark, d):
    s = scored(spark, d).withColumn("risk_level", sc.risk_level("p1"))
    return tidy(pf.risk_rollup(s, score="p1"))


@query
def fairness(spark, d):
    s = scored(spark, d).withColumn("grp", F.col("payer_id") % 4).withColumn("flagged", (F.col("p1") >= 0.6).cast("long"))
    return tidy(pf.fairness(s, "grp", "y", "flagged"))


@query
def mutual_info(spark, d):
    s = tx(spark, d).withColumn("hour", F.hour("ts"))
    return tidy(pf.information(s, "channel", "hour"))


@query
def kl_divergence(spark, d):
    a, b = halves(spark, d)
    return tidy(pf.kl_divergence(a, b, "channel"))


@query
def top_reasons(spark, d):
    s = scored(spark, d).withColumns({"c1": F.col("p1") - 0.5, "c2": F.col("p2") - 0.5, "c3": F.col("e") - 0.4})
    out = pf.top_reasons(s, ["c1", "c2", "c3"], 2)
    names = F.concat_ws(",", F.transform("reason_codes", lambda r: r.feature))
    return tidy(out.select("transaction_id", names.alias("features"), F.col("reason_codes")[0]["contribution"].alias("largest")))


@query
def transitions(spark, d):
    return tidy(pf.transitions(tx(spark, d)))


# ---- causal

@query
def ate_ipw(spark, d):
    return tidy(ca.ate_ipw(scored(spark, d), "t", "amt", "e"))


@query
def ate_dr_given(spark, d):
    s = scored(spark, d).withColumns({"mu0": 60 + F.col("k") * 0.01, "mu1": 61 + F.col("h") * 0.1})
    return tidy(ca.ate_dr(s, "t", "amt", "e"))


@query
def ate_dr(spark, d):
    s = ca.propensity(scored(spark, d), ["k", "h"], "t")
    return tidy(ca.ate_dr(ca.outcome_models(s, ["k", "h"], "t", "amt"), "t", "amt", "propensity"))


@query
def balance(spark, d):
    return tidy(ca.balance(scored(spark, d), ["k", "h", "amt"], "t"))


@query
def overlap(spark, d):
    return tidy(ca.overlap(scored(spark, d), "t", "p1").drop("ks_p"))


@query
def rosenbaum(spark, d):
    out = ca.rosenbaum(scored(spark, d), "t", "amt", "e", "transaction_id")
    return tidy(out.select("gamma", "pairs", "w_plus", "z_upper", "z_lower"))


@query
def iv_2sls(spark, d):
    out = ca.iv_2sls(scored(spark, d), [], "h", "amt", "z")
    return tidy(out.select("iv_estimate", "reduced_form", "partial_f"), 5)


@query
def granger(spark, d):
    out = ca.granger(scored(spark, d), ["payer_id"], ["us", "transaction_id"], "k", "amt")
    return tidy(out)


@query
def mediation(spark, d):
    return tidy(ca.mediation(scored(spark, d), [], "t", "k", "amt"), 5)


@query
def causal_diagnostics(spark, d):
    return tidy(ca.causal_diagnostics(scored(spark, d), "t", "amt", "p2"))


@query
def score_histogram(spark, d):
    return tidy(ca.score_histogram(scored(spark, d), "t", "e"))


# ---- resampling

@query
def bootstrap_ci(spark, d):
    return tidy(rs.bootstrap_ci(tx(spark, d), "transaction_id", "amount"))


@query
def permutation_test(spark, d):
    return tidy(rs.permutation_test(scored(spark, d), "transaction_id", "t", "amt"))


@query
def bayes_linreg(spark, d):
    post, _ = rs.bayes_linreg(scored(spark, d), ["h"], "amt", tau=0.01, sigma2=2500.0)
    return tidy(post, 5)


@query
def stress(spark, d):
    rescore = lambda df: df.withColumn("risk_score", F.col("amt") / (F.col("amt") + F.lit(50.0) + F.col("h")))
    out = rs.stress(scored(spark, d), {"base": {}, "surge": {"amt": 2.0}, "night": {"h": 0.5, "amt": 1.5}}, rescore)
    return tidy(out)


@query
def var_es(spark, d):
    s = scored(spark, d).withColumn("ret", F.col("amt") - 60)
    return tidy(rs.var_es(s, "channel", "ret", (0.95, 0.99)), 5)


@query
def ensemble_uncertainty(spark, d):
    out = rs.ensemble_uncertainty(scored(spark, d), ["p1", "p2", "e"])
    return tidy(out.select("transaction_id", "ensemble_mean", "ensemble_std"))


@query
def normal_score_corr(spark, d):
    return tidy(rs.normal_score_corr(scored(spark, d), ["amt", "k", "h"]))


# ---- models

@query
def fusion_em(spark, d):
    s = scored(spark, d)
    weights = fu.fuse_fit(s, ["p1", "p2", "e"], "y", rounds=50, tol=0.0)
    return tidy(spark.createDataFrame(list(weights.items()), "model string, weight double"), 8)


@query
def fused_score(spark, d):
    out = fu.fuse_score(scored(spark, d), {"p1": 0.5, "p2": 0.3, "e": 0.2}, 0.55)
    return tidy(out.select("transaction_id", "risk_score", "flagged"))


@query
def anomaly_blend(spark, d):
    s = scored(spark, d)
    out = an.anomaly_blend(s, an.score_bounds(s.filter("day <= 15"), ["amt", "k"]), ["k"])
    return tidy(out.select("transaction_id", "anomaly"))


@query
def time_folds(spark, d):
    out = sv.with_fold(scored(spark, d), "us")
    return tidy(out.groupBy("fold").agg(F.count("*").alias("n"), F.min("us").alias("first_us")))


@query
def conformal(spark, d):
    out = sv.conformal(scored(spark, d), "y", "p2", F.col("transaction_id") % 2 == 0, 0.2)
    return tidy(out.select("transaction_id", "set_size", "covered"))


@query
def survival(spark, d):
    s = scored(spark, d).withColumn("weeks", F.floor(F.col("amt") / 5))
    return tidy(sv.survival(s, "weeks", "y"))


@query
def garch(spark, d):
    s = scored(spark, d).withColumn("ret", F.col("p1") - 0.5)
    return tidy(an.garch_moments(s, "payer_id", ["us", "transaction_id"], "ret"))


def customer_profile(spark, d):
    """What each customer has and orders, orders or none."""
    bought = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("spent"))
    people = spark.read.parquet(f"{d}/customer.parquet").join(bought, F.col("c_custkey") == F.col("o_custkey"), "left")
    return people.select("c_custkey", F.col("c_acctbal").alias("balance"), F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("spent", F.lit(0.0)).alias("spent"))


@query
def local_outliers(spark, d):
    people = customer_profile(spark, d)
    return tidy(an.lof_score(people, an.fit_lof(people, ["balance", "orders", "spent"]), "c_custkey"), 5)


@query
def likely_path(spark, d):
    """The channels that amounts alone make most likely, by payer."""
    t = tx(spark, d).select("transaction_id", "payer_id", "us", "channel", "amount").withColumn("band", sc.bin_col("amount", (10, 50, 100, 200), ("A", "B", "C", "D", "E")))
    model = sq.fit_path(t, "payer_id", ["us", "transaction_id"], "channel", "band")
    return sq.likely_path(t, model, "payer_id", ["us", "transaction_id"], "band", "transaction_id")


@query
def garch_targeted(spark, d):
    s = scored(spark, d).withColumn("ret", F.col("p1") - 0.5)
    return tidy(vo.garch_fit(s, "payer_id", ["us", "transaction_id"], "ret", given=(0.1, 0.8)), 5)


@query
def garch_fit(spark, d):
    s = scored(spark, d).withColumn("ret", F.col("p1") - 0.5)
    return tidy(vo.garch_fit(s, "payer_id", ["us", "transaction_id"], "ret"), 5)


@query
def elliptic(spark, d):
    s = scored(spark, d)
    model = an.fit_elliptic(s, ["amt", "k"])
    return tidy(an.elliptic_score(s, model).select("transaction_id", "elliptic"), 5)


@query
def isolation_forest(spark, d):
    s = scored(spark, d)
    return tidy(an.isolation_score(s, an.fit_isolation_forest(s, ["amt", "k", "h"], "transaction_id"), "transaction_id"))


@query
def scorecard(spark, d):
    s = scored(spark, d)
    out = sv.Scorecard(["amt", "k", "h", "geo_lat"], "is_sar", min_iv=0.0).fit(s).transform(s, reasons=2)
    return tidy(out.select("transaction_id", "scorecard", F.to_json("reason_codes").alias("reasons")))


@query
def tree_contributions(spark, d):
    s = scored(spark, d)
    model = sv.TabularModel(["amt", "k", "h"], "is_sar", "transaction_id", depth=3).fit(s, calibrate_folds=0)
    return tidy(sv.tree_contributions(s, model.model, ["amt", "k", "h"], "transaction_id"))


@query
def score_batch(spark, d):
    s = scored(spark, d).withColumn("label", F.col("is_sar"))
    system = fu.RiskSystem(["amt", "k", "h"]).fit(s)
    out = system.score_batch(s, label_communities(spark, d))
    return tidy(out.select("transaction_id", "risk_score", "flagged", "risk_level", "alert_priority", "recommended_action", "investigation_minutes"))


# ---- streaming operators in batch form (tests run them as streams)

@query
def stream_counters(spark, d):
    return tidy(st.stream_counters(tx(spark, d), high=100))


@query
def stream_velocity(spark, d):
    return tidy(st.stream_velocity(tx(spark, d)).drop("approx_payees"))


@query
def stream_sessions(spark, d):
    return tidy(st.sessions(tx(spark, d)))
