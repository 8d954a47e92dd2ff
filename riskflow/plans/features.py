"""The batch feature tables: behaviour, sequences, entities, and the master table that joins them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.functions import scalars as sc
from riskflow.operators import edges as eg
from riskflow.operators import encoding as en
from riskflow.operators import profiles as pf
from riskflow.operators import windows as wn
from riskflow.sources.transactions import recent


def behavioral_features(tx: DataFrame, recent_tx: DataFrame | None = None, with_flag: bool = True) -> DataFrame:
    """Velocity per transaction joined to the payer's tail, burst, geographic and counterparty profiles."""
    base = tx if recent_tx is None else recent_tx
    profiles = pf.evt_profile(base).join(
        pf.burst_profile(base).select("payer_id", "fano_interval", "mean_interval", "burstiness_pattern"), "payer_id", "left"
    ).join(pf.geo_profile(base), "payer_id", "left").join(pf.network_profile(base), "payer_id", "left")
    out = wn.velocity(tx)
    if with_flag:
        out = wn.high_velocity_flag(out, source=wn.velocity(tx, {"24h": wn.DAY}, distinct=()))
    out = out.join(profiles, "payer_id", "left")
    return out.withColumns({
        "amount_evt_ratio": F.try_divide(F.col("total_amount_24h").cast("double"), F.col("evt_threshold_p95")),
        "burstiness_pattern": F.coalesce("burstiness_pattern", F.lit("NORMAL")),
        "extreme_amount_flag": sc.flag(F.col("amount").cast("double") > F.col("evt_threshold_p95")),
        "geo_dispersion_flag": sc.flag(F.col("unique_locations") > 10),
    })


def ml_features(tx: DataFrame, labels: DataFrame, as_of: dt.datetime | None = None, band=(9800, 9999),
                bases: Sequence[int] = (1000, 500, 100), high_amount: float = 10000) -> DataFrame:
    """Master feature table: one row per transaction of the last 30 days.

    Velocity looks back 90 days. Sequence columns are added to the velocity rows in place, so the fact rows are never
    joined to themselves; profiles, edges and entities join by key.
    """
    if as_of is None:
        as_of = tx.agg(F.max("ts")).first()[0]
    long, short = recent(tx, 90, as_of), recent(tx, 30, as_of)
    behaviour = recent(behavioral_features(long, short), 30, as_of)
    seq = wn.sequence_features(short, band, bases, wide=behaviour)
    links = eg.graph_edges(short).select(
        F.col("source_node").alias("payer_id"), F.col("target_node").alias("payee_id"), "edge_risk_category",
        F.col("potential_structuring").alias("graph_structuring_flag"), "community_bridge")
    entities = en.entity_woe(pf.entity_stats(long, high_amount), labels).select(
        "payer_id", *[f"{m}_{n}" for m in ("woe", "iv") for n in en.FIXED_BINS], F.col("is_sar").alias("target_label"))
    joined = seq.join(links, ["payer_id", "payee_id"], "left").join(entities, "payer_id", "left")
    return joined.select(
        "transaction_id", "payer_id", "payee_id", "us", "amount", "channel",
        "tx_count_24h", "tx_count_7d", "tx_count_30d", "total_amount_24h", "unique_payees_24h", "unique_channels_24h",
        "velocity_ratio_24h_7d", "amount_evt_ratio", "fano_interval", "geo_entropy", "max_geo_distance", "out_degree",
        "pagerank_proxy", "high_velocity_flag", "extreme_amount_flag", "geo_dispersion_flag",
        "edge_risk_category", "graph_structuring_flag", "community_bridge",
        "potential_smurfing", "velocity_spike", "potential_layering", "max_run_length", "amount_zscore",
        sc.flag(F.col("sequence_risk_pattern") != "NORMAL").alias("sequence_anomaly_flag"),
        "woe_amount", "woe_volume", "woe_diversity", "iv_amount", "iv_volume", "iv_diversity", "target_label",
        sc.composite_score().alias("composite_risk_score"))
