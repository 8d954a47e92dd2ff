"""Per-payer profiles: tail, inter-event, geographic, counterparty and volume statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.functions import scalars as sc
from riskflow.operators import ordered as od

ORDER = ["us", "transaction_id"]


def evt_profile(tx: DataFrame, p: float = 0.95, approximate: bool = False) -> DataFrame:
    """Tail threshold per payer, rows above it, and coefficient of variation.

    Works on the distinct amounts of each payer with their counts. ``approximate`` uses a quantile sketch instead.
    """
    amounts = tx.groupBy("payer_id", "amount").agg(F.count(F.lit(1)).alias("n"))
    if approximate:
        tail = tx.groupBy("payer_id").agg(
            F.percentile_approx("amount", p, 10_000).cast("double").alias("evt_threshold_p95"))
    else:
        tail = od.group_quantile(tx, ["payer_id"], "amount", p, "evt_threshold_p95")
    x, n = F.col("amount"), F.col("n")
    sums = amounts.join(tail, "payer_id").groupBy("payer_id").agg(
        F.max("evt_threshold_p95").alias("evt_threshold_p95"),
        F.sum(F.when(x.cast("double") > F.col("evt_threshold_p95"), n).otherwise(0)).alias("extreme_count"),
        F.sum(n).alias("sn"), F.sum(x * n).cast("decimal(28,2)").alias("sx"),
        F.sum((sc.squared(x) * n).cast("decimal(38,4)")).alias("sxx"))
    mean = F.col("sx").cast("double") / F.col("sn")
    return sums.select("payer_id", "evt_threshold_p95", "extreme_count",
                       F.try_divide(sc.sample_std("sn", "sx", "sxx"), mean).alias("tail_index_proxy"))


def burst_profile(tx: DataFrame, bin_seconds: int = 3600) -> DataFrame:
    """Mean and deviation of the gaps in seconds, gap dispersion (with and without unit) and count-based Fano factor."""
    gaps = od.shifted(tx.select("payer_id", *ORDER, "s"), ["payer_id"], ORDER, {"_prev": ("s", 1)})
    g = (F.col("s") - F.col("_prev")).cast("decimal(18,0)")
    sums = gaps.groupBy("payer_id", F.floor(F.col("s") / bin_seconds).alias("bin")).agg(
        F.count(g).alias("n"), F.sum(g).alias("sx"), F.sum((g * g).cast("decimal(36,0)")).alias("sxx"),
        F.count(F.lit(1)).alias("c")
    ).groupBy("payer_id").agg(
        F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sxx").cast("decimal(38,0)").alias("sxx"),
        F.sum("c").cast("double").alias("sc"), F.sum(F.col("c") * F.col("c")).cast("double").alias("scc"),
        (F.max("bin") - F.min("bin") + 1).alias("bins"))
    n = F.col("n")
    mean = F.try_divide(F.col("sx").cast("double"), n)
    var = F.when(n > 1, F.greatest(
        (F.col("sxx").cast("double") - F.col("sx").cast("double") * F.col("sx").cast("double") / n), F.lit(0.0)) / (n - 1))
    rate = F.col("sc") / F.col("bins")
    return sums.select(
        "payer_id", mean.alias("mean_interval"), F.sqrt(var).alias("std_interval"),
        F.try_divide(var, mean).alias("fano_interval"), F.try_divide(var, mean * mean).alias("cv2_interval"),
        ((F.col("scc") / F.col("bins") - rate * rate) / rate).alias("fano_counts"),
    ).withColumn("burstiness_pattern", sc.burst_label("fano_interval"))


def geo_profile(tx: DataFrame) -> DataFrame:
    """Entropy over visited grid cells, longest hop between consecutive transactions, number of cells."""
    here = tx.filter(F.col("geo_lat").isNotNull() & F.col("geo_lng").isNotNull())
    cells = here.groupBy("payer_id", F.round("geo_lat", 2).alias("a"), F.round("geo_lng", 2).alias("b")).agg(
        F.count(F.lit(1)).cast("double").alias("c"))
    spread = cells.groupBy("payer_id").agg(
        (F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")).alias("geo_entropy"),
        F.count(F.lit(1)).alias("unique_locations"))
    moves = od.shifted(here.select("payer_id", *ORDER, "geo_lat", "geo_lng"), ["payer_id"], ORDER,
                       {"_lat": ("geo_lat", 1), "_lng": ("geo_lng", 1)})
    hops = moves.groupBy("payer_id").agg(
        F.max(sc.haversine_km("_lat", "_lng", "geo_lat", "geo_lng")).alias("max_geo_distance"))
    return spread.join(hops, "payer_id", "left")


def network_profile(tx: DataFrame) -> DataFrame:
    """Out-degree, mean amount, and amounts weighted by how popular each payee is. Works on pair totals."""
    pairs = tx.groupBy("payer_id", "payee_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
    popular = pairs.groupBy("payee_id").agg(F.sum("n").alias("seen"))
    return pairs.join(popular, "payee_id").groupBy("payer_id").agg(
        F.count(F.lit(1)).alias("out_degree"),
        (F.sum("total").cast("double") / F.sum("n")).alias("avg_tx_amount"),
        F.sum(F.col("total").cast("double") * F.log1p(F.col("seen").cast("double"))).alias("pagerank_proxy"))


def entity_stats(tx: DataFrame, high_amount: float = 10000, atm: str = "ATM") -> DataFrame:
    """Volume, amount and diversity statistics per payer."""
    hour = F.hour("ts")
    x = F.col("amount")
    # one row per payer, payee, channel and day keeps what every statistic needs
    base = tx.groupBy("payer_id", "payee_id", "channel", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(sc.squared(x)).alias("sxx"),
        F.count_if(x > high_amount).alias("hi"), F.count_if((hour >= 22) | (hour <= 6)).alias("night"))
    sums = base.groupBy("payer_id").agg(
        F.sum("n").alias("total_transactions"), F.sum("sx").alias("_sx"), F.sum("sxx").cast("decimal(38,4)").alias("_sxx"),
        F.count_distinct("payee_id").alias("unique_payees"), F.count_distinct("channel").alias("unique_channels"),
        F.count_distinct("day").alias("active_days"), F.sum("hi").alias("high_amount_count"),
        F.sum("night").alias("night_tx_count"),
        F.sum(F.when(F.col("channel") == atm, F.col("n")).otherwise(0)).alias("atm_tx_count"))
    n = F.col("total_transactions")
    return sums.withColumns({
        "total_amount": F.col("_sx").cast("double"),
        "avg_amount": F.col("_sx").cast("double") / n,
        "std_amount": sc.sample_std(n, "_sx", "_sxx"),
    }).drop("_sx", "_sxx")


def risk_rollup(scored: DataFrame, dims=("channel", "risk_level", "day"), score: str = "risk_score") -> DataFrame:
    """Counts and mean score at every level of a drill-down."""
    return scored.rollup(*dims).agg(
        F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"))


def batch_summary(scored: DataFrame, score: str = "risk_score") -> DataFrame:
    """One row: how many were scored or failed, counts by level, share of high risk, mean score."""
    level = F.col("risk_level")
    ok = F.col(score).isNotNull()
    high = F.count_if(ok & level.isin("HIGH", "CRITICAL"))
    levels = [F.count_if(ok & (level == x)).alias(f"{x.lower()}_count") for x in ("CRITICAL", "HIGH", "MEDIUM", "LOW")]
    return scored.agg(
        F.count_if(ok).alias("successful_predictions"), F.count_if(~ok).alias("failed_predictions"),
        *levels, high.alias("high_risk_count"),
        F.coalesce(F.try_divide(high * F.lit(100.0), F.count_if(ok)), F.lit(0.0)).alias("high_risk_percentage"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("average_risk_score"))


def top_reasons(df: DataFrame, columns, n: int = 5, name: str = "reason_codes") -> DataFrame:
    """Per row, the ``n`` contribution columns largest in absolute value, largest first."""
    items = F.array(*[
        F.struct((-F.abs(F.coalesce(F.col(c), F.lit(0.0)))).alias("rank"), F.lit(c).alias("feature"),
                 F.coalesce(F.col(c), F.lit(0.0)).alias("contribution")) for c in columns])
    ordered = F.slice(F.array_sort(items), 1, n)
    return df.withColumn(name, F.transform(ordered, lambda r: F.struct(
        r.feature.alias("feature"), r.contribution.alias("contribution"),
        F.concat(F.lit("Weight of evidence for "), r.feature).alias("description"))))


def fairness(df: DataFrame, group: str, y: str, flagged: str) -> DataFrame:
    """Flag rate, true and false positive rate per group, and the largest gap of each over the groups."""
    rates = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(flagged).cast("double")).alias("flag_rate"),
        F.avg(F.when(F.col(y) == 1, F.col(flagged).cast("double"))).alias("tpr"),
        F.avg(F.when(F.col(y) == 0, F.col(flagged).cast("double"))).alias("fpr"))
    gap = lambda c: F.max(c) - F.min(c)
    gaps = rates.agg(gap("flag_rate").alias("parity_gap"),
                     F.greatest(gap("tpr"), gap("fpr")).alias("odds_gap"))
    return rates.crossJoin(F.broadcast(gaps))


def information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Entropies of two categorical columns, their joint entropy and mutual information, in bits."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("c"))

    def entropy(counts):
        return counts.agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("h"))

    parts = [entropy(cells.groupBy(a).agg(F.sum("c").alias("c"))), entropy(cells.groupBy(b).agg(F.sum("c").alias("c"))),
             entropy(cells)]
    ha, hb, hab = [p.withColumnRenamed("h", n) for p, n in zip(parts, ("entropy_a", "entropy_b", "entropy_joint"))]
    return ha.crossJoin(hb).crossJoin(hab).withColumn(
        "mutual_info", F.col("entropy_a") + F.col("entropy_b") - F.col("entropy_joint"))


def kl_divergence(p: DataFrame, q: DataFrame, column: str, floor: float = 1e-10) -> DataFrame:
    """Divergence in bits of the category shares of ``p`` from those of ``q``."""
    both = p.select(column, F.lit(1).alias("in_p")).unionByName(q.select(column, F.lit(0).alias("in_p")))
    counts = both.groupBy(column).agg(F.sum("in_p").alias("a"), F.count_if(F.col("in_p") == 0).alias("b"))
    totals = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    pa, pb = F.col("a") / F.col("ta"), F.greatest(F.col("b") / F.col("tb"), F.lit(floor))
    return counts.crossJoin(F.broadcast(totals)).agg(
        F.sum(F.when(F.col("a") > 0, pa * F.log2(pa / pb)).otherwise(0.0)).alias("kl"))


def tagged_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two samples stacked, with ``grp`` 0 for the first and 1 for the second."""
    return a.withColumn("grp", F.lit(0)).unionByName(b.withColumn("grp", F.lit(1)))


def transitions(tx: DataFrame, state: str = "channel") -> DataFrame:
    """Counts and shares of moves between consecutive states of the same payer."""
    lead = od.shifted(tx.select("payer_id", *ORDER, state), ["payer_id"], ORDER, {"next_state": (state, -1)})
    moves = lead.filter(F.col("next_state").isNotNull()).groupBy(F.col(state).alias("state"), "next_state").agg(
        F.count(F.lit(1)).alias("n"))
    # states are a small vocabulary: the windows below see one row per pair of states
    return moves.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("state")))
