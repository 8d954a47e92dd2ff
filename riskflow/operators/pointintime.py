"""Point-in-time features: what was known about payer and payee strictly before each transaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.functions import scalars as sc
from riskflow.operators import ordered as od

ORDER = ["us", "transaction_id"]
DAY_US = 86_400_000_000


def _with_next(df: DataFrame, keys: Sequence[str], name: str, hot: od.Hot | None = None) -> DataFrame:
    return od.shifted(df, keys, ORDER, {name: ("us", -1)}, hot)


def _seen_until(following: str, width: int):
    return F.least(F.coalesce(F.col(following), F.col("us") + width), F.col("us") + width)


def pit_24h(tx: DataFrame, hot: od.Hot | None = None, hot_pair: od.Hot | None = None) -> DataFrame:
    """Count, sum, distinct payees, mean and deviation of the payer's previous 24 hours."""
    hot = od.find_hot(tx, ["payer_id"]) if hot is None else hot
    hot_pair = od.find_hot(tx, ["payer_id", "payee_id"], within=hot) if hot_pair is None else hot_pair
    last = F.col("us") + DAY_US
    one = F.lit(1).cast("long")
    out = od.trailing(_with_next(od.gathered(tx, hot), ["payer_id", "payee_id"], "_next", hot_pair), ["payer_id"], "us", {
        "tx_count_24h": (one, last), "total_amount_24h": (F.col("amount"), last),
        "_sxx": (sc.squared("amount"), last),
        "unique_payees_24h": (one, _seen_until("_next", DAY_US)),
    }, hot, inclusive=False)
    n = F.col("tx_count_24h")
    mean = F.coalesce(F.try_divide(F.col("total_amount_24h").cast("double"), n), F.lit(0.0))
    std = F.coalesce(sc.sample_std(n, "total_amount_24h", "_sxx"), F.lit(0.0))
    return out.withColumns({"amount_std_24h": std, "amount_mean_24h": mean}).withColumn(
        "amount_vs_mean_ratio", F.col("amount").cast("double") / F.greatest(F.col("amount_mean_24h"), F.lit(1.0))
    ).drop("_next", "_sxx")


def with_history(tx: DataFrame, item, size: int, name: str, hot: od.Hot | None = None, before: int | None = None,
                 prepare=None) -> DataFrame:
    """Add the last ``size`` values of ``item`` among the payer's rows strictly before each transaction.

    Rows of one instant share the history of the first of them. ``prepare(window)`` may add lag columns first.
    """
    win = od.chunk_window(["payer_id"], ORDER)
    framed = od.row_frames(tx, ["payer_id"], ORDER, before=before or size, hot=hot)
    if prepare:
        framed = framed.withColumns(prepare(win))
    first = F.coalesce(F.lag("us").over(win) < F.col("us"), F.lit(True))
    listed = framed.withColumn("_first", first).withColumn("_h", F.collect_list(item).over(win.rowsBetween(-size, -1)))
    history = F.last(F.when(F.col("_first"), F.col("_h")), ignorenulls=True)
    out = listed.withColumn(name, history.over(win.rowsBetween(Window.unboundedPreceding, 0)))
    return od.shed(out).drop("_first", "_h")


def _mean(a):
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _pop_var(a, mean):
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(a)


def pit_tail(tx: DataFrame, max_hist: int = 1000, minimum: int = 10, days: int = 30, hot: od.Hot | None = None) -> DataFrame:
    """Tail and distribution position of the amount among the payer's latest rows of the last ``days`` days."""
    amount = F.col("amount").cast("double")
    rows = with_history(tx, F.struct("us", amount.alias("x")), max_hist, "_hist", hot)
    recent = F.filter("_hist", lambda r: r.us >= F.col("us") - days * DAY_US)
    rows = rows.withColumn("_a", F.array_sort(F.transform(recent, lambda r: r.x))).drop("_hist")
    n = F.size("_a")
    spot = (n - 1) * F.lit(0.95)
    low, high = F.element_at("_a", (F.floor(spot) + 1).cast("int")), F.element_at("_a", (F.ceil(spot) + 1).cast("int"))
    rows = rows.withColumn("_ok", n >= minimum)
    rows = rows.withColumn("_p95", F.when(F.col("_ok"), low + (high - low) * (spot - F.floor(spot))))
    rows = rows.withColumn("_m", F.when(F.col("_ok"), _mean(F.col("_a"))))
    rows = rows.withColumn("_v", F.when(F.col("_ok"), _pop_var(F.col("_a"), F.col("_m"))))
    rows = rows.withColumn("_x", F.when(F.col("_ok"), F.transform(
        F.filter("_a", lambda x: x > F.col("_p95")), lambda x: x - F.col("_p95"))))
    rows = rows.withColumn("_xm", F.when(F.size("_x") > 0, _mean(F.col("_x"))))
    above = F.col("_ok") & (amount > F.col("_p95"))
    less, up_to = F.size(F.filter("_a", lambda x: x < amount)), F.size(F.filter("_a", lambda x: x <= amount))
    rank = (less + up_to + F.when(less < up_to, 1).otherwise(0)) / (n * F.lit(2.0))
    spread = F.sqrt(_pop_var(F.col("_x"), F.col("_xm")))
    out = rows.withColumns({
        "evt_p95_threshold": F.coalesce(F.col("_p95"), amount),
        "amount_above_evt": sc.flag(above),
        "evt_excess_zscore": F.when(above & (F.size("_x") > 0),
                                    (amount - F.col("_p95") - F.col("_xm")) / (spread + 1e-8)).otherwise(0.0),
        "amount_dispersion": F.when(F.col("_ok"), F.least(F.col("_v") / (F.col("_m") + 1e-8), F.lit(10.0))).otherwise(1.0),
        "amount_percentile": F.when(F.col("_ok"), rank).otherwise(0.5),
        "amount_zscore": F.when(F.col("_ok"), (amount - F.col("_m")) / (F.sqrt("_v") + 1e-8)).otherwise(0.0),
    })
    return out.drop("_a", "_ok", "_p95", "_m", "_v", "_x", "_xm")


def pit_behaviour(tx: DataFrame, size: int = 50, days: int = 7, bases: Sequence[int] = (1000, 500), rapid: int = 30,
                  near: float = 100, above: float = 5000, hot: od.Hot | None = None) -> DataFrame:
    """Habits in the payer's latest rows of the last ``days`` days: round, rapid and similar amounts, channels."""
    amount = F.col("amount").cast("double")
    whole = F.round("amount").cast("long")
    item = F.struct(
        "us", "_pus", "channel",
        (F.when(whole % bases[0] == 0, 1).otherwise(0) + F.when(whole % bases[1] == 0, 1).otherwise(0)).alias("round"),
        ((sc.whole_units("us", "_pus", 60_000_000) < rapid)).alias("rapid"),
        ((F.abs(F.col("amount") - F.col("_pamt")) < near) & (amount > above)).alias("similar"))
    rows = with_history(tx, item, size, "_hist", hot, before=size + 1, prepare=lambda win: {
        "_pus": F.lag("us").over(win), "_pamt": F.lag("amount").over(win)}).drop("_pus", "_pamt")
    start = F.col("us") - days * DAY_US
    rows = rows.withColumn("_k", F.filter("_hist", lambda r: r.us >= start)).drop("_hist")
    n = F.size("_k")
    per = F.greatest(n, F.lit(1))
    tally = lambda cond: F.size(F.filter("_k", cond)) / per
    return rows.withColumns({
        "recent_tx_count": n.cast("long"),
        "round_amount_ratio": F.aggregate("_k", F.lit(0), lambda s, r: s + r.round) / per,
        "rapid_sequence_ratio": tally(lambda r: (r._pus >= start) & r.rapid),
        "similar_amount_ratio": tally(lambda r: (r._pus >= start) & r.similar),
        "channel_diversity": F.greatest(F.size(F.array_distinct(F.transform("_k", lambda r: r.channel))), F.lit(1)).cast("long"),
        f"amount_is_round_{bases[0]}": sc.is_multiple("amount", bases[0]),
        f"amount_is_round_{bases[1]}": sc.is_multiple("amount", bases[1]),
    }).drop("_k")


def pit_network(tx: DataFrame, days: int = 30, hot: od.Hot | None = None) -> DataFrame:
    """Counterparty counts before each transaction: payer out-degree, payee in-degree, busiest and same counterparty."""
    width = days * DAY_US
    pair = ["payer_id", "payee_id"]
    hot_payer = od.find_hot(tx, ["payer_id"]) if hot is None else hot
    one = F.lit(1).cast("long")
    hot_pair = od.find_hot(tx, pair)
    # the peak reads its input twice, so it goes first, on the plain rows
    out = od.trailing_peak(tx, ["payer_id"], "payee_id", "us", width, "max_tx_to_counterparty", hot_payer)
    out = _with_next(out, pair, "_next", hot_pair)
    out = od.trailing(out, ["payer_id"], "us", {"payer_out_degree": (one, _seen_until("_next", width))}, hot_payer, False)
    out = od.trailing(out, ["payee_id"], "us", {"payee_in_degree": (one, _seen_until("_next", width))},
                      od.find_hot(tx, ["payee_id"]), False).drop("_next")
    out = od.trailing(out, pair, "us", {"previous_tx_count": (one, None)}, hot_pair, False)
    return out.withColumns({
        "is_repeated_counterparty": sc.flag(F.col("previous_tx_count") > 0),
        "network_centrality_proxy": F.log1p((F.col("payer_out_degree") * F.col("payee_in_degree")).cast("double")),
    })


def online_features(tx: DataFrame, channels: Sequence[str] = sc.CHANNELS, bases: Sequence[int] = (1000, 500),
                    near: float = 100, above: float = 5000, rapid: int = 30) -> DataFrame:
    """All point-in-time features of every transaction, added step by step so the rows are never joined to themselves."""
    hot = od.find_hot(tx, ["payer_id"])
    # the busiest counterparty needs the plain rows twice, so it comes first
    out = pit_network(sc.basic_features(tx, channels), hot=hot)
    out = pit_24h(out, hot, od.find_hot(tx, ["payer_id", "payee_id"]))
    return pit_behaviour(pit_tail(out, hot=hot), bases=bases, rapid=rapid, near=near, above=above, hot=hot)


def online_names(channels: Sequence[str] = sc.CHANNELS, bases: Sequence[int] = (1000, 500)) -> list[str]:
    """The 35 feature columns in their fixed order."""
    return [
        "amount", "amount_log", "hour_of_day", "day_of_week", "is_weekend", "is_night",
        *[f"channel_{c.lower()}" for c in channels], "has_geo",
        "tx_count_24h", "total_amount_24h", "unique_payees_24h", "amount_std_24h", "amount_mean_24h", "amount_vs_mean_ratio",
        "evt_p95_threshold", "amount_above_evt", "evt_excess_zscore", "amount_dispersion", "amount_percentile", "amount_zscore",
        "recent_tx_count", "round_amount_ratio", "rapid_sequence_ratio", "similar_amount_ratio", "channel_diversity",
        *[f"amount_is_round_{b}" for b in bases],
        "payer_out_degree", "payee_in_degree", "max_tx_to_counterparty", "is_repeated_counterparty", "previous_tx_count",
        "network_centrality_proxy",
    ]


def asof_interval(left: DataFrame, right: DataFrame, key: str, width: int, left_at: str, right_at: str,
                  sums: dict[str, Column]) -> DataFrame:
    """Add to each left row the sums over the right rows of its key in ``[t - width, t)``.

    Right rows enter and expire as events among the left rows, so no pairs are formed however busy a key is.
    """
    values = right.select(key, F.col(right_at).alias("_r"), *[c.alias(n) for n, c in sums.items()])
    kinds = {n: values.schema[n].dataType for n in sums}
    empty = F.lit(None).cast(left.schema)
    step = lambda at, sign: F.struct(at.alias("_at"), *[(F.col(n) * sign).cast(kinds[n]).alias(n) for n in sums])
    moves = values.select(key, F.explode(F.array(step(F.col("_r") + 1, 1), step(F.col("_r") + width + 1, -1))).alias("_e"))
    moves = moves.select(key, "_e.*", empty.alias("_row"))
    asks = left.select(key, F.col(left_at).alias("_at"), *[F.lit(None).cast(k).alias(n) for n, k in kinds.items()],
                       F.struct(*left.columns).alias("_row"))
    out = od.running(asks.unionByName(moves), [key], "_at", {f"_s_{n}": F.col(n) for n in sums})
    return out.filter(F.col("_row").isNotNull()).select(
        "_row.*", *[F.coalesce(F.col(f"_s_{n}"), F.lit(0)).alias(n) for n in sums])
