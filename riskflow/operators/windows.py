"""Per-payer windowed features: trailing velocity, pair history, sequences and structuring flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.functions import scalars as sc
from riskflow.operators import ordered as od

HOUR, DAY = 3600, 86_400
WINDOWS = {"24h": DAY, "7d": 7 * DAY, "30d": 30 * DAY}
ORDER = ["us", "transaction_id"]


def until_next(item: str, at: str, width: int):
    """Last query point that a row still represents its item at: just before the next sighting or the window's end."""
    following = F.col(f"_next_{item}")
    return F.least(F.coalesce(following - 1, F.col(at) + width), F.col(at) + width)


def with_next(tx: DataFrame, keys: Sequence[str], item: str, at: str, hot: od.Hot | None = None) -> DataFrame:
    """Add ``_next_<item>``: when the same item is seen again by the same key."""
    return od.shifted(tx, [*keys, item], [at, "transaction_id"], {f"_next_{item}": (at, -1)}, hot)


def velocity(tx: DataFrame, windows: dict[str, int] | None = None, key: str = "payer_id",
             distinct: Sequence[str] = ("payee_id", "channel")) -> DataFrame:
    """Trailing counts per window, 24h sum and 24h distinct counts, current second included, and the 24h/7d ratio."""
    windows = windows or WINDOWS
    names = {"payee_id": "unique_payees_24h", "channel": "unique_channels_24h"}
    hot = od.find_hot(tx, [key])
    ready = od.gathered(tx, hot)
    for item in distinct:
        ready = with_next(ready, [key], item, "s", od.find_hot(tx, [key, item], within=hot))
    one = F.lit(1).cast("long")
    measures = {f"tx_count_{n}": (one, F.col("s") + w) for n, w in windows.items()}
    measures["total_amount_24h"] = (F.col("amount"), F.col("s") + DAY)
    for item in distinct:
        measures[names.get(item, f"unique_{item}_24h")] = (one, until_next(item, "s", DAY))
    out = od.trailing(ready, [key], "s", measures, hot).drop(*[f"_next_{i}" for i in distinct])
    if {"24h", "7d"} <= set(windows):
        out = out.withColumn("velocity_ratio_24h_7d", F.try_divide("tx_count_24h", "tx_count_7d"))
    return out


def high_velocity_flag(df: DataFrame, column: str = "tx_count_24h", p: float = 0.95, source: DataFrame | None = None) -> DataFrame:
    """1 where the count exceeds its global percentile. ``source`` may hold the same counts more cheaply."""
    cut = od.quantiles(df if source is None else source, column, [p])[0]
    return df.withColumn("high_velocity_flag", sc.flag(F.col(column) > F.lit(cut)))


def edge_running(tx: DataFrame, rapid_seconds: int = 300, high_p: float = 0.95) -> DataFrame:
    """Running count and sum per payer-payee pair, rapid repeats and amounts above the payer's percentile."""
    pair = ["payer_id", "payee_id"]
    hot = od.find_hot(tx, pair)
    lagged = od.shifted(tx, pair, ORDER, {"_prev": ("us", 1)}, hot)
    out = od.running(lagged, pair, "us", {"edge_weight": F.lit(1).cast("long"), "cumulative_amount": F.col("amount")},
                     hot, tie=["transaction_id"])
    tail = od.group_quantile(tx, ["payer_id"], "amount", high_p, "_tail")
    out = out.join(tail, "payer_id", "left")
    gap = sc.whole_units("us", "_prev", 1_000_000)
    return out.withColumns({
        "cumulative_amount": F.col("cumulative_amount").cast("decimal(28,2)"),
        "rapid_sequence_signal": sc.flag(gap < rapid_seconds),
        "high_amount_signal": sc.flag(F.col("amount").cast("double") > F.col("_tail")),
    }).drop("_prev", "_tail")


def sequence_base(tx: DataFrame, bases: Sequence[int] = (1000, 500, 100), span: int = 5, extra=None,
                  hot: od.Hot | None = None) -> DataFrame:
    """Position, three previous amounts, gap in minutes, round-amount class and payee diversity of the last rows.

    ``extra(window)`` may return more columns that look back at most ten rows.
    """
    win = od.chunk_window(["payer_id"], ORDER)
    framed = od.row_frames(tx, ["payer_id"], ORDER, before=10, hot=hot)
    recent_payees = F.collect_set("payee_id").over(win.rowsBetween(1 - span, 0))
    more = extra(win) if extra else {}
    out = framed.select(
        "*",
        F.coalesce(F.col("_pos"), F.row_number().over(win)).cast("long").alias("seq_position"),
        *[F.lag("amount", i).over(win).alias(f"prev_amount_{i}") for i in (1, 2, 3)],
        sc.whole_units("us", F.lag("us").over(win), 60_000_000).alias("time_gap_minutes"),
        sc.amount_pattern("amount", bases).alias("amount_pattern"),
        F.size(recent_payees).cast("long").alias(f"payee_diversity_{span}tx"),
        *[c.alias(n) for n, c in more.items()],
    )
    return od.shed(out)


def _smurf_columns(band, n, k, strict):
    inside = F.col("amount").between(*[F.lit(b).cast("decimal(18,2)") for b in band])

    def columns(win):
        frame = win.rowsBetween(1 - n, 0)
        seen = F.sum(inside.cast("long")).over(frame) if strict else F.count(F.lit(1)).over(frame)
        return {"potential_smurfing": sc.flag(inside & (seen >= k))}

    return columns


def smurfing(tx: DataFrame, band=(9800, 9999), n: int = 10, k: int = 5, strict: bool = False) -> DataFrame:
    """Amounts just under a reporting limit with at least ``k`` rows among the last ``n`` (``strict``: in-band rows)."""
    win = od.chunk_window(["payer_id"], ORDER)
    framed = od.row_frames(tx, ["payer_id"], ORDER, before=n - 1)
    return od.shed(framed.select("*", *[c.alias(a) for a, c in _smurf_columns(band, n, k, strict)(win).items()]))


def payer_amounts(tx: DataFrame) -> DataFrame:
    """Count, mean and sample deviation of the amounts per payer, from exact decimal sums."""
    sums = tx.groupBy("payer_id").agg(F.sum("amount").alias("_sx"), F.sum(sc.squared("amount")).alias("_sxx"),
                                      F.count("amount").alias("_nx"))
    return sums.select("payer_id", (F.col("_sx").cast("double") / F.col("_nx")).alias("payer_mean"),
                       sc.sample_std("_nx", "_sx", "_sxx").alias("payer_std"))


def velocity_spike(seq: DataFrame, gap: int = 30, factor: float = 1.5) -> DataFrame:
    """Short gap and an amount well above the payer's mean (needs ``time_gap_minutes``)."""
    joined = seq if "payer_mean" in seq.columns else seq.join(payer_amounts(seq), "payer_id", "left")
    big = F.col("amount").cast("double") > F.col("payer_mean") * factor
    return joined.withColumn("velocity_spike", sc.flag((F.col("time_gap_minutes") < gap) & big))


def layering(seq: DataFrame, diversity: int = 4, gap: int = 60) -> DataFrame:
    return seq.withColumn("potential_layering", sc.flag(
        (F.col("payee_diversity_5tx") >= diversity) & (F.col("time_gap_minutes") < gap)))


def run_lengths(tx: DataFrame, bases: Sequence[int] = (1000, 500, 100)) -> DataFrame:
    """Count, mean gap and longest run per payer and amount pattern.

    A run is numbered by the rows that open one, so equal neighbours share a number and only the runs are aggregated.
    """
    key = ["payer_id"]
    hot = od.find_hot(tx, key)
    narrow = tx.select("payer_id", *ORDER, sc.amount_pattern("amount", bases).alias("amount_pattern"))
    lagged = od.shifted(narrow, key, ORDER, {"_before": ("amount_pattern", 1), "_prev": ("us", 1)}, hot)
    opens = F.when(F.col("_before") == F.col("amount_pattern"), 0).otherwise(1).cast("long")
    numbered = od.running(lagged, key, "us", {"_run": opens}, hot, tie=["transaction_id"])
    gap = sc.whole_units("us", "_prev", 60_000_000)
    runs = numbered.groupBy("payer_id", "amount_pattern", "_run").agg(
        F.count(F.lit(1)).alias("_len"), F.sum(gap).alias("_gap"), F.count(gap).alias("_gaps"))
    return runs.groupBy("payer_id", "amount_pattern").agg(
        F.sum("_len").alias("pattern_count"),
        F.try_divide(F.sum("_gap").cast("double"), F.sum("_gaps")).alias("avg_time_gap"),
        F.max("_len").alias("max_run_length"))


def amount_zscore(df: DataFrame) -> DataFrame:
    joined = df if "payer_mean" in df.columns else df.join(payer_amounts(df), "payer_id", "left")
    deviation = F.nullif(F.col("payer_std"), F.lit(0.0))
    return joined.withColumn("amount_zscore", (F.col("amount").cast("double") - F.col("payer_mean")) / deviation)


def sequence_features(tx: DataFrame, band=(9800, 9999), bases: Sequence[int] = (1000, 500, 100), strict: bool = False,
                      limit: float = 10000, wide: DataFrame | None = None) -> DataFrame:
    """All sequence flags per transaction, with run lengths, risk pattern and amount z-score.

    ``wide`` may hold the same rows with more columns, which then stay on the result.
    """
    seq = sequence_base(tx if wide is None else wide, bases, extra=_smurf_columns(band, 10, 5, strict),
                        hot=od.find_hot(tx, ["payer_id"]))
    runs = run_lengths(tx, bases).drop("avg_time_gap")
    flags = layering(velocity_spike(amount_zscore(seq.join(payer_amounts(tx), "payer_id", "left"))))
    joined = flags.join(runs, ["payer_id", "amount_pattern"], "left")
    return joined.withColumn("sequence_risk_pattern", sc.sequence_pattern(limit)).drop("payer_mean", "payer_std")


def latest_n(df: DataFrame, keys: Sequence[str], order: str, n: int, tie: str) -> DataFrame:
    """The newest ``n`` rows per key. Spark prunes each partition to ``n`` rows per key before the shuffle."""
    win = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(tie))
    return df.withColumn("rn", F.row_number().over(win)).filter(F.col("rn") <= n)
