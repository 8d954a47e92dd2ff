"""Row-level expressions: everything here is a Column built from Spark functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Mean earth radius in km.
EARTH_KM = 6371.0088
# Actions and base minutes per risk level.
ACTIONS = {
    "CRITICAL": "IMMEDIATE_BLOCK_AND_INVESTIGATE",
    "HIGH": "BLOCK_AND_INVESTIGATE",
    "MEDIUM": "INVESTIGATE_WITHIN_24H",
    "LOW": "MONITOR",
}
MINUTES = {"CRITICAL": 120, "HIGH": 90, "MEDIUM": 45, "LOW": 15}
CHANNELS = ("PIX", "CARD", "TED")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flag(cond: Column) -> Column:
    """1/0, with unknown counted as 0."""
    return F.when(cond, 1).otherwise(0).cast("long")


def squared(x) -> Column:
    """Exact square of an amount."""
    return (_c(x) * _c(x)).cast("decimal(38,4)")


def _spread(n, sx, sxx) -> Column:
    """n * sum of squares - square of the sum, exact in decimals, in doubles only where those overflow."""
    n, sx, sxx = _c(n), _c(sx), _c(sxx)
    exact = F.try_subtract(F.try_multiply(n.cast("decimal(20,0)"), sxx), F.try_multiply(sx, sx)).cast("double")
    rough = n * sxx.cast("double") - sx.cast("double") * sx.cast("double")
    return F.greatest(F.coalesce(exact, rough), F.lit(0.0))


def sample_std(n, sx, sxx) -> Column:
    """Sample deviation from a count, a decimal sum and a decimal sum of squares; NULL below two rows."""
    count = _c(n).cast("double")
    return F.when(count > 1, F.sqrt(_spread(n, sx, sxx) / (count * (count - 1))))


def population_std(n, sx, sxx) -> Column:
    count = _c(n).cast("double")
    return F.when(count > 0, F.sqrt(_spread(n, sx, sxx)) / count)


def basic_features(tx: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    day = F.weekday("ts").cast("long")
    hour = F.hour("ts").cast("long")
    out = {
        "amount_log": F.log1p(F.col("amount").cast("double")),
        "hour_of_day": hour,
        "day_of_week": day,
        "is_weekend": flag(day >= 5),
        "is_night": flag((hour >= 22) | (hour <= 6)),
    }
    for c in channels:
        out[f"channel_{c.lower()}"] = flag(F.col("channel") == c)
    if "geo_lat" in tx.columns:
        out["has_geo"] = flag(F.col("geo_lat").isNotNull() & F.col("geo_lng").isNotNull())
    return tx.withColumns(out)


def is_multiple(amount, base: float) -> Column:
    return flag(_c(amount) % F.lit(base) == 0)


def amount_pattern(amount, bases: Sequence[int] = (1000, 500, 100)) -> Column:
    """Largest round base that divides the amount rounded to a whole number."""
    whole = F.round(_c(amount)).cast("long")
    expr = None
    for b in bases:
        hit, name = whole % b == 0, F.lit(f"ROUND_{b}")
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr.otherwise("NOT_ROUND")


def bin_col(col, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the half-open interval a value lies in: ``labels`` has one more entry than ``edges``."""
    value, expr = _c(col), None
    for edge, label in zip(edges, labels):
        expr = F.when(value < edge, label) if expr is None else expr.when(value < edge, label)
    return expr.otherwise(labels[-1])


def edge_bin(col, edges: Sequence[float]) -> Column:
    """How many inner edges lie strictly below the value: bins are right-closed, as quantile cuts are. NULL for NULL and NaN."""
    value = _c(col).cast("double")
    known = value.isNotNull() & ~F.isnan(value)
    if not edges:
        return F.when(known, F.lit(0).cast("long"))
    marks = F.array(*[F.lit(float(e)) for e in edges])
    return F.when(known, F.size(F.filter(marks, lambda e: e < value)).cast("long"))


def geo_cell(lat="geo_lat", lng="geo_lng") -> Column:
    return F.concat_ws("_", F.round(_c(lat), 2), F.round(_c(lng), 2))


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    a1, a2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat, dlng = a2 - a1, F.radians(_c(lng2)) - F.radians(_c(lng1))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(dlng / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def whole_units(later_us, earlier_us, unit_us: int) -> Column:
    """Whole elapsed units between two microsecond clocks, truncated toward zero."""
    return ((_c(later_us) - _c(earlier_us)) / F.lit(unit_us)).cast("long")


def burst_label(col, high: float = 2.0, low: float = 0.5) -> Column:
    return F.when(_c(col) > high, "BURSTY").when(_c(col) < low, "REGULAR").otherwise("NORMAL")


def sequence_pattern(limit: float = 10000, run: int = 3, repeats: int = 10) -> Column:
    return (
        F.when((F.col("amount") < limit) & (F.col("potential_smurfing") == 1) & (F.col("max_run_length") >= run),
               "STRUCTURING_PATTERN")
        .when((F.col("velocity_spike") == 1) & (F.col("potential_layering") == 1), "LAYERING_PATTERN")
        .when((F.col("pattern_count") > repeats) & (F.col("amount_pattern") != "NOT_ROUND"), "ROUND_AMOUNT_PATTERN")
        .otherwise("NORMAL")
    )


def composite_score() -> Column:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (zero("high_velocity_flag") + zero("extreme_amount_flag") + zero("geo_dispersion_flag")
            + flag(F.col("edge_risk_category") == "HIGH_RISK") + zero("potential_smurfing")
            + zero("potential_layering") + flag(F.col("sequence_risk_pattern") != "NORMAL"))


def risk_level(score, edges: Sequence[float] = (0.9, 0.7, 0.4)) -> Column:
    s = _c(score)
    return F.when(s >= edges[0], "CRITICAL").when(s >= edges[1], "HIGH").when(s >= edges[2], "MEDIUM").otherwise("LOW")


def _lookup(level: Column, table: dict) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), level)


# The confidence above which a level gets the better of its two priorities.
PRIORITY = {"CRITICAL": (0.8, "P1", "P2"), "HIGH": (0.7, "P2", "P3"), "MEDIUM": (0.6, "P3", "P4")}


def alert_priority(level, confidence) -> Column:
    level, out = _c(level), F
    for name, (bar, sure, unsure) in PRIORITY.items():
        out = out.when(level == name, F.when(_c(confidence) > bar, sure).otherwise(unsure))
    return out.otherwise("P4")


def recommended_action(level) -> Column:
    return F.coalesce(_lookup(_c(level), ACTIONS), F.lit(ACTIONS["LOW"]))


def investigation_minutes(level, linked) -> Column:
    base = F.coalesce(_lookup(_c(level), MINUTES), F.lit(MINUTES["LOW"]))
    return (base + F.when(_c(linked), 30).otherwise(0)).cast("long")


def with_decision(df: DataFrame, score: str, confidence=None, linked=None) -> DataFrame:
    """Risk level, priority, action and expected minutes for each scored row."""
    df = df.withColumn("risk_level", risk_level(score))
    return df.withColumns({
        "alert_priority": alert_priority("risk_level", confidence or score),
        "recommended_action": recommended_action("risk_level"),
        "investigation_minutes": investigation_minutes("risk_level", F.lit(False) if linked is None else linked),
    })


def iv_strength(col) -> Column:
    return bin_col(col, (0.02, 0.1, 0.3), ("NONE", "WEAK", "MEDIUM", "STRONG"))


def focal_loss(p, y, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    p = F.greatest(F.least(_c(p), F.lit(1 - 1e-8)), F.lit(1e-8))
    y = _c(y).cast("double")
    pt = p * y + (1 - p) * (1 - y)
    at = F.lit(alpha) * y + F.lit(1 - alpha) * (1 - y)
    return -at * F.pow(1 - pt, gamma) * F.log(pt)


def timing_score(first_us, last_us, n) -> Column:
    days = (_c(last_us) - _c(first_us)) / F.lit(86_400_000_000)
    return (F.when(_c(first_us).isNull() | (_c(n) <= 1), 0.0).when(days <= 0, 1.0)
            .otherwise(F.least(F.try_divide(_c(n) / days, F.lit(10.0)), F.lit(1.0))))


def assign_arm(ident, percent: float, salt: str = "champion") -> Column:
    """Stable traffic split by hash: ``challenger`` gets ``percent`` of the ids."""
    digest = F.md5(F.concat_ws(":", F.lit(salt), _c(ident).cast("string")))
    slot = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10_000
    return F.when(slot < int(percent * 100), "challenger").otherwise("champion")


def woe_value(good, bad, total_good, total_bad) -> Column:
    """Weight of evidence, 0 when any count is 0."""
    good, bad, tg, tb = _c(good), _c(bad), _c(total_good), _c(total_bad)
    empty = (good == 0) | (bad == 0) | (tg == 0) | (tb == 0)
    return F.when(empty, 0.0).otherwise(F.log((good / tg) / (bad / tb)))


def register_sql_functions(spark: SparkSession) -> None:
    """``calculate_woe`` for SQL users; runs as a Spark expression."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION calculate_woe(good DOUBLE, bad DOUBLE, total_good DOUBLE, total_bad DOUBLE)"
        " RETURNS DOUBLE RETURN CASE WHEN good = 0 OR bad = 0 OR total_good = 0 OR total_bad = 0 THEN 0D"
        " ELSE ln((good / total_good) / (bad / total_bad)) END"
    )
