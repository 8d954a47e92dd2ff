"""Weight-of-evidence encodings, thresholds and cost sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.functions import scalars as sc
from riskflow.operators import ordered as od

FIXED_BINS = {
    "amount": ("avg_amount", (100, 1000, 10000), ("LOW_AMOUNT", "MED_AMOUNT", "HIGH_AMOUNT", "VERY_HIGH_AMOUNT")),
    "volume": ("total_transactions", (10, 50, 200), ("LOW_VOLUME", "MED_VOLUME", "HIGH_VOLUME", "VERY_HIGH_VOLUME")),
    "diversity": ("unique_payees", (5, 20), ("LOW_DIVERSITY", "MED_DIVERSITY", "HIGH_DIVERSITY")),
}


def to_long(df: DataFrame, columns: dict[str, Column], keep: Sequence[str], name: str = "feature",
            value: str = "value") -> DataFrame:
    """One row per input row and named column."""
    items = F.array(*[F.struct(F.lit(n).alias(name), c.alias(value)) for n, c in columns.items()])
    return df.select(*keep, F.explode(items).alias("_i")).select(*keep, f"_i.{name}", f"_i.{value}")


def label_counts(df: DataFrame, bins: dict[str, Column], label: str) -> DataFrame:
    """Good and bad rows per feature and bin, with the totals of the feature."""
    long = to_long(df.withColumn("_y", F.col(label)), bins, ["_y"], value="bin")
    counts = long.groupBy("feature", "bin").agg(
        F.count_if(F.col("_y") == 0).alias("good"), F.count_if(F.col("_y") == 1).alias("bad"))
    # one row per bin from here on
    per = Window.partitionBy("feature")
    return counts.withColumns({"total_good": F.sum("good").over(per), "total_bad": F.sum("bad").over(per)})


def woe_iv(df: DataFrame, bins: dict[str, Column], label: str) -> DataFrame:
    """WOE and IV contribution per feature and bin; 0 where a count is 0."""
    counts = label_counts(df, bins, label)
    woe = sc.woe_value("good", "bad", "total_good", "total_bad")
    share = F.try_divide("good", "total_good") - F.try_divide("bad", "total_bad")
    return counts.withColumn("woe", woe).withColumn("iv", share * F.col("woe"))


def fixed_bins(table: dict | None = None) -> dict[str, Column]:
    return {n: sc.bin_col(c, edges, labels) for n, (c, edges, labels) in (table or FIXED_BINS).items()}


def entity_woe(stats: DataFrame, labels: DataFrame, table: dict | None = None) -> DataFrame:
    """Entity statistics with the label and the WOE and IV of each fixed bin."""
    table = table or FIXED_BINS
    base = stats.join(labels, "payer_id", "left").withColumn("is_sar", F.coalesce("is_sar", F.lit(0)).cast("long"))
    model = woe_iv(base, fixed_bins(table), "is_sar")
    # at most one row per bin label: a fixed handful
    pairs = model.agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws(":", "feature", "bin"), F.struct("woe", "iv")))).alias("_woe"))
    out = base.crossJoin(F.broadcast(pairs))
    for name, expr in fixed_bins(table).items():
        entry = F.element_at("_woe", F.concat_ws(":", F.lit(name), expr))
        out = out.withColumns({f"woe_{name}": entry["woe"], f"iv_{name}": entry["iv"]})
    return out.drop("_woe")


def woe_fit(df: DataFrame, columns: Sequence[str], label: str, q: int = 5, min_iv: float = 0.02, k: int = 20,
            categorical: Sequence[str] = ()) -> tuple[dict, DataFrame]:
    """Quantile-bin WOE with floored rates. Returns the bin edges per column and a table of bins for the best features."""
    edges = {}
    for c in columns:
        found = od.quantiles(df, c, [i / q for i in range(q + 1)])
        edges[c] = sorted(set(found))[1:-1]
    bins = {c: sc.edge_bin(F.col(c).cast("double"), e).cast("string") for c, e in edges.items()}
    bins.update({c: F.col(c).cast("string") for c in categorical})
    counts = label_counts(df, bins, label)
    counts = counts.filter(F.col("bin").isNotNull())  # rows without a value tell nothing about a feature
    per = Window.partitionBy("feature")
    counts = counts.withColumns({"total_good": F.sum("good").over(per), "total_bad": F.sum("bad").over(per)})
    good, bad = F.try_divide("good", "total_good"), F.try_divide("bad", "total_bad")
    floor = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-6))
    table = counts.withColumn("woe", F.log(floor(good) / floor(bad))).withColumn("part", F.coalesce((good - bad) * F.col("woe"), F.lit(0.0)))
    table = table.withColumn("iv", F.sum("part").over(Window.partitionBy("feature")))
    rank = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("iv"), "feature"))
    return edges, table.filter(F.col("iv") >= min_iv).withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def woe_transform(df: DataFrame, edges: dict, table: DataFrame) -> DataFrame:
    """Add ``woe_<feature>`` from stored edges and values; unseen bins give 0."""
    rows = table.select("feature", "bin", "woe").collect()  # one row per feature and bin
    for name in sorted({r["feature"] for r in rows}):
        bin_name = sc.edge_bin(F.col(name).cast("double"), edges[name]).cast("string") if name in edges else F.col(name).cast("string")
        pairs = [F.lit(x) for r in rows if r["feature"] == name for x in (r["bin"], r["woe"])]
        df = df.withColumn(f"woe_{name}", F.coalesce(F.try_element_at(F.create_map(*pairs), bin_name), F.lit(0.0)))
    return df


def score_totals(df: DataFrame, y: str, score: str) -> DataFrame:
    """Per distinct score: rows and positives, with running totals in ascending order."""
    base = df.select(F.col(score).cast("double").alias("score"), F.col(y).cast("long").alias("y"))
    return od.ranked_totals(base, "score", {"n": F.lit(1).cast("long"), "pos": F.col("y")})


def _with_totals(table: DataFrame) -> DataFrame:
    return table.crossJoin(F.broadcast(table.agg(F.sum("n").alias("total"), F.sum("pos").alias("total_pos"))))


def threshold_costs(df: DataFrame, y: str, score: str, fn: float = 10.0, fp: float = 1.0, review: float = 0.1,
                    steps: int = 100) -> DataFrame:
    """Cost and workload of flagging ``score >= threshold`` for each percentile of the score."""
    cuts = od.quantiles(df.select(F.col(score).cast("double").alias("score")), "score", [i / 100 for i in range(steps)])
    marks = F.array(*[F.struct(F.lit(i).alias("pct"), F.lit(c).alias("threshold")) for i, c in enumerate(cuts)])
    table = df.select(F.col(score).cast("double").alias("score"), F.col(y).cast("long").alias("y"))
    # how many cuts each row passes: 0..steps, so only steps + 1 groups leave the scan
    passed = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("score")))
    groups = table.groupBy(passed.alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    totals = groups.agg(F.sum("n").alias("total"), F.sum("pos").alias("total_pos"),
                        F.collect_list(F.struct("g", "n", "pos")).alias("gs"))
    rows = totals.select("total", "total_pos", "gs", F.explode(marks).alias("m"))
    over = lambda f: F.aggregate(F.filter("gs", lambda g: g.g > F.col("m.pct")), F.lit(0).cast("long"),
                                 lambda acc, g: acc + g[f])
    flagged, hits = over("n"), over("pos")
    return rows.select(
        F.col("m.pct").cast("long").alias("pct"), F.col("m.threshold").alias("threshold"),
        flagged.alias("reviews"), (F.col("total_pos") - hits).alias("missed"), (flagged - hits).alias("false_alarms"),
        (flagged / F.col("total")).alias("workload"),
        (fn * (F.col("total_pos") - hits) + fp * (flagged - hits) + review * flagged).alias("cost"))


def optimal_threshold(df: DataFrame, y: str, score: str, fn: float = 10.0, fp: float = 1.0, review: float = 0.1,
                      cap: float = 0.2) -> DataFrame:
    """Cheapest percentile threshold within the workload cap; 0.5 when none fits."""
    best = threshold_costs(df, y, score, fn, fp, review).filter(F.col("workload") <= cap).agg(
        F.min_by(F.struct("threshold", "cost", "workload"), F.struct(F.round("cost", 9), "pct")).alias("b"))
    return best.select(F.coalesce("b.threshold", F.lit(0.5)).alias("threshold"), F.col("b.cost").alias("cost"),
                       F.col("b.workload").alias("workload"))


def roc_threshold(df: DataFrame, y: str, score: str, fn: float = 10.0, fp: float = 1.0) -> DataFrame:
    """Score cut that maximises the true positive rate less the cost-weighted false positive rate."""
    t = _with_totals(score_totals(df, y, score))
    caught = F.col("total_pos") - F.col("pos_cum") + F.col("pos")
    flagged = F.col("total") - F.col("n_cum") + F.col("n")
    tpr = F.try_divide(caught, "total_pos")
    fpr = F.try_divide(flagged - caught, F.col("total") - F.col("total_pos"))
    gain = F.round(tpr - F.lit(fp / fn) * fpr, 9)
    best = t.select("score", tpr.alias("tpr"), fpr.alias("fpr"), gain.alias("gain")).agg(
        F.max_by(F.struct("score", "tpr", "fpr", "gain"), F.struct("gain", "score")).alias("b"))
    return best.select(F.col("b.score").alias("threshold"), "b.tpr", "b.fpr", "b.gain")


def evaluate(df: DataFrame, y: str, score: str, threshold: float, workload: float = 0.2) -> DataFrame:
    """One row: average precision, and precision, recall and workload at a threshold and at a fixed workload."""
    t = _with_totals(score_totals(df, y, score))
    caught = F.col("total_pos") - F.col("pos_cum") + F.col("pos")
    flagged = F.col("total") - F.col("n_cum") + F.col("n")
    rows = t.select("*", caught.alias("tp"), flagged.alias("flagged"))
    at = F.col("score") >= threshold
    hit, seen = F.max(F.when(at, F.col("tp"))), F.max(F.when(at, F.col("flagged")))
    inside = F.col("flagged") <= F.lit(workload) * F.col("total")
    return rows.agg(
        F.sum(F.try_divide("pos", "total_pos") * F.col("tp") / F.col("flagged")).alias("average_precision"),
        F.coalesce(hit / seen, F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(hit, F.max("total_pos")), F.lit(0.0)).alias("recall"),
        F.coalesce(seen / F.max("total"), F.lit(0.0)).alias("workload"),
        F.coalesce(F.try_divide(F.max(F.when(inside, F.col("tp"))), F.max("total_pos")), F.lit(0.0)).alias("recall_at_workload"))


def pr_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """Precision and recall at every distinct score."""
    t = _with_totals(score_totals(df, y, score))
    tp = F.col("total_pos") - F.col("pos_cum") + F.col("pos")
    flagged = F.col("total") - F.col("n_cum") + F.col("n")
    return t.select(F.col("score").alias("threshold"), (tp / flagged).alias("precision"),
                    F.try_divide(tp, "total_pos").alias("recall"))
