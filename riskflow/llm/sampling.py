"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_LABELS = 1000


def label_counts(rows: DataFrame, label: str) -> dict:
    """Rows per non-null label, over all rows; an error beyond ``MAX_LABELS`` labels."""
    found = rows.filter(F.col(label).isNotNull()).groupBy(label).count().limit(MAX_LABELS + 1).collect()
    if len(found) > MAX_LABELS:
        raise ValueError(f"{label} has more than {MAX_LABELS} values")
    return {r[label]: r["count"] for r in sorted(found, key=lambda r: str(r[label]))}


def sample_by_label(rows: DataFrame, key: str, label: str, most: dict, counts: dict, seed: int = 17) -> DataFrame:
    """Up to ``most[label]`` rows of each label, those with the smallest hash of their key. A first cut by the hash leaves about
    twice as many, so no label's rows meet in one task."""
    place = F.xxhash64(key, F.lit(seed)) / F.lit(2.0**64) + F.lit(0.5)
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, (2 * most[value] + 50) / n))).otherwise(share)
    first = rows.filter(F.col(label).isNotNull()).withColumn("_place", place).filter(F.col("_place") <= share)
    limit = F.lit(0)
    for value in counts:
        limit = F.when(F.col(label) == F.lit(value), F.lit(most[value])).otherwise(limit)
    order = Window.partitionBy(label).orderBy("_place", key)
    return first.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= limit).drop("_at", "_place")
