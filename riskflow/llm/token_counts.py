"""Exact totals for every context limit from one histogram of encoded lengths.

Documents are aggregated by their encoded length, so all that follows works on as many rows as there are lengths. Sums over the
histogram's suffixes give, for each length L as a limit: documents beyond it, tokens kept when documents are truncated to L
(those of shorter documents and L of each other one), tokens lost, and the share of documents that fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def length_histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """(n_tokens, docs) from a row per document; null lengths count as 0."""
    return lengths.groupBy(F.coalesce(F.col(length), F.lit(0)).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("docs"))


def limits(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, as a context limit: what is at, above and below it, and the truncated total.

    The histogram has at most one row per length, so its size is bounded by the longest document, whatever their number.
    """
    rest = Window.orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    every = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("n_tokens") * F.col("docs")
    return (histogram
            .withColumn("docs_over", F.coalesce(F.sum("docs").over(rest), F.lit(0)))
            .withColumn("tokens_over", F.coalesce(F.sum(tokens).over(rest), F.lit(0)))
            .withColumn("_docs", F.sum("docs").over(every)).withColumn("total_tokens", F.sum(tokens).over(every))
            .withColumn("truncated_total", F.col("total_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens"))
            .withColumn("tokens_lost", F.col("total_tokens") - F.col("truncated_total"))
            .withColumn("share_fitting", 1 - F.col("docs_over") / F.col("_docs"))
            .drop("_docs"))


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """One row (n_tokens): the smallest length that at least ``share`` of the documents don't exceed; none without documents."""
    return limits(histogram).filter(F.col("share_fitting") >= share).agg(F.min("n_tokens").alias("n_tokens")).filter("n_tokens is not null")
