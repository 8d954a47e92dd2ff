"""Tables on disk: the date-partitioned raw layer, feature tables and lookup layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.sources import quality as ql
from riskflow.sources.transactions import with_clock


def write_bronze(df: DataFrame, path: str, mode: str = "append") -> None:
    """Raw rows partitioned by day, stamped with the ingestion time.

    Rows are rebalanced by day: adaptive execution splits busy days and joins quiet ones, so tasks follow the data.
    """
    stamped = df.withColumn("date", F.to_date("ts"))
    if "_ingestion_time" not in df.columns:
        stamped = stamped.withColumn("_ingestion_time", F.current_timestamp())
    stamped.hint("rebalance", "date").write.mode(mode).partitionBy("date").parquet(path)


def materialise(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Replace the table at ``path`` and return it read back, with its lineage cut."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def save_table(df: DataFrame, name: str, bucket_by: str | None = None, buckets: int = 64) -> None:
    """Replace a catalog table; bucketed tables join on the bucket column without a shuffle."""
    writer = df.write.mode("overwrite").format("parquet")
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(name)


def layout(df: DataFrame, by: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Range-partition and sort so that file statistics can skip most files for lookups on ``by``."""
    spread = df.repartitionByRange(tasks, *by) if tasks else df.repartitionByRange(*by)
    return spread.sortWithinPartitions(*by)


def run_layers(spark: SparkSession, raw: DataFrame, root: str, features) -> dict[str, str]:
    """Raw -> cleaned -> features. ``features(tx)`` builds the last layer."""
    paths = {name: f"{root}/{name}" for name in ("raw", "clean", "quarantine", "features")}
    write_bronze(raw, paths["raw"], mode="overwrite")
    good, bad = ql.validate(spark.read.parquet(paths["raw"]))
    materialise(good, paths["clean"], ["date"])
    materialise(bad, paths["quarantine"], ["date"])
    materialise(features(with_clock(spark.read.parquet(paths["clean"]))), paths["features"])
    return paths
