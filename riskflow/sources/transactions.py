"""Transaction tables: the canonical schema, loading, and the views mapped from the given parquet tables.

Canonical columns: transaction_id, payer_id, payee_id, amount decimal(18,2), ts timestamp, channel, geo_lat, geo_lng,
plus ``us`` (epoch microseconds) and ``s`` (epoch seconds), which the ordered operators work on.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.session import prepare

TX_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("payer_id", T.StringType(), False),
    T.StructField("payee_id", T.StringType(), False),
    T.StructField("amount", T.DecimalType(18, 2), False),
    T.StructField("channel", T.StringType(), False),
    T.StructField("device_id", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("geo_lat", T.DoubleType()),
    T.StructField("geo_lng", T.DoubleType()),
    T.StructField("mcc", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("_ingestion_time", T.TimestampType()),
    T.StructField("additional_data", T.MapType(T.StringType(), T.StringType())),
])
REQUIRED = ("transaction_id", "payer_id", "payee_id", "amount", "ts", "channel")


def with_clock(tx: DataFrame) -> DataFrame:
    """Normalise the timestamp and add ``us`` and ``s``."""
    tx = tx.withColumn("ts", F.col("ts").cast("timestamp"))
    us = F.unix_micros("ts")
    return tx.withColumns({"us": us, "s": F.floor(us / 1_000_000).cast("long")})


def recent(tx: DataFrame, days: int, as_of: dt.datetime | None = None, ts: str = "ts") -> DataFrame:
    """Rows of the last ``days`` days before ``as_of`` (the newest row by default), as a literal so scans can prune."""
    if as_of is None:
        as_of = tx.agg(F.max(ts)).first()[0]
        if as_of is None:
            return tx
    start = F.lit(as_of - dt.timedelta(days=days)).cast(tx.schema[ts].dataType)
    kept = tx.filter(F.col(ts) >= start)
    return kept.filter(F.col("date") >= start.cast("date")) if "date" in tx.columns else kept


def load_tx(spark: SparkSession, path: str, as_of: dt.datetime | None = None, days: int | None = None) -> DataFrame:
    """Read a transaction table written as parquet (date partitions are pruned when ``days`` is given)."""
    raw = prepare(spark).read.parquet(path)
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"transaction table lacks {missing}")
    return with_clock(recent(raw, days, as_of) if days else raw)


def tx_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` read as payments: user pays the key in ``props``."""
    events = prepare(spark).read.parquet(f"{sf_dir}/events.parquet")
    user, event = F.col("user_id"), F.col("event_id")
    return with_clock(events.select(
        event.alias("transaction_id"),
        user.alias("payer_id"),
        F.get_json_object("props", "$.k").cast("long").alias("payee_id"),
        F.col("value").cast("decimal(18,2)").alias("amount"),
        F.col("ts"),
        F.col("event_type").alias("channel"),
        ((user * 131 % 120) - 60 + (event * 7 % 5) * 0.01).cast("double").alias("geo_lat"),
        ((user * 197 % 300) - 150 + (event * 3 % 7) * 0.01).cast("double").alias("geo_lng"),
        F.when(user % 10 == 3, 1).otherwise(0).cast("long").alias("is_sar"),
    ))


def tx_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` joined to ``lineitem`` read as payments from customers to suppliers (day-grain time)."""
    prepare(spark)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    ident = F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents,
                              F.date_format("l_shipdate", "yyyy-MM-dd")))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return with_clock(joined.select(
        ident.alias("transaction_id"),
        F.col("o_custkey").alias("payer_id"),
        (F.col("l_suppkey") + 1_000_000).alias("payee_id"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        F.col("l_shipdate").alias("ts"),
        F.col("o_orderpriority").alias("channel"),
    ))


def labels_from(tx: DataFrame) -> DataFrame:
    """One label per payer, from a transaction table that carries ``is_sar``."""
    return tx.groupBy("payer_id").agg(F.max("is_sar").alias("is_sar"))
