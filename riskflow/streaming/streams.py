"""Structured Streaming forms of the features, scores and monitors.

The aggregations also run on batch DataFrames, where the watermark has no effect.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskflow.functions import scalars as sc
from riskflow.operators import drift as dr
from riskflow.operators import ordered as od
from riskflow.session import prepare
from riskflow.sources.quality import request_hash

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_US = 86_400_000_000


def stream_source(spark: SparkSession, kind: str, schema: T.StructType, path: str | None = None, **options) -> DataFrame:
    """Transactions as a stream: files of any Spark format, or ``kafka`` with JSON values."""
    reader = prepare(spark).readStream.format(kind).options(**options)
    if kind == "kafka":
        parsed = F.from_json(F.col("value").cast("string"), schema)
        return reader.load().select(parsed.alias("tx")).select("tx.*")
    return reader.schema(schema).load(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, partition_by: str | None = None, once: bool = False):
    """Append a stream to the lake with an exactly-once file sink."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_counters(s: DataFrame, late: str = "1 hour", size: str = "1 hour", high: float = 10000) -> DataFrame:
    """Tumbling counters per channel."""
    return s.withWatermark("ts", late).groupBy(F.window("ts", size), "channel").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total_amount"),
        F.sum((F.col("amount") > high).cast("long")).alias("high_amount_count")
    ).select(F.unix_micros("window.start").alias("window_start"), "channel", "n", "total_amount", "high_amount_count")


def stream_velocity(s: DataFrame, late: str = "1 hour", size: str = "24 hours", step: str = "1 hour") -> DataFrame:
    """Sliding activity per payer, with a sketched count of distinct payees."""
    return s.withWatermark("ts", late).groupBy(F.window("ts", size, step), "payer_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total_amount"),
        F.approx_count_distinct("payee_id").alias("approx_payees")
    ).select("payer_id", F.unix_micros("window.start").alias("window_start"), "n", "total_amount", "approx_payees")


def stream_sessions(s: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Bursts per payer: a pause of at least ``gap`` starts a new one."""
    return s.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "payer_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total_amount")
    ).select("payer_id", F.unix_micros("w.start").alias("session_start"), F.unix_micros("w.end").alias("session_end"), "n", "total_amount")


def sessions(tx: DataFrame, gap_us: int = 1_800_000_000) -> DataFrame:
    """The same sessions over a table, without sending a busy payer's rows to one task."""
    order = ["us", "transaction_id"]
    hot = od.find_hot(tx, ["payer_id"])
    lagged = od.shifted(tx.select("payer_id", *order, "amount"), ["payer_id"], order, {"_p": ("us", 1)}, hot)
    opens = F.when(F.col("us") - F.col("_p") < gap_us, 0).otherwise(1).cast("long")
    numbered = od.running(lagged, ["payer_id"], "us", {"_sid": opens}, hot, tie=["transaction_id"])
    return numbered.groupBy("payer_id", "_sid").agg(
        F.min("us").alias("session_start"), (F.max("us") + gap_us).alias("session_end"), F.count(F.lit(1)).alias("n"),
        F.sum("amount").alias("total_amount")).drop("_sid")


class PointInTime(StatefulProcessor):
    """Per payer: rows wait until the watermark passes them, then leave in time order with their exact history."""

    ROW = "us bigint, id string, cents bigint, payee string"

    def __init__(self, width_us: int = DAY_US):
        self.width = width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.ROW)
        self.window = handle.getListState("window", self.ROW)
        self.pairs = handle.getMapState("pairs", "payee string", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [r for pdf in rows for r in zip(pdf["us"].tolist(), pdf["id"].tolist(), pdf["cents"].tolist(), pdf["payee"].tolist())]
        self.pending.appendList(fresh)
        for ms in {r[0] // 1000 + 1 for r in fresh}:
            self.handle.registerTimer(ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = expiredTimerInfo.getExpiryTimeInMs() * 1000
        waiting = [tuple(r) for r in self.pending.get()]
        ready = sorted(r for r in waiting if r[0] < limit)
        if not ready:
            yield pd.DataFrame()
            return
        self._store(self.pending, [r for r in waiting if r[0] >= limit])
        kept = deque(tuple(r) for r in self.window.get())
        total, payees, pairs, out = sum(r[2] for r in kept), Counter(r[3] for r in kept), {}, []
        for now, group in groupby(ready, key=lambda r: r[0]):
            same = list(group)
            while kept and kept[0][0] < now - self.width:
                _, _, cents, payee = kept.popleft()
                total -= cents
                payees[payee] -= 1
                if not payees[payee]:
                    del payees[payee]
            for _, ident, _, payee in same:
                if payee not in pairs:
                    pairs[payee] = self.pairs.getValue((payee,))[0] if self.pairs.containsKey((payee,)) else 0
                out.append((str(key[0]), ident, now, len(kept), total / 100.0, len(payees), int(pairs[payee] > 0)))
            for r in same:
                pairs[r[3]] += 1
                total += r[2]
                payees[r[3]] += 1
            kept.extend(same)
        for payee, n in pairs.items():
            self.pairs.updateValue((payee,), (n,))
        self._store(self.window, list(kept))
        yield pd.DataFrame(out, columns=["payer_id", "transaction_id", "us", "tx_count_24h", "total_amount_24h",
                                         "unique_payees_24h", "is_repeated_counterparty"])

    @staticmethod
    def _store(state, rows: list) -> None:
        state.put(rows) if rows else state.clear()

    def close(self) -> None:
        pass


def stream_pit(s: DataFrame, late: str = "1 hour", width_us: int = DAY_US) -> DataFrame:
    """Exact previous-24-hour features per event, in event-time order per payer (keyed state in RocksDB)."""
    s.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = s.withWatermark("ts", late).select(
        F.col("payer_id").cast("string").alias("payer"), "ts", F.unix_micros("ts").alias("us"),
        F.col("transaction_id").cast("string").alias("id"), (F.col("amount") * 100).cast("long").alias("cents"),
        F.col("payee_id").cast("string").alias("payee"))
    return rows.groupBy("payer").transformWithStateInPandas(
        statefulProcessor=PointInTime(width_us),
        outputStructType="payer_id string, transaction_id string, us bigint, tx_count_24h bigint, total_amount_24h double, "
                         "unique_payees_24h bigint, is_repeated_counterparty bigint",
        outputMode="Append", timeMode="EventTime")


def stream_dedup(s: DataFrame, columns: list[str], ttl: str = "5 minutes") -> DataFrame:
    """Drop repeats of the same request content that arrive within ``ttl``."""
    hashed = s.withColumn("request_hash", request_hash(columns))
    return hashed.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["request_hash"])


def stream_score(s: DataFrame, profiles: DataFrame, score: Callable[[DataFrame], DataFrame], key: str = "payer_id") -> DataFrame:
    """Join static profiles, score with any DataFrame function that adds ``risk_score``, and decide."""
    out = score(s.join(profiles, key, "left"))
    return sc.with_decision(out, "risk_score")


def each_batch(s: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    writer = s.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_drift(s: DataFrame, reference: DataFrame, cols: list[str], path: str, checkpoint: str, once: bool = True):
    """PSI, JSD and KS of every micro-batch against a reference, each in its own partition of an alert table.

    A batch that is run again after a failure replaces its partition.
    """

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        if not batch.isEmpty():
            report = dr.drift_report(reference, batch.withColumn("day", F.lit(number)), cols)
            report.drop("day").write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return each_batch(s, handle, checkpoint, once)


def late_counter(late_us: int, path: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that records how many rows lie further behind the newest event of earlier batches than allowed.

    The bound is read from the table of results, so it outlives a restart, and a batch that is run again replaces its partition.
    """

    def handle(batch: DataFrame, number: int) -> None:
        us = F.unix_micros("ts")
        try:
            before = batch.sparkSession.read.parquet(path).filter(F.col("batch") < number).agg(F.max("newest")).first()[0]
        except AnalysisException:  # the first batch
            before = None
        late = F.lit(0) if before is None else F.count_if(us < F.lit(before - late_us))
        row = batch.agg(F.count(F.lit(1)).alias("rows"), late.cast("long").alias("late_rows"), F.max(us).alias("newest"))
        row.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle
