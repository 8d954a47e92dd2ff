"""Streams drained by availableNow equal the batch operators on the same rows."""

import os

from pyspark.sql import functions as F

from riskflow.operators import pointintime as pt
from riskflow.streaming import streams as st


def files(tx, path, parts=3):
    """The table as a few files in time order, plus one far-future row that lets the watermark pass everything."""
    base = tx.select("transaction_id", "payer_id", "payee_id", "amount", "ts", "channel")
    for i in range(parts):
        base.filter((F.dayofmonth("ts") - 1) % 31 >= 31 * i // parts).filter(
            (F.dayofmonth("ts") - 1) % 31 < 31 * (i + 1) // parts).coalesce(1).write.mode("append").parquet(f"{path}/in/p{i}")
    end = base.limit(1).withColumns({"transaction_id": F.lit(-1).cast("long"), "payer_id": F.lit(-1).cast("long"),
                                     "ts": F.lit("2030-01-01").cast("timestamp")})
    end.coalesce(1).write.parquet(f"{path}/in/p{parts}")
    return base.schema


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_counters_and_sessions(spark, tx, scratch):
    schema = files(tx, scratch)
    s = stream_of(spark, scratch, schema)
    got = drain(st.stream_counters(s, high=100), "counters")
    assert rows(got) == rows(st.stream_counters(tx, high=100))
    got = drain(st.stream_sessions(stream_of(spark, scratch, schema)), "sess")
    assert rows(got) == rows(st.sessions(tx))
    got = drain(st.stream_velocity(stream_of(spark, scratch, schema)), "vel")
    assert rows(got) == rows(st.stream_velocity(tx))


def test_point_in_time_state(spark, tx, scratch):
    schema = files(tx, scratch)
    got = drain(st.stream_pit(stream_of(spark, scratch, schema)), "pit").filter("payer_id <> '-1'")
    want = pt.pit_24h(tx)
    cols = ["transaction_id", "tx_count_24h", "total_amount_24h", "unique_payees_24h"]
    plain = lambda df: sorted((str(r[0]), int(r[1]), round(float(r[2]), 2), int(r[3])) for r in df.select(*cols).collect())
    assert plain(got) == plain(want)


def test_dedup_drift_and_late(spark, tx, scratch):
    schema = files(tx.limit(50), scratch + "/a", 1)
    s = stream_of(spark, scratch + "/a", schema)
    kept = drain(st.stream_dedup(s, ["channel"], "100 days"), "dedup")
    assert kept.filter("transaction_id >= 0").count() == tx.limit(50).select("channel").distinct().count()
    schema = files(tx, scratch + "/b")
    s = stream_of(spark, scratch + "/b", schema).withColumn("amt", F.col("amount").cast("double"))
    ref = tx.withColumn("amt", F.col("amount").cast("double"))
    st.stream_drift(s, ref, ["amt"], scratch + "/alerts", scratch + "/ck").awaitTermination()
    assert spark.read.parquet(scratch + "/alerts").select("batch").distinct().count() == 4
    st.each_batch(stream_of(spark, scratch + "/b", schema), st.late_counter(0, scratch + "/late"), scratch + "/ck2").awaitTermination()
    assert spark.read.parquet(scratch + "/late").agg(F.sum("rows")).first()[0] == tx.count() + 1


def test_stream_score_and_sink(spark, tx, scratch):
    schema = files(tx, scratch)
    s = stream_of(spark, scratch, schema)
    profiles = tx.groupBy("payer_id").agg(F.avg("amount").cast("double").alias("mean"))
    scored = st.stream_score(s, profiles, lambda df: df.withColumn("risk_score", F.col("amount").cast("double") / (F.col("amount").cast("double") + F.coalesce("mean", F.lit(1.0)))))
    st.write_stream(scored.select("transaction_id", "risk_score", "risk_level"), scratch + "/out", scratch + "/ck", once=True).awaitTermination()
    assert spark.read.parquet(scratch + "/out").count() == tx.count() + 1
    assert os.path.isdir(scratch + "/out/_spark_metadata")
