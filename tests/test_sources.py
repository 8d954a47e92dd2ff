import pytest
from pyspark.sql import functions as F

from riskflow.functions import scalars as sc
from riskflow.sources import quality as ql
from riskflow.sources import sinks as sk
from riskflow.sources import transactions as sx


def test_layers_and_load(spark, tx, scratch):
    raw = tx.drop("us", "s").withColumn("amount", F.when(F.col("transaction_id") % 100 == 0, F.lit(0)).otherwise(F.col("amount")).cast("decimal(18,2)"))
    paths = sk.run_layers(spark, raw, scratch, lambda t: t.groupBy("payer_id").count())
    assert spark.read.parquet(paths["quarantine"]).count() == raw.filter("amount <= 0").count()
    week = sx.load_tx(spark, paths["clean"], days=7)
    assert 0 < week.count() < tx.count()
    assert "PartitionFilters: [isnotnull(date" in week._jdf.queryExecution().toString()


def test_load_rejects_missing_columns(spark, scratch):
    spark.range(3).write.parquet(scratch + "/x")
    with pytest.raises(ValueError):
        sx.load_tx(spark, scratch + "/x")


def test_layout_and_validate(spark, tx):
    assert sk.layout(tx.select("payer_id", "us"), ["payer_id", "us"], 4).rdd.getNumPartitions() == 4
    good, bad = ql.validate(tx)
    assert good.count() + bad.count() == tx.count()


def test_scalars(spark):
    df = spark.createDataFrame([(2.5,), (999.5,), (1000.0,), (500.49,)], "a double").select(F.col("a").cast("decimal(18,2)").alias("a"))
    assert [r[0] for r in df.select(sc.amount_pattern("a")).collect()] == ["NOT_ROUND", "ROUND_1000", "ROUND_1000", "ROUND_500"]
    one = spark.range(1)
    assert one.select(sc.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()[0] == pytest.approx(20015.1, abs=0.1)
    sc.register_sql_functions(spark)
    assert spark.sql("SELECT calculate_woe(10, 0, 20, 5), calculate_woe(10, 5, 20, 20)").first()[1] == pytest.approx(0.6931471805599453)


def test_resolve_entities(spark):
    rows = [(1, "A-1", None), (2, "a1", "d9"), (3, None, "D9"), (4, "zz", None), (5, None, None)]
    got = {r["id"]: r["entity_id"] for r in ql.resolve_entities(spark.createDataFrame(rows, "id long, tax string, dev string"), "id", ["tax", "dev"]).collect()}
    assert got[1] == got[2] == got[3] and got[4] == "4" and got[5] == "5"


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    out = e.entry(spark)
    assert out.count() == 1000 and "composite_risk_score" in out.columns


def test_reuse_does_not_prolong_a_result(spark):
    from riskflow.sources import quality as ql

    rows = [(i, "a", t, None) for i, t in enumerate((0, 4, 8, 9, 30))] + [(9, "", 1, None), (10, None, 1, None), (11, None, 6, None)]
    df = spark.createDataFrame(rows, "id int, who string, at long, note string")
    got = {r["id"]: r["reused"] for r in ql.dedup_requests(df, ["who", "note"], "at", 5, "id").collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False, 9: False, 10: False, 11: True}
