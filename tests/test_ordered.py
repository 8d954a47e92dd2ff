"""Hot keys take another plan: it must give the same results as the plain one."""

import random

import pytest
from pyspark.sql import functions as F

from riskflow.operators import ordered as od
from riskflow.operators import pointintime as pt
from riskflow.operators import profiles as pf
from riskflow.operators import windows as wn
from riskflow.sources.transactions import with_clock


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belong to one payer, with many equal timestamps; some payers have a single row."""
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        payer = 0 if i % 3 == 0 else rng.randint(1, 120)
        rows.append((i, payer, 1 if rng.random() < 0.4 else rng.randint(0, 9), rng.choice([100, 250, 500, 999]) + rng.randint(0, 3),
                     1_700_000_000 + rng.randint(0, 300) * 3600, rng.choice("abc")))
    df = spark.createDataFrame(rows, "transaction_id long, payer_id long, payee_id long, amount int, t long, channel string")
    return with_clock(df.withColumn("amount", F.col("amount").cast("decimal(18,2)")).withColumn("ts", F.timestamp_seconds("t")).drop("t")).cache()


def both_ways(spark, build, digits=9):
    """Rows of ``build()`` on the plain plan and with nearly every key hot."""
    out = []
    for budget in ("4000000", "12"):
        spark.conf.set("spark.riskflow.segmentRows", budget)
        try:
            rows = build().collect()
        finally:
            spark.conf.unset("spark.riskflow.segmentRows")
        out.append(sorted(repr(tuple(round(v, digits) if isinstance(v, float) else v for v in r)) for r in rows))
    return out


CASES = {
    "velocity": lambda t: wn.velocity(t),
    "edge_running": lambda t: wn.edge_running(t),
    "sequence": lambda t: wn.sequence_features(t),
    "runs": lambda t: wn.run_lengths(t),
    "pit_24h": lambda t: pt.pit_24h(t),
    "pit_tail": lambda t: pt.pit_tail(t, max_hist=25),
    "pit_behaviour": lambda t: pt.pit_behaviour(t),
    "pit_network": lambda t: pt.pit_network(t),
    "asof": lambda t: pt.asof_interval(t.select("transaction_id", "payer_id", "us"), t.filter("channel = 'a'").select("payer_id", F.col("us").alias("r")),
                                       "payer_id", 86_400_000_000, "us", "r", {"n": F.lit(1).cast("long")}),
    "evt": lambda t: pf.evt_profile(t),
    "transitions": lambda t: pf.transitions(t),
}


@pytest.mark.parametrize("name", list(CASES))
def test_hot_keys_change_nothing(spark, skewed, name):
    plain, hot = both_ways(spark, lambda: CASES[name](skewed))
    assert plain == hot and plain


def test_hot_key_is_found_and_split(spark, skewed):
    hot = od.find_hot(skewed, ["payer_id"], 100)
    assert [r["payer_id"] for r in hot.rows] == [0]
    parts = od.segment(skewed, hot, "us").filter("payer_id = 0").groupBy("_seg").count().collect()
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 250


def test_peak_matches_brute_force(spark, skewed):
    day = 86_400_000_000
    got = {r["transaction_id"]: r["peak"] for r in od.trailing_peak(skewed, ["payer_id"], "payee_id", "us", day, "peak").collect()}
    rows = skewed.select("transaction_id", "payer_id", "payee_id", "us").collect()
    for r in rows[::17]:
        seen = {}
        for q in rows:
            if q["payer_id"] == r["payer_id"] and r["us"] - day <= q["us"] < r["us"]:
                seen[q["payee_id"]] = seen.get(q["payee_id"], 0) + 1
        assert got[r["transaction_id"]] == max(seen.values(), default=0)


def test_ranked_totals_split_over_tasks(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("x"))
    got = od.ranked_totals(df, "x", {"n": F.lit(1).cast("long")}, per_task=10).orderBy("x").collect()
    total = 0
    for r in got:
        total += r["n"]
        assert r["n_cum"] == total
    assert total == 1000 and len(got) == 97


def test_quantiles(spark):
    df = spark.range(11).select(F.col("id").cast("double").alias("x"))
    assert od.quantiles(df, "x", [0, 0.25, 0.5, 1]) == [0.0, 2.5, 5.0, 10.0]
