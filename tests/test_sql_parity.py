"""Queries against their SQL on rows chosen for the places where both once differed."""

import datetime as dt

import duckdb
import pytest

from riskflow.plans.oracle import ORACLE
from riskflow.plans.queries import QUERIES

START = dt.datetime(2024, 1, 1)


def both(spark, folder, name, values, gap=60):
    """(query's rows, SQL's rows) over one user's events of these values, ``gap`` seconds apart."""
    rows = [(i, START + dt.timedelta(seconds=gap * i), 7, "view", v, f'{{"k": {i % 3}}}') for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    got = QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM read_parquet('{folder}/events.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


@pytest.mark.parametrize("name", ["pit_behaviour", "online_features"])
@pytest.mark.parametrize("gap", [60, 0])
def test_amounts_exactly_as_far_apart_as_the_limit(spark, tmp_path, name, gap):
    # on two sides of 64, such doubles are a little more or less than 20 apart
    values = [45.01 + i * 0.37 + (20 if j else 0) for i in range(30) for j in (0, 1)]
    got, want = both(spark, tmp_path, name, [round(v, 2) for v in values], gap)
    assert got == want
