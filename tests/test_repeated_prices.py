"""Queries of levels where prices repeat and where means end in 5."""

from __future__ import annotations

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from barlab.functions.scalars import rounded_half
from barlab.operators import backtest as T
from barlab.operators import levels as V
from barlab.plans import ORACLES, QUERIES

from .conftest import rows_of

#: The registered SQL numbers clusters by a lag whose order leaves equal prices open, so its results
#: change from run to run where prices repeat; compared is the same SQL with that order completed.
OPEN, CLOSED = "lag(x) OVER (PARTITION BY symbol ORDER BY x)", "lag(x) OVER (PARTITION BY symbol ORDER BY x, kind, ts)"

#: Queries of levels, by finding.
NAMES = ("horizontal_levels", "expected_pips", "static_backtest", "level_cross_dataset", "level_features", "retest_entries", "level_ranking", "level_scores", "top_levels", "touch_counts", "backtest_summary", "backtest_breakdown", "nearest_level_pips", "pattern_values")


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """The smallest events three times, 30 days apart: every price is there three times."""
    d = tmp_path_factory.mktemp("repeated")
    duckdb.sql(f"COPY (SELECT event_id + r * 100000 AS event_id, ts + to_days((r * 30)::INT) AS ts, user_id, event_type, value, props FROM '/root/testdata/sf0.001/events.parquet', range(3) t(r)) TO '{d}/events.parquet'")
    return str(d)


@pytest.fixture(scope="module")
def fives(tmp_path_factory):
    """Events with a level whose mean is 261.2775."""
    d = tmp_path_factory.mktemp("fives")
    duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.1/events.parquet' WHERE event_type = 'error') TO '{d}/events.parquet'")
    return str(d)


def sql_of(name, d, change=lambda sql: sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    want = con.sql(change(ORACLES[name]))
    return rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", NAMES)
def test_equal_prices_in_any_order(spark, repeated, monkeypatch, name):
    pivots = V.centred_pivots

    def backwards(*args):
        df = pivots(*args)
        return spark.createDataFrame(df.orderBy(F.desc("kind"), F.desc("ts")).collect(), df.schema).coalesce(1)

    monkeypatch.setattr(V, "centred_pivots", backwards)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a broadcast side may come back in another order
    try:
        got = QUERIES[name](spark, repeated)
        rows = rows_of(got.columns, got.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert OPEN in ORACLES[name]
    assert rows == sql_of(name, repeated, lambda sql: sql.replace(OPEN, CLOSED)) and len(rows) > 3


@pytest.mark.parametrize("name", ["expected_pips"])
def test_means_that_end_in_5(spark, fives, name):
    got = QUERIES[name](spark, fives)
    assert rows_of(got.columns, got.collect()) == sql_of(name, fives)


def test_mean_pips_do_not_depend_on_the_order_of_trades(spark):
    pips = [0.1 + i / 7 for i in range(63)] + [1e12, -1e12]
    means = set()
    for seed in range(4):
        random.Random(seed).shuffle(pips)
        trades = spark.createDataFrame([("x", 1.0, "long", p) for p in pips], "symbol string, level_or_val double, dir string, ret_pips double").coalesce(1)
        by_level, by_dir = T.expected_pips(trades)
        means |= {by_level.first()["avg_pips"], by_dir.first()["dir_pips"]}
    assert len(means) == 1 and means.pop() == pytest.approx(sum(0.1 + i / 7 for i in range(63)) / 65, abs=1e-9)
    odd = spark.createDataFrame([("x", 1.0, "long", p) for p in (1.0, 1e30)] + [("y", 1.0, "long", p) for p in (1.0, float("nan"))], "symbol string, level_or_val double, dir string, ret_pips double")
    got = {r.symbol: r.avg_pips for r in T.expected_pips(odd)[0].collect()}
    assert got["x"] == 5e29 and got["y"] != got["y"]


def test_members_of_equal_prices(spark):
    prices = [1.0] * 5 + [1.01] * 4 + [2.0] * 6 + [2.04] * 2
    rows = [("x", "high" if i % 2 else "low", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), p) for i, p in enumerate(prices)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        piv = spark.createDataFrame(rows, "symbol string, kind string, ts timestamp_ntz, price double").coalesce(1)
        assert {r.level: r.members for r in V.horizontal_levels(piv, eps=0.02, min_samples=3).collect()} == {1.004: 9, 2.0: 6}


def test_halves_are_rounded_as_sql_does(spark):
    rng = random.Random(5)
    values = [261.2775, 316.0775, -261.2775, 2.0005, 0.0005, 1.0e305, float("inf"), None] + [rng.randint(-400000, 400000) / 800 for _ in range(500)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", rounded_half(F.col("v"), 3).alias("r")).orderBy("i").collect()
    con = duckdb.connect()
    want = [con.execute("SELECT round(?::DOUBLE, 3)", [v]).fetchall()[0][0] for v in values]
    assert [r.r for r in got] == want and want[0] == 261.277
