"""Walks, scans and lookups in parallel form against plain loops."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd

from barlab.operators import backtest as T
from barlab.operators import levels as V
from barlab.operators import news as J


def test_thinning_in_chunks_equals_the_walk(spark):
    rows, want = [], set()
    for seed, symbol in enumerate(("A", "B")):
        rng = random.Random(seed)
        for kind, top in (("high", 400), ("low", 90)):
            places = sorted(rng.sample(range(3000), top))
            last = -(10**9)
            for i in places:
                rows.append((symbol, kind, i, float(i)))
                if i - last >= 7:
                    want.add((symbol, kind, i))
                    last = i
    frame = spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "kind", "bar_idx", "price"]))
    for chunk in (7, 64, 100_000):
        got = [(r.symbol, r.kind, r.bar_idx) for r in V.thinned(frame, 7, chunk).collect()]
        assert len(got) == len(want) and set(got) == want
    assert V.thinned(frame.limit(0), 7).collect() == []


def test_merged_windows_by_brute_force(spark):
    for seed in range(3):
        rng = random.Random(seed)
        start = datetime(1999, 12, 30)
        rows = []
        for _ in range(rng.choice([1, 40, 160])):
            a = start + timedelta(minutes=rng.randrange(0, 60 * 24 * 9000, 30))
            rows.append((a, a + timedelta(minutes=rng.choice([0, 30, 60, 60 * 30, 60 * 24 * 400]))))
        rows += rows[:2]
        want: list[list[datetime]] = []
        for a, b in sorted(rows):
            if want and a <= want[-1][1]:
                want[-1][1] = max(want[-1][1], b)
            else:
                want.append([a, b])
        frame = spark.createDataFrame([*rows, (None, start), (start, None)], "start timestamp_ntz, end timestamp_ntz")
        merged = J.merged_windows(frame)
        assert sorted([r.start, r.end] for r in merged.collect()) == want
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_nearest_level_by_brute_force(spark):
    rng = random.Random(5)
    levels = [(s, x, d, rng.uniform(-5, 5), rng.randint(1, 9)) for s in "AB" for d in ("long", "short") for x in sorted({round(rng.uniform(-3, 30), 1) for _ in range(12)})]
    wanted = [(s, i, d, round(rng.uniform(-9, 40), 1)) for i in range(150) for s in "ABC" for d in ("long", "short")]
    by_level = spark.createDataFrame(levels, "symbol string, level double, dir string, avg_pips double, n long")
    by_dir = spark.createDataFrame([("A", "long", 1.5), ("B", "short", -2.0), ("C", "long", 0.5)], "symbol string, dir string, dir_pips double")
    frame = spark.createDataFrame(wanted, "symbol string, pid int, dir string, x double")
    got = {(r.symbol, r.pid, r.dir): r.exp_pips for r in T.nearest_pips(frame, by_level, by_dir, ["symbol", "pid"]).collect()}
    average = {("A", "long"): 1.5, ("B", "short"): -2.0, ("C", "long"): 0.5}
    assert len(got) == len(wanted)
    for s, i, d, x in wanted:
        near = min(((abs(x - v), v, a, n) for t, v, e, a, n in levels if (t, e) == (s, d)), default=None)
        assert got[s, i, d] == (near[2] if near and near[3] >= 5 else average.get((s, d), 0.0))


def test_nearest_level_of_a_price_in_the_key(spark):
    by_level = spark.createDataFrame([("A", 10.0, "long", 1.0, 5), ("A", 12.0, "long", 2.0, 5), ("A", 30.0, "long", 3.0, 4)], "symbol string, level double, dir string, avg_pips double, n long")
    by_dir = spark.createDataFrame([("A", "long", 0.5)], "symbol string, dir string, dir_pips double")
    frame = spark.createDataFrame([("A", 10.9, "long"), ("A", 11.0, "long"), ("A", 11.1, "long"), ("A", 29.0, "long"), ("B", 10.0, "long")], "symbol string, x double, dir string")
    got = T.nearest_pips(frame, by_level, by_dir, ["symbol", "x"]).select("symbol", "x", "dir", "exp_pips").collect()
    assert sorted(map(tuple, got)) == [("A", 10.9, "long", 1.0), ("A", 11.0, "long", 1.0), ("A", 11.1, "long", 2.0), ("A", 29.0, "long", 0.5), ("B", 10.0, "long", 0.0)]


def test_trade_gate_opens_and_closes(spark):
    signals = spark.createDataFrame([("a", "NY", True, False), ("b", "NY", False, False), ("c", "NY", True, True), ("d", "Tokyo", True, False), ("e", "Other", True, False)], "id string, session string, signal boolean, in_window boolean")
    run = spark.createDataFrame([("NY", 0.1), ("Tokyo", -0.1)], "session string, run_ev double")
    assert {r.id for r in T.trade_gate(signals, run).filter("trade").collect()} == {"a"}
