"""Hand-made series with known answers, and properties."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.operators import backtest as T
from barlab.operators import evaluate as E
from barlab.operators import features as X
from barlab.operators import labels as L
from barlab.operators import levels as V
from barlab.operators import patterns as D
from barlab.operators import splits as C
from barlab.sources import bars as B
from barlab.sources import news as N
from barlab.sources import sinks as K

T0 = dt.datetime(2024, 1, 1)


def frame(spark, rows, symbol="x"):
    """Bars from (open, high, low, close), an hour apart."""
    data = [(symbol, T0 + dt.timedelta(hours=i), *map(float, r), 1) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long")


def flat(n, price=100.0):
    return [(price, price + 0.5, price - 0.5, price)] * n


def noise(n, seed=1):
    rng = np.random.default_rng(seed)
    c = 100 + np.cumsum(rng.normal(0, 1, n))
    o = np.concatenate(([100], c[:-1]))
    return [(a, max(a, b) + x, min(a, b) - y, b) for a, b, x, y in zip(o, c, rng.random(n), rng.random(n), strict=True)]


def label(spark, tail, cfg=L.BreakConfig(horizon=4, lookback=48, settle_bars=2, timeout=6)):
    rows = flat(60) + tail + flat(40, tail[-1][3])
    return L.break_labels(frame(spark, rows), cfg).filter("bar_idx = 59").first()


def test_break_up_settles_and_pays(spark):
    r = label(spark, [(100, 103, 100, 103), (103, 104, 102.9, 103.5), (103.5, 106, 103.4, 106)])
    assert (r.reason, r.side, r.t_break, r.t_settle, r.outcome, r.y) == ("ok", "up", 60, 61, "tp", 1)


def test_tie_of_sides_goes_up(spark):
    r = label(spark, [(100, 103, 97, 103), (103, 104, 102.9, 103.5), (103.5, 104, 103.4, 103.6)])
    assert r.side == "up"


def test_no_settle_and_no_break(spark):
    assert label(spark, [(100, 103, 100, 103), (100, 100.5, 99.5, 100)]).reason == "no_settle"
    assert label(spark, flat(3)).reason == "no_break"


def test_barrier_tie_is_profit_and_timeout(spark):
    both = label(spark, [(100, 103, 100, 103), (103, 103.6, 102.9, 103.2), (103, 120, 90, 103)])
    assert both.outcome == "tp"
    quiet = [(103.2, 103.3, 103.1, 103.2)] * 3
    r = label(spark, [(100, 103, 100, 103), (103, 103.6, 102.9, 103.2), *quiet], L.BreakConfig(horizon=4, timeout=3))
    assert (r.outcome, r.t_exit) == ("to", 64)


def test_tail_event_and_insufficient(spark):
    df = frame(spark, flat(80))
    out = {r.bar_idx: r.reason for r in L.break_labels(df, L.BreakConfig(horizon=4), F.col("bar_idx") == 60).collect()}
    assert out[75] == "tail" and out[74] == "no_break" and out[60] == "event" and out[10] == "insufficient"


def test_levels_cluster_border_and_noise(spark):
    prices = [1.00, 1.05, 1.08, 1.50, 1.52, 1.55, 1.59, 3.0]
    piv = spark.createDataFrame([("x", "high", T0 + dt.timedelta(hours=i), p) for i, p in enumerate(prices)], "symbol string, kind string, ts timestamp_ntz, price double")
    got = {r.level: r.members for r in V.horizontal_levels(piv, eps=0.08, min_samples=3).collect()}
    assert got == {1.043: 3, 1.54: 4}


def test_rolling_levels_know_no_future(spark):
    rows = noise(300)
    whole = V.rolling_levels(V.centred_pivots(frame(spark, rows)), 10).toPandas()
    part = V.rolling_levels(V.centred_pivots(frame(spark, rows[:200])), 10).toPandas()
    at = 150
    live = lambda d: sorted(d[(d.from_idx <= at) & (d.to_idx.isna() | (d.to_idx > at))].level)
    assert live(whole) == live(part)


def test_features_know_no_future(spark):
    rows = noise(200)
    cols = ["ret_4", "atr14", "z_close_20", "touch_density", "slope_long"]
    a = X.base_features(frame(spark, rows)).filter("bar_idx < 150").select("bar_idx", *cols).toPandas().set_index("bar_idx").sort_index()
    b = X.base_features(frame(spark, rows[:150])).select("bar_idx", *cols).toPandas().set_index("bar_idx").sort_index()
    np.testing.assert_allclose(a.to_numpy(float), b.to_numpy(float), rtol=1e-9, atol=1e-12)


FINDS = {
    "triangles": lambda b, n: D.triangles(b, flat=0.02, width_atr=8, chunk=n),
    "rectangles": lambda b, n: D.rectangles(b, flat=0.02, drift=0.02, width_atr=8, touches=2, chunk=n),
    "flags": lambda b, n: D.flags(b, pole_atr=1, steepest=0.1, width_atr=8, contraction=1.3, quality_min=0.1, chunk=n),
    "atr": lambda b, n: D.exponential_atr(b, chunk=n),
}


@pytest.mark.parametrize("name", FINDS)
def test_chunks_give_what_one_pass_gives(spark, name):
    import pandas as pd

    bars = frame(spark, noise(900, 3))
    key = "bar_idx" if name == "atr" else "end_idx"
    whole, parts = (FINDS[name](bars, n).toPandas().sort_values(key).reset_index(drop=True) for n in (2048, 128))
    assert len(whole)
    pd.testing.assert_frame_equal(whole, parts, rtol=1e-6, check_dtype=False)


def test_splits_keep_train_and_test_apart(spark):
    df = frame(spark, flat(23))
    w = C.walk_forward(df, 5, 2).toPandas()
    for _, g in w.groupby("fold"):
        assert g[g.role == "train"].bar_idx.max() < g[g.role == "test"].bar_idx.min() - 2 or not (g.role == "train").any()
    assert w[w.role == "test"].bar_idx.max() == 17
    days = frame(spark, flat(11 * 24))
    p = C.purged_folds(C.time_groups(days), 4, 1, 1).toPandas()
    assert p[p.role == "test"].groupby("fold").grp.nunique().tolist() == [3, 3, 3, 2]
    assert ((p.role == "dropped").groupby(p.fold).sum() > 0).all()


def scored(spark, values):
    return spark.createDataFrame([(i, T0 + dt.timedelta(minutes=7 * i), y, float(p)) for i, (y, p) in enumerate(values)], "id long, ts timestamp_ntz, y int, p double")


def test_calibration_bins_add_up_and_empty_bin(spark):
    s = scored(spark, [(i % 2, 0.05 + 0.1 * (i % 5)) for i in range(50)])
    t = E.reliability(s, [0.0, 0.25, 0.5, 0.75, 1.0]).orderBy("bin").collect()
    assert sum(r["count"] for r in t) == 50 and t[3]["count"] == 0 and t[3].prob_mean is None
    assert all(r.ci_low <= r.frac_pos <= r.ci_high for r in t if r["count"])


def test_psi_of_itself_is_zero_and_outside_is_ignored(spark):
    s = scored(spark, [(0, i / 100) for i in range(100)])
    assert E.psi(s, s).first().psi == pytest.approx(0)
    assert E.psi(s, s.union(scored(spark, [(0, 5.0)]))).first().psi == pytest.approx(0)


def test_threshold_stages_fall_through(spark):
    low = scored(spark, [(0, 0.1)] * 20)
    assert E.best_theta(E.sweep(low, E.theta_grid())).first().trades == 0
    some = scored(spark, [(0, 0.1)] * 99 + [(1, 0.99)])
    assert E.best_theta(E.sweep(some, E.theta_grid())).first().trades == 1


def test_stratified_sample_is_even(spark):
    s = scored(spark, [(i % 2, (i * 37 % 100) / 100) for i in range(2000)]).withColumn("vol", F.col("p"))
    for mode in ("random", "extreme"):
        out = E.stratified_sample(s, "id", 40, mode).groupBy("y", "stratum").count().collect()
        k = 40 // len({r.stratum for r in out})
        assert all(r["count"] <= max(1, k) for r in out)


def test_times_in_many_notations(spark):
    texts = ["2024-01-02 03:04:05", "2024-01-02T03:04:05Z", "2024/01/02 03:04", "01/02/2024 03:04", "2024.01.02 03:04", "1704164645", "1704164645000", "never", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(B.any_timestamp(F.col("t")).alias("x"))
    got = [r.x for r in df.collect()]
    full, minute = dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4)
    assert got == [full, full, minute, minute, minute, full, full, None, None]


def test_news_headers(spark):
    raw = spark.createDataFrame([("2024/01/02", "03:04", "4", "a"), ("bad", "bad", "5", "b"), ("2024/01/03", "00:00", "high", "c")], "`Date ` string, `TIME` string, `Impact` string, `Event` string")
    got = [(r.ts.day, r.importance, r.title) for r in N.parse_news(raw).orderBy("ts").collect()]
    assert got == [(2, 4, "a"), (3, 0, "c")]
    bare = spark.createDataFrame([("x", "2024-01-02 00:00:00")], "a string, b string")
    assert N.parse_news(bare).count() == 1


def test_csv_needs_its_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Timestamp,Open,High,Low,Close,Volume\n2024-01-01 00:00:00,1,2,0.5,1.5,7\n")
    assert B.read_bars_csv(spark, str(tmp_path / "a.csv"), "x").first().volume == 7
    (tmp_path / "b.csv").write_text("Timestamp,Open\n2024-01-01 00:00:00,1\n")
    with pytest.raises(ValueError, match="high"):
        B.read_bars_csv(spark, str(tmp_path / "b.csv"), "x")


def test_incomplete_candles_are_left_out(spark):
    payload = '{"candles": [{"time": "2024-01-01T01:00:00Z", "complete": false, "mid": {"o": "1", "h": "2", "l": "0", "c": "1"}, "volume": 3}, {"time": "2024-01-01T00:00:00Z", "complete": true, "mid": {"o": "1", "h": "2", "l": "0", "c": "1.5"}, "volume": 3}]}'
    got = B.candles_to_bars(spark.createDataFrame([("x", payload)], "symbol string, payload string")).collect()
    assert [(r.ts.hour, r.close) for r in got] == [(0, 1.5)]


def test_calibration_file_round_trip(spark, tmp_path):
    s = scored(spark, [(i % 2, (i % 10) / 10) for i in range(50)])
    t = E.reliability(s, E.quantile_edges(s, 4))
    K.write_json(K.calibration_row(t, 0.2, 0.1, ["a"]), str(tmp_path / "c"))
    back = K.read_calibration(spark, str(tmp_path / "c")).orderBy("bin").collect()
    assert [r["count"] for r in back] == [r["count"] for r in t.orderBy("bin").collect()]


def test_rank_levels_buy_wins_ties(spark):
    levels = spark.createDataFrame([("x", 1.0, 0.5, 0.5)], "symbol string, level double, p_up double, p_dn double")
    pips = spark.createDataFrame([("x", 1.0, "long", 4.0), ("x", 1.0, "short", 4.0)], "symbol string, level double, dir string, exp_pips double")
    r = T.rank_levels(levels, pips, 1.0).first()
    assert (r.action, r.ev) == ("BUY", 1.5)


def test_streams_agree_with_batch(spark, tmp_path):
    from barlab.streaming import jobs

    bars = frame(spark, noise(260))
    bars.filter("ts < timestamp_ntz'2024-01-11 00:00:00'").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(bars.schema).parquet(str(tmp_path / "in"))
    jobs.live_features(spark, stream, str(tmp_path / "bars"), lambda df, _: seen.append(df.select("ts", "ret_4", "atr14").toPandas()), str(tmp_path / "ck")).awaitTermination()
    batch = X.feature_table(bars.filter("ts < timestamp_ntz'2024-01-11 00:00:00'")).select("ts", "ret_4", "atr14").toPandas()
    got = seen[0].sort_values("ts").reset_index(drop=True)
    np.testing.assert_allclose(got[["ret_4", "atr14"]].to_numpy(float), batch.sort_values("ts")[["ret_4", "atr14"]].to_numpy(float))


def test_drift_buffer_state(spark, tmp_path):
    from barlab.streaming import jobs

    s = spark.createDataFrame([("x", T0 + dt.timedelta(minutes=i), (i % 100) / 100) for i in range(300)], "symbol string, ts timestamp, p double")
    s.coalesce(1).write.parquet(str(tmp_path / "in"))
    edges, share = [0.0, 0.25, 0.5, 0.75, 1.0], [0.25] * 4
    q = jobs.drift_buffer(spark.readStream.schema(s.schema).parquet(str(tmp_path / "in")), edges, share).writeStream.outputMode("update").format("memory").queryName("drift").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("drift").first()
    assert r.n == 300 and abs(r.psi) < 0.01


def test_news_headers_of_many_vendors(spark):
    found = N.resolve_headers(["発表日", "発表時刻", "Priority", "指標名"])
    assert found == {"date": "発表日", "clock": "発表時刻", "importance": "Priority", "title": "指標名"}
    assert N.resolve_headers(["When", "Stars", "Head-Line"]) == {"time": "When", "importance": "Stars", "title": "Head-Line"}
    raw = spark.createDataFrame([("2024-01-02 00:00:00", "x", "3"), ("no", "y", "z")], "a string, b string, c string")
    assert [tuple(r) for r in N.parse_news(raw).select("importance", "title").collect()] == [(3, "x")]


def test_newest_rolling_levels_are_the_static_ones(spark):
    rng = random.Random(31)
    rows = []
    for s in "ab":
        x = 100.0
        for i in range(400):
            x += rng.choice([-0.5, -0.25, 0.25, 0.5])
            rows.append((s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), x, x + rng.choice([0.25, 0.5]), x - rng.choice([0.25, 0.5]), x, 1))
    b = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long")
    piv = V.centred_pivots(b, 6)
    known = V.rolling_levels(piv, 6, 0.05).filter("to_idx IS NULL")
    want = {(r.symbol, r.level) for r in V.horizontal_levels(piv, 0.05).collect()}
    assert {(r.symbol, r.level) for r in known.collect()} == want and len(want) > 2


def test_border_points_join_the_cluster_seen_first():
    prices = np.array([0.75, 0.875, 1.0, 1.25, 1.5, 1.625, 1.75])  # cores 1.0 and 1.5; 1.25 is near both
    lower_first, upper_first = np.arange(7), np.arange(7)[::-1]
    assert V._clusters(prices, lower_first, 0.25, 4) == [0.96875, 1.625]
    assert V._clusters(prices, upper_first, 0.25, 4) == [0.875, 1.53125]


def test_precision_recall_area_and_guards(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.4), (1, 0.3)]
    df = spark.createDataFrame(rows, "y int, p double")
    points = [(0, 1.0)]
    for t in (0.9, 0.8, 0.4, 0.3):
        hit = [y for y, p in rows if p >= t]
        points.append((sum(hit) / 3, sum(hit) / len(hit)))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert E.pr_auc(df).first()[0] == pytest.approx(area)
    none = df.withColumn("y", F.lit(0))
    assert E.pr_auc(none).first()[0] is None and E.average_precision(none).first()[0] is None
    out = E.plain_best(E.sweep(df, [0.95, 0.99]), (), 0.3, 0.25).first()
    assert (out.theta, out.trades, out.ev) == (0.5, 0, None)


def test_patterns_wait_for_their_own_side(spark):
    rows = [("x", "double_top:1", "double_top", 1.0, None, None, 9.0, 10.0, None, 0.5, 0.5), ("x", "rectangle:2", "rectangle", 1.0, 12.0, 8.0, None, None, 3.0, 0.6, None), ("y", "pennant:3", "pennant", 1.0, 12.0, 8.0, None, None, 3.0, 0.5, 0.5)]
    p = spark.createDataFrame(rows, "symbol string, pid string, kind string, quality double, upper double, lower double, neck double, extreme double, height double, p_up double, p_dn double")
    by_level = spark.createDataFrame([("x", 9.0, "short", 10.0, 9), ("x", 12.5, "long", 4.0, 2)], "symbol string, level double, dir string, avg_pips double, n long")
    by_dir = spark.createDataFrame([("x", "short", 1.0), ("x", "long", 20.0)], "symbol string, dir string, dir_pips double")
    last = spark.createDataFrame([("x", 11.0), ("y", 11.0)], "symbol string, close double")
    out = {r.pid: r for r in T.pattern_values(p, by_level, by_dir, last, 2.0).collect()}
    top, box, other = out["double_top:1"], out["rectangle:2"], out["pennant:3"]
    assert (top.upper_level, top.lower_level, top.target_dn, top.ev_dn, top.action, top.ev) == (None, 9.0, 10.0, 4.0, "SELL", 4.0)
    assert (box.ev_up, box.ev_dn, box.action, box.target_up) == (pytest.approx(10.8), None, "BUY", 14.0)  # too few trades at 12.5: the direction's mean
    assert (other.ev_up, other.ev_dn, other.action, other.ev) == (None, None, "SELL", None)


def test_ranks_in_cells_are_plain_ranks(spark):
    rng = random.Random(32)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 50)), rng.choice([0.1, 0.2, 0.2, rng.random()])) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, vol double")
    got = {r.id: r.rank for r in E.global_rank(df, "vol", "ts", "id").collect()}
    want = {i: k for k, (_, _, i) in enumerate(sorted((v, t, i) for i, t, v in rows), 1)}
    assert got == want
    values = sorted(v for _, _, v in rows)
    pct = {r.id: r.pct_rank for r in E.percent_rank_average(df, "vol").collect()}
    for i, _, v in rows:
        below, ties = sum(x < v for x in values), values.count(v)
        assert pct[i] == pytest.approx((below + (ties + 1) / 2) / 700)


def test_calibration_has_folds_of_its_own(spark):
    from barlab.operators import model as M

    rng = random.Random(33)
    rows = []
    for i in range(420):
        y = int(rng.random() < 0.4)
        rows.append(("s", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), y, y + rng.gauss(0, 1.0), rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, y int, a double, b double").coalesce(1)
    oof = M.out_of_fold(df, 3, features=("a", "b")).toPandas()
    assert len(oof) == 420 and oof.groupby("fold").size().min() > 100
    high, low = oof[oof.p > oof.p.median()], oof[oof.p <= oof.p.median()]
    assert high.y.mean() > low.y.mean() + 0.2 and abs(oof.p.mean() - oof.y.mean()) < 0.1
    few = M.calibrated(df.limit(60), df, ("a", "b")).toPandas()  # under 100 rows: not calibrated
    assert len(few) == 420 and few.p.between(0, 1).all()


def test_live_alerts_and_freshness(spark, tmp_path):
    from barlab.operators import news as J
    from barlab.streaming import jobs

    rows = [(10, 11, 9, 10)] * 60 + [(10, 14, 9, 13)]
    bars = frame(spark, rows).unionByName(frame(spark, rows, "y"))
    bars.coalesce(1).write.parquet(str(tmp_path / "in"))
    levels = spark.createDataFrame([("x", 12.0), ("y", 12.0)], "symbol string, level double")
    last = T0 + dt.timedelta(hours=60)
    windows = J.event_windows(spark.createDataFrame([(last + dt.timedelta(hours=5), 5, "n")], "ts timestamp_ntz, importance int, title string"), 3)
    seen = []
    stream = lambda: spark.readStream.schema(bars.schema).parquet(str(tmp_path / "in"))
    jobs.live_alerts(spark, stream(), str(tmp_path / "bars"), levels, windows, lambda df, _: seen.extend(df.collect()), str(tmp_path / "ck")).awaitTermination()
    assert {(r.symbol, r["mode"], r.dir, r.ts) for r in seen if r["mode"] == "level"} == {("x", "level", "long", last), ("y", "level", "long", last)}
    fresh = []
    jobs.live_freshness(stream(), str(tmp_path / "newest"), lambda df, _: fresh.extend(df.collect()), str(tmp_path / "ck2"), lambda: "2024-01-03 12:10:00").awaitTermination()
    assert {(r.symbol, r.age_minutes, r.status) for r in fresh} == {("x", 10.0, "STALE"), ("y", 10.0, "STALE")}
