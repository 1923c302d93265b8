"""Live scores from keyed state against the batch job."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barlab.functions import scalars as S
from barlab.operators import model as M
from barlab.operators import news as J
from barlab.operators.features import feature_table
from barlab.streaming.scoring import Score, live_scores


def test_replay_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    start, rows = datetime(2024, 1, 1), []
    for s, symbol in enumerate(("A", "B")):
        price = 100.0 + s
        for i in range(330 if s else 90):
            o, price = price, price + rng.gauss(0, 0.3)
            rows.append((symbol, start + timedelta(hours=i), o, max(o, price) + rng.random() / 5, min(o, price) - rng.random() / 5, price, 1))
    schema = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long"
    bars = spark.createDataFrame(rows, schema)
    q = {r.symbol: tuple(r.q) for r in feature_cuts(bars).collect()}
    weights = {f: rng.uniform(-0.5, 0.5) * (1e-2 if f in ("ret_8_v_sq", "slope_short_6_v", "high_low_ratio_20") else 1) for f in M.FEATURES}
    hard = ((start + timedelta(hours=30, minutes=30), start + timedelta(hours=40)),)
    soft = ((start + timedelta(hours=50), start + timedelta(hours=70)),)
    theta = {"": 0.5, "NY": 0.52, "London": 0.55, "Tokyo": 0.5}
    score = Score(weights, 0.1, theta, q, 0.2, hard, soft)
    # Batches of any size; two of the bars come again later, out of order.
    rows.sort(key=lambda r: r[1])
    folder = str(tmp_path / "in")
    cuts = [0, 3, 4, 150, 151, 300, len(rows)]
    for lo, hi in zip(cuts, cuts[1:]):
        again = [rows[5], rows[61]] if lo == 300 else []
        spark.createDataFrame(rows[lo:hi] + again, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "out")
    live_scores(stream, score).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(r.symbol, r.ts): r for r in spark.read.parquet(out).collect()}

    f = feature_table(bars)
    margin = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.1))
    session = S.session_for_scoring(F.col("ts"))
    base = F.when(session == "NY", 0.52).when(session == "London", 0.55).when(session == "Tokyo", 0.5).otherwise(0.5)
    windows = lambda w: spark.createDataFrame(list(w), "start timestamp_ntz, end timestamp_ntz")
    f = J.in_any_window(J.in_any_window(f, windows(hard), ["symbol", "ts"], "hard"), windows(soft), ["symbol", "ts"], "soft")
    f = f.withColumns({"p": 1 / (1 + F.exp(-margin)), "theta": S.effective_theta(base, S.regime(F.col("reg_atr_low"), F.col("reg_atr_mid"), F.col("reg_atr_high")), F.col("soft"))})
    want = f.select("symbol", "ts", "p", "theta", "hard", session.alias("session"), ((F.col("p") >= F.col("theta")) & ~F.col("hard")).alias("trade")).collect()
    assert len(want) == len(got) == len(rows)
    for r in want:
        mine = got[r.symbol, r.ts]
        assert mine.p == pytest.approx(r.p, abs=1e-9) and mine.theta == pytest.approx(r.theta), (r, mine)
        assert (mine.session, mine.in_news, mine.trade) == (r.session, r.hard, r.trade)
    assert {r.trade for r in want} == {True, False} and any(r.hard for r in want)
    assert sum(max(r.late for r in got.values() if r.symbol == s) for s in "AB") == 2


def feature_cuts(bars):
    return feature_table(bars).groupBy("symbol").agg(F.percentile(F.when(F.col("atr14").isNotNull(), F.col("atr14")), F.array(F.lit(0.33), F.lit(0.66), F.lit(0.5))).alias("q"))
