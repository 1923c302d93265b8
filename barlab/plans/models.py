"""Queries of models and streams. Models are iterative, so their rows have no SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import backtest as T
from ..operators import evaluate as E
from ..operators import levels as V
from ..operators import model as M
from ..operators import patterns as D
from ..operators.features import feature_table
from ..operators.shared import shared_folder
from .analysis import _trades
from .common import BARS_SQL, rounded
from .decisions import COST
from .features import CONFIG, bars

Q: dict = {}
O: dict[str, str] = {}  # noqa: E741


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


@query()
def out_of_fold_scores(spark, d):
    """Out-of-fold break probabilities of calibrated models (M1, M2, M4)."""
    return rounded(M.out_of_fold(M.training_table(bars(spark, d), CONFIG)))


@query()
def isotonic_scores(spark, d):
    """The same with isotonic calibration (M3), by fold."""
    return rounded(M.fold_summary(M.out_of_fold(M.training_table(bars(spark, d), CONFIG), calibration="isotonic")))


def _level_model(spark, d):
    """A model of all labelled bars at all levels of their symbol, and the level rows of the newest bars."""
    b = bars(spark, d)
    lv = V.horizontal_levels(V.centred_pivots(b), 0.02)
    features = feature_table(b)
    labels = M.break_labels(b, CONFIG).select("symbol", "ts", "y", "side").filter("y IS NOT NULL")
    train = M.level_rows(features, lv, None, 0.5).join(labels, ["symbol", "ts"])
    train = train.withColumn("y", F.when((F.col("side") == "up") == (F.col("dir_sign") == 1), F.col("y")).otherwise(0))
    return M.fit_logistic(train, M.LEVEL_FEATURES), features, lv


@query()
def level_break_probabilities(spark, d):
    """Break probability of each level in both directions, and the levels' ranking by expected value."""
    model, features, lv = _level_model(spark, d)
    p = M.break_probabilities(model, M.level_rows(features, lv, 20, 0.5))
    wanted = lv.select("symbol", "level", F.explode(F.array(F.lit("long"), F.lit("short"))).alias("dir"))
    return rounded(T.rank_levels(p, T.lookup_pips(wanted, *T.expected_pips(_trades(spark, d))), COST))


@query()
def pattern_decisions(spark, d):
    """Patterns of all kinds by expected value, with the model's probability at their boundaries."""
    model, features, _ = _level_model(spark, d)
    b = bars(spark, d)
    p = reduce(DataFrame.unionByName, [D.with_boundaries(x) for x in (D.double_tops(b), D.head_shoulders(b), D.band_flag(b, pole_atr=0.2), D.latest_pattern(D.triangles(b, flat=0.05, width_atr=6.0)), D.latest_pattern(D.rectangles(b, flat=0.05, drift=0.05, width_atr=6.0, touches=2)))])
    upper, lower = S.pattern_boundaries(F.col("kind"), F.col("upper"), F.col("lower"), F.col("neck"))
    ends = p.select("symbol", F.explode(F.array_compact(F.array(upper, lower))).alias("level")).distinct()
    chance = M.break_probabilities(model, M.level_rows(features, ends, 1, 0.5))
    at = p.withColumns({"_u": upper, "_l": lower}).join(chance.select("symbol", F.col("level").alias("_u"), "p_up"), ["symbol", "_u"], "left").join(chance.select("symbol", F.col("level").alias("_l"), "p_dn"), ["symbol", "_l"], "left")
    last = b.groupBy("symbol").agg(F.max_by("close", "ts").alias("close"))
    return rounded(T.pattern_values(at, *T.expected_pips(_trades(spark, d)), last, COST))


@query()
def label_grid_sweep(spark, d):
    """Average precision, Brier score and thresholds of all 24 settings (M7, A4)."""
    return rounded(M.grid_table(M.grid_scores(bars(spark, d), lookback=8)))


def _run(b):
    """The out-of-fold scores of one setting, as a written table."""
    return M.grid_scores(b, (CONFIG.horizon,), (CONFIG.buffer,), lookback=CONFIG.lookback)


@query()
def cost_sensitivity(spark, d):
    """The best threshold of one run at each cost."""
    return rounded(M.grid_table(_run(bars(spark, d)), M.SENSITIVITY))


@query()
def direction_scores(spark, d):
    """Out-of-fold scores of both directions (M8), with the thresholds of both (A5)."""
    oof = M.direction_pipeline(bars(spark, d), 12, 0.05)
    best = E.plain_best(E.sweep(oof, E.DIRECTION_GRID, ("target",), cost=0.02), ("target",), 0.01).select("target", "theta", "coverage", "ev")
    return rounded(oof.groupBy("target").agg(F.count("*").alias("n"), F.avg("p").alias("p_mean"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier")).join(best, "target"))


@query()
def run_meta(spark, d):
    """What a run records about itself."""
    b = bars(spark, d)
    m = M.run_meta(b, _run(b))
    told = ("class_balance", "oof", "threshold", "ev_cfg", "features", "cv", "ev_cost_sensitivity", "theta_by_session", "theta_by_session_regime")
    return m.select("start_ts", "end_ts", "rows", F.to_json(F.struct(*told)).alias("meta"))


@query(f"WITH {BARS_SQL} SELECT symbol, ts, open, high, low, close, volume FROM bars WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def streamed_bars(spark, d):
    """Closed bars of a replayed event stream (T1): the batch answer for closed buckets."""
    from ..streaming.jobs import closed_bars

    base = shared_folder(spark, "stream")
    source = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value")
    source.write.parquet(f"{base}/in")
    stream = closed_bars(spark.readStream.schema(source.schema).parquet(f"{base}/in"))
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query()
def streamed_scores(spark, d):
    """All bars replayed as a stream: probability, threshold and gate of each from keyed state (T2), by a model of
    the labelled bars, thresholds of the sessions, and windows of the calendar."""
    from ..operators import news as J
    from ..sources import news as N
    from ..streaming.scoring import Score, linear_model, live_scores

    b = bars(spark, d)
    features = feature_table(b)
    cuts = features.groupBy("symbol").agg(F.percentile("atr14", F.array(F.lit(0.33), F.lit(0.66), F.lit(0.5))).alias("q"))
    calendar = N.news_from_events(spark, d)
    windows = lambda w: tuple((r.start, r.end) for r in J.merged_windows(w).collect())  # noqa: E731  a calendar's
    weights, intercept = linear_model(M.fit_logistic(M.training_table(b, CONFIG, features)))
    score = Score(weights, intercept, {"": 0.585, "NY": 0.755, "London": 0.665, "Tokyo": 0.74}, {r.symbol: tuple(x or 0.0 for x in r.q or (0.0,) * 3) for r in cuts.collect()}, hard=windows(J.event_windows(calendar, 5)), soft=windows(J.uniform_windows(calendar, 4, 10)))
    base = shared_folder(spark, "stream")
    b.write.parquet(f"{base}/in")
    stream = live_scores(spark.readStream.schema(b.schema).parquet(f"{base}/in"), score)
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.parquet(f"{base}/out"))
