"""Signals, static and point-in-time backtests, summaries and rankings by expected value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import measured_move, pattern_boundaries, rounded_half
from .features import by_time, regression_trend, with_index
from .levels import centred_pivots, rolling_levels
from .news import in_any_window


def with_moves(bars: DataFrame, n: int, wait: int) -> DataFrame:
    """Bars with the previous bar's extremes, the exit n bars on and the next closes."""
    return with_index(bars).withColumns({"prev_low": F.lag("low").over(by_time()), "prev_high": F.lag("high").over(by_time()), "exit": F.lead("close", n).over(by_time()), "_next": F.collect_list("close").over(by_time().rowsBetween(1, wait))})


def retest(target: Column, tolerance: float) -> dict[str, Column]:
    """Share of the next closes within tolerance of the target, and whether any is."""
    near = F.size(F.filter("_next", lambda c: F.abs(c - target) <= tolerance))
    return {"retest_index": F.when(F.size("_next") > 0, near / F.size("_next")).otherwise(0.0), "retest_hit": near > 0}


def _trades(crossed: DataFrame, mode: str, pip: float, spread: float, tolerance: float) -> DataFrame:
    out = crossed.withColumns(retest(F.col("target"), tolerance))
    return out.select("symbol", "ts", "bar_idx", F.lit(mode).alias("mode"), F.col("target").alias("level_or_val"), "dir", F.col("close").alias("entry"), "exit", ((F.col("exit") - F.col("close")) * F.when(F.col("dir") == "long", 1).otherwise(-1) / pip - spread).alias("ret_pips"), "retest_index", "retest_hit")


def crossings(df: DataFrame, buffer: Column | float) -> DataFrame:
    """Rows whose close leaves `target` by the buffer while the previous bar still reached it."""
    long = (F.col("close") > F.col("target") + buffer) & (F.col("prev_low") <= F.col("target"))
    short = (F.col("close") < F.col("target") - buffer) & (F.col("prev_high") >= F.col("target"))
    return df.withColumn("dir", F.when(long, "long").when(short, "short")).filter("dir IS NOT NULL")


def backtest_levels(bars: DataFrame, levels: DataFrame, n: int = 12, buffer: float = 0.0, wait: int = 10, tolerance: float = 0.05, pip: float = 0.01, spread: float = 0.0, suppressed: DataFrame | None = None) -> DataFrame:
    """Static backtest of level breaks with levels of the whole sample, i.e. with look-ahead."""
    df = _without(with_moves(bars, n, wait).filter("exit IS NOT NULL AND bar_idx >= 1"), suppressed)
    return _trades(crossings(df.join(levels.select("symbol", F.col("level").alias("target")), "symbol"), buffer), "level", pip, spread, tolerance)


def beyond_channel(df: DataFrame, buffer: Column | float) -> DataFrame:
    """Rows whose close is above the upper, or below the lower channel line by the buffer; `target` is that line."""
    up, dn = F.col("close") > F.col("channel_up") + buffer, F.col("close") < F.col("channel_dn") - buffer
    return df.filter("trend_sigma > 0").withColumn("dir", F.when(up, "long").when(dn, "short")).filter("dir IS NOT NULL").withColumn("target", F.when(F.col("dir") == "long", F.col("channel_up")).otherwise(F.col("channel_dn")))


def _without(df: DataFrame, suppressed: DataFrame | None) -> DataFrame:
    return df if suppressed is None else df.join(suppressed.select("symbol", "ts"), ["symbol", "ts"], "left_anti")


def backtest_trend(bars: DataFrame, lookback: int = 48, n: int = 12, buffer: float = 0.0, wait: int = 10, tolerance: float = 0.05, pip: float = 0.01, spread: float = 0.0, channel: bool = False, k: float = 2.0, suppressed: DataFrame | None = None, fixed: bool = False) -> DataFrame:
    """Breaks of the trailing trend line, or closes beyond its channel.

    Point in time (B5): each bar's own line, known from the bars up to it. fixed (B4): the newest
    bar's line for all bars, i.e. with look-ahead. Bars of `suppressed` (symbol, ts) give no signal.
    """
    df = regression_trend(bars, lookback, "low", k)
    first = lookback
    if fixed:
        lines = ["trend_end", "trend_sigma", "channel_up", "channel_dn"]
        last = df.groupBy("symbol").agg(F.max_by(F.struct(*lines), "ts").alias("_l")).select("symbol", "_l.*")
        df, first = df.drop(*lines).join(last, "symbol"), 1
    df = _without(with_moves(df, n, wait).filter(f"exit IS NOT NULL AND bar_idx >= {first}"), suppressed)
    found = beyond_channel(df, buffer) if channel else crossings(df.withColumn("target", F.col("trend_end")), buffer)
    return _trades(found, "channel" if channel else "trend", pip, spread, tolerance)


#: Bars of the cells in which bars and level intervals meet.
LEVEL_CELL = 256


def backtest_rolling(bars: DataFrame, look: int = 10, n: int = 12, buffer: float = 0.0, wait: int = 10, tolerance: float = 0.05, pip: float = 0.01, spread: float = 0.0, lookback: int = 48, eps_share: float = 0.05, suppressed: DataFrame | None = None) -> DataFrame:
    """Point-in-time backtest of level breaks: at each bar only levels known from the bars up to it.

    Bars meet the intervals of levels in cells of bar positions, so a bar is not compared with all
    levels that its symbol ever had. Bars of `suppressed` (symbol, ts) give no signal (J5).
    """
    known = rolling_levels(centred_pivots(bars, look), look, eps_share).withColumnRenamed("level", "target")
    df = _without(with_moves(bars, n, wait).filter(f"exit IS NOT NULL AND bar_idx >= {max(2, lookback, 4 * look)}"), suppressed)
    ends = df.groupBy("symbol").agg(F.max("bar_idx").alias("_end"))
    cell = lambda i: F.floor(i / LEVEL_CELL)
    spans = known.join(ends, "symbol").filter("from_idx <= _end").withColumn("_cell", F.explode(F.sequence(cell(F.col("from_idx")), cell(F.least(F.coalesce("to_idx", "_end"), "_end"))))).drop("_end")
    j = df.withColumn("_cell", cell(F.col("bar_idx"))).join(spans, ["symbol", "_cell"]).filter("bar_idx >= from_idx AND (to_idx IS NULL OR bar_idx < to_idx)")
    return _trades(crossings(j, buffer), "level", pip, spread, tolerance)


def retest_entries(trades: DataFrame, bars: DataFrame, n: int = 12, wait: int = 10, touch: float = 0.05, pip: float = 0.01, spread: float = 0.0, suppressed: DataFrame | None = None) -> DataFrame:
    """Enter at the first of the next wait - 1 bars that closes back at the level, exit n bars on.

    As a mode of the backtests (B4, B5): trades are its breaks, whose retest_index and retest_hit stay.
    """
    b = _without(with_index(bars).withColumn("exit", F.lead("close", n).over(by_time())).filter("exit IS NOT NULL"), suppressed)
    kept = ["symbol", "signal_idx", "level_or_val", "dir", "retest_index", "retest_hit"]
    t = trades.withColumnRenamed("bar_idx", "signal_idx").select(*kept).withColumn("bar_idx", F.explode(F.sequence(F.col("signal_idx") + 1, F.col("signal_idx") + wait - 1)))
    j = t.join(b.select("symbol", "ts", "bar_idx", "close", "exit"), ["symbol", "bar_idx"]).filter(F.abs(F.col("close") - F.col("level_or_val")) <= touch)
    first = j.groupBy(*kept).agg(F.min_by(F.struct("bar_idx", "ts", "close", "exit"), "bar_idx").alias("e"))
    sign = F.when(F.col("dir") == "long", 1).otherwise(-1)
    return first.select("symbol", F.col("e.ts").alias("ts"), "signal_idx", "level_or_val", "dir", F.col("e.bar_idx").alias("entry_idx"), F.lit("retest").alias("mode"), F.col("e.close").alias("entry"), F.col("e.exit").alias("exit"), ((F.col("e.exit") - F.col("e.close")) * sign / pip - spread).alias("ret_pips"), "retest_index", "retest_hit")


def summary(trades: DataFrame, *by: str | Column) -> DataFrame:
    """Count, win rate, mean, sample deviation and their ratio."""
    a = trades.groupBy(*by).agg(F.count("*").alias("trades"), F.avg((F.col("ret_pips") > 0).cast("double")).alias("win_rate"), F.avg("ret_pips").alias("avg_pips"), F.stddev_samp("ret_pips").alias("std_pips"))
    return a.withColumn("ratio", F.when(F.col("std_pips") > 0, F.col("avg_pips") / F.col("std_pips")))


def breakdown(trades: DataFrame) -> DataFrame:
    """Trades by mode and direction, by direction, by whether the level was met again, and of the channel alone."""
    label = F.concat_ws(" ", "mode", "dir")
    met = F.when(F.col("retest_hit"), "yes").otherwise("no")
    kinds = F.array_compact(F.array(F.struct(F.lit("mode").alias("kind"), label.alias("name")), F.struct(F.lit("direction").alias("kind"), F.col("dir").alias("name")), F.struct(F.lit("retest").alias("kind"), met.alias("name")), F.when(F.col("mode") == "channel", F.struct(F.lit("channel").alias("kind"), F.col("dir").alias("name")))))
    rows = trades.withColumn("_k", F.explode(kinds)).select("_k.kind", "_k.name", "ret_pips", "retest_index")
    return rows.groupBy("kind", "name").agg(F.count("*").alias("trades"), F.avg((F.col("ret_pips") > 0).cast("double")).alias("win_rate"), F.avg("ret_pips").alias("avg_pips"), F.stddev_samp("ret_pips").alias("std_pips"), F.avg("retest_index").alias("avg_retest"))


def exact_mean(x: str) -> Column:
    """Mean of a column by a sum of decimals with nine places, which no order of rows changes; where a value has none (NaN, 1e19 and more), the plain mean."""
    exact = F.col(x).try_cast("decimal(28,9)")
    return F.when(F.count(exact) == F.count(x), F.sum(exact).cast("double") / F.count(x)).otherwise(F.avg(x))


def expected_pips(trades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean pips by level and direction, and by direction alone."""
    by_level = trades.groupBy("symbol", F.col("level_or_val").alias("level"), "dir").agg(exact_mean("ret_pips").alias("avg_pips"), F.count("*").alias("n"))
    return by_level, trades.groupBy("symbol", "dir").agg(exact_mean("ret_pips").alias("dir_pips"))


def lookup_pips(wanted: DataFrame, by_level: DataFrame, by_dir: DataFrame, least: int = 5) -> DataFrame:
    """Expected pips of (symbol, level, dir): the level's own from `least` trades on, else the direction's, else 0."""
    j = wanted.join(by_level, ["symbol", "level", "dir"], "left").join(by_dir, ["symbol", "dir"], "left")
    return j.withColumn("exp_pips", F.coalesce(F.when(F.col("n") >= least, F.col("avg_pips")), F.col("dir_pips"), F.lit(0.0))).drop("avg_pips", "dir_pips", "n")


def nearest_pips(wanted: DataFrame, by_level: DataFrame, by_dir: DataFrame, key: list[str], least: int = 5) -> DataFrame:
    """As lookup_pips, with the nearest level of the symbol and direction to x (J8), the lower of two.

    x stays a column where it is part of the key. Levels and wanted prices are sorted together within cells
    of one unit of price; the last level below and the first above are carried over cells that have none, so no price meets all levels.
    """
    side, cell = ["symbol", "dir"], F.floor("x").alias("_cell")
    known = F.struct("level", "avg_pips", "n")
    levels = by_level.select(*side, F.col("level").alias("x"), known.alias("_at"), F.floor("level").alias("_cell"))
    rows = wanted.select(*dict.fromkeys([*key, *side, "x"]), cell).unionByName(levels, allowMissingColumns=True)
    ends = rows.groupBy(*side, "_cell").agg(F.max_by("_at", F.when(F.col("_at").isNotNull(), F.col("x"))).alias("_top"), F.min_by("_at", F.when(F.col("_at").isNotNull(), F.col("x"))).alias("_bottom"))
    cells = Window.partitionBy(*side).orderBy("_cell")
    ends = ends.select(*side, "_cell", F.last("_top", True).over(cells.rowsBetween(Window.unboundedPreceding, -1)).alias("_far_below"), F.first("_bottom", True).over(cells.rowsBetween(1, Window.unboundedFollowing)).alias("_far_above"))
    inside = Window.partitionBy(*side, "_cell").orderBy("x")
    near = rows.withColumns({"_below": F.last("_at", True).over(inside.rangeBetween(Window.unboundedPreceding, 0)), "_above": F.first("_at", True).over(inside.rangeBetween(0, Window.unboundedFollowing))})
    near = near.filter(F.col("_at").isNull()).join(ends, [*side, "_cell"], "left")
    away = lambda level: F.when(level.isNotNull(), F.struct(F.abs(F.col("x") - level["level"]).alias("d"), level["level"].alias("level"), level.alias("at")))
    best = F.least(away(F.coalesce("_below", "_far_below")), away(F.coalesce("_above", "_far_above")))["at"]
    out = near.withColumn("b", best).drop("_at", "_below", "_above", "_far_below", "_far_above", "_cell").join(by_dir, side, "left")
    return out.withColumn("exp_pips", F.coalesce(F.when(F.col("b.n") >= least, F.col("b.avg_pips")), F.col("dir_pips"), F.lit(0.0))).drop("b", "dir_pips", *({"x"} - set(key)))


def trade_gate(signals: DataFrame, run: DataFrame, by: tuple[str, ...] = ("session",)) -> DataFrame:
    """signals with trade: the signal holds, no event window does, and the run's expected value of the row's
    session (run: by..., run_ev) is positive; sessions without one don't trade (B9)."""
    ok = F.col("signal") & ~F.col("in_window") & (F.coalesce("run_ev", F.lit(0.0)) > 0)
    return signals.join(run, list(by), "left").withColumn("trade", ok)


def pattern_values(patterns: DataFrame, by_level: DataFrame, by_dir: DataFrame, last: DataFrame, cost: float = 0.0, least: int = 5) -> DataFrame:
    """Patterns by the better expected value of buying their upper and selling their lower break.

    patterns: (symbol, pid, kind, quality, upper, lower, neck, extreme, height, p_up, p_dn); last: (symbol,
    close). A side without a boundary, a probability or any known trades has no value; BUY needs a
    value that is not below the other side's. pid names a pattern within its symbol.
    """
    upper, lower = pattern_boundaries(F.col("kind"), F.col("upper"), F.col("lower"), F.col("neck"))
    move = measured_move(F.col("kind"), F.col("height"), F.col("extreme"), F.col("neck"))
    p = patterns.join(last.select("symbol", "close"), "symbol").withColumns({"upper_level": upper, "lower_level": lower, "target_up": F.col("close") + move, "target_dn": F.col("close") - move})
    kept = ["symbol", "pid", "kind", "quality", "upper_level", "lower_level", "p_up", "p_dn", "target_up", "target_dn"]
    side = lambda d, x, p: F.struct(F.lit(d).alias("dir"), F.col(x).alias("x"), F.col(p).alias("p"))
    sides = p.select(*kept, F.explode(F.array(side("long", "upper_level", "p_up"), side("short", "lower_level", "p_dn"))).alias("_s")).select(*kept, "_s.*")
    near = sides.join(by_level.withColumnRenamed("level", "_near"), ["symbol", "dir"], "left")
    best = near.groupBy(*kept, "dir", "x", "p").agg(F.min_by(F.struct("avg_pips", "n"), F.struct(F.abs(F.col("x") - F.col("_near")), "_near")).alias("_b")).join(by_dir, ["symbol", "dir"], "left")
    pips_ = F.when(F.col("x").isNotNull(), F.coalesce(F.when(F.col("_b.n") >= least, F.col("_b.avg_pips")), F.col("dir_pips")) - cost)
    of = lambda d, c: F.max(F.when(F.col("dir") == d, c))
    out = best.withColumn("pips", pips_).groupBy(*kept).agg(of("long", F.col("pips")).alias("pips_up"), of("short", F.col("pips")).alias("pips_dn"), of("long", F.col("p") * F.col("pips")).alias("ev_up"), of("short", F.col("p") * F.col("pips")).alias("ev_dn"))
    buy = F.col("ev_up").isNotNull() & (F.col("ev_dn").isNull() | (F.col("ev_up") >= F.col("ev_dn")))
    return out.withColumn("action", F.when(buy, "BUY").otherwise("SELL")).withColumn("ev", F.when(buy, F.col("ev_up")).otherwise(F.col("ev_dn")))


def rank_levels(levels: DataFrame, pips: DataFrame, cost: float = 0.0) -> DataFrame:
    """Levels by the better expected value of buying an upward and selling a downward break.

    levels: (symbol, level, p_up, p_dn); pips: (symbol, level, dir, exp_pips). BUY wins ties.
    """
    one = lambda d: pips.filter(F.col("dir") == d).select("symbol", "level", F.col("exp_pips").alias(f"pips_{d}"))
    j = levels.join(one("long"), ["symbol", "level"], "left").join(one("short"), ["symbol", "level"], "left")
    up, dn = F.col("p_up") * (F.coalesce("pips_long", F.lit(0.0)) - cost), F.col("p_dn") * (F.coalesce("pips_short", F.lit(0.0)) - cost)
    out = j.withColumns({"ev_buy": up, "ev_sell": dn}).withColumns({"action": F.when(up >= dn, "BUY").otherwise("SELL"), "ev": F.greatest("ev_buy", "ev_sell")})
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(rounded_half(F.col("ev"), 9)), "level")))


#: What nearby news adds to the break buffer, and to the bars that a retest may take (fixed values).
SOFT_BUFFER, SOFT_WAIT = 0.02, 4


def soft_suppressed(bars: DataFrame, buffer: float, wait: int, near_news: str = "near_news") -> DataFrame:
    """bars with the break buffer and the waiting bars that hold for them: both larger near news (B2)."""
    near = F.coalesce(F.col(near_news), F.lit(False))
    return bars.withColumns({"break_buffer": F.lit(buffer) + F.when(near, SOFT_BUFFER).otherwise(0.0), "wait_bars": F.lit(wait) + F.when(near, SOFT_WAIT).otherwise(0)})


def last_bar_alerts(bars: DataFrame, levels: DataFrame, buffer: float = 0.0, lookback: int = 48, k: float = 2.0, touch: float = 0.05, windows: DataFrame | None = None) -> DataFrame:
    """Alerts of each symbol's newest bar at levels, trend line and channel, and retests of levels that the
    bar before broke (B1).

    The bar's own extremes are compared, not the previous bar's; the channel needs none. Near news
    (in one of the windows) the buffer is larger (B2), and alerts are marked `suppressed` (B3).
    """
    newest = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    last = regression_trend(bars, lookback, "low", k).withColumns({"_r": F.row_number().over(newest), **{f"_{c}": F.lag(c).over(by_time()) for c in ("close", "low", "high")}}).filter("_r = 1")
    last = in_any_window(last, windows, ["symbol", "ts"], "near_news") if windows is not None else last.withColumn("near_news", F.lit(False))
    last = soft_suppressed(last, buffer, 0).withColumns({"prev_low": F.col("low"), "prev_high": F.col("high")})
    pick = lambda df, mode: df.select("symbol", "ts", F.lit(mode).alias("mode"), F.col("target").alias("level_or_val"), "dir", "close", F.col("near_news").alias("suppressed"))
    by_level = last.join(levels.select("symbol", F.col("level").alias("target")), "symbol")
    before = by_level.withColumns({"close": F.col("_close"), "prev_low": F.col("_low"), "prev_high": F.col("_high"), "_now": F.col("close")})
    again = crossings(before, F.col("break_buffer")).withColumn("close", F.col("_now")).filter(F.abs(F.col("close") - F.col("target")) <= touch)
    out = pick(crossings(by_level, F.col("break_buffer")), "level").unionByName(pick(again, "retest"))
    return out.unionByName(pick(crossings(last.withColumn("target", F.col("trend_end")), F.col("break_buffer")), "trend")).unionByName(pick(beyond_channel(last, F.col("break_buffer")), "channel"))


def throttled(alerts: DataFrame, window: int = 10, most: int = 4) -> DataFrame:
    """Alerts with `blocked`: at least `most` of the symbol's last `window` events were alerts.

    alerts: (symbol, ts, fired boolean).
    """
    frame = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-window, -1)
    return alerts.withColumn("blocked", F.col("fired") & (F.coalesce(F.sum(F.col("fired").cast("int")).over(frame), F.lit(0)) >= most))
