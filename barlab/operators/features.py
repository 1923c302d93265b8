"""Rolling features of bars. All windows share one partitioning and order: one shuffle, one sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import candle, hour_cycle, safe_div, session_flags

def by_time() -> WindowSpec:
    """The window that all rolling features share."""
    return Window.partitionBy("symbol").orderBy("ts")


def last_n(n: int, shift: int = 0) -> WindowSpec:
    """The n rows that end `shift` rows before this one."""
    return by_time().rowsBetween(-(n - 1) - shift, -shift)


def gated(agg: Callable[[Column], Column], x: Column, n: int, least: int | None = None, shift: int = 0) -> Column:
    """A rolling aggregate, NULL until `least` (default n) values are there."""
    frame = last_n(n, shift)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), agg(x).over(frame))


def with_index(bars: DataFrame) -> DataFrame:
    """bars with bar_idx, the bar's position in its symbol."""
    return bars.withColumn("bar_idx", (F.row_number().over(by_time()) - 1).cast("long"))


def true_range(bars: DataFrame) -> DataFrame:
    """bars with tr; the first bar's is high - low."""
    before = F.lag("close").over(by_time())
    return bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def slope(x: str, n: int) -> Column:
    """Least-squares slope of x over the last n bars."""
    frame = last_n(n)
    return F.when(F.count(x).over(frame) >= n, F.regr_slope(F.col(x), F.col("bar_idx").cast("double")).over(frame))


def base_features(bars: DataFrame) -> DataFrame:
    """Returns, volatility, trend and session columns."""
    c, h, lo = F.col("close"), F.col("high"), F.col("low")
    nz = lambda x: F.when(F.abs(x) >= 1e-9, x)
    df = true_range(with_index(bars)).withColumn("atr14", gated(F.avg, F.col("tr"), 14)).withColumn("atr56", gated(F.avg, F.col("tr"), 56))
    for k in (1, 4, 8, 12):
        df = df.withColumn(f"ret_{k}", c / nz(F.lag("close", k).over(by_time())) - 1)
    atr = F.col("atr14")
    cols = {
        "d_atr14": atr / nz(F.lag("atr14").over(by_time())) - 1,
        "atr_change_10_pct": atr / nz(F.lag("atr14", 10).over(by_time())) - 1,
        "atr_change_10_diff": atr - F.lag("atr14", 10).over(by_time()),
        "atr_ratio": safe_div(atr, F.col("atr56")),
        "atr14_norm": safe_div(atr, c),
        "rv_20": gated(F.stddev_pop, F.col("ret_1"), 20),
        "z_close_20": safe_div(c - gated(F.avg, c, 20), gated(F.stddev_pop, c, 20)),
        "slope_short_6": safe_div(slope("close", 6), c),
        "slope_24": slope("close", 24),
        "swing_high": (h == gated(F.max, h, 48, 10)).cast("int"),
        "swing_low": (lo == gated(F.min, lo, 48, 10)).cast("int"),
        "ma_96": gated(F.avg, c, 96, 30),
        "high_low_ratio_20": safe_div(gated(F.max, h, 20), gated(F.min, lo, 20)),
        "level_up": gated(F.max, h, 48, shift=1),
        "level_dn": gated(F.min, lo, 48, shift=1),
    }
    df = df.withColumns(cols | candle(F.col("open"), h, lo, c) | session_flags(F.col("ts")))
    sin, cos = hour_cycle(F.col("ts"))
    touch = (F.coalesce("swing_high", F.lit(0)) + F.coalesce("swing_low", F.lit(0))).cast("double")
    return df.withColumns({"touch": touch, "hour_sin": sin, "hour_cos": cos, "slope_long": (F.col("ma_96") - F.lag("ma_96", 12).over(by_time())) / 12}).withColumn("touch_density", gated(F.sum, F.col("touch"), 48, 10))


def volatility_features(df: DataFrame) -> DataFrame:
    """Features in units of volatility, their products and squares."""
    v = F.coalesce(F.col("atr14") / F.when(F.abs("close") >= 1e-9, F.col("close")), F.lit(0.0)) + 1e-8
    df = df.withColumns({f"{c}_v": F.col(c) / v for c in ("ret_1", "ret_4", "ret_8", "ret_12", "range_pct", "slope_short_6")}).withColumn("atr_v", v)
    out = {f"{s}_x_range": F.col(s) * F.col("range_pct_v") for s in ("sess_tokyo", "sess_london", "sess_ny")}
    out |= {f"{s}_x_touch": F.col(s) * F.col("touch_density") for s in ("sess_tokyo", "sess_london", "sess_ny")}
    out |= {"touch_x_atr_v": F.col("touch_density") * F.col("atr_v"), "touch_x_slope_v": F.col("touch_density") * F.col("slope_short_6_v"), "z_x_atr_v": F.col("z_close_20") * F.col("atr_v"), "touch_x_atr": F.col("touch_density") * F.col("atr14"), "slope_long_x_ny": F.col("slope_long") * F.col("sess_ny")}
    out |= {f"{c}_sq": F.col(c) * F.col(c) for c in ("z_close_20", "slope_short_6_v", "ret_8_v", "ret_12_v")}
    return df.withColumns(out)


def direction_features(df: DataFrame) -> DataFrame:
    """Features signed by a direction that alternates from bar to bar (P9); without an rsi column its change is 0."""
    sign = F.when(F.col("bar_idx") % 2 == 0, 1).otherwise(-1)
    return df.withColumns({"dir_sign": sign, "mid_dist_dir": (F.col("close") - (F.col("high") + F.col("low")) / 2) * sign, "d_atr_dir": (F.col("atr14") - F.lag("atr14").over(by_time())) * sign, "rsi_div_dir": F.coalesce((F.col("rsi") - F.lag("rsi").over(by_time())) * sign, F.lit(0.0)) if "rsi" in df.columns else F.lit(0.0)})


def regimes(df: DataFrame, x: str = "atr14") -> DataFrame:
    """Terciles (0.33, 0.66) of x within the symbol as reg_atr_low, _mid, _high; NULL counts as the median.

    The quantiles are one row per symbol; percentile keeps distinct values only.
    """
    cuts = df.groupBy("symbol").agg(F.percentile(x, F.array(F.lit(0.33), F.lit(0.66), F.lit(0.5))).alias("_q"))
    v = F.coalesce(F.col(x), F.col("_q")[2])
    out = df.join(cuts, "symbol").withColumn("_v", v)
    return out.withColumns({"reg_atr_low": (F.col("_v") <= F.col("_q")[0]).cast("int"), "reg_atr_mid": ((F.col("_v") > F.col("_q")[0]) & (F.col("_v") <= F.col("_q")[1])).cast("int"), "reg_atr_high": (F.col("_v") > F.col("_q")[1]).cast("int")}).drop("_q", "_v")


def regression_trend(bars: DataFrame, n: int, y: str = "low", k: float = 2.0) -> DataFrame:
    """Slope, intercept, end value and residual sigma of the trailing regression line, with a channel."""
    df = bars if "bar_idx" in bars.columns else with_index(bars)
    frame = last_n(n)
    x, v = F.col("bar_idx").cast("double"), F.col(y)
    two = F.count(v).over(frame) >= 2
    m, b, r2, var = (F.when(two, f) for f in (F.regr_slope(v, x).over(frame), F.regr_intercept(v, x).over(frame), F.regr_r2(v, x).over(frame), F.var_pop(v).over(frame)))
    df = df.withColumns({"trend_slope": m, "trend_intercept": b, "trend_sigma": F.sqrt(F.greatest(F.lit(0.0), var * (1 - r2)))}).withColumn("trend_end", F.col("trend_intercept") + F.col("trend_slope") * F.col("bar_idx"))
    return df.withColumns({"channel_up": F.col("trend_end") + k * F.col("trend_sigma"), "channel_dn": F.col("trend_end") - k * F.col("trend_sigma")})


def feature_table(bars: DataFrame) -> DataFrame:
    """All features of every bar, NULLs as 0."""
    df = regimes(direction_features(volatility_features(base_features(bars))))
    df = df.withColumns({f"reg_{r}_x_z": F.col(f"reg_atr_{r}") * F.col("z_close_20") for r in ("low", "mid", "high")} | {f"reg_{r}_x_slope_v": F.col(f"reg_atr_{r}") * F.col("slope_short_6_v") for r in ("low", "mid", "high")})
    keep = {"symbol", "ts", "level_up", "level_dn", "atr14"}
    return df.na.fill(0.0, [c for c in df.columns if c not in keep]).na.fill(0, [c for c in df.columns if c not in keep])
