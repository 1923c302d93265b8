"""Queries of sources, features and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features as X
from ..operators import labels as L
from ..sources import bars as B
from ..sources import news as N
from .common import BARS_SQL, NEWS_SQL, WIN, div, r, roll, rounded, rslope

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


def bars(spark: SparkSession, d: str) -> DataFrame:
    return B.bars_from_events(spark, d)


@query(f"WITH {BARS_SQL} SELECT symbol, ts, open, high, low, close, volume FROM bars")
def bars_hourly(spark, d):
    """Bars of the events table (IO1 adapter)."""
    return bars(spark, d)


@query("""SELECT event_type AS symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, arg_min(value, ts) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, ts) AS close, count(*)::BIGINT AS volume FROM events GROUP BY 1, 2""")
def bars_quarter_hourly(spark, d):
    return B.bars_from_events(spark, d, 15)


@query("""SELECT l_suppkey::VARCHAR AS symbol, l_shipdate AS ts, round(arg_min(p, k), 8) AS open, round(max(p), 8) AS high,
  round(min(p), 8) AS low, round(arg_max(p, k), 8) AS close, count(*)::BIGINT AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS p, l_orderkey * 100 + l_linenumber AS k FROM lineitem) GROUP BY 1, 2""")
def bars_many_symbols(spark, d):
    """Daily bars of every supplier."""
    return rounded(B.bars_from_ticks(spark, d), 8)


@query(f"WITH {BARS_SQL} SELECT symbol, ts, open, high, low, close, volume FROM bars")
def candle_json_round_trip(spark, d):
    """Bars packed to candle JSON per symbol and day, then parsed again (IO4)."""
    price = lambda c: F.col(c).cast("string").alias(c[0])
    c = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), F.lit(True).alias("complete"), F.struct(*map(price, B.PRICES)).alias("mid"), "volume")
    packed = bars(spark, d).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.to_json(F.struct(F.collect_list(c).alias("candles"))).alias("payload"))
    return B.candles_to_bars(packed)


@query(f"""WITH {BARS_SQL} SELECT symbol, ts, open, high, low, close, volume FROM bars WHERE symbol IN ('click', 'view', 'error', 'purchase', 'signup')""")
def wide_table_to_bars(spark, d):
    """A ticker x field table and back (IO3); column names as vendors have them (IO2)."""
    names = ("click", "view", "error", "purchase", "signup")
    cells = [F.max(F.when(F.col("symbol") == s, F.col(f))).alias(f"{s}|{f.title()}") for s in names for f in (*B.PRICES, "volume")]
    return B.wide_to_bars(bars(spark, d).groupBy("ts").agg(*cells))


@query(f"""WITH {BARS_SQL} SELECT symbol, ts, close FROM (SELECT *, max(ts) OVER (PARTITION BY symbol) AS m FROM bars) WHERE ts >= m - INTERVAL 7 DAY""")
def clamped_history(spark, d):
    """The last seven days of each symbol (IO8)."""
    return B.clamp_history(bars(spark, d), 60, 7).select("symbol", "ts", "close")


@query("""SELECT event_id, ts::TIMESTAMP AS iso, date_trunc('second', ts) AS slash, date_trunc('second', ts) AS epoch, date_trunc('millisecond', ts) AS millis,
  date_trunc('second', ts) + INTERVAL 9 HOUR AS tokyo FROM events""")
def mixed_time_formats(spark, d):
    """Times written in several notations and read back (IO6), and in another zone (IO7)."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    t = F.col("ts").cast("timestamp")
    e = e.select("event_id", B.any_timestamp(F.col("ts").cast("string")).alias("iso"), B.any_timestamp(F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).alias("slash"), B.any_timestamp(F.unix_seconds(t).cast("string")).alias("epoch"), B.any_timestamp(F.unix_millis(t).cast("string")).alias("millis"))
    return e.withColumn("tokyo", B.to_zone(F.col("slash")))


@query(f"WITH {NEWS_SQL} SELECT date_trunc('minute', ts) AS ts, importance, title FROM news")
def news_calendar(spark, d):
    """News written under vendor headers, with date and time apart, and parsed (IO5)."""
    n = N.news_from_events(spark, d)
    raw = n.select(F.date_format("ts", "yyyy/MM/dd").alias("Date"), F.date_format("ts", "HH:mm").alias("Time (UTC)"), F.col("importance").cast("string").alias("Impact"), F.col("title").alias("Event"))
    return N.parse_news(raw.withColumnRenamed("Time (UTC)", "Time"))


_BASE = f"""
f1 AS (SELECT *, {roll('avg', 'tr', 14)} AS atr14, {roll('avg', 'tr', 56)} AS atr56,
  close / CASE WHEN abs(lag(close) OVER w) >= 1e-9 THEN lag(close) OVER w END - 1 AS ret_1,
  close / CASE WHEN abs(lag(close, 4) OVER w) >= 1e-9 THEN lag(close, 4) OVER w END - 1 AS ret_4,
  close / CASE WHEN abs(lag(close, 8) OVER w) >= 1e-9 THEN lag(close, 8) OVER w END - 1 AS ret_8,
  close / CASE WHEN abs(lag(close, 12) OVER w) >= 1e-9 THEN lag(close, 12) OVER w END - 1 AS ret_12,
  hour(ts) AS h FROM b WINDOW w AS ({WIN})),
f2 AS (SELECT *,
  atr14 / CASE WHEN abs(lag(atr14) OVER w) >= 1e-9 THEN lag(atr14) OVER w END - 1 AS d_atr14,
  atr14 / CASE WHEN abs(lag(atr14, 10) OVER w) >= 1e-9 THEN lag(atr14, 10) OVER w END - 1 AS atr_change_10_pct,
  atr14 - lag(atr14, 10) OVER w AS atr_change_10_diff, atr14 - lag(atr14) OVER w AS d_atr,
  CASE WHEN atr14 IS NULL AND abs(atr56) >= 1e-9 THEN NULL WHEN abs(atr56) < 1e-9 THEN 0.0 ELSE atr14 / atr56 END AS atr_ratio, {div('atr14', 'close')} AS atr14_norm,
  {roll('stddev_pop', 'ret_1', 20)} AS rv_20, close - {roll('avg', 'close', 20)} AS dev20, {roll('stddev_pop', 'close', 20)} AS sd20,
  {rslope(6)} AS s6, {rslope(24)} AS slope_24,
  (high = {roll('max', 'high', 48, 10)})::INT AS swing_high, (low = {roll('min', 'low', 48, 10)})::INT AS swing_low,
  {roll('avg', 'close', 96, 30)} AS ma_96, {roll('max', 'high', 20)} AS hi20, {roll('min', 'low', 20)} AS lo20,
  {roll('max', 'high', 48, shift=1)} AS level_up, {roll('min', 'low', 48, shift=1)} AS level_dn,
  {div('high - low', 'close')} AS range_pct, {div('abs(close - open)', 'high - low')} AS body_ratio,
  {div('high - greatest(open, close)', 'high - low')} AS wick_up_ratio, {div('least(open, close) - low', 'high - low')} AS wick_dn_ratio,
  (h >= 9 AND h < 15)::INT AS sess_tokyo, (h >= 16)::INT AS sess_london, (h >= 22 OR h < 5)::INT AS sess_ny
  FROM f1 WINDOW w AS ({WIN})),
f3 AS (SELECT *, {div('dev20', 'sd20')} AS z_close_20, {div('s6', 'close')} AS slope_short_6, {div('hi20', 'lo20')} AS high_low_ratio_20,
  (ma_96 - lag(ma_96, 12) OVER w) / 12 AS slope_long, (coalesce(swing_high, 0) + coalesce(swing_low, 0))::DOUBLE AS touch,
  coalesce(atr14 / CASE WHEN abs(close) >= 1e-9 THEN close END, 0.0) + 1e-8 AS atr_v FROM f2 WINDOW w AS ({WIN})),
f AS (SELECT *, {roll('sum', 'touch', 48, 10)} AS touch_density FROM f3)"""


def _features(spark, d):
    return X.base_features(bars(spark, d))


def _select(names: list[str], more: str = "", digits: int = 6) -> str:
    return f"WITH {BARS_SQL}, {_BASE} SELECT symbol, ts, {', '.join(f'round({n}, {digits}) + 0.0 AS {n}' for n in names)}{more} FROM f"


_VOL = ["atr14", "atr56", "d_atr14", "atr_change_10_pct", "atr_change_10_diff", "atr_ratio", "atr14_norm", "rv_20"]
_RET = ["ret_1", "ret_4", "ret_8", "ret_12", "z_close_20", "high_low_ratio_20"]
_TREND = ["slope_short_6", "slope_24", "slope_long", "touch_density", "level_up", "level_dn"]
_CANDLE = ["range_pct", "body_ratio", "wick_up_ratio", "wick_dn_ratio"]


@query(_select(_VOL))
def volatility(spark, d):
    """True range, ATR and their changes."""
    return rounded(_features(spark, d).select("symbol", "ts", *_VOL))


@query(_select(_RET))
def returns(spark, d):
    """Returns, z-score, range ratio."""
    return rounded(_features(spark, d).select("symbol", "ts", *_RET))


@query(_select(_TREND, ", swing_high, swing_low", 9))
def trend_and_swings(spark, d):
    """Slopes, swings, touches and proxy levels."""
    return rounded(_features(spark, d).select("symbol", "ts", *_TREND, "swing_high", "swing_low"), 9)


@query(_select(_CANDLE, f""", {r('sin(h * 2 * pi() / 24)', 'hour_sin')}, {r('cos(h * 2 * pi() / 24)', 'hour_cos')}, sess_tokyo, sess_london, sess_ny,
  CASE WHEN h >= 9 AND h < 15 THEN 'Tokyo' WHEN h >= 16 THEN 'London' WHEN h < 5 THEN 'NY' ELSE 'Other' END AS session,
  CASE WHEN h >= 22 OR h < 5 THEN 'NY' WHEN h >= 16 THEN 'London' WHEN h >= 9 AND h < 15 THEN 'Tokyo' ELSE '' END AS scoring_session"""))
def candles_and_sessions(spark, d):
    """Candle anatomy, hour cycle and sessions."""
    f = _features(spark, d).withColumns({"session": S.session_name(F.col("ts")), "scoring_session": S.session_for_scoring(F.col("ts"))})
    return rounded(f.select("symbol", "ts", *_CANDLE, "hour_sin", "hour_cos", "sess_tokyo", "sess_london", "sess_ny", "session", "scoring_session"))


_P = {"ret_1_v": "ret_1 / atr_v", "ret_12_v": "ret_12 / atr_v", "range_pct_v": "range_pct / atr_v", "slope_short_6_v": "slope_short_6 / atr_v", "sess_ny_x_range": "sess_ny * range_pct / atr_v", "sess_tokyo_x_touch": "sess_tokyo * touch_density", "touch_x_atr_v": "touch_density * atr_v", "z_x_atr_v": "z_close_20 * atr_v", "touch_x_atr": "touch_density * atr14", "slope_long_x_ny": "slope_long * sess_ny", "z_close_20_sq": "z_close_20 * z_close_20", "mid_dist_dir": "(close - (high + low) / 2) * CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END", "d_atr_dir": "d_atr * CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END"}


@query(f"WITH {BARS_SQL}, {_BASE} SELECT symbol, ts, {', '.join(f'round({v}, 3) + 0.0 AS {k}' for k, v in _P.items())} FROM f")
def interactions(spark, d):
    """Features in units of volatility, products, squares, direction-signed."""
    return rounded(X.direction_features(X.volatility_features(_features(spark, d))).select("symbol", "ts", *_P), 3)


@query(f"""WITH {BARS_SQL}, {_BASE}, q AS (SELECT symbol, quantile_cont(atr14, 0.33) AS a, quantile_cont(atr14, 0.66) AS c, quantile_cont(atr14, 0.5) AS m FROM f GROUP BY 1)
SELECT symbol, ts, (coalesce(atr14, m) <= a)::INT AS reg_atr_low, (coalesce(atr14, m) > a AND coalesce(atr14, m) <= c)::INT AS reg_atr_mid, (coalesce(atr14, m) > c)::INT AS reg_atr_high
FROM f JOIN q USING (symbol)""")
def volatility_regimes(spark, d):
    """ATR terciles."""
    return X.regimes(_features(spark, d)).select("symbol", "ts", "reg_atr_low", "reg_atr_mid", "reg_atr_high")


@query()
def feature_table(spark, d):
    """The whole feature table, NULLs as 0."""
    return rounded(X.feature_table(bars(spark, d)))


_TREND_W = f"({WIN} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)"


@query(f"""WITH {BARS_SQL}, t AS (SELECT symbol, ts, i, count(low) OVER w AS n, regr_slope(low, i::DOUBLE) OVER w AS m, regr_intercept(low, i::DOUBLE) OVER w AS c,
  sqrt(greatest(0.0, (1 - regr_r2(low, i::DOUBLE) OVER w) * var_pop(low) OVER w)) AS s FROM b WINDOW w AS {_TREND_W})
SELECT symbol, ts, round(CASE WHEN n >= 2 THEN m END, 5) + 0.0 AS trend_slope, round(CASE WHEN n >= 2 THEN c + m * i END, 5) + 0.0 AS trend_end, round(CASE WHEN n >= 3 THEN s END, 5) + 0.0 AS trend_sigma,
  round(CASE WHEN n >= 3 THEN c + m * i + 2.0 * s END, 5) + 0.0 AS channel_up, round(CASE WHEN n >= 3 THEN c + m * i - 2.0 * s END, 5) + 0.0 AS channel_dn FROM t""")
def regression_channel(spark, d):
    """Trailing regression line and channel."""
    t = X.regression_trend(bars(spark, d), 48)
    three = F.col("bar_idx") >= 2
    return rounded(t.select("symbol", "ts", "trend_slope", "trend_end", *[F.when(three, F.col(c)).alias(c) for c in ("trend_sigma", "channel_up", "channel_dn")]), 5)


@query(f"""WITH {BARS_SQL} SELECT symbol, ts, {r('fr', 'fwd_ret')}, (fr > 0.05)::INT AS y_up, (fr < -0.05)::INT AS y_down
FROM (SELECT *, lead(close, 12) OVER ({WIN}) / CASE WHEN abs(close) >= 1e-9 THEN close END - 1 AS fr FROM b)""")
def direction_labels(spark, d):
    """Labels of the forward return (L2)."""
    return rounded(L.direction_labels(bars(spark, d), 12, 0.05).select("symbol", "ts", "fwd_ret", "y_up", "y_down"))


def _simple(frame: str, lag: bool) -> str:
    pick = lambda x: f"lag({x}, 12) OVER ({WIN})" if lag else x
    hit = "(h >= close * 1.05 OR l <= close * 0.95)::INT"
    return f"""WITH {BARS_SQL}, x AS (SELECT *, CASE WHEN count(*) OVER w >= 12 THEN max(high) OVER w END AS h0, CASE WHEN count(*) OVER w >= 12 THEN min(low) OVER w END AS l0
  FROM b WINDOW w AS ({WIN} ROWS BETWEEN {frame})), z AS (SELECT *, {pick('h0')} AS h, {pick('l0')} AS l FROM x)
  SELECT symbol, ts, {f'coalesce({hit}, 0)' if lag else f'CASE WHEN h IS NOT NULL THEN {hit} END'} AS y FROM z"""


@query(_simple("1 FOLLOWING AND 12 FOLLOWING", False))
def forward_break_label(spark, d):
    """Breaks of a band around the close in the next bars (L3)."""
    return L.simple_break_label(bars(spark, d), 12, 0.05).select("symbol", "ts", "y")


@query(_simple("10 PRECEDING AND 1 FOLLOWING", True))
def legacy_break_label(spark, d):
    """The legacy frame of the same label (L3)."""
    return L.simple_break_label(bars(spark, d), 12, 0.05, forward=False).select("symbol", "ts", "y")


#: Levels of few bars: the test series is noise, which seldom settles beyond older extremes.
CONFIG = L.BreakConfig(lookback=8)

#: Break labels by joins of bars with themselves.
LABEL_SQL = f"""WITH {BARS_SQL}, a AS (
  SELECT *, last_value(atr0 IGNORE NULLS) OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS atr, count(*) OVER (PARTITION BY symbol) AS n
  FROM (SELECT *, {roll('avg', 'tr', 14)} AS atr0, {roll('max', 'high', 8, shift=1)} AS up, {roll('min', 'low', 8, shift=1)} AS dn FROM b)),
h AS (SELECT a.symbol, a.i, min(CASE WHEN c.high >= a.up + 0.15 * a.atr THEN c.i END) AS tu, min(CASE WHEN c.low <= a.dn - 0.15 * a.atr THEN c.i END) AS td
  FROM a JOIN b c ON a.symbol = c.symbol AND c.i BETWEEN a.i + 1 AND a.i + 12 GROUP BY 1, 2),
s AS (SELECT a.*, h.tu, h.td, CASE WHEN tu IS NOT NULL AND (td IS NULL OR tu <= td) THEN 'up' WHEN td IS NOT NULL THEN 'dn' ELSE '' END AS sd FROM a LEFT JOIN h USING (symbol, i)),
t AS (SELECT *, CASE WHEN sd = 'up' THEN tu WHEN sd = 'dn' THEN td END AS tb FROM s),
p AS (SELECT t.symbol, t.i, c.i AS j, CASE WHEN sd = 'up' THEN c.close >= t.up + 0.15 * t.atr ELSE c.close <= t.dn - 0.15 * t.atr END AS ok
  FROM t JOIN b c ON t.symbol = c.symbol AND c.i BETWEEN t.tb AND t.tb + 11),
g AS (SELECT symbol, i, min(j) AS tset FROM (SELECT *, ok AND lag(ok) OVER (PARTITION BY symbol, i ORDER BY j) AS two FROM p) WHERE two GROUP BY 1, 2),
e AS (SELECT t.*, g.tset, c.close AS px, c.atr AS atre FROM t LEFT JOIN g USING (symbol, i) LEFT JOIN a c ON c.symbol = t.symbol AND c.i = g.tset),
x AS (SELECT e.symbol, e.i, min(CASE WHEN c.high >= px + atre THEN c.i END) AS tp, min(CASE WHEN c.low <= px - atre THEN c.i END) AS sl
  FROM e JOIN b c ON e.symbol = c.symbol AND c.i BETWEEN e.tset + 1 AND e.tset + 48 GROUP BY 1, 2),
z AS (SELECT e.*, x.tp, x.sl, CASE WHEN e.i + 13 >= n THEN 'tail' WHEN up IS NULL OR dn IS NULL OR atr <= 0 THEN 'insufficient' WHEN tb IS NULL THEN 'no_break' WHEN tset IS NULL THEN 'no_settle' ELSE 'ok' END AS reason,
  CASE WHEN tp IS NULL AND sl IS NULL THEN 'to' WHEN sl IS NULL OR tp <= sl THEN 'tp' ELSE 'sl' END AS oc FROM e LEFT JOIN x USING (symbol, i))
SELECT symbol, ts, i AS bar_idx, CASE WHEN reason IN ('no_break', 'no_settle') THEN 0 WHEN reason = 'ok' THEN (oc = 'tp')::INT END AS y,
  CASE WHEN reason IN ('no_settle', 'ok') THEN sd ELSE '' END AS side, CASE WHEN reason IN ('no_settle', 'ok') THEN tb END AS t_break,
  CASE WHEN reason = 'ok' THEN tset END AS t_settle, CASE WHEN reason = 'ok' THEN oc ELSE '' END AS outcome,
  CASE WHEN reason = 'ok' THEN coalesce(least(tp, sl), least(n, tset + 49) - 1) END AS t_exit, reason FROM z"""


@query(LABEL_SQL)
def break_labels(spark, d):
    """Break, settle and triple-barrier labels."""
    return L.break_labels(bars(spark, d), CONFIG)


@query(f"SELECT symbol, reason, y, count(*)::BIGINT AS n FROM ({LABEL_SQL}) GROUP BY ALL")
def label_distribution(spark, d):
    """Class balance and reasons."""
    return L.break_labels(bars(spark, d), CONFIG).groupBy("symbol", "reason", "y").agg(F.count("*").alias("n"))


@query(f"""WITH {BARS_SQL}, {_BASE}, m AS (SELECT *, lead(close, 12) OVER ({WIN}) AS ex FROM f),
g AS (SELECT *, CASE WHEN h >= 9 AND h < 15 THEN 'Tokyo' WHEN h >= 16 THEN 'London' WHEN h < 5 THEN 'NY' ELSE 'Other' END AS session,
  CASE WHEN close > level_up + 0.15 * atr14 THEN 'up' WHEN close < level_dn - 0.15 * atr14 THEN 'dn' END AS side FROM m)
SELECT symbol, session, side, count(*)::BIGINT AS signals, round(avg((CASE WHEN side = 'up' THEN ex - close ELSE close - ex END > 0)::INT), 6) AS win_rate
FROM g WHERE side IS NOT NULL AND ex IS NOT NULL GROUP BY 1, 2, 3""")
def break_signal_summary(spark, d):
    """Closes beyond the previous extremes: how often, and how often they pay."""
    f = _features(spark, d).withColumns({"exit": F.lead("close", 12).over(X.by_time()), "session": S.session_name(F.col("ts"))})
    f = f.withColumn("side", F.when(F.col("close") > F.col("level_up") + 0.15 * F.col("atr14"), "up").when(F.col("close") < F.col("level_dn") - 0.15 * F.col("atr14"), "dn")).filter("side IS NOT NULL AND exit IS NOT NULL")
    gain = (F.col("exit") - F.col("close")) * F.when(F.col("side") == "up", 1).otherwise(-1)
    return f.groupBy("symbol", "session", "side").agg(F.count("*").alias("signals"), F.round(F.avg((gain > 0).cast("int")), 6).alias("win_rate"))
