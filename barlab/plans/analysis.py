"""Queries of levels, news, evaluation, splits, backtests and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import backtest as T
from ..operators import evaluate as E
from ..operators import levels as V
from ..operators import news as J
from ..operators import patterns as D
from ..operators import splits as C
from ..sources import news as N
from .common import BARS_SQL, NEWS_SQL, SCORED_SQL, WIN, roll, rounded
from .features import _features, bars

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


def _pivots(frame: str, full: str, high: str, low: str) -> str:
    return f"""SELECT symbol, ts, i, 'high' AS kind, high AS price FROM b WINDOW {frame} QUALIFY {full} AND {high}
  UNION ALL SELECT symbol, ts, i, 'low', low FROM b WINDOW {frame} QUALIFY {full} AND {low}"""


_CENTRED = _pivots(f"w AS ({WIN} ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)", "count(*) OVER w >= 10", "high = max(high) OVER w", "low = min(low) OVER w")
_STRICT = _pivots(f"p AS ({WIN} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), n AS ({WIN} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)", "count(*) OVER p = 3 AND count(*) OVER n = 3", "high > max(high) OVER p AND high > max(high) OVER n", "low < min(low) OVER p AND low < min(low) OVER n")


@query(f"WITH {BARS_SQL}, piv AS ({_CENTRED}) SELECT symbol, ts, i AS bar_idx, kind, price FROM piv")
def centred_pivots(spark, d):
    """Pivots of centred windows."""
    return V.centred_pivots(bars(spark, d))


@query(f"WITH {BARS_SQL}, piv AS ({_STRICT}) SELECT symbol, ts, i AS bar_idx, kind, price FROM piv")
def strict_pivots(spark, d):
    """Fractal pivots."""
    return V.strict_pivots(bars(spark, d))


@query(f"""WITH RECURSIVE {BARS_SQL}, piv AS ({_CENTRED}), o AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY i) AS k FROM piv),
  keep AS (SELECT symbol, kind, k, i, i AS last FROM o WHERE k = 1
    UNION ALL SELECT o.symbol, o.kind, o.k, o.i, CASE WHEN o.i - g.last >= 5 THEN o.i ELSE g.last END FROM keep g JOIN o ON o.symbol = g.symbol AND o.kind = g.kind AND o.k = g.k + 1)
  SELECT symbol, kind, i AS bar_idx FROM keep WHERE i = last""")
def thinned_pivots(spark, d):
    """Pivots at least five bars apart."""
    return V.thinned(V.centred_pivots(bars(spark, d))).select("symbol", "kind", "bar_idx")


#: Density clusters of pivot prices by comparing all pairs.
_LEVELS = f"""piv AS ({_CENTRED}), e AS (SELECT symbol, stddev_pop(price) * 0.02 AS eps FROM piv GROUP BY 1),
pts AS (SELECT symbol, kind, ts, price / eps AS x, price FROM piv JOIN e USING (symbol) WHERE eps > 0),
cnt AS (SELECT *, count(*) OVER (PARTITION BY symbol ORDER BY x RANGE BETWEEN 1.0 PRECEDING AND 1.0 FOLLOWING) >= 3 AS core FROM pts),
cor AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY x, kind, ts ROWS UNBOUNDED PRECEDING) AS cl FROM (
  SELECT *, coalesce((x - lag(x) OVER (PARTITION BY symbol ORDER BY x) > 1.0)::INT, 1) AS fresh FROM cnt WHERE core)),
sn AS (SELECT symbol, cl, min(CASE kind WHEN 'high' THEN '0' ELSE '1' END || ts::VARCHAR) AS seen FROM cor GROUP BY 1, 2),
bor AS (SELECT p.symbol, p.price, p.kind, p.ts, arg_min(c.cl, s.seen) AS cl FROM cnt p JOIN cor c ON p.symbol = c.symbol AND abs(p.x - c.x) <= 1.0 JOIN sn s ON s.symbol = c.symbol AND s.cl = c.cl
  WHERE NOT p.core GROUP BY 1, 2, 3, 4),
mem AS (SELECT symbol, price, cl FROM cor UNION ALL SELECT symbol, price, cl FROM bor),
levels AS (SELECT symbol, level, sum(n)::BIGINT AS members FROM (SELECT symbol, cl, round(avg(price), 3) + 0.0 AS level, count(*) AS n FROM mem GROUP BY 1, 2) GROUP BY 1, 2)"""


def _lv(spark, d):
    return V.horizontal_levels(V.centred_pivots(bars(spark, d)), 0.02)


@query(f"WITH {BARS_SQL}, {_LEVELS} SELECT * FROM levels")
def horizontal_levels(spark, d):
    """Support and resistance levels (V1, O2)."""
    return _lv(spark, d)


_TOUCH = "((low <= level AND high >= level) OR abs(close - level) <= 0.5)"


@query(f"""WITH {BARS_SQL}, {_LEVELS}, h AS (SELECT symbol, level, count(*) AS touches, avg((hour(ts) >= 9 AND hour(ts) < 15 OR hour(ts) >= 16 OR hour(ts) < 5)::INT) AS sr FROM b JOIN levels USING (symbol) WHERE {_TOUCH} GROUP BY 1, 2),
a AS (SELECT symbol, arg_max(close, ts) AS c, arg_max(coalesce(atr, 0), ts) AS atr FROM (SELECT *, {roll('avg', 'tr', 14)} AS atr FROM b) GROUP BY 1),
m AS (SELECT l.symbol, l.level, coalesce(touches, 0) AS touches, 1 / (abs(c - level) + 1e-6) AS near, coalesce(sr, 0.0) AS session_ratio, atr / greatest(1e-6, c) AS atr_norm FROM levels l LEFT JOIN h USING (symbol, level) JOIN a USING (symbol)),
n AS (SELECT *, {', '.join(f"CASE WHEN abs(max({c}) OVER s - min({c}) OVER s) <= 1e-9 * greatest(abs(min({c}) OVER s), abs(max({c}) OVER s)) THEN (rank() OVER (PARTITION BY symbol ORDER BY {c}) + (count(*) OVER (PARTITION BY symbol, {c}) - 1) / 2.0) / count(*) OVER s ELSE ({c} - min({c}) OVER s) / nullif((max({c}) OVER s - min({c}) OVER s)::DOUBLE, 0) END AS {c}_n" for c in ("touches", "near", "session_ratio", "atr_norm"))} FROM m WINDOW s AS (PARTITION BY symbol))
SELECT symbol, level, touches::BIGINT AS touches, round(session_ratio, 6) AS session_ratio, round(atr_norm, 6) AS atr_norm, round((0.3 * touches_n + 0.3 * near_n + 0.2 * session_ratio_n + 0.2 * atr_norm_n) * 100, 5) AS score FROM n""")
def level_scores(spark, d):
    """Scored levels (V2)."""
    s = V.level_scores(bars(spark, d), _lv(spark, d), 0.5)
    return s.select("symbol", "level", F.col("touches").cast("long").alias("touches"), S.rounded_half(F.col("session_ratio"), 6).alias("session_ratio"), S.rounded_half(F.col("atr_norm"), 6).alias("atr_norm"), S.rounded_half(F.col("score"), 5).alias("score"))


@query(f"""WITH {BARS_SQL}, {_LEVELS} SELECT symbol, level, sum(t)::BIGINT AS total, max(t)::BIGINT AS most FROM (
  SELECT symbol, level, sum({_TOUCH}::INT) OVER (PARTITION BY symbol, level ORDER BY ts ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS t FROM b JOIN levels USING (symbol)) GROUP BY 1, 2""")
def touch_counts(spark, d):
    """Touches of levels in the last 200 bars."""
    return V.touch_counts(bars(spark, d), _lv(spark, d), 200, 0.5).groupBy("symbol", "level").agg(F.sum("touches").alias("total"), F.max("touches").alias("most"))


_CROSS = f"""x AS (SELECT *, lag(low) OVER w AS pl, lag(high) OVER w AS ph, lead(close, 12) OVER w AS ex FROM b WINDOW w AS ({WIN})),
c AS (SELECT x.*, level, CASE WHEN close > level + 1.0 AND pl <= level THEN 'long' WHEN close < level - 1.0 AND ph >= level THEN 'short' END AS dir FROM x JOIN levels USING (symbol) WHERE ex IS NOT NULL AND i >= 1),
trades AS (SELECT symbol, ts, i, level, dir, close AS entry, ex, (ex - close) * CASE dir WHEN 'long' THEN 1 ELSE -1 END / 0.01 - 2.0 AS pips FROM c WHERE dir IS NOT NULL)"""


@query(f"WITH {BARS_SQL}, {_LEVELS}, {_CROSS} SELECT symbol, ts, level, CASE dir WHEN 'long' THEN 1 ELSE -1 END AS dir, round((ex - entry) * CASE dir WHEN 'long' THEN 1 ELSE -1 END, 6) + 0.0 AS move FROM trades")
def level_cross_dataset(spark, d):
    """Bars that cross levels, with their forward move (L4)."""
    from ..operators.labels import level_crosses

    return rounded(level_crosses(bars(spark, d), _lv(spark, d), 12, 1.0).select("symbol", "ts", "level", "dir", "move"))


def _trades(spark, d):
    return T.backtest_levels(bars(spark, d), _lv(spark, d), 12, 1.0, 10, 0.5, 0.01, 2.0)


@query(f"""WITH {BARS_SQL}, {_LEVELS}, {_CROSS}, k AS (SELECT t.symbol, t.i, t.level, t.dir, count(*) AS n, sum((abs(c.close - t.level) <= 0.5)::INT) AS hit FROM trades t JOIN b c ON c.symbol = t.symbol AND c.i BETWEEN t.i + 1 AND t.i + 10 GROUP BY ALL)
SELECT symbol, ts, i AS bar_idx, 'level' AS mode, level AS level_or_val, dir, entry, ex AS exit, round(pips, 6) + 0.0 AS ret_pips, round(hit / n, 6) AS retest_index, hit > 0 AS retest_hit FROM trades JOIN k USING (symbol, i, level, dir)""")
def static_backtest(spark, d):
    """Level breaks with look-ahead levels."""
    return rounded(_trades(spark, d))


@query(f"""WITH {BARS_SQL}, {_LEVELS}, {_CROSS} SELECT symbol, dir, count(*)::BIGINT AS trades, round(avg((pips > 0)::INT), 6) AS win_rate, round(avg(pips), 5) AS avg_pips, round(stddev_samp(pips), 5) AS std_pips,
  round(CASE WHEN stddev_samp(pips) > 0 THEN avg(pips) / stddev_samp(pips) END, 5) AS ratio FROM trades GROUP BY 1, 2""")
def backtest_summary(spark, d):
    """Trades by direction."""
    s = T.summary(_trades(spark, d), "symbol", "dir")
    return s.select("symbol", "dir", "trades", S.rounded_half(F.col("win_rate"), 6).alias("win_rate"), *[S.rounded_half(F.col(c), 5).alias(c) for c in ("avg_pips", "std_pips", "ratio")])


@query(f"""WITH {BARS_SQL}, {_LEVELS}, {_CROSS}, bl AS (SELECT symbol, level, dir, avg(pips) AS a, count(*) AS n FROM trades GROUP BY 1, 2, 3), bd AS (SELECT symbol, dir, avg(pips) AS a FROM trades GROUP BY 1, 2),
w AS (SELECT symbol, level, unnest(['long', 'short']) AS dir FROM levels)
SELECT w.symbol, w.level, w.dir, round(coalesce(CASE WHEN bl.n >= 5 THEN bl.a END, bd.a, 0.0), 5) + 0.0 AS exp_pips FROM w LEFT JOIN bl USING (symbol, level, dir) LEFT JOIN bd USING (symbol, dir)""")
def expected_pips(spark, d):
    """Expected pips of levels with fallbacks."""
    wanted = _lv(spark, d).select("symbol", "level", F.explode(F.array(F.lit("long"), F.lit("short"))).alias("dir"))
    return rounded(T.lookup_pips(wanted, *T.expected_pips(_trades(spark, d))), 5)


@query(f"""WITH {BARS_SQL}, {_LEVELS}, {_CROSS}, bl AS (SELECT symbol, level, dir, avg(pips) AS a, count(*) AS n FROM trades GROUP BY 1, 2, 3), bd AS (SELECT symbol, dir, avg(pips) AS a FROM trades GROUP BY 1, 2),
w AS (SELECT symbol, arg_max(close, ts) AS x, unnest(['long', 'short']) AS dir FROM b GROUP BY 1),
nb AS (SELECT w.symbol, w.dir, w.x, bl.a, bl.n, row_number() OVER (PARTITION BY w.symbol, w.dir ORDER BY abs(w.x - bl.level), bl.level) AS k FROM w LEFT JOIN bl USING (symbol, dir))
SELECT nb.symbol, nb.dir, nb.x, round(coalesce(CASE WHEN nb.n >= 5 THEN nb.a END, bd.a, 0.0), 5) + 0.0 AS exp_pips FROM nb LEFT JOIN bd USING (symbol, dir) WHERE k = 1""")
def nearest_level_pips(spark, d):
    """Expected pips of the newest price by its nearest level."""
    last = bars(spark, d).groupBy("symbol").agg(F.max_by("close", "ts").alias("x"))
    wanted = last.select("symbol", "x", F.explode(F.array(F.lit("long"), F.lit("short"))).alias("dir"))
    return rounded(T.nearest_pips(wanted, *T.expected_pips(_trades(spark, d)), ["symbol", "x"]).select("symbol", "dir", "x", "exp_pips"), 5)


@query(f"""WITH {BARS_SQL}, {_LEVELS}, {_CROSS}, s AS (SELECT *, i AS si FROM trades),
  en AS (SELECT s.symbol, s.si, s.level, s.dir, min(c.i) AS ei FROM s JOIN x c ON c.symbol = s.symbol AND c.i BETWEEN s.si + 1 AND s.si + 9 AND c.ex IS NOT NULL AND abs(c.close - s.level) <= 2.0 GROUP BY ALL)
SELECT e.symbol, si AS signal_idx, level AS level_or_val, dir, ei AS entry_idx, c.close AS entry, c.ex AS exit, round((c.ex - c.close) * CASE dir WHEN 'long' THEN 1 ELSE -1 END / 0.01 - 2.0, 6) + 0.0 AS ret_pips
FROM en AS e JOIN x c ON c.symbol = e.symbol AND c.i = e.ei""")
def retest_entries(spark, d):
    """Entries at the first close back at the level."""
    e = T.retest_entries(_trades(spark, d), bars(spark, d), 12, 10, 2.0, 0.01, 2.0)
    return rounded(e.select("symbol", "signal_idx", "level_or_val", "dir", "entry_idx", "entry", "exit", "ret_pips"))


@query()
def rolling_levels(spark, d):
    """Levels as they were known at each time (V3)."""
    return V.rolling_levels(V.centred_pivots(bars(spark, d)), 10, 0.02)


@query()
def rolling_backtest(spark, d):
    """Point-in-time backtest of level breaks."""
    return rounded(T.backtest_rolling(bars(spark, d), 10, 12, 1.0, 10, 0.5, 0.01, 2.0, 48, 0.02))


_TL = f"""tl AS (SELECT *, regr_intercept(low, i::DOUBLE) OVER w + i * regr_slope(low, i::DOUBLE) OVER w AS y1 FROM b WINDOW w AS ({WIN} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)),
tx AS (SELECT *, lag(low) OVER w AS pl, lag(high) OVER w AS ph, lead(close, 12) OVER w AS ex FROM tl WINDOW w AS ({WIN}))"""


@query(f"""WITH {BARS_SQL}, {_TL}, t AS (SELECT *, CASE WHEN close > y1 + 1.0 AND pl <= y1 THEN 'long' WHEN close < y1 - 1.0 AND ph >= y1 THEN 'short' END AS dir FROM tx WHERE ex IS NOT NULL AND i >= 48)
SELECT symbol, ts, i AS bar_idx, dir, round(y1, 5) AS level_or_val, close AS entry, ex AS exit, round((ex - close) * CASE dir WHEN 'long' THEN 1 ELSE -1 END / 0.01, 6) + 0.0 AS ret_pips FROM t WHERE dir IS NOT NULL""")
def trend_backtest(spark, d):
    """Point-in-time breaks of the trend line."""
    t = T.backtest_trend(bars(spark, d), 48, 12, 1.0)
    return rounded(t.select("symbol", "ts", "bar_idx", "dir", F.round("level_or_val", 5).alias("level_or_val"), "entry", "exit", "ret_pips"))


@query(f"""WITH {BARS_SQL}, x AS (SELECT symbol, ts, coalesce(abs(close - lag(close) OVER ({WIN})) > 80, false) AS fired FROM b)
SELECT symbol, ts, fired, fired AND coalesce(sum(fired::INT) OVER ({WIN} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) >= 4 AS blocked FROM x""")
def throttled_alerts(spark, d):
    """Alerts held back after many recent ones."""
    from ..operators.features import by_time

    fired = F.coalesce(F.abs(F.col("close") - F.lag("close").over(by_time())) > 80, F.lit(False))
    return T.throttled(bars(spark, d).select("symbol", "ts", fired.alias("fired")))


_MIN = "CASE importance WHEN 5 THEN 60 WHEN 4 THEN 45 WHEN 3 THEN 30 ELSE 0 END"
_WINS = f"wins AS (SELECT ts - to_minutes({_MIN}) AS s, ts + to_minutes({_MIN}) AS e, ts AS et, importance, title FROM news WHERE importance >= 4)"


@query(f'WITH {NEWS_SQL}, {_WINS} SELECT s AS start, e AS "end", importance, title, et AS event_ts FROM wins')
def event_windows(spark, d):
    """Windows around important events."""
    return J.event_windows(N.news_from_events(spark, d), 4)


@query(f"""WITH {BARS_SQL}, {NEWS_SQL}, {_WINS} SELECT symbol, ts, EXISTS (SELECT 1 FROM wins WHERE ts BETWEEN s AND e) AS in_window,
  EXISTS (SELECT 1 FROM wins WHERE ts BETWEEN s AND e AND et <= ts) AS after_event, EXISTS (SELECT 1 FROM news n WHERE n.importance >= 5 AND b.ts BETWEEN n.ts - INTERVAL 20 MINUTE AND n.ts + INTERVAL 20 MINUTE) AS near_news FROM b""")
def bars_in_windows(spark, d):
    """Bars inside event windows, on both sides, after the event, and by one margin."""
    n = N.news_from_events(spark, d)
    w, key = J.event_windows(n, 4), ["symbol", "ts"]
    out = J.in_any_window(bars(spark, d).select("symbol", "ts"), w, key)
    out = J.in_any_window(out, w, key, "after_event", past_only=True)
    return J.in_any_window(out, J.uniform_windows(n, 5, 20), key, "near_news")


@query(f"""WITH {NEWS_SQL}, {_WINS}, o AS (SELECT s, e, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM wins),
g AS (SELECT *, sum(CASE WHEN s <= r THEN 0 ELSE 1 END) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT min(s) AS start, max(e) AS "end" FROM g GROUP BY k""")
def merged_event_windows(spark, d):
    """Overlapping windows merged."""
    return J.merged_windows(J.event_windows(N.news_from_events(spark, d), 4))


def _suppressed(spark, d):
    return J.in_any_window(bars(spark, d).select("symbol", "ts"), J.event_windows(N.news_from_events(spark, d), 5), ["symbol", "ts"]).filter("in_window")


@query(f"""WITH {BARS_SQL}, {NEWS_SQL}, {_LEVELS}, {_CROSS} SELECT symbol, dir, count(*)::BIGINT AS trades, round(avg(pips), 5) + 0.0 AS avg_pips FROM trades t
WHERE NOT EXISTS (SELECT 1 FROM news n WHERE importance >= 5 AND t.ts BETWEEN n.ts - INTERVAL 60 MINUTE AND n.ts + INTERVAL 60 MINUTE) GROUP BY 1, 2""")
def suppressed_backtest(spark, d):
    """Level breaks outside the windows of the most important events."""
    t = T.backtest_levels(bars(spark, d), _lv(spark, d), 12, 1.0, 10, 0.5, 0.01, 2.0, _suppressed(spark, d))
    return rounded(T.summary(t, "symbol", "dir").select("symbol", "dir", "trades", "avg_pips"), 5)


def _scored(spark, d):
    return N.scored_from_events(spark, d)


@query(f"""WITH {SCORED_SQL}, c AS (SELECT *, hour(ts) AS h FROM scored), t AS (SELECT *, CASE WHEN h >= 22 OR h < 5 THEN 'NY' WHEN h >= 16 THEN 'London' WHEN h >= 9 AND h < 15 THEN 'Tokyo' ELSE '' END AS session FROM c),
u AS (SELECT *, CASE session WHEN 'NY' THEN 0.755 WHEN 'London' THEN 0.665 WHEN 'Tokyo' THEN 0.74 ELSE 0.585 END AS theta FROM t) SELECT id, ts, round(p, 6) AS proba, theta::DOUBLE AS theta, (p >= theta)::INT AS signal, session FROM u""")
def session_scoring(spark, d):
    """Signals by session thresholds (M5)."""
    session = S.session_for_scoring(F.col("ts"))
    theta = F.when(session == "NY", 0.755).when(session == "London", 0.665).when(session == "Tokyo", 0.74).otherwise(0.585)
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "p"))
    return _scored(spark, d).select("id", "ts", F.round(p, 6).alias("proba"), theta.alias("theta"), (p >= theta).cast("int").alias("signal"), session.alias("session"))


GRID = E.theta_grid()
_GRID_SQL = "grid AS (SELECT unnest([" + ", ".join(f"{x!r}::DOUBLE" for x in GRID) + f"]) AS theta, unnest(range(1, {len(GRID) + 1})) AS i)"


@query(f"""WITH {SCORED_SQL}, {_GRID_SQL}, n AS (SELECT count(*) AS n FROM scored) SELECT i::INT AS i, theta, n.n::BIGINT AS n, count(p)::BIGINT AS trades, round(count(p) / n.n, 6) AS coverage, round(CASE WHEN count(p) > 0 THEN avg(p) - (1 - avg(p)) - 0.15 END, 6) AS ev
FROM grid CROSS JOIN n LEFT JOIN scored ON p >= theta GROUP BY i, theta, n.n""")
def theta_sweep(spark, d):
    """Expected value at all thresholds in one pass (A1, A2)."""
    return E.sweep(_scored(spark, d), GRID).select("i", "theta", "n", "trades", F.round("coverage", 6).alias("coverage"), F.round("ev", 6).alias("ev"))


@query(f"""WITH {SCORED_SQL}, {_GRID_SQL}, m AS (SELECT *, unnest(list_filter([CASE WHEN hour(ts) >= 9 AND hour(ts) < 15 THEN 'Tokyo' END, CASE WHEN hour(ts) >= 16 THEN 'London' END, CASE WHEN hour(ts) >= 22 OR hour(ts) < 5 THEN 'NY' END], lambda z: z IS NOT NULL)) AS session FROM scored),
n AS (SELECT session, count(*) AS n FROM m GROUP BY 1), s AS (SELECT n.session, i, theta, count(p) AS trades, count(p) / n.n AS coverage, avg(p) - (1 - avg(p)) - 0.15 AS ev FROM n CROSS JOIN grid LEFT JOIN m ON m.session = n.session AND p >= theta GROUP BY n.session, i, theta, n.n),
k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY CASE WHEN coverage >= 0.12 THEN 1 WHEN coverage >= 0.05 THEN 2 WHEN trades > 0 THEN 3 ELSE 4 END,
  round(CASE WHEN coverage >= 0.12 THEN ev - 0.05 * abs(coverage - 0.12) WHEN trades > 0 THEN ev ELSE coverage END, 9) DESC, i) AS r FROM s)
SELECT session, theta, trades::BIGINT AS trades, round(coverage, 6) AS coverage, round(ev, 6) AS ev FROM k WHERE r = 1""")
def best_theta_by_session(spark, d):
    """Thresholds per session."""
    b = E.best_theta(E.sweep(E.by_session(_scored(spark, d)), GRID, ("session",)), ("session",), 0.12, 0.05)
    return b.select("session", "theta", "trades", F.round("coverage", 6).alias("coverage"), F.round("ev", 6).alias("ev"))


@query(f"WITH {SCORED_SQL}, a AS (SELECT count(*) AS n, count(*) FILTER (p >= 0.7) AS k, avg(p) FILTER (p >= 0.7) AS m FROM scored) SELECT k::BIGINT AS trades, round(k / n, 6) AS coverage, round(m, 6) AS p_mean, round(m * 1.5 - (1 - m) - 0.15, 6) + 0.0 AS ev FROM a")
def value_at_threshold(spark, d):
    """Trades, coverage and expected value at one threshold (A1)."""
    return rounded(E.ev_at(_scored(spark, d), 0.7, 1.5))


@query(f"""WITH {SCORED_SQL}, c AS (SELECT sum((p >= 0.6 AND y = 1)::INT) AS tp, sum((p >= 0.6 AND y = 0)::INT) AS fp, sum((p < 0.6 AND y = 1)::INT) AS fn, sum((p < 0.6 AND y = 0)::INT) AS tn, avg((p - y) ** 2) AS brier, avg(p) FILTER (p >= 0.6) AS ph FROM scored)
SELECT round(ph - (1 - ph) - 0.15, 6) + 0.0 AS ev, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(brier, 6) AS brier, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1_pos, round(2 * tn / (2 * tn + fp + fn), 6) AS f1_neg,
round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, CASE WHEN tp + fn <= fp + tn THEN 1 ELSE 0 END AS minority_class FROM c""")
def confusion_metrics(spark, d):
    """Metrics at a threshold."""
    return rounded(E.confusion(_scored(spark, d), 0.6))


@query(f"""WITH {SCORED_SQL}, g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM scored GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS k, sum(pos) OVER () AS t FROM g)
SELECT round(sum(pos * tp / k) / max(t), 6) AS average_precision, max(t)::BIGINT AS positives FROM c""")
def average_precision(spark, d):
    """Average precision from distinct probabilities."""
    return rounded(E.average_precision(_scored(spark, d)))


@query(f"""WITH {SCORED_SQL}, q AS (SELECT unnest(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e, unnest(range(11)) AS k FROM scored),
bins AS (SELECT k, e AS lo, lead(e) OVER (ORDER BY k) AS hi FROM q QUALIFY hi IS NOT NULL), t AS (SELECT bins.*, p, y FROM bins JOIN scored ON p >= lo AND (p < hi OR k = 9 AND p <= hi)),
a AS (SELECT k, lo, hi, avg(p) AS pm, avg(y) AS f, count(*) AS n FROM t GROUP BY 1, 2, 3), w AS (SELECT *, 1.959963984540054 AS z FROM a)
SELECT k::INT AS bin, round(lo, 6) AS "left", round(hi, 6) AS "right", round(pm, 6) AS prob_mean, round(f, 6) AS frac_pos, n::BIGINT AS "count",
round(greatest(0.0, (f + z * z / (2 * n) - z * sqrt(f * (1 - f) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS ci_low, round(least(1.0, (f + z * z / (2 * n) + z * sqrt(f * (1 - f) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS ci_high FROM w""")
def reliability_table(spark, d):
    """Calibration by quantile bins with Wilson intervals."""
    s = _scored(spark, d)
    return rounded(E.reliability(s, E.quantile_edges(s)))


@query(f"""WITH {SCORED_SQL}, m AS (SELECT median(ts::TIMESTAMP) AS m FROM scored), base AS (SELECT p FROM scored, m WHERE ts < m), cur AS (SELECT p FROM scored, m WHERE ts >= m),
q AS (SELECT unnest(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e, unnest(range(11)) AS k FROM base), bins AS (SELECT k, e AS lo, lead(e) OVER (ORDER BY k) AS hi FROM q QUALIFY hi IS NOT NULL),
x AS (SELECT k, (SELECT count(*) FROM base WHERE p >= lo AND (p < hi OR k = 9 AND p <= hi)) AS a, (SELECT count(*) FROM cur WHERE p >= lo AND (p < hi OR k = 9 AND p <= hi)) AS c FROM bins),
s AS (SELECT greatest(a / sum(a) OVER (), 1e-6) AS u, greatest(c / sum(c) OVER (), 1e-6) AS v FROM x), z AS (SELECT sum((v - u) * ln(v / u)) AS psi FROM s)
SELECT round(psi, 6) AS psi, CASE WHEN psi < 0.10 THEN 'OK' WHEN psi < 0.25 THEN 'WARN' ELSE 'DRIFT' END AS severity FROM z""")
def drift_psi(spark, d):
    """Population stability of the later half against the earlier."""
    s = _scored(spark, d).withColumn("_u", F.unix_micros(F.col("ts").cast("timestamp")))
    mid = s.agg(F.percentile("_u", F.lit(0.5))).first()[0]
    return rounded(E.psi(s.filter(F.col("_u") < int(mid)), s.filter(F.col("_u") >= int(mid))))


@query(f"WITH {SCORED_SQL} SELECT round(avg((p >= 0.585)::INT), 6) AS rate FROM scored")
def exceed_rate(spark, d):
    """Share of probabilities above the threshold."""
    return rounded(E.exceed_rate(_scored(spark, d), 0.585))


@query(f"""WITH {SCORED_SQL}, c AS (SELECT CASE WHEN hour(ts) >= 9 AND hour(ts) < 15 THEN 'Tokyo' WHEN hour(ts) >= 16 THEN 'London' WHEN hour(ts) < 5 THEN 'NY' ELSE 'Other' END AS session, p, y FROM scored)
SELECT session, count(*)::BIGINT AS n, round(avg((p >= 0.585)::INT), 6) AS coverage, round(avg(y) - (1 - avg(y)) - 0.15, 6) AS base_ev, CASE WHEN avg(y) - (1 - avg(y)) - 0.15 > 0 THEN 'trade' ELSE 'skip' END AS gate FROM c GROUP BY 1""")
def session_coverage(spark, d):
    """Coverage and base-rate expected value by session."""
    s = _scored(spark, d).withColumn("session", S.session_name(F.col("ts"))).groupBy("session").agg(F.count("*").alias("n"), F.avg((F.col("p") >= 0.585).cast("double")).alias("coverage"), S.expected_r(F.avg("y"), cost=0.15).alias("base_ev"))
    return rounded(s.withColumn("gate", F.when(F.col("base_ev") > 0, "trade").otherwise("skip")))


@query(f"""WITH {BARS_SQL}, f AS (SELECT symbol, close, volume, high - low AS rng, (lead(close) OVER ({WIN}) > close)::INT AS y FROM b), s AS (SELECT avg(close) AS m, stddev_pop(close) AS s FROM f)
SELECT feature, round(c, 6) AS corr, round(pr, 6) AS positive_ratio, n::BIGINT AS rows FROM (SELECT unnest(['close', 'volume', 'rng']) AS feature, unnest([corr(close, y), corr(volume, y), corr(rng, y)]) AS c, avg(y) AS pr, count(y) AS n FROM f)""")
def feature_correlations(spark, d):
    """Correlations with the label."""
    from ..operators.features import by_time

    f = bars(spark, d).withColumns({"rng": F.col("high") - F.col("low"), "y": (F.lead("close").over(by_time()) > F.col("close")).cast("int")})
    return rounded(E.top_correlations(f, ["close", "volume", "rng"]))


@query(f"""WITH {BARS_SQL}, s AS (SELECT avg(close) AS m, stddev_pop(close) AS s, avg(high) AS hm, stddev_pop(high) AS hs FROM b)
SELECT symbol, ts, round(greatest(m - 2 * s, least(m + 2 * s, close)), 6) + 0.0 AS close, round(greatest(hm - 2 * hs, least(hm + 2 * hs, high)), 6) + 0.0 AS high FROM b, s""")
def winsorized(spark, d):
    """Columns kept within two deviations."""
    return rounded(E.winsorized(bars(spark, d).select("symbol", "ts", "close", "high"), ["close", "high"], 2.0))


@query(f"""WITH {BARS_SQL}, n AS (SELECT symbol, count(*) // 6 AS s FROM b GROUP BY 1), x AS (SELECT b.symbol, b.ts, b.i, k, s, CASE WHEN i >= k * s AND i < (k + 1) * s THEN 'test' WHEN i < k * s - 12 THEN 'train' END AS role FROM b JOIN n USING (symbol), range(1, 6) AS g(k))
SELECT symbol, ts, i AS bar_idx, k::INT AS fold, role FROM x WHERE role IS NOT NULL""")
def walk_forward_folds(spark, d):
    """Walk-forward splits by position."""
    return C.walk_forward(bars(spark, d))


@query(f"""WITH {BARS_SQL}, g AS (SELECT symbol, ts, dense_rank() OVER (ORDER BY date_trunc('day', ts)) - 1 AS grp FROM b), n AS (SELECT max(grp) + 1 AS n FROM g),
f AS (SELECT k + 1 AS fold, k * (n // 5) + least(k, n % 5) AS a, (k + 1) * (n // 5) + least(k + 1, n % 5) AS z FROM n, range(5) AS r(k))
SELECT fold::INT AS fold, CASE WHEN grp >= a AND grp < z THEN 'test' WHEN grp < a - 1 OR grp >= z + 1 THEN 'train' ELSE 'dropped' END AS role, count(*)::BIGINT AS n FROM g, f GROUP BY ALL""")
def purged_group_folds(spark, d):
    """Purged folds of days."""
    return C.purged_folds(C.time_groups(bars(spark, d))).groupBy("fold", "role").agg(F.count("*").alias("n"))


@query(f"""WITH {BARS_SQL} SELECT symbol, max(ts) AS last_ts, round(epoch(TIMESTAMP '2024-02-01' - max(ts)) / 60, 6) AS age_minutes, CASE WHEN epoch(TIMESTAMP '2024-02-01' - max(ts)) / 60 > 5 THEN 'STALE' ELSE 'OK' END AS status FROM b GROUP BY 1""")
def freshness(spark, d):
    """Age of each symbol's newest bar."""
    from ..operators.monitor import freshness as fresh

    return rounded(fresh(bars(spark, d), "2024-02-01 00:00:00"))


@query(f"""WITH {BARS_SQL}, l AS (SELECT symbol, max(i) AS n FROM b GROUP BY 1), p AS (SELECT b.*, unnest(range(13)) AS step FROM b JOIN l ON b.symbol = l.symbol AND b.i = l.n)
SELECT symbol, step::INT AS step, round(close + (step / 12) * (0.6 * 10.0 - 0.4 * 8.0), 6) AS path, round(close + 2.0 * sqrt(step), 6) AS cone_up, round(close - 2.0 * sqrt(step), 6) AS cone_dn FROM p""")
def projection_path(spark, d):
    """Expected path and volatility cone from the newest bar."""
    from ..operators.monitor import projection

    last = bars(spark, d).groupBy("symbol").agg(F.max_by("close", "ts").alias("close"))
    return rounded(projection(last, F.lit(0.6), F.lit(0.4), F.lit(10.0), F.lit(8.0), F.lit(2.0), 12))


@query()
def triangles(spark, d):
    """Triangles."""
    return rounded(D.triangles(bars(spark, d), flat=0.05, width_atr=6.0))


@query()
def rectangles(spark, d):
    """Rectangles."""
    return rounded(D.rectangles(bars(spark, d), flat=0.05, drift=0.05, width_atr=6.0, touches=2))


@query()
def flags(spark, d):
    """Flags and pennants (D3)."""
    return rounded(D.flags(bars(spark, d), pole_atr=1.0, steepest=0.5, width_atr=8.0, contraction=1.2, quality_min=0.2))


@query()
def best_patterns(spark, d):
    """All patterns in one table, the best of each symbol."""
    b = bars(spark, d)
    share, points = F.lit("share"), F.lit("points")
    every = D.all_patterns((D.triangles(b, flat=0.05, width_atr=6.0), share), (D.double_tops(b), points), (D.head_shoulders(b), points))
    return rounded(D.best_patterns(every).select("symbol", "rank", F.coalesce("type", "kind").alias("kind"), "start_idx", "end_idx", "quality", "scale"), 5)
