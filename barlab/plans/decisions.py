"""Queries of backtest modes, alerts, thresholds, samples, patterns of pivots and rankings by expected value."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import backtest as T
from ..operators import evaluate as E
from ..operators import features as X
from ..operators import levels as V
from ..operators import model as M
from ..operators import news as J
from ..operators import patterns as D
from ..sources import news as N
from .analysis import _CENTRED, _CROSS, _LEVELS, _TOUCH, GRID, _GRID_SQL, _lv, _scored, _trades
from .common import BARS_SQL, NEWS_SQL, SCORED_SQL, WIN, roll, rounded, rslope
from .features import bars

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


#: Each bar's trend line at its end, and the deviation from the line.
_LINE = f"""ln AS (SELECT *, regr_intercept(low, i::DOUBLE) OVER w + i * regr_slope(low, i::DOUBLE) OVER w AS y1, CASE WHEN count(low) OVER w >= 3 THEN sqrt(greatest(0.0, (1 - regr_r2(low, i::DOUBLE) OVER w) * var_pop(low) OVER w)) END AS sg,
  lag(low) OVER v AS pl, lag(high) OVER v AS ph, lag(close) OVER v AS pc, lead(close, 12) OVER v AS ex FROM b WINDOW w AS ({WIN} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW), v AS ({WIN}))"""
_TREND_DIR = "CASE WHEN close > y1 + 1.0 AND pl <= y1 THEN 'long' WHEN close < y1 - 1.0 AND ph >= y1 THEN 'short' END"
_CHANNEL_DIR = "CASE WHEN sg > 1e-9 AND close > y1 + 2.0 * sg + 1.0 THEN 'long' WHEN sg > 1e-9 AND close < y1 - 2.0 * sg - 1.0 THEN 'short' END"
_SIGN = "CASE dir WHEN 'long' THEN 1 ELSE -1 END"


def _line_trades(source: str, where: str) -> str:
    out = f"SELECT symbol, ts, i AS bar_idx, 'trend' AS mode, y1 AS target, {_TREND_DIR} AS dir, close, ex FROM {source} WHERE {where} UNION ALL SELECT symbol, ts, i, 'channel', y1 + CASE WHEN close > y1 THEN 2.0 ELSE -2.0 END * sg, {_CHANNEL_DIR}, close, ex FROM {source} WHERE {where}"
    return f"SELECT symbol, ts, bar_idx, mode, dir, round(target, 5) + 0.0 AS level_or_val, close AS entry, ex AS exit, round((ex - close) * {_SIGN} / 0.01 - 2.0, 6) + 0.0 AS ret_pips FROM ({out}) WHERE dir IS NOT NULL"


def _plain(trades):
    return rounded(trades.select("symbol", "ts", "bar_idx", "mode", "dir", F.round("level_or_val", 5).alias("level_or_val"), "entry", "exit", "ret_pips"))


@query(f"WITH {BARS_SQL}, {_LINE}, la AS (SELECT symbol, arg_max(y1, ts) AS y1, arg_max(sg, ts) AS sg FROM ln GROUP BY 1), fx AS (SELECT ln.* EXCLUDE (y1, sg), la.y1, la.sg FROM ln JOIN la USING (symbol)) {_line_trades('fx', 'ex IS NOT NULL AND i >= 1')}")
def fixed_line_backtests(spark, d):
    """Breaks of the newest trend line and of its channel over the whole series."""
    b = bars(spark, d)
    one = lambda channel: T.backtest_trend(b, 48, 12, 1.0, 10, 0.5, 0.01, 2.0, channel, 2.0, None, True)
    return _plain(one(False).unionByName(one(True)))


_AFTER = "NOT EXISTS (SELECT 1 FROM news n WHERE importance >= 5 AND ln.ts BETWEEN n.ts AND n.ts + INTERVAL 60 MINUTE)"


@query(f"WITH {BARS_SQL}, {NEWS_SQL}, {_LINE}, fx AS (SELECT * FROM ln WHERE {_AFTER}) {_line_trades('fx', 'ex IS NOT NULL AND i >= 48')}")
def rolling_line_backtests(spark, d):
    """Point-in-time breaks of trend lines and channels, none within the hour after important events."""
    b = bars(spark, d)
    windows = J.event_windows(N.news_from_events(spark, d), 5)
    held = J.in_any_window(b.select("symbol", "ts"), windows, ["symbol", "ts"], past_only=True).filter("in_window")
    one = lambda channel: T.backtest_trend(b, 48, 12, 1.0, 10, 0.5, 0.01, 2.0, channel, 2.0, held)
    return _plain(one(False).unionByName(one(True)))


@query()
def rolling_backtest_outside_news(spark, d):
    """Point-in-time level breaks, none within the hour after important events."""
    b = bars(spark, d)
    held = J.in_any_window(b.select("symbol", "ts"), J.event_windows(N.news_from_events(spark, d), 5), ["symbol", "ts"], past_only=True).filter("in_window")
    return rounded(T.backtest_rolling(b, 10, 12, 1.0, 10, 0.5, 0.01, 2.0, 48, 0.02, held))


_HELD = "EXISTS (SELECT 1 FROM news n WHERE importance >= 5 AND {t}.ts BETWEEN n.ts - INTERVAL 60 MINUTE AND n.ts + INTERVAL 60 MINUTE)"
_RETEST = f"""k AS (SELECT t.symbol, t.i, t.level, t.dir, count(*) AS n, sum((abs(c.close - t.level) <= 0.5)::INT) AS hit FROM trades t JOIN b c ON c.symbol = t.symbol AND c.i BETWEEN t.i + 1 AND t.i + 10 GROUP BY ALL)"""


@query(f"""WITH {BARS_SQL}, {NEWS_SQL}, {_LEVELS}, {_CROSS}, {_RETEST}, sg AS (SELECT t.*, k.n, k.hit FROM trades t JOIN k USING (symbol, i, level, dir) WHERE NOT {_HELD.format(t='t')}),
  en AS (SELECT s.symbol, s.i AS si, s.level, s.dir, s.n, s.hit, min(c.i) AS ei FROM sg s JOIN x c ON c.symbol = s.symbol AND c.i BETWEEN s.i + 1 AND s.i + 9 AND c.ex IS NOT NULL AND abs(c.close - s.level) <= 2.0 AND NOT {_HELD.format(t='c')} GROUP BY ALL)
SELECT e.symbol, c.ts, si AS signal_idx, level AS level_or_val, dir, ei AS entry_idx, 'retest' AS mode, c.close AS entry, c.ex AS exit, round((c.ex - c.close) * {_SIGN} / 0.01 - 2.0, 6) + 0.0 AS ret_pips, round(hit / n, 6) AS retest_index, hit > 0 AS retest_hit
FROM en AS e JOIN x c ON c.symbol = e.symbol AND c.i = e.ei""")
def retest_backtest(spark, d):
    """Entries at the retest of broken levels, with signals and entries outside event windows."""
    b = bars(spark, d)
    held = J.in_any_window(b.select("symbol", "ts"), J.event_windows(N.news_from_events(spark, d), 5), ["symbol", "ts"]).filter("in_window")
    breaks = T.backtest_levels(b, _lv(spark, d), 12, 1.0, 10, 0.5, 0.01, 2.0, held)
    return rounded(T.retest_entries(breaks, b, 12, 10, 2.0, 0.01, 2.0, held))


@query(f"""WITH {BARS_SQL}, {_LEVELS}, {_CROSS}, {_RETEST}, {_LINE}, la AS (SELECT symbol, arg_max(y1, ts) AS y1, arg_max(sg, ts) AS sg FROM ln GROUP BY 1), fx AS (SELECT ln.* EXCLUDE (y1, sg), la.y1, la.sg FROM ln JOIN la USING (symbol)),
lt AS ({_line_trades('fx', 'ex IS NOT NULL AND i >= 1')}), ch AS (SELECT *, (SELECT avg((abs(c.close - lt.level_or_val) <= 0.5)::INT) FROM b c WHERE c.symbol = lt.symbol AND c.i BETWEEN lt.bar_idx + 1 AND lt.bar_idx + 10) AS ri FROM lt WHERE mode = 'channel'),
al AS (SELECT 'level' AS mode, dir, pips, hit / n AS ri FROM trades JOIN k USING (symbol, i, level, dir) UNION ALL SELECT mode, dir, ret_pips, ri FROM ch),
g AS (SELECT 'mode' AS kind, mode || ' ' || dir AS name, * FROM al UNION ALL SELECT 'direction', dir, * FROM al UNION ALL SELECT 'retest', CASE WHEN ri > 0 THEN 'yes' ELSE 'no' END, * FROM al UNION ALL SELECT 'channel', dir, * FROM al WHERE mode = 'channel')
SELECT kind, name, count(*)::BIGINT AS trades, round(avg((pips > 0)::INT), 6) AS win_rate, round(avg(pips), 5) AS avg_pips, round(stddev_samp(pips), 5) AS std_pips, round(avg(ri), 5) AS avg_retest FROM g GROUP BY 1, 2""")
def backtest_breakdown(spark, d):
    """Trades by mode, direction and retest, and of the channel alone."""
    b = bars(spark, d)
    trades = _trades(spark, d).unionByName(T.backtest_trend(b, 48, 12, 1.0, 10, 0.5, 0.01, 2.0, True, 2.0, None, True))
    return rounded(T.breakdown(trades).select("kind", "name", "trades", "win_rate", *[S.rounded_half(F.col(c), 5).alias(c) for c in ("avg_pips", "std_pips", "avg_retest")]))


def _alert(mode: str, long: str, short: str, target: str, source: str) -> str:
    return f"SELECT symbol, ts, '{mode}' AS mode, {target} AS level_or_val, CASE WHEN {long} THEN 'long' WHEN {short} THEN 'short' END AS dir, close, nn AS suppressed FROM {source}"


_NOW = [
    _alert("level", "close > level + bb AND low <= level", "close < level - bb AND high >= level", "level", "z JOIN levels USING (symbol)"),
    _alert("retest", "abs(close - level) <= 2.0 AND pc > level + bb AND pl <= level", "abs(close - level) <= 2.0 AND pc < level - bb AND ph >= level", "level", "z JOIN levels USING (symbol)"),
    _alert("trend", "close > y1 + bb AND low <= y1", "close < y1 - bb AND high >= y1", "y1", "z"),
    _alert("channel", "sg > 0 AND close > y1 + 2.0 * sg + bb", "sg > 0 AND close < y1 - 2.0 * sg - bb", "y1 + CASE WHEN close > y1 THEN 2.0 ELSE -2.0 END * sg", "z"),
]


@query(f"""WITH {BARS_SQL}, {NEWS_SQL}, {_LEVELS}, {_LINE}, m AS (SELECT symbol, max(i) AS i FROM b GROUP BY 1),
z AS (SELECT ln.*, nn, 0.5 + CASE WHEN nn THEN 0.02 ELSE 0.0 END AS bb FROM (SELECT *, EXISTS (SELECT 1 FROM news n WHERE importance >= 3 AND ln.ts BETWEEN n.ts - to_minutes(CASE importance WHEN 5 THEN 60 WHEN 4 THEN 45 ELSE 30 END) AND n.ts + to_minutes(CASE importance WHEN 5 THEN 60 WHEN 4 THEN 45 ELSE 30 END)) AS nn FROM ln) AS ln JOIN m USING (symbol, i))
SELECT symbol, ts, mode, round(level_or_val, 5) + 0.0 AS level_or_val, dir, close, suppressed FROM ({' UNION ALL '.join(_NOW)}) WHERE dir IS NOT NULL""")
def last_bar_alerts(spark, d):
    """Alerts of the newest bars in four modes, with the buffer raised near news."""
    a = T.last_bar_alerts(bars(spark, d), _lv(spark, d), 0.5, 48, 2.0, 2.0, J.event_windows(N.news_from_events(spark, d), 3))
    return rounded(a, 5)


@query(f"""WITH {BARS_SQL}, {NEWS_SQL}, x AS (SELECT symbol, ts, EXISTS (SELECT 1 FROM news n WHERE importance >= 4 AND b.ts BETWEEN n.ts - INTERVAL 15 MINUTE AND n.ts + INTERVAL 15 MINUTE) AS nn FROM b)
SELECT symbol, ts, nn AS near_news, round((0.05 + CASE WHEN nn THEN 0.02 ELSE 0 END)::DOUBLE, 6) AS break_buffer, (10 + CASE WHEN nn THEN 4 ELSE 0 END)::INT AS wait_bars FROM x""")
def soft_suppression(spark, d):
    """Break buffer and waiting bars of every bar, raised near news."""
    near = J.in_any_window(bars(spark, d).select("symbol", "ts"), J.uniform_windows(N.news_from_events(spark, d), 4, 15), ["symbol", "ts"], "near_news")
    return rounded(T.soft_suppressed(near, 0.05, 10))


# --- thresholds and metrics


def _sweep_sql(grid: list[float], by: str = "", source: str = "scored", cost: float = 0.15) -> str:
    """n, trades, coverage and expected value at each threshold of the grid, by the named columns."""
    values = ", ".join(f"{x!r}::DOUBLE" for x in grid)
    key = f"{by}, " if by else ""
    same = " AND ".join(f"n.{c} = m.{c}" for c in by.split(", ")) + " AND " if by else ""
    named = ", ".join(f"n.{c}" for c in by.split(", ")) + ", " if by else ""
    return f"""gr AS (SELECT unnest([{values}]) AS theta, unnest(range(1, {len(grid) + 1})) AS i), n AS (SELECT {key}count(*) AS n FROM {source} {f'GROUP BY {by}' if by else ''}),
sw AS (SELECT {named}n.n, i, theta, count(p) AS trades, count(p) / n.n AS coverage, avg(p) - (1 - avg(p)) - {cost} AS ev FROM n CROSS JOIN gr LEFT JOIN {source} m ON {same}p >= theta GROUP BY {named}n.n, i, theta)"""


def _plain_best_sql(grid: list[float], name: str, least: tuple[float, ...]) -> str:
    stage = "CASE " + " ".join(f"WHEN coverage >= {x} AND ev IS NOT NULL THEN {k}" for k, x in enumerate(least)) + " END"
    return f"""(WITH {_sweep_sql(grid)}, k AS (SELECT *, {stage} AS st FROM sw) SELECT '{name}' AS grid, round(CASE WHEN st IS NULL THEN 0.5 ELSE theta END, 6) AS theta, (CASE WHEN st IS NULL THEN 0 ELSE trades END)::BIGINT AS trades, round(CASE WHEN st IS NULL THEN 0 ELSE coverage END, 6) AS coverage, round(CASE WHEN st IS NOT NULL THEN ev END, 6) AS ev
  FROM k QUALIFY row_number() OVER (ORDER BY st NULLS LAST, round(ev, 9) DESC NULLS LAST, i) = 1)"""


@query(f"WITH {SCORED_SQL} SELECT * FROM {_plain_best_sql(E.SWEEP_GRID, 'sweep', (0.30, 0.25))} UNION ALL SELECT * FROM {_plain_best_sql(E.DIRECTION_GRID, 'direction', (0.01,))}")
def best_thetas_of_grids(spark, d):
    """Best thresholds on the grids of the label sweep and of the direction models (A4, A5)."""
    s = _scored(spark, d)
    one = lambda grid, name, *least: E.plain_best(E.sweep(s, grid), (), *least).withColumn("grid", F.lit(name))
    return rounded(one(E.SWEEP_GRID, "sweep", 0.30, 0.25).unionByName(one(E.DIRECTION_GRID, "direction", 0.01)).withColumn("trades", F.col("trades").cast("long")))


_SESSIONS = "unnest(list_filter([CASE WHEN hour(ts) >= 9 AND hour(ts) < 15 THEN 'Tokyo' END, CASE WHEN hour(ts) >= 16 THEN 'London' END, CASE WHEN hour(ts) >= 22 OR hour(ts) < 5 THEN 'NY' END], lambda z: z IS NOT NULL)) AS session"


def _staged_sql(by: str, least: str, target: str) -> str:
    return f"""SELECT {by}, theta, trades::BIGINT AS trades, round(coverage, 6) AS coverage, round(ev, 6) AS ev FROM sw WHERE n >= 200
  QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY CASE WHEN coverage >= {target} THEN 1 WHEN coverage >= {least} THEN 2 WHEN trades > 0 THEN 3 ELSE 4 END,
    round(CASE WHEN coverage >= {target} THEN ev - 0.05 * abs(coverage - {target}) WHEN trades > 0 THEN ev ELSE coverage END, 9) DESC, i) = 1"""


_BY_SESSION = f"m1 AS (SELECT p, {_SESSIONS} FROM scored), {_sweep_sql(GRID, 'session', 'm1')}"
_THETAS = _staged_sql("session", "(CASE session WHEN 'Tokyo' THEN 0.03 ELSE 0.05 END)", "(CASE session WHEN 'Tokyo' THEN 0.07 ELSE 0.12 END)")


@query(f"WITH {SCORED_SQL}, {_BY_SESSION} {_THETAS}")
def session_thetas(spark, d):
    """Thresholds of sessions with enough rows, by their own coverages."""
    return rounded(E.session_thetas(_scored(spark, d), GRID))


def _with_regime(spark, d):
    """Scored rows with the tercile of their value within the event type as regime."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.col("event_type").alias("symbol"), "value")
    return X.regimes(_scored(spark, d).join(e, "id"), "value")


_REGIMES = """q AS (SELECT event_type, quantile_cont(value, 0.33) AS a, quantile_cont(value, 0.66) AS c FROM events GROUP BY 1),
rs AS (SELECT s.*, CASE WHEN e.value <= a THEN 'low' WHEN e.value <= c THEN 'mid' ELSE 'high' END AS regime FROM scored s JOIN events e ON e.event_id = s.id JOIN q USING (event_type))"""


@query(f"WITH {SCORED_SQL}, {_REGIMES}, m1 AS (SELECT p, regime, {_SESSIONS} FROM rs), {_sweep_sql(GRID, 'session, regime', 'm1')} {_staged_sql('session, regime', '0.22', '0.30')}")
def regime_thetas(spark, d):
    """Thresholds of sessions and volatility regimes."""
    return rounded(E.regime_thetas(_with_regime(spark, d), GRID))


@query(f"WITH {SCORED_SQL}, {_BY_SESSION}, th AS ({_THETAS}), md AS (SELECT median(theta) AS theta FROM th) SELECT round(theta, 6) AS theta, round(avg((p >= theta)::INT), 6) AS rate FROM scored, md GROUP BY 1")
def exceed_rate_at_median_theta(spark, d):
    """Share of probabilities at or above the median of the thresholds in use."""
    s = _scored(spark, d)
    theta = E.session_thetas(s, GRID).agg(F.median("theta").alias("theta"))  # one row
    return rounded(s.crossJoin(theta).groupBy("theta").agg(F.avg((F.col("p") >= F.col("theta")).cast("double")).alias("rate")))


def _pr_sql(y: str, p: str) -> str:
    return f"""(SELECT sum(pos * (tp / k + CASE WHEN k = n THEN 1.0 ELSE (tp - pos) / (k - n) END) / 2) / max(t) FROM (
  SELECT *, sum(pos) OVER (ORDER BY q DESC) AS tp, sum(n) OVER (ORDER BY q DESC) AS k, sum(pos) OVER () AS t FROM (SELECT {p} AS q, sum({y}) AS pos, count(*) AS n FROM scored GROUP BY 1)))"""


@query(f"""WITH {SCORED_SQL}, c AS (SELECT sum((p >= 0.5 AND y = 1)::INT)::DOUBLE AS tp, sum((p >= 0.5 AND y = 0)::INT)::DOUBLE AS fp, sum((p < 0.5 AND y = 1)::INT)::DOUBLE AS fn, sum((p < 0.5 AND y = 0)::INT)::DOUBLE AS tn, avg((p - y) ** 2) AS brier FROM scored)
SELECT round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(2 * tn / (2 * tn + fp + fn), 6) AS f1_neg, round(2 * tp / (2 * tp + fp + fn), 6) AS f1_pos, round(brier, 6) AS brier,
CASE WHEN tp + fn <= fp + tn THEN 1 ELSE 0 END AS minority_class, round({_pr_sql('y', 'p')}, 6) AS pr_auc_pos, round({_pr_sql('1 - y', '1 - p')}, 6) AS pr_auc_neg FROM c""")
def minority_metrics(spark, d):
    """Metrics of both classes, with the area under both precision-recall curves."""
    return rounded(E.minority_metrics(_scored(spark, d)))


# --- samples

_QUARTILE = "CASE WHEN rk > 1 + 0.75 * (nn - 1) THEN 'Q4' WHEN rk > 1 + 0.5 * (nn - 1) THEN 'Q3' WHEN rk > 1 + 0.25 * (nn - 1) THEN 'Q2' ELSE 'Q1' END"
_STRATA = f"""vs AS (SELECT *, abs(p - 0.5) AS vol FROM scored), vr AS (SELECT *, row_number() OVER (ORDER BY vol, ts, id) AS rk, count(*) OVER () AS nn FROM vs),
st AS (SELECT *, {_QUARTILE} AS quartile, (hour(ts) >= 9 AND hour(ts) < 15)::INT || '' || (hour(ts) >= 16)::INT || '' || (hour(ts) >= 22 OR hour(ts) < 5)::INT || '|' || {_QUARTILE} AS stratum,
  (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0) / count(*) OVER () AS pct FROM vr),
sk AS (SELECT st.*, greatest(1, 120 // z) AS k FROM st JOIN (SELECT y, count(DISTINCT stratum) AS z FROM st GROUP BY 1) USING (y))"""


def _vol(spark, d):
    return _scored(spark, d).withColumn("vol", F.abs(F.col("p") - 0.5))


@query(f"WITH {SCORED_SQL}, {_STRATA} SELECT id, quartile, round(pct, 6) AS pct_rank FROM st")
def ranks_of_scores(spark, d):
    """Quartile of the rank of volatility, and percent rank of the probability."""
    return rounded(E.percent_rank_average(E.quartiles_by_rank(_vol(spark, d), "vol", "ts", "id"), "p").select("id", "quartile", "pct_rank"))


@query(f"WITH {SCORED_SQL}, {_STRATA} SELECT id, y, stratum, round(p, 6) AS p FROM sk QUALIFY row_number() OVER (PARTITION BY y, stratum ORDER BY md5(id::VARCHAR || ':7'), id) <= k")
def audit_sample(spark, d):
    """Equally many rows of each stratum for review."""
    return rounded(E.stratified_sample(_vol(spark, d), "id").select("id", "y", "stratum", "p"))


@query(f"""WITH {SCORED_SQL}, {_STRATA} SELECT id, y, stratum, round(p, 6) AS p, round(pct, 6) AS pct_rank FROM sk
QUALIFY row_number() OVER (PARTITION BY y, stratum ORDER BY pct, id) <= k // 2 OR row_number() OVER (PARTITION BY y, stratum ORDER BY pct DESC, id DESC) <= k - k // 2""")
def audit_sample_of_extremes(spark, d):
    """Rows of each stratum from both ends of the probabilities."""
    return rounded(E.stratified_sample(_vol(spark, d), "id", mode="extreme").select("id", "y", "stratum", "p", "pct_rank"))


# --- decisions


@query(f"""WITH {BARS_SQL}, {NEWS_SQL}, rg AS (SELECT *, {roll('avg', 'tr', 14)} AS atr14 FROM b), q AS (SELECT symbol, quantile_cont(atr14, 0.33) AS a, quantile_cont(atr14, 0.66) AS c, quantile_cont(atr14, 0.5) AS m FROM rg GROUP BY 1),
x AS (SELECT symbol, ts, close / (close + 50) AS p, greatest(greatest(high - greatest(open, close), 0.0), greatest(least(open, close) - low, 0.0)) / greatest(abs(close - open), 1e-9) AS wick,
  CASE WHEN hour(ts) >= 22 OR hour(ts) < 5 THEN 0.755 WHEN hour(ts) >= 16 THEN 0.665 WHEN hour(ts) >= 9 AND hour(ts) < 15 THEN 0.74 ELSE 0.585 END - 0.2 AS theta, CASE WHEN coalesce(atr14, m) <= a THEN 0.0 WHEN coalesce(atr14, m) <= c THEN 0.02 ELSE 0.03 END AS bump,
  EXISTS (SELECT 1 FROM news n WHERE importance >= 5 AND rg.ts BETWEEN n.ts - INTERVAL 60 MINUTE AND n.ts + INTERVAL 60 MINUTE) AS hard, EXISTS (SELECT 1 FROM news n WHERE importance >= 4 AND rg.ts BETWEEN n.ts - INTERVAL 10 MINUTE AND n.ts + INTERVAL 10 MINUTE) AS soft, (volume % 7) / 100.0 AS spread FROM rg JOIN q USING (symbol)),
y AS (SELECT *, greatest(0.5, least(0.99, theta + bump + CASE WHEN soft THEN 0.03 ELSE 0 END)) AS te, p - (1 - p) - 0.02 AS ev FROM x),
z AS (SELECT *, CASE WHEN hard THEN 'news' WHEN spread > 0.03 THEN 'spread' WHEN p < te THEN 'probability' WHEN ev < 0 THEN 'expected value' END AS why FROM y)
SELECT symbol, ts, round(te::DOUBLE, 6) AS theta_eff, CASE WHEN why IS NOT NULL THEN 'skip' WHEN wick >= 2.5 THEN 'limit_retest' ELSE 'market' END AS action,
CASE WHEN why IS NOT NULL THEN why WHEN wick >= 2.5 THEN 'long wick,retest preferred' ELSE '' END AS reasons, round(CASE WHEN why IS NULL OR why = 'expected value' THEN ev END, 6) + 0.0 AS ev_r FROM z""")
def recommendations(spark, d):
    """Actions and reasons by session threshold, regime, news, spread and wicks."""
    n, key = N.news_from_events(spark, d), ["symbol", "ts"]
    b = X.regimes(X.true_range(bars(spark, d)).withColumn("atr14", X.gated(F.avg, F.col("tr"), 14)))
    b = J.in_any_window(b, J.event_windows(n, 5), key, "hard")
    b = J.in_any_window(b, J.uniform_windows(n, 4, 10), key, "soft").withColumn("p", F.col("close") / (F.col("close") + 50))
    session = S.session_for_scoring(F.col("ts"))
    theta = F.when(session == "NY", 0.755).when(session == "London", 0.665).when(session == "Tokyo", 0.74).otherwise(0.585) - 0.2
    theta = S.effective_theta(theta, S.regime(F.col("reg_atr_low"), F.col("reg_atr_mid"), F.col("reg_atr_high")), F.col("soft"))
    wick = F.greatest(*S.wick_ratios(*map(F.col, ("open", "high", "low", "close"))))
    action, reasons, ev = S.recommend(F.col("p"), theta, S.expected_r(F.col("p"), cost=0.02), wick, F.col("hard"), (F.col("volume") % 7) / 100)
    return rounded(b.select(*key, theta.alias("theta_eff"), action.alias("action"), F.concat_ws(",", reasons).alias("reasons"), ev.alias("ev_r")))


#: Session of a time (P5).
_SESSION = "CASE WHEN hour(ts) >= 9 AND hour(ts) < 15 THEN 'Tokyo' WHEN hour(ts) >= 16 THEN 'London' WHEN hour(ts) < 5 THEN 'NY' ELSE 'Other' END"


@query(f"""WITH {BARS_SQL}, {NEWS_SQL}, {SCORED_SQL}, g AS (SELECT {_SESSION} AS session, avg(y) * 2.0 - (1 - avg(y)) - 0.01 AS run_ev FROM scored GROUP BY 1),
x AS (SELECT symbol, ts, {_SESSION} AS session, close / (close + 50) AS p, EXISTS (SELECT 1 FROM news n WHERE importance >= 5 AND b.ts BETWEEN n.ts - INTERVAL 60 MINUTE AND n.ts + INTERVAL 60 MINUTE) AS inn FROM b)
SELECT symbol, ts, session, round(p, 6) AS p, round(run_ev, 6) + 0.0 AS run_ev, p >= 0.585 AND NOT inn AND coalesce(run_ev, 0.0) > 0 AS trade FROM x LEFT JOIN g USING (session)""")
def trade_gate(spark, d):
    """Rows with a signal, outside event windows, in sessions whose expected value over the run is positive, at
    twice the risk won and 0.01 of it in costs (B9)."""
    run = _scored(spark, d).groupBy(S.session_name(F.col("ts")).alias("session")).agg(S.expected_r(F.avg("y"), 2.0, 1.0, 0.01).alias("run_ev"))
    b = J.in_any_window(bars(spark, d), J.event_windows(N.news_from_events(spark, d), 5), ["symbol", "ts"]).withColumns({"p": F.col("close") / (F.col("close") + 50), "session": S.session_name(F.col("ts"))})
    return rounded(T.trade_gate(b.withColumn("signal", F.col("p") >= 0.585), run).select("symbol", "ts", "session", "p", "run_ev", "trade"))


@query(f"""WITH {BARS_SQL}, {_LEVELS}, f AS (SELECT *, {roll('avg', 'tr', 14)} AS atr14, max(high) OVER w AS rh, min(low) OVER w AS rl FROM b WINDOW w AS ({WIN} ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)), g AS (SELECT *, atr14 - lag(atr14) OVER ({WIN}) AS da, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM f),
j AS (SELECT g.*, level, sum({_TOUCH}::INT) OVER (PARTITION BY symbol, level ORDER BY ts ROWS BETWEEN 200 PRECEDING AND CURRENT ROW) AS tc FROM g JOIN levels USING (symbol))
SELECT symbol, ts, level, s::INT AS dir_sign, round((close - level) * s, 6) + 0.0 AS dist_to_level, round(1 / (abs(close - level) + 1e-6), 3) AS near, tc::BIGINT AS touches, (close > level)::INT AS above_level, (close < level)::INT AS below_level, round(rh * s, 6) + 0.0 AS recent_high, round(rl * s, 6) + 0.0 AS recent_low,
round(coalesce(da, 0.0) * s, 6) + 0.0 AS atr_slope_dir, 0.0::DOUBLE AS rsi_div_dir, round(coalesce(atr14, 0.0) / greatest(1e-6, close), 6) + 0.0 AS atr_norm FROM j, (SELECT unnest([1, -1]) AS s) WHERE k <= 20""")
def level_features(spark, d):
    """Features of the newest bars for each level and direction (P10)."""
    names = ("dist_to_level", "near", "touches", "above_level", "below_level", "recent_high", "recent_low", "atr_slope_dir", "rsi_div_dir", "atr_norm")
    r = M.level_rows(X.base_features(bars(spark, d)), _lv(spark, d), 20, 0.5)
    return rounded(r.select("symbol", "ts", "level", "dir_sign", *[S.rounded_half(F.col(c), 3).alias(c) if c == "near" else F.col(c).cast("long").alias(c) if c == "touches" else F.col(c) for c in names]))


# --- rankings

_PIPS = "bl AS (SELECT symbol, level, dir, avg(pips) AS a, count(*) AS n FROM trades GROUP BY 1, 2, 3), bd AS (SELECT symbol, dir, avg(pips) AS a FROM trades GROUP BY 1, 2)"
#: Pips that a trade costs: commission, slippage and gap.
COST = S.extra_cost(0.5, 1.0, 0.25)


@query(f"""WITH {BARS_SQL}, {_LEVELS}, {_CROSS}, {_PIPS}, w AS (SELECT symbol, level, unnest(['long', 'short']) AS dir FROM levels), xp AS (SELECT w.*, coalesce(CASE WHEN bl.n >= 5 THEN bl.a END, bd.a, 0.0) - 1.75 AS ep FROM w LEFT JOIN bl USING (symbol, level, dir) LEFT JOIN bd USING (symbol, dir)),
v AS (SELECT u.symbol, u.level, u.level / (u.level + 50) * u.ep AS ub, (1 - u.level / (u.level + 50)) * s.ep AS us FROM xp u JOIN xp s ON u.symbol = s.symbol AND u.level = s.level AND u.dir = 'long' AND s.dir = 'short')
SELECT symbol, level, round(ub, 5) + 0.0 AS ev_buy, round(us, 5) + 0.0 AS ev_sell, CASE WHEN ub >= us THEN 'BUY' ELSE 'SELL' END AS action, round(greatest(ub, us), 5) + 0.0 AS ev, row_number() OVER (PARTITION BY symbol ORDER BY round(greatest(ub, us), 9) DESC, level)::INT AS rank FROM v""")
def level_ranking(spark, d):
    """Levels by expected value, given each level's probabilities."""
    lv = _lv(spark, d).withColumn("p_up", F.col("level") / (F.col("level") + 50)).withColumn("p_dn", 1 - F.col("p_up"))
    wanted = lv.select("symbol", "level", F.explode(F.array(F.lit("long"), F.lit("short"))).alias("dir"))
    ranked = T.rank_levels(lv, T.lookup_pips(wanted, *T.expected_pips(_trades(spark, d))), COST)
    return rounded(ranked.select("symbol", "level", "ev_buy", "ev_sell", "action", "ev", "rank"), 5)


@query(f"""WITH {BARS_SQL}, {_LEVELS}, h AS (SELECT symbol, level, count(*) AS t FROM b JOIN levels USING (symbol) WHERE {_TOUCH} GROUP BY 1, 2) SELECT symbol, level, coalesce(t, 0)::BIGINT AS touches, row_number() OVER (PARTITION BY symbol ORDER BY coalesce(t, 0) DESC, level)::INT AS rank FROM levels LEFT JOIN h USING (symbol, level) QUALIFY rank <= 15""")
def top_levels(spark, d):
    """The 15 levels of each symbol with most touches (O3)."""
    scored = V.level_scores(bars(spark, d), _lv(spark, d), 0.5, (1.0, 0.0, 0.0, 0.0)).withColumn("touches", F.col("touches").cast("long"))
    return V.top_levels(scored, 15, "touches").select("symbol", "level", "touches", "rank")


# --- patterns of pivots


def _context_sql(lookback: int) -> str:
    return f"""cx AS (SELECT *, {rslope(24)} AS s24, max(i) OVER (PARTITION BY symbol) AS mi FROM b), d AS (SELECT * FROM cx WHERE i > mi - {lookback}),
a1 AS (SELECT *, CASE WHEN count(tr) OVER w >= 8 THEN avg(tr) OVER w END AS a0 FROM d WINDOW w AS ({WIN} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)), a2 AS (SELECT symbol, last_value(a0 IGNORE NULLS) OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM a1), med AS (SELECT symbol, median(a) AS am FROM a2 GROUP BY 1),
piv AS ({_CENTRED}), pv AS (SELECT piv.symbol, piv.kind, piv.i, piv.price, d.s24 FROM piv JOIN d ON piv.symbol = d.symbol AND piv.i = d.i)"""


#: Confirmation and retest of patterns cd (symbol, kind, i, i2, nm, nb, am).
_JUDGED_SQL = """cf AS (SELECT symbol, kind, i, min(CASE WHEN run >= 2 THEN j END) AS confirm_idx FROM (
  SELECT c.symbol, c.kind, c.i, d.i AS j, sum(CASE WHEN c.kind = 'high' THEN d.close <= nm * d.i + nb - 0.15 * am ELSE d.close >= nm * d.i + nb + 0.15 * am END::INT) OVER (PARTITION BY c.symbol, c.kind, c.i ORDER BY d.i ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS run
  FROM cd c JOIN d ON c.symbol = d.symbol AND d.i >= c.i2) GROUP BY 1, 2, 3),
cc AS (SELECT cd.*, confirm_idx FROM cd LEFT JOIN cf USING (symbol, kind, i)),
rt AS (SELECT c.symbol, c.kind, c.i, min(d.i) AS retest_idx FROM cc c JOIN d ON c.symbol = d.symbol AND d.i BETWEEN coalesce(confirm_idx, i2) + 1 AND coalesce(confirm_idx, i2) + 31 AND d.high >= nm * d.i + nb - 0.25 * am AND d.low <= nm * d.i + nb + 0.25 * am GROUP BY 1, 2, 3),
jd AS (SELECT cc.*, retest_idx FROM cc LEFT JOIN rt USING (symbol, kind, i))"""

_DOUBLES = f"""{_context_sql(200)}, pr AS (SELECT *, lead(i) OVER q AS i2, lead(price) OVER q AS v2 FROM pv WINDOW q AS (PARTITION BY symbol, kind ORDER BY i)), c0 AS (SELECT pr.*, am, (price + v2) / 2 AS mid FROM pr JOIN med USING (symbol) WHERE i2 - i >= 10 AND abs(price - v2) <= 0.55 * am),
c1 AS (SELECT c.symbol, c.kind, c.i, c.price, c.s24, c.i2, c.v2, c.am, c.mid, CASE WHEN c.kind = 'high' THEN min(d.low) ELSE max(d.high) END AS nb, 0.0 AS nm FROM c0 c JOIN d ON c.symbol = d.symbol AND d.i BETWEEN c.i AND c.i2 GROUP BY c.symbol, c.kind, c.i, c.price, c.s24, c.i2, c.v2, c.am, c.mid),
cd AS (SELECT *, CASE WHEN kind = 'high' THEN mid - nb ELSE nb - mid END AS depth FROM c1 WHERE CASE WHEN kind = 'high' THEN mid - nb ELSE nb - mid END >= 0.9 * am), {_JUDGED_SQL},
dbl AS (SELECT symbol, CASE kind WHEN 'high' THEN 'double_top' ELSE 'double_bottom' END AS kind, i AS start_idx, i2 AS end_idx, mid AS extreme, nb AS neck, confirm_idx, retest_idx,
  greatest(0.0, least(99.0, 50 + 20 * greatest(0.0, least(1.0, 1 - abs(price - v2) / greatest(1e-9, abs(mid)))) + least(20.0, 6 * greatest(0.0, depth / greatest(1e-9, am) - 0.5)) + CASE WHEN confirm_idx IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN retest_idx IS NOT NULL THEN 7 ELSE 0 END
  + CASE WHEN coalesce(s24, 0.0) * CASE kind WHEN 'high' THEN 1 ELSE -1 END > 0 THEN 5 ELSE 0 END - least(10.0, abs(i2 - i - 20) * 0.4))) AS quality, CASE kind WHEN 'high' THEN 'down' ELSE 'up' END AS direction_bias FROM jd)"""

_ROUNDED = "symbol, kind, start_idx, end_idx, round(extreme, 5) + 0.0 AS extreme, round(neck, 5) + 0.0 AS neck, confirm_idx, retest_idx, round(quality, 5) + 0.0 AS quality, direction_bias"


@query(f"WITH {BARS_SQL}, {_DOUBLES} SELECT {_ROUNDED} FROM dbl")
def double_tops(spark, d):
    """Double tops and bottoms."""
    return rounded(D.double_tops(bars(spark, d)), 5)


@query(f"WITH {BARS_SQL}, {_DOUBLES} SELECT {_ROUNDED} FROM dbl QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY end_idx DESC, round(quality, 9) DESC, start_idx) = 1")
def latest_double(spark, d):
    """The latest double top or bottom of each symbol."""
    return rounded(D.latest_pattern(D.double_tops(bars(spark, d))), 5)


_HEADS = f"""{_context_sql(260)}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i) AS k FROM pv WHERE kind = 'high'),
kp AS (SELECT symbol, k, i, i AS last FROM o WHERE k = 1 UNION ALL SELECT o.symbol, o.k, o.i, CASE WHEN o.i - g.last >= 5 THEN o.i ELSE g.last END FROM kp g JOIN o ON o.symbol = g.symbol AND o.k = g.k + 1),
tp AS (SELECT pv.* FROM pv JOIN kp ON pv.symbol = kp.symbol AND pv.i = kp.i AND kp.i = kp.last WHERE pv.kind = 'high' UNION ALL SELECT * FROM pv WHERE kind = 'low'),
t0 AS (SELECT *, lead(i) OVER q AS ih, lead(price) OVER q AS vh, lead(i, 2) OVER q AS i2, lead(price, 2) OVER q AS v2 FROM tp WINDOW q AS (PARTITION BY symbol, kind ORDER BY i)),
t1 AS (SELECT t0.*, am FROM t0 JOIN med USING (symbol) WHERE ih - i >= 10 AND i2 - ih >= 10 AND CASE WHEN kind = 'high' THEN vh >= greatest(price, v2) + 0.8 * am ELSE vh <= least(price, v2) - 0.8 * am END AND abs(price - v2) <= greatest(0.003 * greatest(abs(vh), 1e-9), 0.6 * am)),
t2 AS (SELECT c.*, CASE WHEN kind = 'high' THEN lo1 ELSE hi1 END AS nl, CASE WHEN kind = 'high' THEN lo2 ELSE hi2 END AS nr FROM (SELECT c.symbol, c.kind, c.i, c.price, c.s24, c.ih, c.vh, c.i2, c.v2, c.am, min(d.low) FILTER (d.i <= c.ih) AS lo1, min(d.low) FILTER (d.i >= c.ih) AS lo2, max(d.high) FILTER (d.i <= c.ih) AS hi1, max(d.high) FILTER (d.i >= c.ih) AS hi2
  FROM t1 c JOIN d ON c.symbol = d.symbol AND d.i BETWEEN c.i AND c.i2 GROUP BY ALL) AS c),
cd AS (SELECT *, (nr - nl) / (i2 - i) AS nm, nl - (nr - nl) / (i2 - i) * i AS nb FROM t2), {_JUDGED_SQL},
hs AS (SELECT symbol, CASE kind WHEN 'high' THEN 'head_shoulders' ELSE 'inverse_head_shoulders' END AS kind, i AS start_idx, i2 AS end_idx, vh AS extreme, (nl + nr) / 2 AS neck, confirm_idx, retest_idx,
  greatest(0.0, least(99.0, 45 + 20 * greatest(0.0, 1 - abs(price - v2) / greatest(1e-6, abs(price), abs(v2))) + least(18.0, 6 * greatest(0.0, greatest(0.0, (vh - (nl + nr) / 2) * CASE kind WHEN 'high' THEN 1 ELSE -1 END / greatest(1e-9, am)) - 0.5)) + CASE WHEN confirm_idx IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN retest_idx IS NOT NULL THEN 6 ELSE 0 END
  + CASE WHEN coalesce(s24, 0.0) * CASE kind WHEN 'high' THEN 1 ELSE -1 END > 0 THEN 5 ELSE 0 END + 5 * greatest(0.0, 1 - abs((ih - i) - (i2 - ih)) / greatest(ih - i, i2 - ih, 1)) - least(12.0, abs(nm) / greatest(1e-9, am) * 6))) AS quality, CASE kind WHEN 'high' THEN 'down' ELSE 'up' END AS direction_bias FROM jd)"""


@query(f"WITH RECURSIVE {BARS_SQL}, {_HEADS} SELECT {_ROUNDED} FROM hs")
def head_shoulders(spark, d):
    """Head and shoulders."""
    return rounded(D.head_shoulders(bars(spark, d)), 5)


@query(f"""WITH {BARS_SQL}, f AS (SELECT *, {roll('avg', 'tr', 14)} AS atr, lag(close, 40) OVER v - lag(close, 69) OVER v AS pole, regr_slope(close, i::DOUBLE) OVER w AS m, regr_intercept(close, i::DOUBLE) OVER w AS c, sqrt(greatest(0.0, (1 - regr_r2(close, i::DOUBLE) OVER w) * var_pop(close) OVER w)) AS sg, max(i) OVER (PARTITION BY symbol) AS mi
  FROM b WINDOW v AS ({WIN}), w AS ({WIN} ROWS BETWEEN 39 PRECEDING AND CURRENT ROW))
SELECT symbol, ts, CASE WHEN abs(m) < 1e-4 THEN 'pennant' WHEN m > 0 THEN 'flag_up' ELSE 'flag_dn' END AS kind, CASE WHEN pole > 0 THEN 'up' ELSE 'down' END AS direction_bias, round(pole, 5) + 0.0 AS pole, round(m, 5) + 0.0 AS slope, round(sg, 5) AS sigma, round(m * i + c + sg, 5) + 0.0 AS upper_now, round(m * i + c - sg, 5) + 0.0 AS lower_now,
round(65 + least(20.0, abs(pole) / atr * 3) + least(10.0, 1 / (sg / atr + 1e-6)), 5) AS quality FROM f WHERE i = mi AND i >= 74 AND atr > 0 AND sg > 0 AND abs(pole) >= 0.2 * atr""")
def band_flags(spark, d):
    """Flags of the newest window."""
    return rounded(D.band_flag(bars(spark, d), pole_atr=0.2), 5)


@query(f"""WITH RECURSIVE {BARS_SQL}, s AS (SELECT symbol, avg(tr) FILTER (i < 14) AS seed FROM b GROUP BY 1),
e AS (SELECT b.symbol, b.ts, b.i, seed AS a FROM b JOIN s USING (symbol) WHERE i = 0 UNION ALL SELECT b.symbol, b.ts, b.i, CASE WHEN b.i < 14 THEN e.a ELSE 2.0 / 15 * b.tr + (1 - 2.0 / 15) * e.a END FROM e JOIN b ON b.symbol = e.symbol AND b.i = e.i + 1)
SELECT symbol, ts, i AS bar_idx, round(a, 6) + 0.0 AS ema_atr FROM e""")
def exponential_atr(spark, d):
    """Exponential ATR in chunks."""
    return rounded(D.exponential_atr(bars(spark, d)))


_NEAREST = """nr AS (SELECT w.*, n.a AS na, n.n AS nn, row_number() OVER (PARTITION BY w.symbol, w.kind, w.start_idx, w.dir ORDER BY abs(w.x - n.level), n.level) AS k FROM w LEFT JOIN bl n ON n.symbol = w.symbol AND n.dir = w.dir),
ep AS (SELECT nr.symbol, nr.kind, nr.start_idx, nr.dir, coalesce(CASE WHEN nn >= 5 THEN na END, bd.a) - 1.75 AS pips FROM nr LEFT JOIN bd ON bd.symbol = nr.symbol AND bd.dir = nr.dir WHERE k = 1)"""


@query(f"""WITH RECURSIVE {BARS_SQL}, db AS (SELECT * FROM (WITH {_DOUBLES} SELECT * FROM dbl)), hd AS (SELECT * FROM (WITH RECURSIVE {_HEADS} SELECT * FROM hs)), {_LEVELS}, {_CROSS}, {_PIPS}, al AS (SELECT symbol, kind, start_idx, quality, extreme, neck FROM db UNION ALL SELECT symbol, kind, start_idx, quality, extreme, neck FROM hd),
ls AS (SELECT symbol, arg_max(close, ts) AS c FROM b GROUP BY 1), w AS (SELECT *, neck AS x, CASE WHEN kind IN ('double_bottom', 'inverse_head_shoulders') THEN 'long' ELSE 'short' END AS dir FROM al), {_NEAREST},
v AS (SELECT w.*, c, abs(extreme - neck) AS mv, pips, pips * neck / (neck + 50) AS ev FROM w JOIN ls USING (symbol) LEFT JOIN ep USING (symbol, kind, start_idx, dir))
SELECT symbol, kind || ':' || start_idx AS pid, kind, round(quality, 5) AS quality, round(CASE dir WHEN 'long' THEN neck END, 5) + 0.0 AS upper_level, round(CASE dir WHEN 'short' THEN neck END, 5) + 0.0 AS lower_level, round(c + mv, 5) + 0.0 AS target_up, round(c - mv, 5) + 0.0 AS target_dn,
round(CASE dir WHEN 'long' THEN ev END, 5) + 0.0 AS ev_up, round(CASE dir WHEN 'short' THEN ev END, 5) + 0.0 AS ev_dn, CASE WHEN dir = 'long' AND ev IS NOT NULL THEN 'BUY' ELSE 'SELL' END AS action, round(CASE WHEN dir = 'short' OR ev IS NOT NULL THEN ev END, 5) + 0.0 AS ev FROM v""")
def pattern_values(spark, d):
    """Patterns of pivots by expected value, given each boundary's probability."""
    p = D.with_boundaries(D.double_tops(bars(spark, d)).unionByName(D.head_shoulders(bars(spark, d))))
    chance = lambda x: x / (x + 50)
    p = p.withColumns({"p_up": chance(F.col("neck")), "p_dn": chance(F.col("neck"))})
    last = bars(spark, d).groupBy("symbol").agg(F.max_by("close", "ts").alias("close"))
    v = T.pattern_values(p, *T.expected_pips(_trades(spark, d)), last, COST)
    return rounded(v.select("symbol", "pid", "kind", "quality", "upper_level", "lower_level", "target_up", "target_dn", "ev_up", "ev_dn", "action", "ev"), 5)
