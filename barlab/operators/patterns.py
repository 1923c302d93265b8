"""Chart patterns.

Searches over many windows (triangles, rectangles, flags) run on chunks of a series that carry the
bars around them, so a long series is many tasks; within a chunk, all windows of one length are
judged at once by prefix sums. Patterns of pivots (doubles, head and shoulders) are joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import by_time, gated, slope, true_range, with_index
from .levels import centred_pivots, thinned

#: Core bars of a chunk; bars before it that let the exponential ATR settle to double precision.
CHUNK, WARM = 2048, 320


def chunked(bars: DataFrame, back: int, ahead: int, size: int = CHUNK) -> DataFrame:
    """bars with bar_idx and _chunk; a bar is repeated in each chunk whose core needs it as surroundings."""
    df = bars if "bar_idx" in bars.columns else with_index(bars)
    first = F.greatest(F.lit(0), F.floor((F.col("bar_idx") - ahead) / size))
    return df.withColumn("_chunk", F.explode(F.sequence(first, F.floor((F.col("bar_idx") + back) / size))))


def ema_atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> np.ndarray:
    """Exponential ATR with weight 2 / (n + 1), begun with the mean of the first n true ranges."""
    before = np.concatenate((close[:1], close[:-1]))
    tr = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
    out = np.full(len(tr), tr[: min(n, len(tr))].mean() if len(tr) else 0.0)
    a = 2.0 / (n + 1)
    for i in range(n, len(tr)):
        out[i] = a * tr[i] + (1 - a) * out[i - 1]
    return out


def strict_extremes(x: np.ndarray, left: int = 2, right: int = 2) -> np.ndarray:
    """Where x is above all neighbours."""
    ok = np.zeros(len(x), bool)
    if len(x) > left + right:
        mid = x[left : len(x) - right]
        ok[left : len(x) - right] = np.all([mid > x[left + d : len(x) - right + d] for d in (*range(-left, 0), *range(1, right + 1))], axis=0)
    return ok


class Lines:
    """Least-squares lines through the marked points of any window, by prefix sums."""

    def __init__(self, mark: np.ndarray, y: np.ndarray):
        x = np.arange(len(y), dtype=float)
        self.sums = [np.concatenate(([0.0], np.cumsum(np.where(mark, v, 0.0)))) for v in (np.ones(len(y)), x, y, x * y, x * x, y * y)]

    def fit(self, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
        """Count, slope, intercept and r2 for windows [s, e]."""
        return _line(*(c[e + 1] - c[s] for c in self.sums))


def _line(n, sx, sy, sxy, sxx, syy) -> tuple[np.ndarray, ...]:
    with np.errstate(all="ignore"):
        vx, vy, c = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
        m = np.where(vx > 0, c / vx, 0.0)
        r2 = np.where((vx > 0) & (vy > 1e-12), np.clip(c * c / (vx * vy), 0, 1), 0.0)
        return n, m, (sy - m * sx) / n, r2


def side_lines(y: np.ndarray, marks: np.ndarray, length: int, e: np.ndarray, least: int, top: int) -> tuple[np.ndarray, ...]:
    """Lines along one side of the windows [e - length + 1, e]: through the pivots, or, where there
    are too few, through the lower part of the `top` most extreme points (y: larger is more extreme)."""
    s = e - length + 1
    n, m, b, r2 = Lines(marks, y).fit(s, e)
    few = np.flatnonzero(n < least)
    if len(few):
        k = min(top, length)
        take = max(least, k // 2)
        view = np.lib.stride_tricks.sliding_window_view(y, length)[s[few]]
        x = np.argsort(view, axis=1, kind="stable")[:, -k:][:, :take] + s[few][:, None]
        v = y[x]
        f = _line(np.full(len(few), float(x.shape[1])), x.sum(1).astype(float), v.sum(1), (x * v).sum(1), (x * x).sum(1).astype(float), (v * v).sum(1))
        for whole, part in zip((n, m, b, r2), f, strict=True):
            whole[few] = part
    return n, m, b, r2


def _confirmed(close, atr, e, up, m_u, b_u, m_l, b_l, buffer, within=5):
    """First of `within` bars from e on that closes beyond its line by the buffer: place (or -1), entry, stop."""
    found, entry, stop = np.full(len(e), -1), np.full(len(e), np.nan), np.full(len(e), np.nan)
    for d in range(within):
        j = np.minimum(e + d, len(close) - 1)
        hi, lo, thr = m_u * j + b_u, m_l * j + b_l, buffer * atr[j]
        ok = (found < 0) & (e + d < len(close)) & np.where(up, close[j] >= hi + thr, close[j] <= lo - thr)
        found[ok] = j[ok]
        entry[ok] = np.where(up, np.maximum(hi + thr, close[j]), np.minimum(lo - thr, close[j]))[ok]
        stop[ok] = np.where(up, lo - 0.25 * atr[j], hi + 0.25 * atr[j])[ok]
    return found, entry, stop


COLUMNS = "symbol string, type string, dir string, start_idx long, end_idx long, breakout_idx long, upper_slope double, upper_intercept double, lower_slope double, lower_intercept double, quality double, entry double, stop double, target double"


def _rows(symbol, base, kind, up, s, e, found, mu, bu, ml, bl, q, entry, stop, target) -> pd.DataFrame:
    """Rows with absolute bar numbers; intercepts refer to these."""
    return pd.DataFrame({
        "symbol": np.full(len(e), symbol, object), "type": np.broadcast_to(kind, len(e)).astype(object), "dir": np.where(up, "bull", "bear").astype(object), "start_idx": s + base, "end_idx": e + base, "breakout_idx": np.where(found >= 0, (found + base).astype(object), None),
        "upper_slope": mu, "upper_intercept": bu - mu * base, "lower_slope": ml, "lower_intercept": bl - ml * base, "quality": q, "entry": entry, "stop": stop, "target": target,
    })


def _arrays(p: pd.DataFrame):
    p = p.sort_values("bar_idx")
    h, lo, c = (p[k].to_numpy(float) for k in ("high", "low", "close"))
    return int(p["bar_idx"].iloc[0]), h, lo, c, ema_atr(h, lo, c)


def _best_per_end(found: list[pd.DataFrame]) -> pd.DataFrame | None:
    if not found:
        return None
    rows = pd.concat(found)
    return rows.sort_values(["end_idx", "quality", "start_idx"], ascending=[True, False, False], kind="stable").drop_duplicates("end_idx")


def _empty() -> pd.DataFrame:
    return pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in COLUMNS.split(", ")})


def triangles(bars: DataFrame, shortest: int = 12, longest: int = 40, step: int = 2, flat: float = 0.0012, converge: float = 0.20, width_atr: float = 3.5, r2_min: float = 0.20, parallel: float = 0.22, buffer: float = 0.25, chunk: int = CHUNK) -> DataFrame:
    """Ascending, descending and symmetric triangles, the best per end bar."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        base, h, lo, c, atr = _arrays(p)
        core = p["_chunk"].iloc[0] * chunk
        ends = np.arange(len(c))
        ends = ends[(ends + base >= core) & (ends + base < core + chunk) & (ends >= 14 + shortest) & ((ends + base) % step == 0)]
        tops, lows = strict_extremes(h), strict_extremes(-lo)
        mean = lambda x: np.concatenate(([0.0], np.cumsum(x)))
        ca, cc = mean(atr), mean(c)
        pre = Lines(np.ones(len(c), bool), c)
        found = []
        for n in range(shortest, longest + 1, step):
            e = ends[ends - n + 1 >= 14]
            if not len(e):
                continue
            s = e - n + 1
            view = lambda y: np.lib.stride_tricks.sliding_window_view(y, n)  # noqa: E731, B023
            wide = view(h).max(1)[s] - view(lo).min(1)[s]
            ok = (wide <= width_atr * 1.5 * atr[e]) & ((ca[e + 1] - ca[s]) / n <= 0.95 * (ca[s] - ca[s - 14]) / 14)
            e, s = e[ok], s[ok]
            if not len(e):
                continue
            nu, mu, bu, ru = side_lines(h, tops, n, e, 3, 6)
            nl, ml, bl, rl = side_lines(-lo, lows, n, e, 3, 6)
            ml, bl = -ml, -bl
            scale = (cc[e + 1] - cc[s]) / n
            un, ln = mu / np.maximum(np.abs(scale), 1e-9), ml / np.maximum(np.abs(scale), 1e-9)
            ws, we = (mu - ml) * s + bu - bl, (mu - ml) * e + bu - bl
            conv = (ws - we) / np.maximum(ws, 1e-9)
            big = np.maximum(np.maximum(np.abs(un), np.abs(ln)), 1e-9)
            unlike = np.abs(np.abs(un) - np.abs(ln)) / big
            kind = np.where((np.abs(un) <= flat) & (ln > flat), "ascending_triangle", np.where((np.abs(ln) <= flat) & (un < -flat), "descending_triangle", np.where((np.sign(un) * np.sign(ln) < 0) & (unlike <= parallel), "sym_triangle", "")))
            ok = ((ru + rl) / 2 >= r2_min) & (ws > 0) & (we > 0) & (we <= width_atr * atr[e]) & (conv >= converge) & (kind != "")
            if not ok.any():
                continue
            e, s, nu, mu, bu, ru, nl, ml, bl, rl, un, ln, ws, conv, unlike, kind = (v[ok] for v in (e, s, nu, mu, bu, ru, nl, ml, bl, rl, un, ln, ws, conv, unlike, kind))
            up = np.where(kind == "ascending_triangle", True, np.where(kind == "descending_triangle", False, c[e] >= ((mu + ml) * e + bu + bl) / 2))
            at, entry, stop = _confirmed(c, atr, e, up, mu, bu, ml, bl, buffer)
            hi, low = mu * e + bu, ml * e + bl
            entry = np.where(at >= 0, entry, np.where(up, hi, low))
            stop = np.where(at >= 0, stop, np.where(up, low - 0.25 * atr[e], hi + 0.25 * atr[e]))
            j1 = np.maximum(0, e - shortest)
            _, trend, _, _ = pre.fit(np.maximum(0, j1 - 24), j1)
            bias = np.where(kind == "ascending_triangle", trend > 0, np.where(kind == "descending_triangle", trend < 0, 0.5)).astype(float)
            flatness = 1 - np.minimum(1, np.where(kind == "ascending_triangle", np.abs(un) / flat, np.where(kind == "descending_triangle", np.abs(ln) / flat, unlike)))
            q = 0.25 * np.clip((ru + rl) / 2, 0, 1) + 0.35 * np.clip((conv - converge) / (1 - converge), 0, 1) + 0.15 * flatness + 0.15 * np.minimum(1, (np.minimum(nu, nl) - 2) / 3) + 0.10 * bias
            found.append(_rows(p["symbol"].iloc[0], base, kind, up, s, e, at, mu, bu, ml, bl, np.clip(q, 0, 1), entry, stop, np.where(up, entry + ws, entry - ws)))
        best = _best_per_end(found)
        return _empty() if best is None else best

    return chunked(bars.select("symbol", "ts", "high", "low", "close"), WARM + longest, 5, chunk).groupBy("symbol", "_chunk").applyInPandas(run, COLUMNS)


def rectangles(bars: DataFrame, shortest: int = 10, longest: int = 48, flat: float = 0.0009, drift: float = 0.0007, width_atr: float = 3.5, unsteady: float = 0.28, touches: int = 3, touch_atr: float = 0.25, r2_min: float = 0.12, buffer: float = 0.30, chunk: int = CHUNK) -> DataFrame:
    """Rectangles: flat parallel sides with touches on both, the best per end bar."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        base, h, lo, c, atr = _arrays(p)
        core = p["_chunk"].iloc[0] * chunk
        ends = np.arange(len(c))
        ends = ends[(ends + base >= core) & (ends + base < core + chunk) & (ends >= 14 + shortest)]
        tops, lows = strict_extremes(h), strict_extremes(-lo)
        cc = np.concatenate(([0.0], np.cumsum(c)))
        found = []
        for n in range(shortest, longest + 1):
            e = ends[ends - n + 1 >= 14]
            if not len(e):
                continue
            s = e - n + 1
            _, mu, bu, ru = side_lines(h, tops, n, e, 2, 4)
            _, ml, bl, rl = side_lines(-lo, lows, n, e, 2, 4)
            ml, bl = -ml, -bl
            scale = np.maximum(np.abs((cc[e + 1] - cc[s]) / n), 1e-9)
            un, ln, mn = mu / scale, ml / scale, (mu + ml) / 2 / scale
            ws, we = (mu - ml) * s + bu - bl, (mu - ml) * e + bu - bl
            mean = (ws + we) / 2
            std = np.abs(mu - ml) * np.sqrt((n * n - 1) / 12.0)  # of a straight width
            steady = std / np.maximum(mean, 1e-9)
            ok = (np.abs(un) <= flat) & (np.abs(ln) <= flat) & ((ru + rl) / 2 >= r2_min) & (np.abs(mn) <= drift) & (ws > 0) & (we > 0) & (mean <= width_atr * atr[e]) & (steady <= unsteady)
            if not ok.any():
                continue
            e, s, mu, bu, ru, ml, bl, rl, un, ln, mn, ws, steady = (v[ok] for v in (e, s, mu, bu, ru, ml, bl, rl, un, ln, mn, ws, steady))
            w = s[:, None] + np.arange(n)[None, :]
            tol = touch_atr * atr[e][:, None]
            tu = ((np.abs(h[w] - (mu[:, None] * w + bu[:, None])) <= tol) & tops[w]).sum(1)
            tl = ((np.abs(lo[w] - (ml[:, None] * w + bl[:, None])) <= tol) & lows[w]).sum(1)
            ok = (tu >= touches) & (tl >= touches)
            if not ok.any():
                continue
            e, s, mu, bu, ru, ml, bl, rl, un, ln, mn, ws, steady, tu, tl = (v[ok] for v in (e, s, mu, bu, ru, ml, bl, rl, un, ln, mn, ws, steady, tu, tl))
            hi, low = mu * e + bu, ml * e + bl
            up = c[e] >= (hi + low) / 2
            at, entry, stop = _confirmed(c, atr, e, up, mu, bu, ml, bl, buffer)
            entry = np.where(at >= 0, entry, np.where(up, hi, low))
            stop = np.where(at >= 0, stop, np.where(up, low - 0.25 * atr[e], hi + 0.25 * atr[e]))
            q = 0.30 * np.clip((ru + rl) / 2, 0, 1) + 0.25 * (1 - np.minimum(1, np.maximum(np.abs(un), np.abs(ln)) / flat)) + 0.20 * (1 - np.minimum(1, steady / unsteady)) + 0.15 * (np.minimum(1, tu / touches) + np.minimum(1, tl / touches)) / 2 + 0.10 * (1 - np.minimum(1, np.abs(mn) / drift))
            found.append(_rows(p["symbol"].iloc[0], base, "rectangle", up, s, e, at, mu, bu, ml, bl, np.clip(q, 0, 1), entry, stop, np.where(up, entry + ws, entry - ws)))
        best = _best_per_end(found)
        return _empty() if best is None else best

    return chunked(bars.select("symbol", "ts", "high", "low", "close"), WARM + longest, 5, chunk).groupBy("symbol", "_chunk").applyInPandas(run, COLUMNS)


def flags(bars: DataFrame, pole_bars: int = 20, pole_atr: float = 2.5, cons: int = 8, steepest: float = 0.004, parallel: float = 0.20, converge: float = 0.25, width_atr: float = 3.0, contraction: float = 0.75, buffer: float = 0.30, r2_min: float = 0.15, quality_min: float = 0.55, chunk: int = CHUNK) -> DataFrame:
    """Flags and pennants: a pole, then `cons` bars of consolidation; one row per qualifying end bar (D3)."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        base, h, lo, c, atr = _arrays(p)
        core = p["_chunk"].iloc[0] * chunk
        e = np.arange(len(c))
        e = e[(e + base >= core) & (e + base < core + chunk) & (e >= 14 + pole_bars + cons)]
        if not len(e):
            return _empty()
        tip = e - cons
        back = np.arange(pole_bars, 0, -1)
        start = tip[:, None] - back[None, :]
        move = c[tip][:, None] - c[start]
        units = np.abs(move) / (atr[tip][:, None] + 1e-12)
        rate = np.where((units >= pole_atr) & (start >= 14), units / back[None, :], -1.0)
        pick = rate.argmax(1)
        row = np.arange(len(e))
        pole_s, move, units, valid = start[row, pick], move[row, pick], units[row, pick], rate[row, pick] > 0
        s, bull = tip + 1, move > 0
        view = lambda y: np.lib.stride_tricks.sliding_window_view(y, cons)[s]
        ca = np.concatenate(([0.0], np.cumsum(atr)))
        first = np.maximum(pole_s - 14, 0)
        calm, lively = (ca[e + 1] - ca[s]) / cons, (ca[tip + 1] - ca[first]) / (tip + 1 - first)
        valid &= (view(h).max(1) - view(lo).min(1) <= width_atr * atr[e]) & (calm <= contraction * lively)
        nu, mu, bu, ru = side_lines(h, strict_extremes(h), cons, e, 3, 6)
        nl, ml, bl, rl = side_lines(-lo, strict_extremes(-lo), cons, e, 3, 6)
        ml, bl = -ml, -bl
        scale = np.maximum(np.abs(view(c).mean(1)), 1e-9)
        un, ln = mu / scale, ml / scale
        unlike = np.abs(np.abs(un) - np.abs(ln)) / np.maximum(np.maximum(np.abs(un), np.abs(ln)), 1e-9)
        same = (np.sign(un) == np.sign(ln)) & (un != 0)
        kind = np.where(same & (unlike <= parallel), "flag", np.where(~same & (unlike <= converge), "pennant", ""))
        ret = c[e] - c[s]
        valid &= ((ru + rl) / 2 >= r2_min) & (np.abs(un) <= steepest) & (np.abs(ln) <= steepest) & (kind != "") & np.where(bull, ret >= -0.25 * calm, ret <= 0.25 * calm)
        hi, low = mu * e + bu, ml * e + bl
        trigger = np.where(bull, hi + buffer * atr[e], low - buffer * atr[e])
        at = np.where(np.where(bull, h[e] >= trigger, lo[e] <= trigger), e, -1)
        q = 0.30 * np.minimum(units / 5, 1) + 0.30 * np.clip((ru + rl) / 2, 0, 1) + 0.15 * (1 - unlike) + 0.15 * np.clip((1 - calm / (lively + 1e-12)) / (1 - contraction + 1e-9), 0, 1) + 0.10 * np.minimum(1, (np.minimum(nu, nl) - 2) / 3)
        valid &= q >= quality_min
        height = np.abs(c[tip] - c[np.maximum(pole_s, 0)])
        entry = np.where(bull, np.maximum(trigger, hi), np.minimum(trigger, low))
        rows = _rows(p["symbol"].iloc[0], base, kind, bull, s, e, at, mu, bu, ml, bl, np.clip(q, 0, 1), entry, np.where(bull, low - 0.25 * atr[e], hi + 0.25 * atr[e]), np.where(bull, entry + height, entry - height))
        return rows[valid] if valid.any() else _empty()

    return chunked(bars.select("symbol", "ts", "high", "low", "close"), WARM + pole_bars + cons, 5, chunk).groupBy("symbol", "_chunk").applyInPandas(run, COLUMNS)


def exponential_atr(bars: DataFrame, n: int = 14, chunk: int = CHUNK) -> DataFrame:
    """(symbol, ts, bar_idx, ema_atr)."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("bar_idx")
        p["ema_atr"] = ema_atr(*(p[k].to_numpy(float) for k in ("high", "low", "close")), n)
        core = p["_chunk"].iloc[0] * chunk
        return p.loc[(p["bar_idx"] >= core) & (p["bar_idx"] < core + chunk), ["symbol", "ts", "bar_idx", "ema_atr"]]

    return chunked(bars.select("symbol", "ts", "high", "low", "close"), WARM, 0, chunk).groupBy("symbol", "_chunk").applyInPandas(run, "symbol string, ts timestamp_ntz, bar_idx long, ema_atr double")


def band_flag(bars: DataFrame, push: int = 30, cons: int = 40, k: float = 1.0, pole_atr: float = 2.0) -> DataFrame:
    """Flag or pennant of the newest window: a pole before a regression band of the last bars; at most one row a symbol."""
    df = true_range(with_index(bars)).withColumn("atr", gated(F.avg, F.col("tr"), 14))
    frame = by_time().rowsBetween(-(cons - 1), 0)
    x = F.col("bar_idx").cast("double")
    m, b, r2, var = (f.over(frame) for f in (F.regr_slope("close", x), F.regr_intercept("close", x), F.regr_r2("close", x), F.var_pop("close")))
    df = df.withColumns({"pole": F.lag("close", cons).over(by_time()) - F.lag("close", cons + push - 1).over(by_time()), "slope": m, "_b": b, "sigma": F.sqrt(F.greatest(F.lit(0.0), var * (1 - r2))), "_last": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))})
    mid, size = F.col("slope") * F.col("bar_idx") + F.col("_b"), F.abs("pole")
    df = df.filter((F.col("_last") == 1) & (F.col("bar_idx") >= push + cons + 4) & (F.col("atr") > 0) & (F.col("sigma") > 0) & (size >= pole_atr * F.col("atr")))
    kind = F.when(F.abs("slope") < 1e-4, "pennant").when(F.col("slope") > 0, "flag_up").otherwise("flag_dn")
    quality = 65 + F.least(F.lit(20.0), size / F.col("atr") * 3) + F.least(F.lit(10.0), 1 / (F.col("sigma") / F.col("atr") + 1e-6))
    return df.select("symbol", "ts", kind.alias("kind"), F.when(F.col("pole") > 0, "up").otherwise("down").alias("direction_bias"), "pole", "slope", "sigma", (mid + k * F.col("sigma")).alias("upper_now"), (mid - k * F.col("sigma")).alias("lower_now"), quality.alias("quality"))


def _context(bars: DataFrame, lookback: int) -> tuple[DataFrame, DataFrame]:
    """The last bars of each symbol with the slope before them, and the median ATR."""
    df = true_range(with_index(bars)).withColumn("slope_24", slope("close", 24))
    last = df.groupBy("symbol").agg(F.max("bar_idx").alias("_n"))
    df = df.join(last, "symbol").filter(F.col("bar_idx") > F.col("_n") - lookback).drop("_n")
    sub = df.withColumn("_atr", gated(F.avg, F.col("tr"), 14, 8)).withColumn("_atr", F.last("_atr", True).over(by_time()))
    return df, sub.groupBy("symbol").agg(F.median("_atr").alias("atr_med"))


def _judged(found: DataFrame, bars: DataFrame, confirm: int, beyond: float, within: int, tolerance: float) -> DataFrame:
    """Adds confirm_idx and retest_idx of patterns (symbol, pid, side, i2, neck_m, neck_b, atr_med).

    Confirmed: `confirm` closes in a row beyond the neck line by a share of the ATR, from i2 on;
    retested: a bar that meets the line again within the bars after that (or after i2).
    """
    b = bars.select("symbol", F.col("bar_idx").alias("j"), "high", "low", "close")
    line = F.col("neck_m") * F.col("j") + F.col("neck_b")
    j = found.join(b, "symbol").filter("j >= i2")
    ok = F.when(F.col("side") == "down", F.col("close") <= line - beyond * F.col("atr_med")).otherwise(F.col("close") >= line + beyond * F.col("atr_med"))
    frame = Window.partitionBy("symbol", "pid").orderBy("j").rowsBetween(-(confirm - 1), 0)
    j = j.withColumn("_run", F.sum(ok.cast("int")).over(frame))
    hits = j.groupBy("symbol", "pid").agg(F.min(F.when(F.col("_run") >= confirm, F.col("j"))).alias("confirm_idx"))
    out = found.join(hits, ["symbol", "pid"], "left")
    start = F.coalesce("confirm_idx", "i2") + 1
    r = out.join(b, "symbol").filter((F.col("j") >= start) & (F.col("j") <= start + within) & (F.col("high") >= line - tolerance * F.col("atr_med")) & (F.col("low") <= line + tolerance * F.col("atr_med")))
    return out.join(r.groupBy("symbol", "pid").agg(F.min("j").alias("retest_idx")), ["symbol", "pid"], "left")


def double_tops(bars: DataFrame, look: int = 10, lookback: int = 200, equal_atr: float = 0.55, apart: int = 10, depth_atr: float = 0.90) -> DataFrame:
    """Double tops and bottoms among the last bars, quality 0 to 99."""
    df, med = _context(bars, lookback)
    piv = centred_pivots(bars, look).join(df.select("symbol", "bar_idx", "slope_24"), ["symbol", "bar_idx"])
    w = Window.partitionBy("symbol", "kind").orderBy("bar_idx")
    pair = piv.withColumns({"i2": F.lead("bar_idx").over(w), "v2": F.lead("price").over(w)}).withColumnsRenamed({"bar_idx": "i1", "price": "v1"}).join(med, "symbol")
    pair = pair.filter((F.col("i2") - F.col("i1") >= apart) & (F.abs(F.col("v1") - F.col("v2")) <= equal_atr * F.col("atr_med"))).withColumn("pid", F.concat_ws(":", "kind", "i1"))
    span = pair.join(df.select("symbol", F.col("bar_idx").alias("j"), "high", "low"), "symbol").filter("j BETWEEN i1 AND i2")
    neck = span.groupBy("symbol", "pid").agg(F.when(F.first("kind") == "high", F.min("low")).otherwise(F.max("high")).alias("neck_b"))
    top = F.col("kind") == "high"
    p = pair.join(neck, ["symbol", "pid"]).withColumns({"mid": (F.col("v1") + F.col("v2")) / 2, "neck_m": F.lit(0.0), "side": F.when(top, "down").otherwise("up")})
    p = p.withColumn("depth", F.abs(F.col("mid") - F.col("neck_b")) * F.when(top == (F.col("mid") >= F.col("neck_b")), 1).otherwise(-1)).filter(F.col("depth") >= depth_atr * F.col("atr_med"))
    p = _judged(p, df, 2, 0.15, 30, 0.25)
    trend = F.coalesce("slope_24", F.lit(0.0)) * F.when(top, 1).otherwise(-1) > 0
    equal = 1 - F.abs(F.col("v1") - F.col("v2")) / F.greatest(F.lit(1e-9), F.abs("mid"))
    q = 50 + 20 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), equal)) + F.least(F.lit(20.0), 6 * F.greatest(F.lit(0.0), F.col("depth") / F.greatest(F.lit(1e-9), "atr_med") - 0.5)) + F.when(F.col("confirm_idx").isNotNull(), 8).otherwise(0) + F.when(F.col("retest_idx").isNotNull(), 7).otherwise(0) + F.when(trend, 5).otherwise(0) - F.least(F.lit(10.0), F.abs(F.col("i2") - F.col("i1") - 20) * 0.4)
    return p.select("symbol", F.when(top, "double_top").otherwise("double_bottom").alias("kind"), F.col("i1").alias("start_idx"), F.col("i2").alias("end_idx"), F.col("mid").alias("extreme"), F.col("neck_b").alias("neck"), "confirm_idx", "retest_idx", F.greatest(F.lit(0.0), F.least(F.lit(99.0), q)).alias("quality"), F.col("side").alias("direction_bias"))


def head_shoulders(bars: DataFrame, look: int = 10, lookback: int = 260, tol: float = 0.003, apart: int = 10, shoulder_atr: float = 0.60, head_atr: float = 0.80, thin: bool = True) -> DataFrame:
    """Head and shoulders, and inverse, among the last bars, quality 0 to 99 (D6). Tops are thinned to 5 bars apart."""
    df, med = _context(bars, lookback)
    piv = centred_pivots(bars, look).join(df.select("symbol", "bar_idx", "slope_24"), ["symbol", "bar_idx"])
    if thin:
        piv = thinned(piv.filter("kind = 'high'"), 5).unionByName(piv.filter("kind = 'low'"))
    w = Window.partitionBy("symbol", "kind").orderBy("bar_idx")
    t = piv.withColumns({"ih": F.lead("bar_idx").over(w), "vh": F.lead("price").over(w), "i2": F.lead("bar_idx", 2).over(w), "v2": F.lead("price", 2).over(w)}).withColumnsRenamed({"bar_idx": "i1", "price": "v1"}).join(med, "symbol")
    top, a = F.col("kind") == "high", F.col("atr_med")
    margin = F.when(top, F.col("vh") >= F.greatest("v1", "v2") + head_atr * a).otherwise(F.col("vh") <= F.least("v1", "v2") - head_atr * a)
    t = t.filter((F.col("ih") - F.col("i1") >= apart) & (F.col("i2") - F.col("ih") >= apart) & margin & (F.abs(F.col("v1") - F.col("v2")) <= F.greatest(tol * F.greatest(F.abs("vh"), F.lit(1e-9)), shoulder_atr * a))).withColumn("pid", F.concat_ws(":", "kind", "i1"))
    span = t.join(df.select("symbol", F.col("bar_idx").alias("j"), "high", "low"), "symbol").filter("j BETWEEN i1 AND i2")
    inner = F.when(F.col("kind") == "high", F.col("low")).otherwise(-F.col("high"))
    necks = span.groupBy("symbol", "pid").agg(F.min(F.when(F.col("j") <= F.col("ih"), inner)).alias("_l"), F.min(F.when(F.col("j") >= F.col("ih"), inner)).alias("_r"))
    t = t.join(necks, ["symbol", "pid"]).withColumns({"neck_left": F.when(top, F.col("_l")).otherwise(-F.col("_l")), "neck_right": F.when(top, F.col("_r")).otherwise(-F.col("_r")), "side": F.when(top, "down").otherwise("up")})
    t = t.withColumn("neck_m", (F.col("neck_right") - F.col("neck_left")) / (F.col("i2") - F.col("i1"))).withColumn("neck_b", F.col("neck_left") - F.col("neck_m") * F.col("i1"))
    t = _judged(t, df, 2, 0.15, 30, 0.25)
    centre, sign = (F.col("neck_left") + F.col("neck_right")) / 2, F.when(top, 1).otherwise(-1)
    gap_l, gap_r = F.col("ih") - F.col("i1"), F.col("i2") - F.col("ih")
    unit = F.greatest(F.lit(1e-9), a)
    depth = F.greatest(F.lit(0.0), (F.col("vh") - centre) * sign / unit)
    q = 45 + 20 * F.greatest(F.lit(0.0), 1 - F.abs(F.col("v1") - F.col("v2")) / F.greatest(F.lit(1e-6), F.abs("v1"), F.abs("v2"))) + F.least(F.lit(18.0), 6 * F.greatest(F.lit(0.0), depth - 0.5)) + F.when(F.col("confirm_idx").isNotNull(), 8).otherwise(0) + F.when(F.col("retest_idx").isNotNull(), 6).otherwise(0) + F.when(F.coalesce("slope_24", F.lit(0.0)) * sign > 0, 5).otherwise(0) + 5 * F.greatest(F.lit(0.0), 1 - F.abs(gap_l - gap_r) / F.greatest(gap_l, gap_r, F.lit(1))) - F.least(F.lit(12.0), F.abs("neck_m") / unit * 6)
    return t.select("symbol", F.when(top, "head_shoulders").otherwise("inverse_head_shoulders").alias("kind"), F.col("i1").alias("start_idx"), F.col("i2").alias("end_idx"), F.col("vh").alias("extreme"), centre.alias("neck"), "confirm_idx", "retest_idx", F.greatest(F.lit(0.0), F.least(F.lit(99.0), q)).alias("quality"), F.col("side").alias("direction_bias"))


def all_patterns(*tables: tuple[DataFrame, Column]) -> DataFrame:
    """Pattern tables of different columns as one, each with the scale of its quality (O1)."""
    out = None
    for df, scale in tables:
        df = df.withColumn("scale", scale)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def with_boundaries(patterns: DataFrame) -> DataFrame:
    """Patterns of any table in the columns that boundaries and targets need: (symbol, pid, kind, quality,
    upper, lower, neck, extreme, height); those that a table lacks are NULL. Lines are read at the
    pattern's end; a pattern with an entry and a target measures the distance between them."""
    names = set(patterns.columns)
    have = lambda c: F.col(c) if c in names else F.lit(None).cast("double")
    kind = F.col("type") if "type" in names else F.col("kind")
    at = next(c for c in ("start_idx", "ts") if c in names)
    line = lambda side: F.col(f"{side}_slope") * F.col("end_idx") + F.col(f"{side}_intercept") if f"{side}_slope" in names else have(f"{side}_now")
    height = F.abs(F.col("target") - F.col("entry")) if "target" in names else F.abs(have("pole"))
    return patterns.select("symbol", F.concat_ws(":", kind, F.col(at).cast("string")).alias("pid"), kind.alias("kind"), "quality", line("upper").alias("upper"), line("lower").alias("lower"), have("neck").alias("neck"), have("extreme").alias("extreme"), height.alias("height"))


def latest_pattern(patterns: DataFrame) -> DataFrame:
    """The pattern of each symbol that ends last, the better of equals first."""
    w = Window.partitionBy("symbol").orderBy(F.desc("end_idx"), F.desc(F.round("quality", 9)), "start_idx")
    return patterns.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def best_patterns(patterns: DataFrame, k: int = 10, least: float = 0.0, order: str = "end_idx") -> DataFrame:
    """The best k of each symbol by quality, the later of equals first."""
    w = Window.partitionBy("symbol").orderBy(F.desc(F.round("quality", 9)), F.desc(order))
    return patterns.filter(F.col("quality") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
