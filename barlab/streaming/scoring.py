"""Live scores: features, probability, threshold and gate of every new bar, from keyed state.

The state of a symbol is its last RING bars, which all finite frames of the model's features fit
into. A new bar is scored from the state alone: no table is read again. Bars that are not newer
than the newest one known are late: they are counted and dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import EPS, REGIME_BUMPS
from ..operators.model import FEATURES

#: Bars of a symbol that are kept.
RING = 210
#: The threshold's rise near an event that is not excluded.
NEWS_BUMP = 0.03
OUT = "symbol string, ts timestamp_ntz, p double, session string, theta double, in_news boolean, trade boolean, late long"
STATE = "ts array<long>, open array<double>, high array<double>, low array<double>, close array<double>, late long"


@dataclass(frozen=True)
class Score:
    """A linear model on plain features, the thresholds of sessions, and each symbol's cuts of atr14 (0.33, 0.66, 0.5)."""

    weights: dict[str, float]
    intercept: float
    theta: dict[str, float]
    cuts: dict[str, tuple[float, float, float]]
    run_ev: float = 1.0
    hard: tuple[tuple[datetime, datetime], ...] = field(default=())
    soft: tuple[tuple[datetime, datetime], ...] = field(default=())


def linear_model(model: PipelineModel, features: tuple[str, ...] = FEATURES) -> tuple[dict[str, float], float]:
    """Weights of the plain features and intercept of a fitted pipeline of scaler and logistic regression."""
    scaler, fit = model.stages[1], model.stages[2]
    scale, mean = scaler.std.toArray(), scaler.mean.toArray()
    w = np.where(scale > 0, fit.coefficients.toArray() / np.where(scale > 0, scale, 1), 0.0)
    return dict(zip(features, w.tolist(), strict=True)), float(fit.intercept - w @ mean)


def rolled(x: np.ndarray, n: int, f, least: int | None = None) -> np.ndarray:
    """f over the last n values, NaN until `least` (default n) of them are there."""
    w = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.full(n - 1, np.nan), x)), n)
    enough = (~np.isnan(w)).sum(axis=1) >= (n if least is None else least)
    out = np.full(len(x), np.nan)
    if enough.any():
        out[enough] = f(w[enough], axis=1)
    return out


def before(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate((np.full(min(k, len(x)), np.nan), x[: max(0, len(x) - k)]))


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(np.abs(b) < EPS, 0.0, a / np.where(np.abs(b) < EPS, 1, b))


def bar_features(ts: np.ndarray, o: np.ndarray, h: np.ndarray, lo: np.ndarray, c: np.ndarray, cuts: tuple[float, float, float]) -> dict[str, np.ndarray]:
    """The model's features (and atr14) of consecutive bars of one symbol, as the feature table has them, NaN as 0."""
    nz = lambda x: np.where(np.abs(x) >= 1e-9, x, np.nan)
    with np.errstate(invalid="ignore", divide="ignore"):
        last = before(c, 1)
        tr = np.fmax(h - lo, np.fmax(np.abs(h - last), np.abs(lo - last)))
        atr, atr56 = rolled(tr, 14, np.mean), rolled(tr, 56, np.mean)
        ret = {k: c / nz(before(c, k)) - 1 for k in (1, 4, 8, 12)}
        v = np.nan_to_num(atr / nz(c)) + 1e-8
        z = ratio(c - rolled(c, 20, np.mean), rolled(c, 20, np.std))
        x = np.arange(6) - 2.5
        slope = rolled(c, 6, lambda w, axis: (w * x).sum(axis=axis) / (x * x).sum())
        ma = rolled(c, 96, np.nanmean, 30)
        touch = (h == rolled(h, 48, np.nanmax, 10)).astype(float) + (lo == rolled(lo, 48, np.nanmin, 10))
        hour = (ts // 3_600_000_000) % 24
        level = np.where(np.isnan(atr), cuts[2], atr)
        out = {f"ret_{k}": r for k, r in ret.items()} | {
            "range_pct": ratio(h - lo, c), "body_ratio": ratio(np.abs(c - o), h - lo), "wick_up_ratio": ratio(h - np.maximum(o, c), h - lo), "wick_dn_ratio": ratio(np.minimum(o, c) - lo, h - lo),
            "atr14": atr, "atr14_norm": ratio(atr, c), "atr_ratio": ratio(atr, atr56), "d_atr14": atr / nz(before(atr, 1)) - 1, "rv_20": rolled(ret[1], 20, np.std), "z_close_20": z,
            "slope_short_6_v": ratio(slope, c) / v, "slope_long": (ma - before(ma, 12)) / 12, "touch_density": rolled(touch, 48, np.nansum, 10), "high_low_ratio_20": ratio(rolled(h, 20, np.max), rolled(lo, 20, np.min)),
            "hour_sin": np.sin(hour * 2 * np.pi / 24), "hour_cos": np.cos(hour * 2 * np.pi / 24), "sess_tokyo": (hour >= 9) & (hour < 15), "sess_london": hour >= 16, "sess_ny": (hour >= 22) | (hour < 5),
            "reg_atr_low": level <= cuts[0], "reg_atr_high": level > cuts[1], "ret_8_v_sq": (ret[8] / v) ** 2, "z_close_20_sq": z**2,
        }
    return {k: np.nan_to_num(np.asarray(x, float)) for k, x in out.items()}


def judged(score: Score, symbol: str, ts: np.ndarray, features: dict[str, np.ndarray]) -> pd.DataFrame:
    """Probability, session, threshold, news and trade of bars with their features."""
    margin = sum((features[k] * w for k, w in score.weights.items()), np.zeros(len(ts))) + score.intercept
    p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
    hour = (ts // 3_600_000_000) % 24
    session = np.select([(hour >= 22) | (hour < 5), hour >= 16, (hour >= 9) & (hour < 15)], ["NY", "London", "Tokyo"], "")
    micros = lambda windows: [tuple(int(pd.Timestamp(t).value // 1000) for t in w) for w in windows]
    inside = lambda windows: np.any([(ts >= a) & (ts <= b) for a, b in micros(windows)] or [np.zeros(len(ts), bool)], axis=0)
    low, high = features["reg_atr_low"] > 0.5, features["reg_atr_high"] > 0.5
    bump = np.select([low, ~low & ~high], [REGIME_BUMPS["low"], REGIME_BUMPS["mid"]], REGIME_BUMPS["high"]) + np.where(inside(score.soft), NEWS_BUMP, 0.0)
    theta = np.clip(np.array([score.theta.get(s, score.theta[""]) for s in session]) + bump, 0.5, 0.99)
    news = inside(score.hard)
    return pd.DataFrame({"symbol": symbol, "ts": pd.to_datetime(ts, unit="us"), "p": p, "session": session, "theta": theta, "in_news": news, "trade": (p >= theta) & ~news & (score.run_ev > 0)})


def live_scores(bars: DataFrame, score: Score) -> DataFrame:
    """OUT of each new bar of a stream of closed bars (symbol, ts, open, high, low, close); late is the number of
    late bars of the symbol so far. Windows of `score` come from a calendar, a few thousand at most."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        symbol = key[0]
        held = list(state.get) if state.exists else [[], [], [], [], [], 0]
        new = pd.concat(list(batches)).sort_values("ts")
        new["_u"] = new["ts"].astype("datetime64[us]").astype("int64")
        fresh = new[new["_u"] > (held[0][-1] if held[0] else -(2**63))].drop_duplicates("_u")
        late = int(held[5]) + len(new) - len(fresh)
        ring = [np.concatenate((np.array(h, kind), fresh[c].to_numpy(kind))) for h, c, kind in zip(held, ("_u", "open", "high", "low", "close"), (np.int64, *[float] * 4))]
        if len(fresh):
            features = bar_features(*ring, score.cuts.get(symbol, (0.0, 0.0, 0.0)))
            at = slice(len(held[0]), None)
            yield judged(score, symbol, ring[0][at], {k: x[at] for k, x in features.items()}).assign(late=late)
        state.update(tuple([*(x[-RING:].tolist() for x in ring), late]))

    columns = bars.select("symbol", "ts", "open", "high", "low", "close")
    return columns.groupBy("symbol").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
