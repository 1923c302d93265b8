"""Row-wise column functions: safe division, candles, sessions, expected value, decisions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def safe_div(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is next to 0."""
    return F.when(F.abs(b) < EPS, F.lit(0.0)).otherwise(a / b)


def rounded_half(x: Column, digits: int) -> Column:
    """x to digits, halves away from zero, as SQL does it: scaled, rounded and divided as a double.

    F.round takes the decimal that a double is printed as, so it parts from SQL where that ends in 5.
    """
    scaled = x * 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / 10.0**digits).otherwise(x)


def candle(o: Column, h: Column, lo: Column, c: Column) -> dict[str, Column]:
    """Range over close, and body and wicks as shares of the range."""
    rng = h - lo
    return {"range_pct": safe_div(rng, c), "body_ratio": safe_div(F.abs(c - o), rng), "wick_up_ratio": safe_div(h - F.greatest(o, c), rng), "wick_dn_ratio": safe_div(F.least(o, c) - lo, rng)}


def hour_cycle(ts: Column) -> tuple[Column, Column]:
    """Sine and cosine of the hour of day."""
    angle = F.hour(ts) * F.lit(2 * math.pi / 24)
    return F.sin(angle), F.cos(angle)


def session_flags(ts: Column) -> dict[str, Column]:
    """Tokyo 9-15, London 16-24, New York 22-5; the last two overlap."""
    h = F.hour(ts)
    return {"sess_tokyo": ((h >= 9) & (h < 15)).cast("int"), "sess_london": (h >= 16).cast("int"), "sess_ny": ((h >= 22) | (h < 5)).cast("int")}


def session_name(ts: Column) -> Column:
    """The first of Tokyo, London, NY that holds, else Other (P5)."""
    h = F.hour(ts)
    return F.when((h >= 9) & (h < 15), "Tokyo").when(h >= 16, "London").when(h < 5, "NY").otherwise("Other")


def session_for_scoring(ts: Column) -> Column:
    """As scoring assigns it: later sessions win, so 22 and 23 h are New York; else empty (M5)."""
    h = F.hour(ts)
    return F.when((h >= 22) | (h < 5), "NY").when(h >= 16, "London").when((h >= 9) & (h < 15), "Tokyo").otherwise("")


def expected_r(p: Column, win: float = 1.0, loss: float = 1.0, cost: float = 0.0) -> Column:
    """Expected value of a trade in units of risk."""
    return p * win - (1 - p) * loss - cost


def wick_ratios(o: Column, h: Column, lo: Column, c: Column) -> tuple[Column, Column]:
    """Upper and lower wick over the body, the body at least 1e-9."""
    body = F.greatest(F.abs(c - o), F.lit(EPS))
    return F.greatest(h - F.greatest(o, c), F.lit(0.0)) / body, F.greatest(F.least(o, c) - lo, F.lit(0.0)) / body


def regime(low: Column, mid: Column, high: Column) -> Column:
    """The first regime flag above one half."""
    return F.when(low > 0.5, "low").when(mid > 0.5, "mid").when(high > 0.5, "high")


#: What each regime adds to the threshold (fixed values).
REGIME_BUMPS = {"low": 0.0, "mid": 0.02, "high": 0.03}


def effective_theta(theta: Column, reg: Column, soft_news: Column, bumps: dict[str, float] | None = None, news_bump: float = 0.03) -> Column:
    """Threshold raised by regime and nearby news, kept in 0.50 to 0.99."""
    bump = F.lit(0.0)
    for name, x in (REGIME_BUMPS if bumps is None else bumps).items():
        bump = F.when(reg == name, x).otherwise(bump)
    return F.greatest(F.lit(0.5), F.least(F.lit(0.99), theta + bump + F.when(soft_news, news_bump).otherwise(0.0)))


def recommend(p: Column, theta: Column, ev: Column, wick: Column, hard_news: Column, spread: Column, max_spread: float = 0.03, min_ev: float = 0.0, long_wick: float = 2.5, prefer_limit: bool = False) -> tuple[Column, Column, Column]:
    """Action (skip, limit_retest, market), the reasons for it, and the expected value where it was asked for.

    The first of news, spread, probability and expected value that fails is the reason to skip;
    wick is the longer wick over the body.
    """
    gates = (("news", hard_news), ("spread", spread > max_spread), ("probability", p < theta), ("expected value", ev < min_ev))
    skip = F.lit(None).cast("string")
    for name, fails in reversed(gates):
        skip = F.when(fails, name).otherwise(skip)
    limit = (wick >= long_wick) | F.lit(prefer_limit)
    reasons = F.when(skip.isNotNull(), F.array(skip)).otherwise(F.array_compact(F.array(F.when(wick >= long_wick, "long wick"), F.when(limit, "retest preferred"))))
    action = F.when(skip.isNotNull(), "skip").when(limit, "limit_retest").otherwise("market")
    return action, reasons, F.when(~F.coalesce(skip.isin("news", "spread", "probability"), F.lit(False)), ev)


#: Price of one pip: of symbols that end in JPY, and of others (fixed values).
PIP_JPY, PIP = 0.01, 0.0001


def pip_size(symbol: Column, table: dict[str, float] | None = None) -> Column:
    """Price of one pip of a symbol: by the table, else by its quote currency."""
    out = F.when(F.upper(symbol).endswith("JPY"), PIP_JPY).otherwise(PIP)
    for name, size in (table or {}).items():
        out = F.when(symbol == name, size).otherwise(out)
    return out


def extra_cost(commission: float = 0.0, slippage: float = 0.0, gap: float = 0.0) -> float:
    """Pips that a trade costs beside the spread."""
    return commission + slippage + gap


def pips(exit_: Column, entry: Column, direction: Column, pip: Column | float = 0.01, spread: float = 0.0) -> Column:
    """Move in pips in the trade's direction, less the spread."""
    return (exit_ - entry) * direction / pip - spread


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of a share."""
    p = k / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.greatest(F.lit(0.0), (mid - half) / scale), F.least(F.lit(1.0), (mid + half) / scale)


def psi_severity(psi: Column) -> Column:
    """OK below 0.10, WARN below 0.25, else DRIFT (P20)."""
    return F.when(psi < 0.10, "OK").when(psi < 0.25, "WARN").otherwise("DRIFT")


#: Kinds with two boundaries, and those with the neck alone, above or below (fixed values).
TWO_SIDED = ("ascending_triangle", "descending_triangle", "symmetric_triangle", "rectangle", "flag_up", "flag_dn", "flag", "pennant")
NECK_ABOVE, NECK_BELOW = ("double_bottom", "inverse_head_shoulders"), ("double_top", "head_shoulders")


def pattern_boundaries(kind: Column, upper: Column, lower: Column, neck: Column) -> tuple[Column, Column]:
    """The levels whose break a pattern waits for: both lines, or the neck on one side."""
    return F.when(kind.isin(*TWO_SIDED), upper).when(kind.isin(*NECK_ABOVE), neck), F.when(kind.isin(*TWO_SIDED), lower).when(kind.isin(*NECK_BELOW), neck)


def measured_move(kind: Column, height: Column, extreme: Column, neck: Column) -> Column:
    """Size of the move that a pattern measures: its height (a flag's pole), or from extreme to neck."""
    return F.coalesce(F.when(kind.isin(*TWO_SIDED), height).when(kind.isin(*NECK_ABOVE, *NECK_BELOW), F.abs(extreme - neck)), F.lit(0.0))
