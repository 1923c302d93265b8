"""Labels: breakouts with settlement and triple barriers, directions, level crosses."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import by_time, gated, true_range, with_index


@dataclass(frozen=True)
class BreakConfig:
    """How a break is found, confirmed and judged."""

    horizon: int = 12
    lookback: int = 48
    buffer_mode: str = "atr"
    buffer: float = 0.15
    settle_bars: int = 2
    settle_atr: float = 0.15
    up_r: float = 1.0
    down_r: float = 1.0
    timeout: int = 48


def _first(values: Column, test) -> Column:
    """1-based place of the first element that passes, NULL if none does."""
    place = F.array_position(F.transform(values, lambda v: F.coalesce(test(v), F.lit(False))), F.lit(True))
    return F.when(place > 0, place)


def first_barrier(high: Column, low: Column, up: Column, down: Column, left: Column) -> tuple[Column, Column]:
    """Outcome (tp, sl, to) and offset of the exit, from the following highs and lows; tp wins ties."""
    tp, sl = _first(high, lambda v: v >= up), _first(low, lambda v: v <= down)
    outcome = F.when(tp.isNull() & sl.isNull(), "to").when(sl.isNull() | (tp <= sl), "tp").otherwise("sl")
    return outcome, F.coalesce(F.least(tp, sl), left).cast("long")


def with_ahead(bars: DataFrame, lookback: int, horizon: int, timeout: int) -> DataFrame:
    """bars with their levels (of the previous `lookback` bars, unless they have some), atr, and the following
    2 * horizon + timeout highs, lows and closes, and atr: what break labels up to that horizon look at."""
    df = true_range(with_index(bars))
    if "level_up" not in bars.columns:
        df = df.withColumns({"level_up": gated(F.max, F.col("high"), lookback, shift=1), "level_dn": gated(F.min, F.col("low"), lookback, shift=1)})
    df = df.withColumn("atr", gated(F.avg, F.col("tr"), 14)).withColumn("atr", F.last("atr", True).over(by_time()))
    ahead = {f"_{c}": F.collect_list(c).over(by_time().rowsBetween(1, 2 * horizon + timeout)) for c in ("high", "low", "close")} | {"_atrs": F.collect_list(F.coalesce("atr", F.lit(float("nan")))).over(by_time().rowsBetween(1, 2 * horizon))}
    return df.withColumns(ahead).withColumn("_left", F.size("_close"))


def break_labels(bars: DataFrame, cfg: BreakConfig = BreakConfig(), excluded: Column | None = None) -> DataFrame:
    """Break, settle and triple-barrier label of every bar.

    Looks ahead over arrays of at most 2 * horizon + timeout following bars, in the partitioning
    and order that all bar windows share; `excluded` marks bars inside event windows. Bars come
    with level_up and level_dn, or get the extremes of the previous `lookback` bars.
    """
    return judged(with_ahead(bars, cfg.lookback, cfg.horizon, cfg.timeout), cfg, excluded)


def label_grid(bars: DataFrame, configs: list[BreakConfig]) -> DataFrame:
    """(symbol, ts, y0, y1, ...): the labels of break_labels for each configuration; these share lookback and
    timeout, so the bars are windowed once, and arrays of a batch of bars are judged for all of them (M7)."""
    lookback, timeout = configs[0].lookback, configs[0].timeout
    if any((c.lookback, c.timeout, c.buffer_mode) != (lookback, timeout, "atr") for c in configs):
        raise ValueError("configurations of one grid share lookback and timeout, and have buffers in ATR")
    reach = 2 * max(c.horizon for c in configs) + timeout
    df = with_ahead(bars, lookback, max(c.horizon for c in configs), timeout)
    rows = df.select("symbol", "ts", "level_up", "level_dn", "atr", *[F.col(c).alias(c[1:]) for c in ("_high", "_low", "_close", "_atrs")])

    def padded(column: pa.Array, width: int) -> np.ndarray:
        """Lists as rows of a matrix, NaN beyond their ends."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        out = np.full((len(size), width), np.nan)
        out[np.arange(width) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            up, dn, atr = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3, 4))
            high, low, close, atrs = (padded(batch.column(i), reach) for i in (5, 6, 7, 8))
            ys = [judge_rows(up, dn, atr, high, low, close, atrs, c) for c in configs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(np.maximum(y, 0), pa.int32(), mask=y < 0) for y in ys]], names=["symbol", "ts", *[f"y{i}" for i in range(len(ys))]])

    ts = dict(rows.dtypes)["ts"]
    return rows.mapInArrow(run, f"symbol string, ts {ts}, " + ", ".join(f"y{i} int" for i in range(len(configs))))


def _place(hits: np.ndarray) -> np.ndarray:
    """0-based place of the first hit in each row; the width where there is none."""
    return np.where(hits.any(axis=1), hits.argmax(axis=1), hits.shape[1])


def judge_rows(up: np.ndarray, dn: np.ndarray, atr: np.ndarray, high: np.ndarray, low: np.ndarray, close: np.ndarray, atrs: np.ndarray, cfg: BreakConfig) -> np.ndarray:
    """Labels (0, 1, -1 for none) of bars from what follows them: the same as break_labels, on arrays."""
    h, none, row = cfg.horizon, close.shape[1], np.arange(len(up))
    with np.errstate(invalid="ignore"):
        size = cfg.buffer * atr
        above, below = _place(high[:, :h] >= (up + size)[:, None]), _place(low[:, :h] <= (dn - size)[:, None])
        rises, breaks = (above < h) & (above <= below), (above < h) | (below < h)
        at = np.where(rises, above, below)
        # Closes beyond the settle line from the break on, settle_bars in a row, within the horizon.
        line = np.where(rises, up + cfg.settle_atr * atr, dn - cfg.settle_atr * atr)
        beyond = np.where(rises[:, None], close >= line[:, None], close <= line[:, None])
        runs = np.zeros_like(beyond)
        s = cfg.settle_bars
        for j in range(s - 1, none):
            runs[:, j] = beyond[:, j - s + 1 : j + 1].all(axis=1)
        place = np.arange(none)
        settle = _place(runs & (place >= (at + s - 1)[:, None]) & (place < (at + h)[:, None]))
        settled = breaks & (settle < none)
        here = np.minimum(settle, none - 1)
        entry, now = close[row, here], atrs[row, here]
        later = (place > here[:, None]) & (place <= (here + cfg.timeout)[:, None])
        tp, sl = _place((high >= (entry + cfg.up_r * now)[:, None]) & later), _place((low <= (entry - cfg.down_r * now)[:, None]) & later)
        won = settled & (tp < none) & (tp <= sl)
        out = won.astype(np.int32)
        left = (~np.isnan(close)).sum(axis=1)
        return np.where((left <= h) | np.isnan(up) | np.isnan(dn) | (atr <= 0), -1, out)


def judged(df: DataFrame, cfg: BreakConfig, excluded: Column | None = None) -> DataFrame:
    """The labels of bars with what lies ahead of them."""
    h = cfg.horizon
    size = {"atr": lambda level: F.lit(cfg.buffer) * F.col("atr"), "pct": lambda level: level * cfg.buffer, "abs": lambda level: F.lit(cfg.buffer)}[cfg.buffer_mode]
    up, dn = F.col("level_up"), F.col("level_dn")
    near = {k: F.slice(f"_{k}", 1, h) for k in ("high", "low")}
    df = df.withColumns({"_up": _first(near["high"], lambda v: v >= up + size(up)), "_dn": _first(near["low"], lambda v: v <= dn - size(dn))})
    side = F.when(F.col("_up").isNotNull() & (F.col("_dn").isNull() | (F.col("_up") <= F.col("_dn"))), "up").when(F.col("_dn").isNotNull(), "dn").otherwise("")
    df = df.withColumn("_side", side).withColumn("_tb", F.when(F.col("_side") == "up", F.col("_up")).otherwise(F.col("_dn")))
    # From t_break on: closes beyond the settle line, settle_bars in a row, within the horizon.
    line_up, line_dn = up + cfg.settle_atr * F.col("atr"), dn - cfg.settle_atr * F.col("atr")
    beyond = F.transform(F.slice("_close", F.coalesce("_tb", F.lit(1)).cast("int"), F.lit(h)), lambda c: F.when(F.col("_side") == "up", c >= line_up).otherwise(c <= line_dn))
    df = df.withColumn("_beyond", beyond)
    s = cfg.settle_bars
    runs = F.transform(F.sequence(F.lit(1), F.lit(h)), lambda i: (F.size("_beyond") >= i) & (i >= s) & F.forall(F.slice("_beyond", F.greatest(i - s + 1, F.lit(1)), F.lit(s)), lambda b: F.coalesce(b, F.lit(False))))
    settled = F.array_position(runs, F.lit(True))
    df = df.withColumn("_ts", F.when(F.col("_tb").isNotNull() & (settled > 0), F.col("_tb") + settled - 1).cast("int"))
    entry, atr = F.element_at("_close", F.coalesce("_ts", F.lit(1))), F.element_at("_atrs", F.coalesce("_ts", F.lit(1)))
    later = {k: F.slice(f"_{k}", F.coalesce("_ts", F.lit(1)) + 1, cfg.timeout) for k in ("high", "low")}
    ready = (F.col("_left") > h) & F.col("_ts").isNotNull()
    outcome, exit_at = first_barrier(later["high"], later["low"], entry + cfg.up_r * atr, entry - cfg.down_r * atr, F.size(later["high"]))
    df = df.withColumns({"_outcome": F.when(ready, outcome), "_exit": F.when(ready, exit_at)})
    tail = F.col("_left") <= h
    event = F.coalesce(excluded, F.lit(False)) if excluded is not None else F.lit(False)
    reason = F.when(tail, "tail").when(event, "event").when(up.isNull() | dn.isNull() | (F.col("atr") <= 0), "insufficient").when(F.col("_tb").isNull(), "no_break").when(F.col("_ts").isNull(), "no_settle").otherwise("ok")
    df = df.withColumn("reason", reason)
    broke, ok, i = F.col("reason").isin("no_settle", "ok"), F.col("reason") == "ok", F.col("bar_idx")
    return df.select(
        "symbol", "ts", i, F.when(F.col("reason").isin("no_break", "no_settle"), 0).when(ok, (F.col("_outcome") == "tp").cast("int")).alias("y"), F.when(broke, F.col("_side")).otherwise("").alias("side"),
        F.when(broke, i + F.col("_tb")).alias("t_break"), F.when(ok, i + F.col("_ts")).alias("t_settle"), F.when(ok, F.col("_outcome")).otherwise("").alias("outcome"), F.when(ok, i + F.col("_ts") + F.col("_exit")).alias("t_exit"), "reason",
    )


def direction_labels(bars: DataFrame, h: int = 12, band: float = 0.0005) -> DataFrame:
    """Forward return over h bars, and whether it passes a dead band upwards or downwards (L2)."""
    ret = F.lead("close", h).over(by_time()) / F.when(F.abs("close") >= 1e-9, F.col("close")) - 1
    return bars.withColumn("fwd_ret", ret).withColumns({"y_up": (F.col("fwd_ret") > band).cast("int"), "y_down": (F.col("fwd_ret") < -band).cast("int")})


def simple_break_label(bars: DataFrame, h: int = 12, band: float = 0.0005, forward: bool = True) -> DataFrame:
    """1 where the price leaves close * (1 +- band) in the next h bars (L3).

    forward=False gives the frame of the legacy label: rows -(h-2) to 1, shifted by h; too few rows give 0.
    """
    frame = by_time().rowsBetween(1, h) if forward else by_time().rowsBetween(-(h - 2), 1)
    full = F.count("close").over(frame) >= h
    high, low = F.when(full, F.max("high").over(frame)), F.when(full, F.min("low").over(frame))
    if forward:
        return bars.withColumns({"_h": high, "_l": low}).withColumn("y", F.when(F.col("_h").isNotNull(), ((F.col("_h") >= F.col("close") * (1 + band)) | (F.col("_l") <= F.col("close") * (1 - band))).cast("int"))).drop("_h", "_l")
    df = bars.withColumns({"_h": high, "_l": low}).withColumns({"_h": F.lag("_h", h).over(by_time()), "_l": F.lag("_l", h).over(by_time())})
    return df.withColumn("y", F.coalesce(((F.col("_h") >= F.col("close") * (1 + band)) | (F.col("_l") <= F.col("close") * (1 - band))).cast("int"), F.lit(0))).drop("_h", "_l")


def level_crosses(bars: DataFrame, levels: DataFrame, n: int = 12, buffer: float = 0.0) -> DataFrame:
    """Bars that close across a level of their symbol, up and down, with the move over n bars.

    The join is by symbol; levels are few per symbol, so a row meets tens of them.
    """
    df = bars.withColumns({"prev_low": F.lag("low").over(by_time()), "prev_high": F.lag("high").over(by_time()), "exit": F.lead("close", n).over(by_time())}).filter("exit IS NOT NULL")
    j = df.join(levels.select("symbol", "level"), "symbol")
    up = j.filter((F.col("close") > F.col("level") + buffer) & (F.col("prev_low") <= F.col("level"))).withColumn("dir", F.lit(1))
    dn = j.filter((F.col("close") < F.col("level") - buffer) & (F.col("prev_high") >= F.col("level"))).withColumn("dir", F.lit(-1))
    return up.unionByName(dn).withColumn("move", (F.col("exit") - F.col("close")) * F.col("dir"))
