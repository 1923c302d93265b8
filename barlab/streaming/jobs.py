"""Streaming jobs: closed bars from ticks, live features, drift buffers and alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import news as J
from ..operators.backtest import last_bar_alerts
from ..operators.features import feature_table
from ..operators.monitor import freshness

#: Bars before a new one that all finite frames need.
HALO_BARS = 210
#: Probabilities that a drift buffer keeps, that it compares, and that it needs.
KEEP, RECENT, NEEDED = 3000, 1000, 200


def closed_bars(ticks: DataFrame, minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """Bars of ticks (symbol, ts, value); in append mode a bar comes once it is closed."""
    w = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", f"{minutes} minutes").alias("w"))
    t = F.col("ts")
    bars = w.agg(F.min_by("value", t).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", t).alias("close"), F.count("*").alias("volume"))
    return bars.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def with_halo(bars: DataFrame, new: DataFrame, days: int) -> DataFrame:
    """The bars of the new bars' symbols from `days` before the first new one on."""
    first = new.groupBy("symbol").agg(F.min("ts").alias("_first"))
    return bars.join(first, "symbol").filter(F.col("ts") >= F.col("_first") - F.make_dt_interval(F.lit(days))).drop("_first")


def recent_bars(spark: SparkSession, table: str, new: DataFrame, days: int) -> DataFrame:
    """The table's bars from `days` before the first new one on, once each: older files are not read."""
    first = new.agg(F.min("ts")).first()[0]
    return spark.read.parquet(table).drop("epoch").filter(F.col("ts") >= F.lit(first) - F.make_dt_interval(F.lit(days))).dropDuplicates(["symbol", "ts"])


def live_features(spark: SparkSession, stream: DataFrame, table: str, sink: Callable[[DataFrame, int], None], checkpoint: str, halo_days: int = 30) -> StreamingQuery:
    """Features of each new bar, computed from the bar table, to the sink.

    A micro-batch first enters the table (rows of its epoch replace those of an earlier try), then
    the batch job runs over the bars around it; only new bars go on.
    """

    def step(new: DataFrame, epoch: int) -> None:
        if new.isEmpty():
            return
        new.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")
        bars = recent_bars(spark, table, new, halo_days)
        out = feature_table(with_halo(bars, new, halo_days)).join(new.select("symbol", "ts"), ["symbol", "ts"], "left_semi")
        sink(out, epoch)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_alerts(spark: SparkSession, stream: DataFrame, table: str, levels: DataFrame, windows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, halo_days: int = 30) -> StreamingQuery:
    """Alerts at the newest bars outside event windows (T4)."""

    def step(new: DataFrame, epoch: int) -> None:
        if new.isEmpty():
            return
        new.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")
        bars = recent_bars(spark, table, new, halo_days)
        alerts = last_bar_alerts(bars.join(new.select("symbol").distinct(), "symbol", "left_semi"), levels)
        sink(J.in_any_window(alerts, windows, ["symbol", "ts"]).filter("NOT in_window"), epoch)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_freshness(stream: DataFrame, table: str, sink: Callable[[DataFrame, int], None], checkpoint: str, now: Callable[[], str] | None = None, limit: float = 5.0) -> StreamingQuery:
    """Age of each symbol's newest bar after every micro-batch (T5). The table keeps one row a symbol."""

    def step(new: DataFrame, epoch: int) -> None:
        spark = new.sparkSession
        newest = new.groupBy("symbol").agg(F.max("ts").alias("ts"))
        if epoch > 0:
            newest = newest.unionByName(spark.read.parquet(f"{table}/epoch={epoch - 1}")).groupBy("symbol").agg(F.max("ts").alias("ts"))
        newest.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")
        sink(freshness(spark.read.parquet(f"{table}/epoch={epoch}"), now() if now else None, limit), epoch)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stability(values: np.ndarray, edges: np.ndarray, expected: np.ndarray, eps: float = 1e-6) -> float:
    """PSI of values over given edges against expected shares; values outside are left out."""
    counts, _ = np.histogram(values, edges)
    share = np.maximum(counts / max(1, counts.sum()), eps)
    base = np.maximum(expected, eps)
    return float(((share - base) * np.log(share / base)).sum())


def drift_buffer(scores: DataFrame, edges: list[float], expected: list[float]) -> DataFrame:
    """(symbol, n, psi) after each micro-batch, from the newest probabilities of each symbol.

    scores: (symbol, ts, p). The state of a symbol is its last KEEP probabilities; psi is NULL
    below NEEDED. Within a batch they are taken in time order.
    """
    cuts, base = np.array(edges), np.array(expected)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(batches)).sort_values("ts")["p"].tolist()
        kept = ((list(state.get[0]) if state.exists else []) + new)[-KEEP:]
        state.update((kept,))
        psi = stability(np.array(kept[-RECENT:]), cuts, base) if len(kept) >= NEEDED else None
        yield pd.DataFrame({"symbol": [key[0]], "n": [len(kept)], "psi": pd.Series([psi], dtype="float64")})

    return scores.groupBy("symbol").applyInPandasWithState(update, "symbol string, n long, psi double", "kept array<double>", "update", GroupStateTimeout.NoTimeout)
