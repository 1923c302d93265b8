"""Freshness and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def freshness(bars: DataFrame, now: str | None = None, limit: float = 5.0) -> DataFrame:
    """Age of each symbol's newest bar in minutes, STALE beyond the limit."""
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    age = (F.unix_micros(at) - F.unix_micros(F.max("ts").cast("timestamp"))) / 60e6
    return bars.groupBy("symbol").agg(F.max("ts").alias("last_ts"), age.alias("age_minutes")).withColumn("status", F.when(F.col("age_minutes") > limit, "STALE").otherwise("OK"))


def projection(last: DataFrame, p_up: Column, p_dn: Column, gain_up: Column, gain_dn: Column, atr: Column, steps: int) -> DataFrame:
    """Path of the expected move from the newest close, and a cone of atr * sqrt(step).

    The two probabilities are normalised; if both are 0 they count one half each.
    """
    total = p_up + p_dn
    up = F.when(total > 0, p_up / F.nullif(total, F.lit(0))).otherwise(0.5)
    drift = up * gain_up - (1 - up) * gain_dn
    p = last.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    cone = atr * F.sqrt("step")
    return p.select("symbol", "step", (F.col("close") + F.col("step") / steps * drift).alias("path"), (F.col("close") + cone).alias("cone_up"), (F.col("close") - cone).alias("cone_dn"))
