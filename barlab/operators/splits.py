"""Cross-validation splits of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import with_index


def walk_forward(bars: DataFrame, splits: int = 5, embargo: int = 12) -> DataFrame:
    """(symbol, ts, bar_idx, fold, role): test fold k is the k-th of splits + 1 equal stretches, training
    all before it less the embargo; the remainder at the end is in no test fold (C1)."""
    df = with_index(bars).select("symbol", "ts", "bar_idx")
    n = df.groupBy("symbol").agg(F.count("*").alias("_n"))
    df = df.join(n, "symbol").withColumn("_s", F.floor(F.col("_n") / (splits + 1))).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(splits))))
    start = F.col("fold") * F.col("_s")
    role = F.when((F.col("bar_idx") >= start) & (F.col("bar_idx") < start + F.col("_s")), "test").when(F.col("bar_idx") < start - embargo, "train")
    return df.withColumn("role", role).filter("role IS NOT NULL").drop("_n", "_s")


def time_groups(df: DataFrame, unit: str = "day") -> DataFrame:
    """df with grp, the 0-based number of its day (or week) among those that occur."""
    day = F.date_trunc(unit, "ts").cast("timestamp_ntz")
    days = df.select(day.alias("_day")).distinct().withColumn("grp", (F.dense_rank().over(Window.orderBy("_day")) - 1).cast("long"))
    return df.withColumn("_day", day).join(days, "_day").drop("_day")


def fold_bounds(groups: int, splits: int) -> list[tuple[int, int]]:
    """First and one past the last group of each fold; the first groups % splits are one longer."""
    out, at = [], 0
    for i in range(splits):
        size = groups // splits + (i < groups % splits)
        out.append((at, at + size))
        at += size
    return out


def fold_role(bounds: tuple[int, int], gap: int = 1, embargo: int = 1) -> Column:
    """Role of a row's group in a fold: test inside, dropped within the gap and embargo, else train."""
    start, stop = bounds
    g = F.col("grp")
    return F.when((g >= start) & (g < stop), "test").when((g < start - gap) | (g >= stop + embargo), "train").otherwise("dropped")


def purged_folds(df: DataFrame, splits: int = 5, gap: int = 1, embargo: int = 1) -> DataFrame:
    """df with fold and role: groups in consecutive blocks; training keeps groups before start - gap
    and from stop + embargo on, the future included (C3, J9)."""
    groups = (df.agg(F.max("grp")).first()[0] or 0) + 1
    roles = [F.struct(F.lit(k).alias("fold"), fold_role(b, gap, embargo).alias("role")) for k, b in enumerate(fold_bounds(groups, splits), 1)]
    return df.withColumn("_f", F.explode(F.array(*roles))).select(*df.columns, "_f.*")
