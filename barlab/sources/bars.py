"""Sources of bar series: CSV, vendor tables, wide tables, candle JSON, and tick tables.

Bars are (symbol, ts, open, high, low, close, volume); ts is a UTC time without zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close")
REQUIRED = ("timestamp", *PRICES, "volume")

#: Longest history by bar interval in minutes, in days (limits of a public data provider; fixed values).
MAX_DAYS = {1: 7, 2: 60, 5: 60, 15: 60, 30: 60, 60: 730, 90: 60}


def require(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """df with lower-case, trimmed names; raises if one of the columns is missing."""
    out = df.toDF(*[c.strip().lower() for c in df.columns])
    missing = [c for c in columns if c not in out.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return out


def read_bars_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Bars of one symbol from CSV with a header (IO1)."""
    raw = require(spark.read.option("header", True).csv(path), REQUIRED)
    return raw.select(F.lit(symbol).alias("symbol"), any_timestamp(F.col("timestamp")).alias("ts"), *[F.expr(f"try_cast({c} AS double)").alias(c) for c in PRICES], F.expr("try_cast(volume AS bigint)").alias("volume"))


def normalize_ohlcv(df: DataFrame) -> DataFrame:
    """Vendor names to ours by prefix, trimmed and lower-cased ("Open " and "open.1" are open) (IO2)."""
    out: dict[str, str] = {}
    for c in df.columns:
        low = c.strip().lower()
        name = next((p for p in (*PRICES, "volume") if low.startswith(p)), low)
        if name not in out.values():
            out[c] = name
    plain = df.select(*[F.col(f"`{c}`").alias(n) for c, n in out.items()])
    return require(plain, PRICES)


def wide_to_bars(df: DataFrame, time_col: str = "ts") -> DataFrame:
    """Columns "TICKER|Field" or "Field|TICKER" to bars of all tickers (IO3)."""
    fields = {"open", "high", "low", "close", "volume"}
    pieces = []
    for c in df.columns:
        a, _, b = c.partition("|")
        if b and a.strip().lower() in fields:
            pieces.append((c, b.strip(), a.strip().lower()))
        elif b and b.strip().lower() in fields:
            pieces.append((c, a.strip(), b.strip().lower()))
    long = df.select(time_col, F.explode(F.array(*[F.struct(F.lit(s).alias("symbol"), F.lit(f).alias("field"), F.col(f"`{c}`").cast("double").alias("value")) for c, s, f in pieces])).alias("x"))
    one = lambda f: F.max(F.when(F.col("x.field") == f, F.col("x.value")))
    return long.groupBy(F.col("x.symbol").alias("symbol"), F.col(time_col).alias("ts")).agg(*[one(f).alias(f) for f in PRICES], one("volume").cast("long").alias("volume")).filter("close IS NOT NULL")


CANDLES = T.StructType([T.StructField("candles", T.ArrayType(T.StructType([T.StructField("time", T.StringType()), T.StructField("complete", T.BooleanType()), T.StructField("mid", T.StructType([T.StructField(k, T.StringType()) for k in "ohlc"])), T.StructField("volume", T.LongType())])))])


def candles_to_bars(payloads: DataFrame, symbol: str = "symbol", payload: str = "payload") -> DataFrame:
    """Candle JSON to bars, complete candles only (IO4)."""
    c = payloads.select(symbol, F.explode(F.from_json(payload, CANDLES)["candles"]).alias("c")).filter("c.complete")
    price = lambda k: F.col(f"c.mid.{k}").cast("double")
    return c.select(F.col(symbol).alias("symbol"), any_timestamp(F.col("c.time")).alias("ts"), price("o").alias("open"), price("h").alias("high"), price("l").alias("low"), price("c").alias("close"), F.col("c.volume").alias("volume"))


def any_timestamp(text: Column) -> Column:
    """Times in several notations, or epoch seconds or milliseconds, as UTC; NULL if none fits (IO6)."""
    trimmed = F.trim(text.cast("string"))
    number = F.when(trimmed.rlike(r"^\d{9,14}(\.\d+)?$"), trimmed.try_cast("double"))
    seconds = F.when(number > 1e10, number / 1000).otherwise(number)
    # The accepted notations.
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm", "yyyy.MM.dd HH:mm")
    known = [F.when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}"), trimmed.try_cast("timestamp"))]
    known += [F.try_to_timestamp(trimmed, F.lit(f)) for f in formats]
    return F.coalesce(*known, F.timestamp_millis(F.round(seconds * 1000).cast("long"))).cast("timestamp_ntz")


def to_zone(ts: Column, zone: str = "Asia/Tokyo") -> Column:
    """A UTC time as the wall clock of a zone (IO7)."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz")


def clamp_history(bars: DataFrame, interval_minutes: int, days: int) -> DataFrame:
    """The last `days` of each symbol, at most what the interval allows (IO8)."""
    keep = min(days, MAX_DAYS.get(interval_minutes, days))
    last = bars.groupBy("symbol").agg(F.max("ts").alias("_last"))
    return bars.join(last, "symbol").filter(F.col("ts") >= F.col("_last") - F.make_dt_interval(F.lit(keep))).drop("_last")


def bars_from_events(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    """Bars of the events table: one symbol per event type; ticks are in time order.

    min_by and max_by pre-aggregate before the shuffle, which is by (symbol, bucket).
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("t"), "value")
    bucket = F.date_trunc("hour", "t").cast("timestamp_ntz") if minutes == 60 else F.window(F.col("t").cast("timestamp"), f"{minutes} minutes")["start"].cast("timestamp_ntz")
    return e.groupBy("symbol", bucket.alias("ts")).agg(F.min_by("value", "t").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "t").alias("close"), F.count("*").alias("volume"))


def bars_from_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of many symbols: suppliers' unit prices in lineitem."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price, at = F.col("l_extendedprice") / F.col("l_quantity"), F.struct("l_orderkey", "l_linenumber")
    t = li.select(F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), price.alias("p"), at.alias("at"))
    return t.groupBy("symbol", "ts").agg(F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"), F.count("*").alias("volume"))
