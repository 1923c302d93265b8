"""News calendars: header synonyms, best-effort times, importance and event windows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bars import any_timestamp

# Header names by meaning, as compared after normalisation.
TIME = ("time", "timestamp", "datetime", "date_time", "timejst", "datetimejst", "日時", "日付時刻", "発表時刻", "発表時間", "時刻", "時間", "date", "when")
DATE_ONLY = ("date", "日付", "発表日")
CLOCK_ONLY = ("time", "時刻", "発表時刻", "発表時間", "時間")
IMPORTANCE = ("importance", "重要度", "impact", "rank", "priority", "優先度", "star", "stars")
TITLE = ("title", "イベント", "指標名", "headline", "event", "name", "内容", "subject")


def plain_header(name: str) -> str:
    """Lower case without spaces (also wide ones), dashes, underscores, slashes and parentheses."""
    return re.sub(r"[\s\-_/()]", "", name.strip().replace("\u3000", " ").lower())


def resolve_headers(columns: list[str]) -> dict[str, str]:
    """Meaning (time, or date and clock; importance; title) -> the first column with a name of it, if any.

    A column of dates alone is no time; with a column of clock times it makes one.
    """
    plain = [(plain_header(c), c) for c in columns]
    first = lambda names: next((c for n, c in plain if n in set(map(plain_header, names))), None)
    date, clock = first(DATE_ONLY), first(CLOCK_ONLY)
    when = {"date": date, "clock": clock} if date and clock else {"time": first([n for n in TIME if n not in DATE_ONLY])}
    found = when | {"importance": first(IMPORTANCE), "title": first(TITLE)}
    return {k: c for k, c in found.items() if c is not None}


def parse_news(raw: DataFrame) -> DataFrame:
    """(ts, importance, title) from a table of strings (IO5).

    The time comes from date and clock joined, from the time column, or else from the column with
    most parseable times; the importance, where no header names it, from the other column with most
    numbers, the title from the first column left. A bad or missing importance is 0; rows without a
    time are dropped. Raises where no column has times.
    """
    found = resolve_headers(raw.columns)
    column = lambda c: F.col(f"`{c}`")
    times, numbers = any_timestamp, lambda c: c.try_cast("double")
    missing = [k for k in ("time", "importance") if k not in found and not (k == "time" and "date" in found)]
    if missing:
        tests = [f(column(c)).isNotNull().cast("int") for f in (times, numbers) for c in raw.columns]
        counts = raw.agg(*[F.coalesce(F.sum(t), F.lit(0)).alias(str(i)) for i, t in enumerate(tests)]).first()
        n = len(raw.columns)
        for k, at in (("time", 0), ("importance", n)):
            free = [i for i in range(n) if raw.columns[i] not in found.values() and counts[at + i]]
            if k in missing:
                if free:
                    found[k] = raw.columns[max(free, key=lambda i: (counts[at + i], -i))]
                elif k == "time":
                    raise ValueError("no column of the news has times")
    when = any_timestamp(F.concat_ws(" ", F.trim(column(found["date"])), F.trim(column(found["clock"])))) if "date" in found else any_timestamp(column(found["time"]))
    left = [c for c in raw.columns if c not in found.values()]
    title = found.get("title") or (left[0] if left else None)
    importance = F.coalesce(F.floor(numbers(column(found["importance"]))).cast("int"), F.lit(0)) if "importance" in found else F.lit(0)
    return raw.select(when.alias("ts"), importance.alias("importance"), (F.coalesce(column(title), F.lit("")) if title else F.lit("")).alias("title")).filter("ts IS NOT NULL")


def read_news_csv(spark: SparkSession, path: str) -> DataFrame:
    """News from CSV files with a header, all columns as strings."""
    return parse_news(spark.read.option("header", True).csv(path))


def news_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News derived from error events: importance 1 to 5 from the event's properties."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'error'")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("ts").cast("timestamp_ntz").alias("ts"), (k % 5 + 1).cast("int").alias("importance"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("title"))


def scored_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ts, y, p): probabilities and outcomes derived from all events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("ts"), (F.get_json_object("props", "$.k").cast("int") % 3 == 0).cast("int").alias("y"), (F.col("value") / (F.col("value") + 50)).alias("p"))
