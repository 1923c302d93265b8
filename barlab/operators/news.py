"""Event windows and joins of points in time with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Minutes around an event by importance (fixed values).
MINUTES = {5: 60, 4: 45, 3: 30}
#: Seconds of the cells in which points and windows meet.
CELL = 3600


def event_windows(news: DataFrame, importance: int = 3, minutes: dict[int, int] | None = None) -> DataFrame:
    """(start, end, importance, title, event_ts) of events that matter; closed intervals."""
    m = F.create_map(*[F.lit(x) for kv in (minutes or MINUTES).items() for x in kv])
    around = F.make_dt_interval(mins=F.coalesce(m[F.col("importance")], F.lit(0)))
    return news.filter(F.col("importance") >= importance).select((F.col("ts") - around).alias("start"), (F.col("ts") + around).alias("end"), "importance", "title", F.col("ts").alias("event_ts"))


def uniform_windows(news: DataFrame, importance: int, minutes: int) -> DataFrame:
    """The same margin around every event that matters."""
    around = F.make_dt_interval(mins=F.lit(minutes))
    return news.filter(F.col("importance") >= importance).select((F.col("ts") - around).alias("start"), (F.col("ts") + around).alias("end"), F.col("ts").alias("event_ts"))


#: Cells of a block in a scan over cells.
SCAN = 1024


def carried(cells: DataFrame, value: str, agg, none, name: str) -> DataFrame:
    """cells (_day, value, ...) with `name`: agg over the values of all cells before, `none` for the first.

    Cells are scanned within blocks of SCAN, and blocks by their totals, so that no task has all cells;
    the last scan is over one row for each block (a block of days is close to three years).
    """
    inside = Window.partitionBy("_block").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_block", F.floor(F.col("_day") / SCAN))
    totals = cells.groupBy("_block").agg(agg(value).alias("_total")).withColumn("_top", F.floor(F.col("_block") / SCAN))
    over = Window.partitionBy("_top").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    far = totals.select("_block", agg("_total").over(over).alias("_far"))
    both = (F.greatest if agg is F.max else lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))(F.col("_near"), F.col("_far"))
    return cells.withColumn("_near", agg(value).over(inside)).join(far, "_block").withColumn(name, F.coalesce(both, none)).drop("_near", "_far", "_block")


def merged_windows(windows: DataFrame) -> DataFrame:
    """Overlapping windows as one: (start, end).

    A window begins an island if it starts after the ends of all before it. The windows of a day are one
    task's; what reaches into a day from the days before, and how many islands began before, are
    carried over the days, so that no task has all windows. Windows without both ends are left out.
    """
    w = windows.select("start", "end", F.unix_date(F.to_date("start")).alias("_day")).filter("start IS NOT NULL AND end IS NOT NULL")
    reach = carried(w.groupBy("_day").agg(F.max("end").alias("_end")), "_end", F.max, F.lit(None), "_reach").select("_day", "_reach")
    today = Window.partitionBy("_day").orderBy("start", "end")
    before = F.greatest(F.max("end").over(today.rowsBetween(Window.unboundedPreceding, -1)), F.col("_reach"))
    new = w.join(reach, "_day").withColumn("_new", F.when(F.col("start") <= before, 0).otherwise(1))
    begun = carried(new.groupBy("_day").agg(F.sum("_new").alias("_n")), "_n", F.sum, F.lit(0), "_begun").select("_day", "_begun")
    island = F.col("_begun") + F.sum("_new").over(today.rowsBetween(Window.unboundedPreceding, 0))
    return new.join(begun, "_day").withColumn("_island", island).groupBy("_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def in_any_window(points: DataFrame, windows: DataFrame, key: list[str], flag: str = "in_window", past_only: bool = False) -> DataFrame:
    """points with a flag: whether ts lies in any closed window (J2); past_only: of an event not
    later than ts (J5). Points and windows meet in hour cells, an equi join at any number of windows;
    of the windows of a cell that cover it whole, and have come, one is enough, so merged ones are used."""
    w = windows.select("start", "end", *(["event_ts"] if past_only else []))
    inside = (F.col("ts") >= F.col("start")) & (F.col("ts") <= F.col("end"))
    if past_only:
        # A window counts from its event on: its closed part after the event.
        w = w.select(F.greatest("start", "event_ts").alias("start"), "end").filter("start <= end")
    w = merged_windows(w)
    ids = points.select(*key, "ts") if "ts" not in key else points.select(*key)
    cell = lambda t: F.floor(F.unix_seconds(t.cast("timestamp")) / CELL)
    cells = w.withColumn("_w", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))))
    hit = ids.withColumn("_c", cell(F.col("ts"))).join(cells, (F.col("_c") == F.col("_w")) & inside, "left_semi").drop("_c")
    marked = hit.select(*key).distinct().withColumn(flag, F.lit(True))
    return points.join(marked, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
