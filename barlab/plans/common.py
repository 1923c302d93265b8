"""Shared pieces of the registered queries: rounding, and the SQL of the input adapters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import rounded_half

#: Hourly bars of the events table with their position in the symbol.
BARS_SQL = """
bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, ts) AS close, count(*)::BIGINT AS volume
  FROM events GROUP BY 1, 2),
b AS (
  SELECT *, row_number() OVER w - 1 AS i,
         greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""

SCORED_SQL = """
scored AS (
  SELECT event_id AS id, ts, (json_extract(props, '$.k')::INT % 3 = 0)::INT AS y, value / (value + 50) AS p FROM events)"""

NEWS_SQL = """
news AS (
  SELECT ts, (1 + json_extract(props, '$.k')::INT % 5)::INT AS importance, 'event ' || event_id AS title
  FROM events WHERE event_type = 'error')"""

WIN = "PARTITION BY symbol ORDER BY ts"


def roll(agg: str, x: str, n: int, least: int | None = None, shift: int = 0) -> str:
    """SQL of a rolling aggregate, NULL until enough values are there."""
    frame = f"({WIN} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"
    return f"CASE WHEN count({x}) OVER {frame} >= {n if least is None else least} THEN {agg}({x}) OVER {frame} END"


def rslope(n: int) -> str:
    """SQL of the slope of close over the last n bars."""
    frame = f"({WIN} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(close) OVER {frame} >= {n} THEN regr_slope(close, i::DOUBLE) OVER {frame} END"


def div(a: str, b: str) -> str:
    """SQL of a / b, and 0 where b is next to 0."""
    return f"CASE WHEN abs({b}) < 1e-9 THEN 0.0 ELSE ({a}) / ({b}) END"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded as the SQL rounds them; 0.0 is added so that no negative zero is left."""
    return df.select(*[(rounded_half(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(x: str, name: str) -> str:
    """SQL of a rounded column."""
    return f"round({x}, 6) + 0.0 AS {name}"
