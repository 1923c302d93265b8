"""Sinks of reports: CSV and JSON by Spark's writers, and the way back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """Audit samples, sweeps and summaries (IO9)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def calibration_row(table: DataFrame, brier: float, ece: float, features: list[str]) -> DataFrame:
    """A reliability table as one row of arrays, in bin order (IO10)."""
    names = ("left", "right", "prob_mean", "frac_pos", "count", "ci_low", "ci_high")
    rows = F.sort_array(F.collect_list(F.struct("bin", *names)))
    out = table.agg(rows.alias("r")).select(*[F.col(f"r.{n}").alias(n) for n in names])
    return out.select(F.lit(brier).alias("brier"), F.lit(ece).alias("ece"), F.array(*map(F.lit, features)).alias("features"), *names)


def write_json(df: DataFrame, path: str) -> None:
    """Calibration and run meta (IO10); the committer puts the finished file in place at once."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """The bins of a calibration file as rows (IO11)."""
    schema = "brier double, ece double, features array<string>, left array<double>, right array<double>, prob_mean array<double>, frac_pos array<double>, count array<bigint>, ci_low array<double>, ci_high array<double>"
    raw = spark.read.schema(schema).json(path)
    bins = raw.select("brier", "ece", F.posexplode(F.arrays_zip("left", "right", "prob_mean", "frac_pos", "count", "ci_low", "ci_high")).alias("bin", "x"))
    return bins.select("brier", "ece", "bin", "x.*")
