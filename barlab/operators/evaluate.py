"""Thresholds, calibration, drift, metrics and samples of scored rows (columns y, p)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import expected_r, psi_severity, session_flags, wilson


def theta_grid(win: float = 1.0, loss: float = 1.0, cost: float = 0.15) -> list[float]:
    """Thresholds from just below break-even (at least 0.50) to 0.95 in steps of about 0.005 (A3)."""
    low = max(0.50, (loss + cost) / (win + loss) - 0.02)
    return [float(x) for x in np.linspace(low, 0.95, int((0.95 - low) / 0.005) + 1)]


def ev_at(df: DataFrame, theta: float, win: float = 1.0, loss: float = 1.0, cost: float = 0.15) -> DataFrame:
    """Trades, coverage, mean probability and expected value at one threshold (A1)."""
    hit = F.col("p") >= theta
    a = df.agg(F.count("*").alias("n"), F.sum(hit.cast("long")).alias("trades"), F.avg(F.when(hit, F.col("p"))).alias("p_mean"))
    return a.select("trades", (F.col("trades") / F.col("n")).alias("coverage"), "p_mean", F.coalesce(expected_r(F.col("p_mean"), win, loss, cost), F.lit(float("-inf"))).alias("ev"))


def sweep(df: DataFrame, grid: list[float], by: tuple[str, ...] = (), win: float = 1.0, loss: float = 1.0, cost: float = 0.15) -> DataFrame:
    """(by..., theta, trades, n, coverage, ev) at all thresholds in one pass (A2).

    Rows are counted by how many thresholds they reach; sums from the highest bucket down give
    every threshold's figures. The bucketed table has at most len(grid) + 1 rows a group.
    """
    reached = sum(((F.col("p") >= t).cast("int") for t in grid), F.lit(0))
    counts = df.groupBy(*by, reached.alias("_b")).agg(F.count("*").alias("_n"), F.sum("p").alias("_p"))
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("n"))
    t = F.explode(F.arrays_zip(F.sequence(F.lit(1), F.lit(len(grid))).alias("i"), F.array(*map(F.lit, grid)).alias("theta"))).alias("g")
    all_t = totals.select(*by, "n", t).select(*by, "n", "g.i", "g.theta")
    left, right = all_t.alias("t"), counts.alias("c")
    same = [F.col(f"t.{b}").eqNullSafe(F.col(f"c.{b}")) for b in by]
    on = F.col("c._b") >= F.col("t.i")
    for s in same:
        on = s & on
    out = left.join(right, on, "left").groupBy(*[F.col(f"t.{b}") for b in by], "t.i", "t.theta", "t.n").agg(F.coalesce(F.sum("c._n"), F.lit(0)).alias("trades"), F.sum("c._p").alias("_sum"))
    ev = expected_r(F.col("_sum") / F.col("trades"), win, loss, cost)
    return out.withColumns({"coverage": F.col("trades") / F.col("n"), "ev": F.when(F.col("trades") > 0, ev)}).drop("_sum")


def best_theta(swept: DataFrame, by: tuple[str, ...] = (), target: float = 0.05, least: float = 0.03, pull: float = 0.05) -> DataFrame:
    """The threshold to use (A3-A8): where coverage reaches the target, the best expected value less
    a pull towards it; else the best above the least coverage; else the best with trades; else the
    widest. The first of equals wins. swept has one row a threshold."""
    stage = F.when(F.col("coverage") >= target, 1).when(F.col("coverage") >= least, 2).when(F.col("trades") > 0, 3).otherwise(4)
    value = F.when(F.col("coverage") >= target, F.col("ev") - pull * F.abs(F.col("coverage") - target)).when(F.col("trades") > 0, F.col("ev")).otherwise(F.col("coverage"))
    w = Window.partitionBy(*by).orderBy("_stage", F.desc("_value"), "i")
    return swept.withColumns({"_stage": stage, "_value": F.round(value, 9)}).withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*by, "theta", "trades", "coverage", "ev")


def plain_best(swept: DataFrame, by: tuple[str, ...] = (), *least: float) -> DataFrame:
    """The threshold of highest expected value among those that reach the first of the given coverages
    that any reaches (A4: target, then minimum; A5: one minimum). The first of equals wins; where none
    is reached the threshold is 0.5 without trades."""
    stage = F.lit(None).cast("int")
    for i, x in reversed(list(enumerate(least))):
        stage = F.when((F.col("coverage") >= x) & F.col("ev").isNotNull(), i).otherwise(stage)
    w = Window.partitionBy(*by).orderBy(F.col("_stage").asc_nulls_last(), F.desc("_value"), "i")
    best = swept.withColumns({"_stage": stage, "_value": F.round("ev", 9)}).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    found = F.col("_stage").isNotNull()
    return best.select(*by, F.when(found, F.col("theta")).otherwise(0.5).alias("theta"), F.when(found, F.col("trades")).otherwise(0).alias("trades"), F.when(found, F.col("coverage")).otherwise(0.0).alias("coverage"), F.when(found, F.col("ev")).alias("ev"))


#: Thresholds of the label sweep and of the direction models (fixed values).
SWEEP_GRID = [float(x) for x in np.linspace(0.55, 0.98, 88)]
DIRECTION_GRID = [float(x) for x in np.linspace(0.5, 0.99, 100)]
#: Rows that a session needs for a threshold of its own; least and target coverage of Tokyo, and of the
#: other sessions (fixed values).
SESSION_ROWS, TOKYO_COVERAGE, COVERAGE = 200, (0.03, 0.07), (0.05, 0.12)


def by_session(df: DataFrame) -> DataFrame:
    """Each row once for every session that it belongs to; 22 and 23 h are in two."""
    f = session_flags(F.col("ts"))
    names = F.array_compact(F.array(*[F.when(f[k] == 1, n) for k, n in (("sess_tokyo", "Tokyo"), ("sess_london", "London"), ("sess_ny", "NY"))]))
    return df.withColumn("session", F.explode(names))


def session_thetas(df: DataFrame, grid: list[float], cost: float = 0.15) -> DataFrame:
    """The threshold of each session with enough rows, by the session's coverages."""
    swept = sweep(by_session(df), grid, ("session",), cost=cost).filter(F.col("n") >= SESSION_ROWS)
    tokyo = F.col("session") == "Tokyo"
    one = lambda rows, least, target: best_theta(rows, ("session",), target, least)
    return one(swept.filter(tokyo), *TOKYO_COVERAGE).unionByName(one(swept.filter(~tokyo), *COVERAGE))


def regime_thetas(df: DataFrame, grid: list[float], least: float = 0.22, target: float = 0.30, cost: float = 0.15) -> DataFrame:
    """The threshold of each session and volatility regime with enough rows (A7). df has reg_atr_low, _mid, _high."""
    reg = F.when(F.col("reg_atr_low") == 1, "low").when(F.col("reg_atr_mid") == 1, "mid").when(F.col("reg_atr_high") == 1, "high")
    swept = sweep(by_session(df.withColumn("regime", reg).filter("regime IS NOT NULL")), grid, ("session", "regime"), cost=cost)
    return best_theta(swept.filter(F.col("n") >= SESSION_ROWS), ("session", "regime"), target, least)


def average_precision_by(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by..., ap): average precision of each group, NULL without positives."""
    at = df.groupBy(*by, "p").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    curve = at.withColumns({"tp": F.sum("pos").over(w), "k": F.sum("n").over(w)})
    return curve.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("k")), F.sum("pos")).alias("ap"))


def confusion(df: DataFrame, theta: float, by: tuple[str, ...] = (), win: float = 1.0, loss: float = 1.0, cost: float = 0.15) -> DataFrame:
    """Counts at a threshold with precision, recall, F1, MCC, balanced accuracy, Brier, and the expected value
    of a trade there, -infinity without trades (A9, A10)."""
    hit, y = F.col("p") >= theta, F.col("y") == 1
    one = lambda c: F.sum(c.cast("long"))
    a = df.groupBy(*by).agg(one(hit & y).alias("tp"), one(hit & ~y).alias("fp"), one(~hit & y).alias("fn"), one(~hit & ~y).alias("tn"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), F.coalesce(expected_r(F.avg(F.when(hit, F.col("p"))), win, loss, cost), F.lit(float("-inf"))).alias("ev"))
    div = lambda x, z: F.when(z == 0, F.lit(0.0)).otherwise(x / z)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    mcc = div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return a.withColumns({
        "precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "f1_pos": div(2 * tp, 2 * tp + fp + fn), "f1_neg": div(2 * tn, 2 * tn + fp + fn), "mcc": mcc,
        "balanced_accuracy": (div(tp, tp + fn) + div(tn, tn + fp)) / 2, "minority_class": F.when(tp + fn <= fp + tn, 1).otherwise(0),
    })


def pr_curve(df: DataFrame) -> DataFrame:
    """(p, tp, fp, positives) at each distinct probability, from the highest down.

    Rows are first reduced to distinct probabilities; these are summed within 1024 ranges of p and
    then across the ranges, so that no task holds them all.
    """
    c = df.groupBy("p").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).withColumn("_cell", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "p")) * 1023))
    cells = c.groupBy("_cell").agg(F.sum("pos").alias("_p"), F.sum("n").alias("_n"))
    above = Window.orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select("_cell", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_bp"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_bn"), F.sum("_p").over(Window.partitionBy()).alias("positives"))
    inside = Window.partitionBy("_cell").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    out = c.join(F.broadcast(base), "_cell").withColumn("tp", F.col("_bp") + F.sum("pos").over(inside)).withColumn("fp", F.col("_bn") + F.sum("n").over(inside) - F.col("tp"))
    return out.select("p", "tp", "fp", "positives", "pos", "n", "_cell")


def average_precision(df: DataFrame) -> DataFrame:
    """Average precision: precision at each distinct probability, weighted by its positives (A11); NULL
    without positives."""
    return pr_curve(df).agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("positives")).alias("average_precision"), F.max("positives").alias("positives"))


def pr_auc(df: DataFrame) -> DataFrame:
    """Area under the precision-recall curve by trapezoids, from recall 0 and precision 1 on (A11); NULL
    without positives. The point before each one is its own without its rows, so no window is needed."""
    tp, fp = F.col("tp"), F.col("fp")
    before = F.coalesce(F.try_divide(tp - F.col("pos"), tp + fp - F.col("n")), F.lit(1.0))
    area = F.sum(F.col("pos") * (tp / (tp + fp) + before) / 2)
    return pr_curve(df).agg(F.try_divide(area, F.max("positives")).alias("pr_auc"))


def minority_metrics(df: DataFrame, theta: float = 0.5) -> DataFrame:
    """MCC, balanced accuracy, F1 of both classes, Brier, the rarer class, and PR-AUC of both classes (A10)."""
    m = confusion(df, theta).select("mcc", "balanced_accuracy", "f1_neg", "f1_pos", "brier", "minority_class")
    turned = df.select((1 - F.col("y")).alias("y"), (1 - F.col("p")).alias("p"))
    return m.crossJoin(pr_auc(df).withColumnRenamed("pr_auc", "pr_auc_pos")).crossJoin(pr_auc(turned).withColumnRenamed("pr_auc", "pr_auc_neg"))  # one row each


def quantile_edges(df: DataFrame, bins: int = 10, x: str = "p") -> list[float]:
    """Distinct edges of equal-count bins; of equal width where fewer than three differ."""
    q = df.agg(F.percentile(x, F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).first()[0]
    edges = sorted(set(q)) if q else []
    return edges if len(edges) >= 3 else [i / bins for i in range(bins + 1)]


def bin_of(x: Column, edges: list[float]) -> Column:
    """0-based bin, left-closed, the last closed on both sides; NULL outside."""
    i = sum(((x >= e).cast("int") for e in edges[1:-1]), F.lit(0))
    return F.when((x >= edges[0]) & (x <= edges[-1]), i)


def reliability(df: DataFrame, edges: list[float]) -> DataFrame:
    """One row a bin: mean p, share of positives, count, Wilson interval (A12); empty bins have NULLs."""
    b = df.groupBy(bin_of(F.col("p"), edges).alias("bin")).agg(F.avg("p").alias("prob_mean"), F.avg("y").alias("frac_pos"), F.count("*").alias("count"), F.sum("y").alias("_k"))
    frame = df.sparkSession.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(len(edges) - 1)], "bin int, left double, right double")
    lo, hi = wilson(F.col("_k"), F.col("count"))
    return F.broadcast(frame).join(b, "bin", "left").select("bin", "left", "right", "prob_mean", "frac_pos", F.coalesce("count", F.lit(0)).alias("count"), lo.alias("ci_low"), hi.alias("ci_high"))


def calibration_error(table: DataFrame) -> DataFrame:
    """Expected calibration error of a reliability table."""
    return table.agg((F.sum(F.col("count") * F.abs(F.col("prob_mean") - F.col("frac_pos"))) / F.sum("count")).alias("ece"))


def psi(baseline: DataFrame, current: DataFrame, bins: int = 10, x: str = "p", eps: float = 1e-6) -> DataFrame:
    """Population stability index over the baseline's deciles, with its severity."""
    edges = quantile_edges(baseline, bins, x)
    count = lambda df, name: df.select(bin_of(F.col(x), edges).alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias(name))
    frame = baseline.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    j = frame.join(count(baseline, "b"), "bin", "left").join(count(current, "c"), "bin", "left").na.fill(0)
    w = Window.partitionBy()
    share = lambda c: F.greatest(F.col(c) / F.greatest(F.sum(c).over(w), F.lit(1)), F.lit(eps))
    j = j.withColumns({"_b": share("b"), "_c": share("c")})
    return j.agg(F.sum((F.col("_c") - F.col("_b")) * F.log(F.col("_c") / F.col("_b"))).alias("psi")).withColumn("severity", psi_severity(F.col("psi")))


def exceed_rate(df: DataFrame, theta: float) -> DataFrame:
    """Share of probabilities at or above a threshold; NULL without rows."""
    return df.agg(F.avg((F.col("p") >= theta).cast("double")).alias("rate"))


def top_correlations(df: DataFrame, features: list[str], k: int = 10) -> DataFrame:
    """Features by absolute correlation with y, beside the share of positives and the rows (A15), from one
    aggregate row."""
    row = df.agg(F.avg(F.col("y").cast("double")).alias("positive_ratio"), F.count("y").alias("rows"), *[F.corr(c, "y").alias(f"_{c}") for c in features])
    long = row.select("positive_ratio", "rows", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_{c}").alias("corr")) for c in features])).alias("x")).select("x.*", "positive_ratio", "rows")
    return long.filter("corr IS NOT NULL AND NOT isnan(corr)").orderBy(F.desc(F.abs("corr")), "feature").limit(k)


def winsorized(df: DataFrame, columns: list[str], k: float = 5.0) -> DataFrame:
    """Columns kept within mean +- k population standard deviations; constant ones as they are."""
    s = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    cut = lambda c: F.greatest(F.lit(s[f"m_{c}"] - k * s[f"s_{c}"]), F.least(F.lit(s[f"m_{c}"] + k * s[f"s_{c}"]), F.col(c)))
    return df.withColumns({c: F.when(F.col(c).isNotNull(), cut(c)) for c in columns if s[f"s_{c}"]})


#: Cells into which values are cut to rank them; a cell is one task's work.
RANK_CELLS = 256


def global_rank(df: DataFrame, x: str, *then: str, name: str = "rank") -> DataFrame:
    """df with the rank (from 1) of each row by x, ties by `then`: counts of cells of like values are added
    up, and rows are ranked within their cell, so that no task sorts all rows."""
    cuts = df.agg(F.approx_percentile(x, [i / RANK_CELLS for i in range(1, RANK_CELLS)], 10_000)).first()[0] or []
    cuts = sorted(set(map(float, cuts)))
    cell = F.size(F.filter(F.lit(cuts), lambda c: c < F.col(x))) if cuts else F.lit(0)
    placed = df.withColumn("_cell", F.when(F.col(x).isNotNull(), cell))
    counts = placed.groupBy("_cell").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_cell").alias("_c"), F.coalesce(F.sum("_n").over(Window.orderBy(F.col("_cell").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy(x, *then))
    return placed.withColumn("_in", inside).join(before, F.col("_cell").eqNullSafe(F.col("_c"))).withColumn(name, F.col("_base") + F.col("_in")).drop("_cell", "_c", "_base", "_in")


def quartiles_by_rank(df: DataFrame, x: str, *then: str, name: str = "quartile") -> DataFrame:
    """df with Q1 to Q4 of the rank of x (first of equals first), cut at the interpolated quartiles of the ranks."""
    n = df.filter(F.col(x).isNotNull()).count()
    edges = [1 + q * (n - 1) for q in (0.25, 0.5, 0.75)]
    ranked = global_rank(df, x, *then, name="_rank")
    quartile = sum(((F.col("_rank") > e).cast("int") for e in edges), F.lit(1))
    return ranked.withColumn(name, F.when(F.col(x).isNotNull(), F.concat(F.lit("Q"), quartile)).otherwise("Q?")).drop("_rank")


def percent_rank_average(df: DataFrame, x: str, name: str = "pct_rank") -> DataFrame:
    """df with the rank of x over the number of rows, equals at their mean rank (W20); distinct values are
    counted and summed in cells first."""
    values = df.filter(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("_ties"))
    cuts = values.agg(F.approx_percentile(x, [i / RANK_CELLS for i in range(1, RANK_CELLS)], 10_000)).first()[0] or []
    cuts = sorted(set(map(float, cuts)))
    values = values.withColumn("_cell", F.size(F.filter(F.lit(cuts), lambda c: c < F.col(x))) if cuts else F.lit(0))
    cells = values.groupBy("_cell").agg(F.sum("_ties").alias("_n"))
    whole = F.sum("_n").over(Window.partitionBy())
    cells = cells.select("_cell", F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), whole.alias("_all"))
    upto = F.sum("_ties").over(Window.partitionBy("_cell").orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    ranks = values.withColumn("_upto", upto).join(cells, "_cell")
    ranks = ranks.select(F.col(x).alias("_x"), ((F.col("_base") + F.col("_upto") - (F.col("_ties") - 1) / 2) / F.col("_all")).alias(name))
    return df.join(ranks, F.col(x) == F.col("_x"), "left").drop("_x")


def stratified_sample(df: DataFrame, key: str, per_class: int = 120, mode: str = "random", seed: int = 7) -> DataFrame:
    """For each class, equally many rows of every stratum of sessions and volatility quartile.

    df: key, ts, y, p, vol. The share of a stratum is per_class over the number of strata, at least
    1. "random" takes the lowest hashes of key and seed, "extreme" half (rounded down) from the low
    end of p's ranks and the rest from the high end.
    """
    f = session_flags(F.col("ts"))
    strata = quartiles_by_rank(df, "vol", "ts", key).withColumn("stratum", F.concat(f["sess_tokyo"], f["sess_london"], f["sess_ny"], F.lit("|"), "quartile")).drop("quartile")
    count = strata.select("y", "stratum").distinct().groupBy("y").agg(F.count("*").alias("_strata"))
    strata = strata.join(count, "y").withColumn("_k", F.greatest(F.lit(1), F.floor(F.lit(per_class) / F.col("_strata"))))
    w = Window.partitionBy("y", "stratum")
    if mode == "random":
        mark = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
        return strata.withColumn("_p", F.row_number().over(w.orderBy(mark, key)) <= F.col("_k")).filter("_p").drop("_p", "_k", "_strata")
    strata = percent_rank_average(strata, "p")
    head, tail = F.row_number().over(w.orderBy("pct_rank", key)), F.row_number().over(w.orderBy(F.desc("pct_rank"), F.desc(key)))
    half = F.floor(F.col("_k") / 2)
    return strata.withColumns({"_h": head, "_t": tail}).filter((F.col("_h") <= half) | (F.col("_t") <= F.col("_k") - half)).drop("_h", "_t", "_k", "_strata")
