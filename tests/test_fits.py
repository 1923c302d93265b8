"""Fits of a whole label grid against fits one by one."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from barlab.operators import labels as L
from barlab.operators import many_fits as Y
from barlab.operators import model as M
from barlab.operators.features import feature_table
from barlab.operators.splits import fold_bounds, fold_role, time_groups
from barlab.sources.bars import bars_from_events

SF = "/root/testdata/sf0.001"
CONFIGS = [L.BreakConfig(horizon=h, lookback=8, buffer=b) for h, b in ((8, 0.05), (16, 0.15))]


@pytest.fixture(scope="module")
def table(spark):
    bars = bars_from_events(spark, SF)
    df = feature_table(bars).select("symbol", "ts", *M.FEATURES).join(L.label_grid(bars, CONFIGS).select("symbol", "ts", "y0", "y1"), ["symbol", "ts"])
    # The test series has few breaks: the second label is made to have two classes of like size.
    return df.withColumn("y1", F.when(F.col("y1").isNotNull(), (F.pmod(F.xxhash64("symbol", "ts"), F.lit(100)) < 50 + 30 * F.signum("z_close_20")).cast("int"))).cache()


def test_grid_labels_are_break_labels(spark):
    bars = bars_from_events(spark, SF)
    got = {(r.symbol, r.ts): (r.y0, r.y1) for r in L.label_grid(bars, CONFIGS).collect()}
    for i, cfg in enumerate(CONFIGS):
        want = {(r.symbol, r.ts): r.y for r in L.break_labels(bars, cfg).select("symbol", "ts", "y").collect()}
        assert {k: v[i] for k, v in got.items()} == want and len(want) > 50


def test_one_pass_fits_equal_separate_ones(table):
    grid = Y.LabelGrid(table, M.FEATURES, ("y0", "y1"), splits=3, kept=M.PLAIN)
    try:
        weights = grid.fit()
        f = int(np.flatnonzero((grid.fits.setting == 1) & (grid.fits.fold == 2))[0])
        mine = {(r.symbol, r.ts): (r.y, r.p) for r in grid.scores().filter("setting = 1 and fold = 2").collect()}
        # The same by itself: winsorized rows, days' folds, the older 70 % of training rows.
        rows = M.E.winsorized(table.withColumnRenamed("y1", "y").drop("y0").filter("y IS NOT NULL"), [c for c in M.FEATURES if c not in M.PLAIN])
        rows = time_groups(rows).cache()
        groups = rows.agg(F.max("grp")).first()[0] + 1
        role = fold_role(fold_bounds(groups, 3)[1])
        train, test = rows.filter(role == "train"), rows.filter(role == "test")
        cut = M.time_cuts(train, [0.7])[None][0]
        assert abs(cut - grid.fits.cut[f]) < 1
        u = F.unix_micros(F.col("ts").cast("timestamp"))
        older, newer = train.filter(u < F.lit(cut)), train.filter(u >= F.lit(cut))
        assert older.count() == grid.fits.n[f] and grid.calibrated[f]
        pipeline = M.fit_logistic(older)
        scaled = M.with_weights(older)
        for stage in pipeline.stages[:-1]:
            scaled = stage.transform(scaled)
        # The same problem with as many steps as it takes.
        exact = LogisticRegression(featuresCol="_z", labelCol="y", weightCol="_w", elasticNetParam=0.12, regParam=1 / (0.45 * older.count()), maxIter=1000, tol=1e-12, standardization=False).fit(scaled)
        assert np.abs(np.append(exact.coefficients.toArray(), exact.intercept) - weights[f]).max() < 1e-3
        # Isotonic calibration of the same model's probabilities.
        z = np.array([r._z.toArray() for r in pipeline.stages[1].transform(pipeline.stages[0].transform(newer)).select("_z").collect()])
        p = 1 / (1 + np.exp(-(z @ weights[f][:-1] + weights[f][-1])))
        ys = [r.y for r in newer.select("y").collect()]
        iso = IsotonicRegression(featuresCol="p", labelCol="y").fit(table.sparkSession.createDataFrame([(float(a), float(b)) for a, b in zip(p, ys)], "p double, y double"))
        zt = pipeline.stages[1].transform(pipeline.stages[0].transform(test)).select("symbol", "ts", "y", "_z").collect()
        assert len(zt) == len(mine)
        for r in zt:
            raw = 1 / (1 + np.exp(-(r._z.toArray() @ weights[f][:-1] + weights[f][-1])))
            want = np.interp(raw, iso.boundaries.toArray(), iso.predictions.toArray())
            assert mine[r.symbol, r.ts][0] == r.y and abs(mine[r.symbol, r.ts][1] - want) < 1e-6
    finally:
        grid.tables.clear()


def test_newton_step_meets_the_optimum():
    rng = np.random.default_rng(0)
    d, fits = 6, 4
    a = rng.normal(size=(fits, 40, d))
    curvature = np.einsum("fni,fnj->fij", a, a) / 40
    w, g = rng.normal(size=(fits, d)), rng.normal(size=(fits, d))
    l1, l2 = np.full(fits, 0.05), np.full(fits, 0.3)
    new = Y.newton_step(w, g, curvature, l1, l2)
    value = lambda x, f: g[f] @ (x - w[f]) + (x - w[f]) @ curvature[f] @ (x - w[f]) / 2 + l1[f] * np.abs(x[:-1]).sum() + l2[f] / 2 * (x[:-1] ** 2).sum()
    for f in range(fits):
        assert all(value(new[f] + e, f) >= value(new[f], f) - 1e-9 for e in rng.normal(scale=1e-3, size=(300, d)))


def test_pool_is_isotonic_regression():
    rng = np.random.default_rng(2)
    p = np.sort(rng.random(300))
    y = (rng.random(300) < p).astype(float)
    blocks = Y.pool(np.array([p, p]), y, np.ones(300))
    means = [s / n for _, _, s, n in blocks]
    assert means == sorted(means) and sum(n for *_, n in blocks) == 300
    # Pooling cells first changes nothing.
    parts = [b for i in range(10) for b in Y.pool(np.array([p, p])[:, (p * 10).astype(int) == i], y[(p * 10).astype(int) == i], np.ones(int(((p * 10).astype(int) == i).sum())))]
    lo, hi, s, n = (np.array(v) for v in zip(*parts))
    assert np.allclose(Y.pool(np.array([lo, hi]), s, n), blocks)


def test_fold_summary_is_describe(spark):
    rng = np.random.default_rng(4)
    rows = [(f, int(rng.random() < 0.4), float(round(rng.random(), 2))) for f in (1, 2, 3, 4) for _ in range(60)] + [(5, 0, 0.3)] * 10
    got = {r.fold: r for r in M.fold_summary(spark.createDataFrame(rows, "fold int, y int, p double")).collect()}
    assert set(got) == {*map(str, range(1, 6)), *M.DESCRIBED} and got["5"].ap is None and got["count"].ap == 4
    for metric in ("ap", "brier", "mcc", "balanced_accuracy", "f1_pos", "f1_neg"):
        want = pd.Series([got[str(f)][metric] for f in range(1, 6)], dtype=float).describe()
        assert np.allclose([got[d][metric] for d in M.DESCRIBED], want[list(M.DESCRIBED)].to_numpy())
