"""Break-probability models with Spark ML: elastic-net logistic regression, calibrated, by purged folds."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import evaluate as E
from .features import by_time, feature_table
from .labels import BreakConfig, break_labels, direction_labels, label_grid
from .levels import touched
from .many_fits import LabelGrid
from .shared import Tables
from .splits import fold_bounds, fold_role, time_groups

#: Model columns of the feature table.
FEATURES = ("ret_1", "ret_4", "ret_8", "ret_12", "range_pct", "body_ratio", "wick_up_ratio", "wick_dn_ratio", "atr14_norm", "atr_ratio", "d_atr14", "rv_20", "z_close_20", "slope_short_6_v", "slope_long", "touch_density", "high_low_ratio_20", "hour_sin", "hour_cos", "sess_tokyo", "sess_london", "sess_ny", "reg_atr_low", "reg_atr_high", "ret_8_v_sq", "z_close_20_sq")


def training_table(bars: DataFrame, cfg: BreakConfig = BreakConfig(), features: DataFrame | None = None) -> DataFrame:
    """Features (those of the bars, if not given) joined with labels on (symbol, ts), unlabelled bars dropped,
    features winsorized (L5)."""
    labels = break_labels(bars, cfg).select("symbol", "ts", "y").filter("y IS NOT NULL")
    table = (feature_table(bars) if features is None else features).join(labels, ["symbol", "ts"])
    return E.winsorized(table, [c for c in FEATURES if not c.startswith(("sess_", "reg_", "hour_"))])


def with_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """Balanced class weights n / (2 * n_class)."""
    s = df.agg(F.count("*").alias("n"), F.sum(y).alias("k")).first()
    n, k = s.n, s.k or 0
    return df.withColumn("_w", F.when(F.col(y) == 1, n / (2 * max(k, 1))).otherwise(n / (2 * max(n - k, 1))))


def fit_logistic(df: DataFrame, features: tuple[str, ...] = FEATURES, y: str = "y", c: float = 0.45, l1: float = 0.12) -> PipelineModel:
    """Standardised elastic-net logistic regression with balanced classes (M1). The rows are cached while it is fitted."""
    held = df.select(*features, F.col(y)).cache()
    rows = held.count()
    w = with_weights(held.coalesce(max(1, -(-rows // FIT_ROWS))), y)
    steps = [VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True), LogisticRegression(featuresCol="_z", labelCol=y, weightCol="_w", elasticNetParam=l1, regParam=1 / (c * max(1, rows)), maxIter=40, standardization=False, rawPredictionCol="_raw", probabilityCol="_p", predictionCol="_y")]
    model = Pipeline(stages=steps).fit(w)
    held.unpersist()
    return model


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with the model's margin and probability p."""
    out = model.transform(df)
    return out.withColumns({"margin": vector_to_array("_raw")[1], "p": vector_to_array("_p")[1]}).drop("_x", "_z", "_raw", "_p", "_y")


def fit_platt(df: DataFrame, y: str = "y"):
    """One-feature logistic regression of y on the margin (M2)."""
    x = VectorAssembler(inputCols=["margin"], outputCol="_m")
    return Pipeline(stages=[x, LogisticRegression(featuresCol="_m", labelCol=y, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_y")]).fit(df)


def platt(model, df: DataFrame) -> DataFrame:
    """p replaced by the calibrated probability."""
    return model.transform(df).withColumn("p", vector_to_array("_p")[1]).drop("_m", "_p", "_raw", "_y")


def isotonic(train: DataFrame, df: DataFrame, y: str = "y") -> DataFrame:
    """p of df calibrated by isotonic regression fitted to train (M3)."""
    fitted = IsotonicRegression(featuresCol="p", labelCol=y, predictionCol="_p").fit(train.select("p", F.col(y).cast("double").alias(y)))
    return fitted.transform(df).withColumn("p", F.col("_p")).drop("_p")


def time_cuts(df: DataFrame, shares: list[float], y: str | None = None) -> dict:
    """Times that split df (each class of y apart) into consecutive shares."""
    u = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = df.groupBy(*([y] if y else [])).agg(F.percentile(u, F.array(*map(F.lit, shares))).alias("cuts")).collect()
    return {(r[y] if y else None): r.cuts for r in rows}


def recent_share(df: DataFrame, share: float) -> DataFrame:
    """The newest share of rows by time."""
    cuts = time_cuts(df, [1 - share]).get(None)
    return df.filter(F.unix_micros(F.col("ts").cast("timestamp")) >= F.lit(cuts[0])) if cuts else df


#: Shares of the newest training rows that calibration tries in turn, the rows it needs, and its folds
#: (fixed values).
SHARES, LEAST_ROWS, FOLDS = (0.3, 0.4, 0.5), 100, 3


def calibrated(train: DataFrame, test: DataFrame, features: tuple[str, ...] = FEATURES, y: str = "y") -> DataFrame:
    """test with p of calibrated models (M2).

    Of the newest 30, else 40, else 50 % of the training rows, the first share that has 100 rows of two
    classes is cut into three consecutive folds, class by class; per fold a model is fitted to the other
    folds and its margin is scaled on the fold, which the model has not seen. p is the mean of the
    three. If no share will do, one model of all training rows is left uncalibrated.
    """
    for share in SHARES:
        recent = recent_share(train, share)
        sizes = {r[y]: r["count"] for r in recent.groupBy(y).count().collect()}
        if sum(sizes.values()) < LEAST_ROWS or len(sizes) < 2 or min(sizes.values()) < FOLDS:
            continue
        cuts = time_cuts(recent, [i / FOLDS for i in range(1, FOLDS)], y)
        u = F.unix_micros(F.col("ts").cast("timestamp"))
        fold = F.lit(0)
        for k, at in cuts.items():
            fold = F.when(F.col(y) == k, sum(((u > F.lit(c)).cast("int") for c in at), F.lit(0))).otherwise(fold)
        folded = recent.withColumn("_fold", fold)
        out = None
        for i in range(FOLDS):
            rest, held = folded.filter(F.col("_fold") != i), folded.filter(F.col("_fold") == i)
            model = fit_logistic(rest, features, y)
            scale = fit_platt(scored(model, held), y)
            source = test if out is None else out
            out = platt(scale, scored(model, source)).drop("margin").withColumnRenamed("p", f"_p{i}")
        return out.withColumn("p", sum((F.col(f"_p{i}") for i in range(FOLDS)), F.lit(0.0)) / FOLDS).drop(*(f"_p{i}" for i in range(FOLDS)))
    return scored(fit_logistic(train, features, y), test)


def held_out_isotonic(train: DataFrame, test: DataFrame, features: tuple[str, ...] = FEATURES, y: str = "y") -> DataFrame:
    """test with p of a model of the older 70 % of the training rows, calibrated by isotonic regression on
    the newest 30 %, which it has not seen (M3); uncalibrated where either part lacks a class."""
    cut = time_cuts(train, [0.7])[None][0]
    u = F.unix_micros(F.col("ts").cast("timestamp"))
    older, newer = train.filter(u < F.lit(cut)), train.filter(u >= F.lit(cut))
    if older.select(y).distinct().count() < 2 or newer.select(y).distinct().count() < 2:
        return scored(fit_logistic(train, features, y), test)
    model = fit_logistic(older, features, y)
    return isotonic(scored(model, newer), scored(model, test), y)


CALIBRATIONS = {"platt": calibrated, "isotonic": held_out_isotonic, "none": lambda train, test, features, y: scored(fit_logistic(train, features, y), test)}
#: Rows of a task in a fit.
FIT_ROWS = 50_000
#: Fits that the driver has under way at a time; each is a few small Spark jobs.
PARALLEL_FITS = 8


def out_of_fold(table: DataFrame, splits: int = 5, gap: int = 1, embargo: int = 1, calibration: str = "platt", y: str = "y", features: tuple[str, ...] = FEATURES) -> DataFrame:
    """(symbol, ts, fold, y, p): every row scored by a model that did not see its days (M4).

    The table is cached while the folds are fitted, several at a time. Folds without both classes in
    training are left out, keys stay with the rows.
    """
    whole = time_groups(table.select("symbol", "ts", y, *features)).cache()
    size = whole.agg(F.count("*").alias("rows"), F.max("grp").alias("last")).first()
    groups = (size.last or 0) + 1
    # Fits pass over the table many times: as many tasks as it has work for, no more.
    table = whole.coalesce(max(1, -(-size.rows // FIT_ROWS)))

    def one(k: int, bounds: tuple[int, int]) -> DataFrame | None:
        role = fold_role(bounds, gap, embargo)
        train, test = table.filter(role == "train"), table.filter(role == "test")
        if {r[y] for r in train.select(y).distinct().collect()} < {0, 1}:
            return None
        return CALIBRATIONS[calibration](train, test, features, y).select("symbol", "ts", F.lit(k).alias("fold"), y, "p")

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        parts = [x for x in pool.map(one, range(1, splits + 1), fold_bounds(groups, splits)) if x is not None]
    if not parts:
        return table.limit(0).select("symbol", "ts", F.lit(0).alias("fold"), y, F.lit(0.0).alias("p"))
    return reduce(DataFrame.unionByName, parts)


def level_rows(features: DataFrame, levels: DataFrame, last: int | None = 20, buffer: float = 0.05, sparse: bool = False) -> DataFrame:
    """Feature rows of the newest bars (None: of all) for each level and direction (P10).

    Level-specific columns replace the bar's own: distance, touches of the last 201 bars, nearness, the
    extremes of the last 11, slopes signed by direction. sparse keeps only these and sets the other
    model columns to 0.
    """
    recent = by_time().rowsBetween(-10, 0)
    d_rsi = F.coalesce(F.col("rsi") - F.lag("rsi").over(by_time()), F.lit(0.0)) if "rsi" in features.columns else F.lit(0.0)
    f = features.withColumns({"_rh": F.max("high").over(recent), "_rl": F.min("low").over(recent), "_da": F.coalesce(F.col("atr14") - F.lag("atr14").over(by_time()), F.lit(0.0)), "_dr": d_rsi})
    if last is not None:
        f = f.withColumn("_new", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))) <= last)
    j = f.join(levels.select("symbol", "level"), "symbol").withColumn("_t", touched(buffer).cast("int"))
    j = j.withColumn("touches", F.sum("_t").over(Window.partitionBy("symbol", "level").orderBy("ts").rowsBetween(-200, 0))).drop("_t")
    j = (j if last is None else j.filter("_new").drop("_new")).withColumn("dir_sign", F.explode(F.array(F.lit(1), F.lit(-1))))
    sign, gap = F.col("dir_sign"), F.col("close") - F.col("level")
    if sparse:
        j = j.withColumns({c: F.lit(0.0) for c in FEATURES if not c.startswith(("sess_", "hour_"))})
    return j.withColumns({"dist_to_level": gap * sign, "near": 1 / (F.abs(gap) + 1e-6), "above_level": (gap > 0).cast("int"), "below_level": (gap < 0).cast("int"), "recent_high": F.col("_rh") * sign, "recent_low": F.col("_rl") * sign, "atr_slope_dir": F.col("_da") * sign, "rsi_div_dir": F.col("_dr") * sign, "atr_norm": F.coalesce("atr14", F.lit(0.0)) / F.greatest(F.lit(1e-6), "close")}).drop("_rh", "_rl", "_da", "_dr")


LEVEL_FEATURES = (*FEATURES, "dist_to_level", "near", "touches", "above_level", "recent_high", "recent_low", "atr_slope_dir", "dir_sign")


def break_probabilities(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """(symbol, level, p_up, p_dn): mean probability of the newest bars in each direction (M6)."""
    s = scored(model, rows)
    return s.groupBy("symbol", "level").agg(F.avg(F.when(F.col("dir_sign") == 1, F.col("p"))).alias("p_up"), F.avg(F.when(F.col("dir_sign") == -1, F.col("p"))).alias("p_dn"))


def directions_differ(probabilities: DataFrame) -> bool:
    """Whether the probabilities tell the directions apart for any level (the check of M6)."""
    return not probabilities.filter(F.abs(F.col("p_up") - F.col("p_dn")) > 1e-12).isEmpty()


#: The grid of the label sweep: horizons, buffers in ATR and costs.
HORIZONS, BUFFERS, COSTS = (8, 10, 12, 16), (0.05, 0.1, 0.15), (0.02, 0.03)
#: Costs at which the best threshold's sensitivity is told (fixed values).
SENSITIVITY = (0.02, 0.03, 0.04)
#: Model columns that are not winsorized.
PLAIN = tuple(c for c in FEATURES if c.startswith(("sess_", "reg_", "hour_")))


def grid_scores(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS, buffers: tuple[float, ...] = BUFFERS, splits: int = 5, lookback: int = 48) -> DataFrame:
    """(h, buffer, symbol, ts, fold, y, p): out-of-fold scores of every label set of the grid (M7), all fitted in
    the same passes over the rows. Folds whose training rows lack a class have no rows. Costs change no
    model, so they come later. The scores are a written table."""
    settings = list(product(horizons, buffers))
    labels = label_grid(bars, [BreakConfig(horizon=h, lookback=lookback, buffer=b) for h, b in settings])
    names = tuple(f"y{i}" for i in range(len(settings)))
    grid = LabelGrid(feature_table(bars).select("symbol", "ts", *FEATURES).join(labels.select("symbol", "ts", *names), ["symbol", "ts"]), FEATURES, names, splits, kept=PLAIN)
    try:
        grid.fit()
        at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("setting") + 1)
        scores = grid.scores().select(at([h for h, _ in settings]).alias("h"), at([b for _, b in settings]).alias("buffer"), "symbol", "ts", "fold", "y", "p")
        return Tables(bars.sparkSession).written(scores)
    finally:
        grid.tables.clear()


def grid_table(scores: DataFrame, costs: tuple[float, ...] = COSTS, least: tuple[float, ...] = (0.30, 0.25)) -> DataFrame:
    """(h, buffer, cost, ap, brier, theta, coverage, ev) of grid_scores (M7, A4, A8): one pass over the scores for
    the metrics and one for each cost. ap is NULL for a setting without positives."""
    by = ("h", "buffer")
    ap = E.average_precision_by(scores, by)
    brier = scores.groupBy(*by).agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))
    out = None
    for cost in costs:
        best = E.plain_best(E.sweep(scores, E.SWEEP_GRID, by, cost=cost), by, *least).withColumn("cost", F.lit(cost))
        out = best if out is None else out.unionByName(best)
    return out.join(ap, list(by)).join(brier, list(by)).select(*by, "cost", "ap", "brier", "theta", "trades", "coverage", "ev")


def direction_pipeline(bars: DataFrame, h: int = 12, band: float = 0.0005, splits: int = 5) -> DataFrame:
    """Out-of-fold scores for upward and downward moves (M8): (target, symbol, ts, fold, y, p)."""
    table = direction_labels(feature_table(bars), h, band).filter("fwd_ret IS NOT NULL")
    one = lambda t: out_of_fold(table.withColumn("y", F.col(t)), splits, calibration="isotonic").withColumn("target", F.lit(t))
    return one("y_up").unionByName(one("y_down"))


#: Statistics of fold metrics (fixed names).
DESCRIBED = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def fold_summary(oof: DataFrame, theta: float = 0.5) -> DataFrame:
    """Metrics of each fold, then their count, mean, deviation, least, quartiles and greatest; a metric that a fold
    lacks is passed over (A16). Folds are few."""
    folds = E.confusion(oof, theta, ("fold",)).join(E.average_precision_by(oof, ("fold",)), "fold").select(F.col("fold").cast("string").alias("fold"), "ap", "brier", "mcc", "balanced_accuracy", "f1_pos", "f1_neg")
    metrics = folds.columns[1:]
    figures = {"count": lambda c: F.count(c).cast("double"), "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max} | {f"{int(100 * q)}%": (lambda q: lambda c: F.percentile(c, F.lit(q)))(q) for q in (0.25, 0.5, 0.75)}
    one = folds.agg(*[figures[d](c).alias(f"{d} {c}") for d in DESCRIBED for c in metrics])
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("fold"), *[F.col(f"{d} {c}").alias(c) for c in metrics]) for d in DESCRIBED])).alias("x")
    return folds.unionByName(one.select(rows).select("x.*"))


def run_meta(bars: DataFrame, oof: DataFrame, features: tuple[str, ...] = FEATURES, win: float = 1.0, loss: float = 1.0, cost: float = 0.15, splits: int = 5, embargo: int = 1) -> DataFrame:
    """One row that tells about a run (A22): span, rows, class balance, mean metrics of the folds, the threshold
    with its coverage and expected values, the settings, cost sensitivity, and thresholds by session and by
    session and regime. oof is a written table, as every figure reads it; a few figures of each are joined."""
    span = bars.agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    rows = oof.agg(F.count("*").alias("rows"), F.struct(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).alias("class_balance"))
    macro = fold_summary(oof).filter("fold = 'mean'").select(F.struct(F.col("ap").alias("ap_macro"), F.col("brier").alias("brier_macro")).alias("oof"))
    best = E.best_theta(E.sweep(oof, E.theta_grid(cost=cost), win=win, loss=loss, cost=cost)).select(F.struct("theta", "coverage", "ev").alias("threshold"))
    mapped = lambda df, key, value, name: df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key.alias("k"), value.alias("v"))))).alias(name))  # noqa: E731  a few rows
    costs = mapped(grid_table(oof.withColumns({"h": F.lit(0), "buffer": F.lit(0.0)}), SENSITIVITY), F.col("cost").cast("string"), F.struct("theta", "coverage", "ev", "trades"), "ev_cost_sensitivity")
    by_session = E.by_session(oof)
    grid = E.theta_grid(cost=cost)
    sessions = mapped(E.best_theta(E.sweep(by_session, grid, ("session",), cost=cost), ("session",)), F.col("session"), F.col("theta"), "theta_by_session")
    known = feature_table(bars).select("symbol", "ts", "reg_atr_low", "reg_atr_mid", "reg_atr_high")
    both = E.regime_thetas(oof.join(known, ["symbol", "ts"]), grid, cost=cost)
    regimes = mapped(both, F.concat_ws("|", "session", "regime"), F.col("theta"), "theta_by_session_regime")
    out = span
    for one in (rows, macro, best, costs, sessions, regimes):
        out = out.crossJoin(one)  # one row each
    settings = {"ev_cfg": F.struct(F.lit(win).alias("win"), F.lit(loss).alias("loss"), F.lit(cost).alias("cost")), "features": F.array(*map(F.lit, features)), "cv": F.struct(F.lit("purged").alias("kind"), F.lit(splits).alias("n_splits"), F.lit(embargo).alias("embargo"))}
    return out.withColumns(settings)
