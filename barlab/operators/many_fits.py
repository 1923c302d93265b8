"""Many logistic fits in one pass over the rows (M7).

All settings of a label grid and all folds are fitted together. A row is read once a pass: it has
one label per setting, and its day tells which folds it trains, calibrates or tests. Tasks
add up each fit's gradient and curvature (a vector and a matrix of the features), Spark adds up the
tasks', and the driver takes one proximal Newton step for every fit. Some eight passes do what
separate fits need a few hundred jobs for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables
from .splits import fold_bounds

#: Roles of a row in a fit.
NONE, TRAIN, TEST = 0, 1, 2
DAY = 86_400_000_000
#: Cells of probabilities in which isotonic regression pools before the cells' blocks meet.
CELLS = 4096


@dataclass
class Fits:
    """What the driver knows of all fits: one for each setting and fold."""

    setting: np.ndarray  # of each fit, the place of its label
    fold: np.ndarray
    days: np.ndarray  # the days that occur
    role: np.ndarray  # days x fits
    cut: np.ndarray  # microseconds from which training rows are kept for calibration
    low: np.ndarray  # settings x features: bounds of the winsorized features
    high: np.ndarray
    mean: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # fits x features
    scale: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    n: np.ndarray = field(default_factory=lambda: np.zeros(0))
    positive: np.ndarray = field(default_factory=lambda: np.zeros(0))


def summed(rows: DataFrame, terms: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sums over all rows of the vectors that terms(u, x, y) gives for a batch by number: every task adds up
    its own, Spark's summarizer the tasks'."""
    schema = pa.schema([("k", pa.int32()), ("v", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for u, x, y in arrays(batches):
            for k, v in terms(u, x, y).items():
                total[k] = total[k] + v if k in total else v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], schema=schema)

    found = rows.mapInArrow(run, "k int, v array<double>").groupBy("k").agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect()
    return {r.k: r.v.toArray() for r in found}


def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(u, x, y) of batches whose first columns are these; a label that is not there is -1."""
    for batch in batches:
        n = batch.num_rows
        if n:
            flat = [batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2)]
            yield batch.column(0).to_numpy(), flat[0].reshape(n, -1), flat[1].reshape(n, -1)


def pool(p: np.ndarray, total: np.ndarray, n: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Blocks (lowest p, highest p, sum, rows) of isotonic regression over values sorted by p."""
    out: list[tuple[float, float, float, float]] = []
    for lo, hi, s, k in zip(p[0].tolist(), p[1].tolist(), total.tolist(), n.tolist(), strict=True):
        while out and out[-1][2] * k >= s * out[-1][3]:
            first, _, s0, k0 = out.pop()
            lo, s, k = first, s + s0, k + k0
        out.append((lo, hi, s, k))
    return out


def soft(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


def newton_step(w: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """The weights (last: intercept, without penalty) that minimise each fit's quadratic model plus its elastic
    net, by coordinate descent over all fits together."""
    new, d = w.copy(), w.shape[1]
    slope = gradient.copy()  # of the quadratic model at new
    for _ in range(2000):
        moved = 0.0
        for j in range(d):
            own = curvature[:, j, j]
            free = j == d - 1
            bend = own + (0 if free else l2)
            target = own * new[:, j] - slope[:, j]
            to = np.where(bend > 0, (target if free else soft(target, l1)) / np.where(bend > 0, bend, 1), new[:, j])
            step = to - new[:, j]
            if step.any():
                new[:, j] = to
                slope += curvature[:, :, j] * step[:, None]
                moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-9:
            break
    return new


class LabelGrid:
    """Elastic-net logistic fits (standardised features, balanced classes) for many labels and folds.

    rows: symbol, ts, the features, and one label column (0, 1 or null) for each setting. Folds are
    consecutive days of a setting's labelled rows; training keeps days before the fold less `gap` and
    after it plus `embargo`. A fit learns from the older 70 % of its training rows and is calibrated
    by isotonic regression on the rest; where a part lacks a class, it learns from all of them and stays
    uncalibrated. Fits without both classes in training have no scores.
    """

    def __init__(self, rows: DataFrame, features: tuple[str, ...], labels: tuple[str, ...], splits: int = 5, gap: int = 1, embargo: int = 1, c: float = 0.45, l1: float = 0.12, kept: tuple[str, ...] = ()):
        self.tables = Tables(rows.sparkSession)
        self.features, self.labels, self.c, self.l1 = features, labels, c, l1
        u = F.unix_micros(F.col("ts").cast("timestamp"))
        x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
        y = F.array(*[F.coalesce(F.col(k).cast("int"), F.lit(-1)) for k in labels])
        some = F.coalesce(*[F.col(k) for k in labels]).isNotNull()
        self.rows = self.tables.written(rows.filter(some).select(u.alias("u"), x.alias("x"), y.alias("y"), "symbol", "ts"))
        self.data = self.rows.select("u", "x", "y")
        self.free = np.array([f not in kept for f in features])  # features that are winsorized
        self.fits = self._folds(splits, gap, embargo)
        self._scale()

    # --- what each fit reads

    def _folds(self, splits: int, gap: int, embargo: int) -> Fits:
        """Roles of days in all fits. Days are few; rows are only counted."""
        is_there = lambda s: (F.col("y")[s] >= 0).cast("long")
        counted = self.data.groupBy(F.floor(F.col("u") / DAY).alias("day")).agg(*[F.sum(is_there(s)).alias(f"n{s}") for s in range(len(self.labels))]).orderBy("day").collect()
        days = np.array([r.day for r in counted], np.int64)
        n = np.array([list(r)[1:] for r in counted], np.int64).reshape(len(days), -1)
        setting, fold, role, place = [], [], [], []
        for s in range(len(self.labels)):
            grp = np.cumsum(n[:, s] > 0) - 1
            for k, (start, stop) in enumerate(fold_bounds(int(grp[-1]) + 1 if len(grp) else 0, splits), 1):
                r = np.where((grp >= start) & (grp < stop), TEST, np.where((grp < start - gap) | (grp >= stop + embargo), TRAIN, NONE))
                setting.append(s)
                fold.append(k)
                role.append(np.where(n[:, s] > 0, r, NONE))
                # The 70 % quantile of the training rows' times lies between two of them.
                held = np.cumsum(np.where(role[-1] == TRAIN, n[:, s], 0))
                at = 0.7 * (held[-1] - 1) if len(held) and held[-1] else 0.0
                place.append((at, held))
        fits = Fits(np.array(setting), np.array(fold), days, np.array(role, np.int8).T.reshape(len(days), -1), np.zeros(len(setting)), np.zeros((0, 0)), np.zeros((0, 0)))
        # Only the days that hold these rows are looked into.
        wanted = {}
        for f, (at, held) in enumerate(place):
            for rank in {int(np.floor(at)), int(np.ceil(at))} if len(held) and held[-1] else ():
                day = int(np.searchsorted(held, rank, side="right"))
                wanted[(f, rank)] = (int(days[day]), rank - int(held[day - 1] if day else 0))
        times = self._times({(setting[f], day) for (f, _), (day, _) in wanted.items()})
        for f, (at, held) in enumerate(place):
            if len(held) and held[-1]:
                lo, hi = (times[setting[f], wanted[f, int(r)][0]][wanted[f, int(r)][1]] for r in (np.floor(at), np.ceil(at)))
                fits.cut[f] = lo + (hi - lo) * (at - np.floor(at))
        return fits

    def _times(self, wanted: set[tuple[int, int]]) -> dict[tuple[int, int], "Ranks"]:
        """Of some days and settings, how many labelled rows stand at each time."""
        days = sorted({day for _, day in wanted})
        near = self.data.filter(F.floor(F.col("u") / DAY).isin(days)) if days else self.data.limit(0)
        found = near.groupBy("u").agg(*[F.sum((F.col("y")[s] >= 0).cast("long")).alias(f"n{s}") for s in range(len(self.labels))]).orderBy("u").collect()
        out = {}
        for s, day in wanted:
            mine = [(r.u, r[f"n{s}"]) for r in found if r.u // DAY == day and r[f"n{s}"]]
            out[s, day] = Ranks([u for u, _ in mine], np.cumsum([k for _, k in mine]))
        return out

    def _scale(self) -> None:
        """Bounds of winsorized features by setting, then means and deviations by fit."""
        n_sets, d = len(self.labels), len(self.features)

        def moments(u: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[int, np.ndarray]:
            have = (y >= 0).astype(float)
            return {s: np.concatenate(([have[:, s].sum()], have[:, s] @ x, have[:, s] @ x**2)) for s in range(n_sets)}

        m = summed(self.data, moments)
        m = np.array([m.get(s, np.zeros(2 * d + 1)) for s in range(n_sets)])
        n = np.maximum(m[:, :1], 1)
        mean = m[:, 1 : d + 1] / n
        dev = np.sqrt(np.maximum(m[:, d + 1 :] / n - mean**2, 0))
        whole = ~self.free | (dev <= 1e-12 * np.maximum(1, np.abs(mean)))
        self.fits.low, self.fits.high = np.where(whole, -np.inf, mean - 5 * dev), np.where(whole, np.inf, mean + 5 * dev)
        fits = self.fits

        def parts(u: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[int, np.ndarray]:
            out = {}
            for f, cut_x, mine, train, older in members(fits, u, x, y):
                sides = []
                for rows in (older, train):
                    z, k = cut_x[rows], mine[rows]
                    sides.append(np.concatenate(([len(z), k.sum()], z.sum(axis=0), (z**2).sum(axis=0))))
                out[f] = np.concatenate(sides)
            return out

        found = summed(self.data, parts)
        s = np.array([found.get(f, np.zeros(4 * d + 4)) for f in range(len(fits.setting))])
        old, train = s[:, : 2 * d + 2], s[:, 2 * d + 2 :]
        both = lambda a: (a[:, 1] > 0) & (a[:, 1] < a[:, 0])
        self.calibrated = both(old) & both(train - old)
        self.usable = both(train)
        used = np.where(self.calibrated[:, None], old, train)
        n = np.maximum(used[:, :1], 1)
        fits.mean = used[:, 2 : d + 2] / n
        var = np.maximum(used[:, d + 2 :] / n - fits.mean**2, 0) * n / np.maximum(n - 1, 1)
        dev = np.sqrt(var)
        fits.scale = np.where(dev > 1e-12 * np.maximum(1, np.abs(fits.mean)), 1 / np.where(dev > 0, dev, 1), 0.0)
        fits.n, fits.positive = used[:, 0], used[:, 1]

    # --- fitting

    def fit(self, passes: int = 30, tolerance: float = 1e-7) -> np.ndarray:
        """Weights of the standardised features and, last, the intercept, of each fit."""
        fits, d = self.fits, len(self.features)
        n_fits = len(fits.setting)
        reg = 1 / (self.c * np.maximum(fits.n, 1))
        l1, l2 = self.l1 * reg, (1 - self.l1) * reg
        calibrated, usable = self.calibrated, self.usable
        weight = np.array([fits.n / (2 * np.maximum(fits.n - fits.positive, 1)), fits.n / (2 * np.maximum(fits.positive, 1))])
        upper = np.triu_indices(d + 1)
        w, before, value = np.zeros((n_fits, d + 1)), np.zeros((n_fits, d + 1)), np.full(n_fits, np.inf)
        going = usable.copy()
        for _ in range(passes):
            at = w.copy()

            def terms(u: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[int, np.ndarray]:
                out = {}
                for f, cut_x, mine, train, older in members(fits, u, x, y):
                    rows = older if calibrated[f] else train
                    if not going[f] or not len(rows):
                        continue
                    z = np.column_stack(((cut_x[rows] - fits.mean[f]) * fits.scale[f], np.ones(len(rows))))
                    k = mine[rows]
                    share = weight[k, f] / fits.n[f]
                    margin = z @ at[f]
                    p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                    loss = share @ (np.logaddexp(0, margin) - k * margin)
                    bend = (z * (share * p * (1 - p))[:, None]).T @ z
                    out[f] = np.concatenate(([loss], (share * (p - k)) @ z, bend[upper]))
                return out

            found = summed(self.data, terms)
            loss, gradient, curvature = np.zeros(n_fits), np.zeros((n_fits, d + 1)), np.zeros((n_fits, d + 1, d + 1))
            for f, v in found.items():
                loss[f], gradient[f] = v[0], v[1 : d + 2]
                curvature[f][upper] = v[d + 2 :]
                curvature[f] += np.triu(curvature[f], 1).T
            penalty = l1 * np.abs(w[:, :-1]).sum(axis=1) + l2 / 2 * (w[:, :-1] ** 2).sum(axis=1)
            worse = going & (loss + penalty > value + 1e-12)
            value = np.where(worse | ~going, value, loss + penalty)
            step = newton_step(w, gradient, curvature, l1, l2)
            # A step that made things worse is halved and tried again.
            new = np.where(worse[:, None], (w + before) / 2, np.where(going[:, None], step, w))
            before = np.where(worse[:, None], before, w)
            moved = np.abs(new - w).max(axis=1)
            w = new
            going &= moved > tolerance
            if not going.any():
                break
        self.weights = w
        return w

    def calibrate(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Of each calibrated fit, the points between which its probabilities are interpolated."""
        fits, w, calibrated = self.fits, self.weights, self.calibrated
        schema = pa.schema([("fit", pa.int32()), ("p", pa.float64()), ("y", pa.int32())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for u, x, y in arrays(batches):
                for f, cut_x, mine, train, older in members(fits, u, x, y):
                    rows = np.setdiff1d(train, older, assume_unique=True)
                    if calibrated[f] and len(rows):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), f), pa.int32()), pa.array(probability(fits, w, f, cut_x[rows])), pa.array(mine[rows], pa.int32())], schema=schema)

        held = self.data.mapInArrow(run, "fit int, p double, y int").groupBy("fit", "p").agg(F.sum("y").cast("double").alias("s"), F.count("*").cast("double").alias("n"))

        def blocks(table: pa.Table) -> pa.Table:
            t = table.sort_by("p")
            p = t["p"].to_numpy()
            out = pool(np.array([p, p]), t["s"].to_numpy(), t["n"].to_numpy())
            return pa.table({"fit": pa.array([t["fit"][0].as_py()] * len(out), pa.int32()), **{k: pa.array(v, pa.float64()) for k, v in zip(("lo", "hi", "s", "n"), zip(*out), strict=True)}})

        # Cells of p pool by themselves; only their blocks, which are few, come to the driver.
        cell = F.floor(F.col("p") * CELLS)
        found = held.groupBy("fit", cell.alias("cell")).applyInArrow(lambda t: blocks(t), "fit int, lo double, hi double, s double, n double").collect()
        out = {}
        for f in sorted({r.fit for r in found}):
            mine = sorted((r.lo, r.hi, r.s, r.n) for r in found if r.fit == f)
            lo, hi, s, n = (np.array(v) for v in zip(*mine, strict=True))
            final = pool(np.array([lo, hi]), s, n)
            points = [(x, total / k) for first, last, total, k in final for x in ([first, last] if first < last else [first])]
            out[f] = (np.array([x for x, _ in points]), np.array([v for _, v in points]))
        return out

    def scores(self) -> DataFrame:
        """(setting, fold, symbol, ts, y, p) of the test rows of all fits."""
        fits, w, usable = self.fits, self.weights, self.usable
        curves = self.calibrate()
        schema = pa.schema([("setting", pa.int32()), ("fold", pa.int32()), ("symbol", pa.string()), ("ts", self.ts_type()), ("y", pa.int32()), ("p", pa.float64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for u, x, y in arrays(iter([batch])):
                    for f, cut_x, mine, *_, test in members(fits, u, x, y, tests=True):
                        if usable[f] and len(test):
                            p = probability(fits, w, f, cut_x[test])
                            p = np.interp(p, *curves[f]) if f in curves else p
                            at = pa.array(test)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(test), fits.setting[f]), pa.int32()), pa.array(np.full(len(test), fits.fold[f]), pa.int32()), batch.column(3).take(at), batch.column(4).take(at).cast(schema.field("ts").type), pa.array(mine[test], pa.int32()), pa.array(p)], schema=schema)

        ts = dict(self.rows.dtypes)["ts"]
        return self.rows.mapInArrow(run, f"setting int, fold int, symbol string, ts {ts}, y int, p double")

    def ts_type(self) -> pa.DataType:
        return pa.timestamp("us", tz=None if dict(self.rows.dtypes)["ts"] == "timestamp_ntz" else "UTC")


@dataclass
class Ranks:
    """Times with running counts: the time of the row of a rank."""

    times: list[int]
    upto: np.ndarray

    def __getitem__(self, rank: int) -> int:
        return self.times[int(np.searchsorted(self.upto, rank, side="right"))]


def members(fits: Fits, u: np.ndarray, x: np.ndarray, y: np.ndarray, tests: bool = False) -> Iterator[tuple]:
    """(fit, winsorized features, labels, training rows, older training rows[, test rows]) of a batch."""
    day = np.searchsorted(fits.days, u // DAY)
    for s in range(y.shape[1]):
        cut_x = np.clip(x, fits.low[s], fits.high[s])
        there = y[:, s] >= 0
        for f in np.flatnonzero(fits.setting == s).tolist():
            role = fits.role[day, f]
            train = np.flatnonzero(there & (role == TRAIN))
            out = (f, cut_x, y[:, s], train, train[u[train] < fits.cut[f]])
            yield (*out, np.flatnonzero(there & (role == TEST))) if tests else out


def probability(fits: Fits, w: np.ndarray, f: int, x: np.ndarray) -> np.ndarray:
    margin = ((x - fits.mean[f]) * fits.scale[f]) @ w[f, :-1] + w[f, -1]
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
