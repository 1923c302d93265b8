"""Pivots, support and resistance levels, and their scores."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import rounded_half, session_name
from .features import by_time, gated, true_range, with_index


def centred_pivots(bars: DataFrame, look: int = 10) -> DataFrame:
    """(symbol, ts, bar_idx, kind, price): bars that equal the extreme of the centred window.

    The window holds look // 2 bars before and (look - 1) // 2 after; edges give none, plateaus several.
    """
    df = with_index(bars)
    frame = by_time().rowsBetween(-(look // 2), (look - 1) // 2)
    full = F.count("*").over(frame) >= look
    df = df.withColumns({"_h": full & (F.col("high") == F.max("high").over(frame)), "_l": full & (F.col("low") == F.min("low").over(frame))})
    one = lambda flag, kind, price: df.filter(flag).select("symbol", "ts", "bar_idx", F.lit(kind).alias("kind"), F.col(price).alias("price"))
    return one("_h", "high", "high").unionByName(one("_l", "low", "low"))


def strict_pivots(bars: DataFrame, left: int = 3, right: int = 3) -> DataFrame:
    """Bars strictly above (below) their neighbours on both sides."""
    df = with_index(bars)
    before, after = by_time().rowsBetween(-left, -1), by_time().rowsBetween(1, right)
    full = (F.count("*").over(before) == left) & (F.count("*").over(after) == right)
    h, lo = F.col("high"), F.col("low")
    df = df.withColumns({"_h": full & (h > F.max(h).over(before)) & (h > F.max(h).over(after)), "_l": full & (lo < F.min(lo).over(before)) & (lo < F.min(lo).over(after))})
    one = lambda flag, kind, price: df.filter(flag).select("symbol", "ts", "bar_idx", F.lit(kind).alias("kind"), F.col(price).alias("price"))
    return one("_h", "high", "high").unionByName(one("_l", "low", "low"))


#: Bars of a chunk in which pivots are thinned.
THIN_CHUNK = 4096


def _walk(places: np.ndarray, free_from: int, gap: int) -> tuple[np.ndarray, int]:
    """Which of the sorted places the greedy rule keeps, and from where on the next may be kept."""
    kept = np.zeros(len(places), bool)
    at = int(np.searchsorted(places, free_from))
    while at < len(places):
        kept[at] = True
        free_from = int(places[at]) + gap
        at = int(np.searchsorted(places, free_from))
    return kept, free_from


def thinned(pivots: DataFrame, gap: int = 5, chunk: int = THIN_CHUNK) -> DataFrame:
    """Pivots of a kind at least `gap` bars after the last one kept.

    The greedy rule is a walk over jump pointers. What a chunk of bars does to it depends only on how
    many of its first bars are still barred (0 to gap - 1): every chunk works out all these ways through,
    the chunks' ways are composed one after another, and each chunk then takes the one that is true.
    """
    chunk, columns = max(chunk, gap), list(pivots.columns)
    dealt = pivots.withColumn("_chunk", F.floor(F.col("bar_idx") / chunk).cast("long"))

    def ways(p: pd.DataFrame) -> pd.DataFrame:
        places, begin = np.sort(p["bar_idx"].to_numpy()), int(p["_chunk"].iloc[0]) * chunk
        out = [max(0, _walk(places, begin + barred, gap)[1] - begin - chunk) for barred in range(gap)]
        return p[["symbol", "kind", "_chunk"]].iloc[:1].assign(_out=[out])

    def composed(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_chunk")
        barred, last, entry = 0, None, []
        for at, out in zip(p["_chunk"].tolist(), p["_out"], strict=True):
            barred = barred if last is None or at == last + 1 else 0  # a chunk without pivots bars nothing further on
            entry.append(barred)
            barred, last = int(out[barred]), at
        return p[["symbol", "kind", "_chunk"]].assign(_barred=np.array(entry, np.int32))

    def keep(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("bar_idx")
        kept, _ = _walk(p["bar_idx"].to_numpy(), int(p["_chunk"].iloc[0]) * chunk + int(p["_barred"].iloc[0]), gap)
        return p.loc[kept, columns]

    key = ("symbol", "kind", "_chunk")
    schema = dict((f.name, f.dataType.simpleString()) for f in pivots.schema)
    names = f"symbol {schema['symbol']}, kind {schema['kind']}, _chunk long"
    entries = dealt.groupBy(*key).applyInPandas(ways, f"{names}, _out array<int>").groupBy("symbol", "kind").applyInPandas(composed, f"{names}, _barred int")
    return dealt.join(entries, list(key)).groupBy(*key).applyInPandas(keep, pivots.schema)


def horizontal_levels(pivots: DataFrame, eps_share: float = 0.05, eps: float = 0.0, min_samples: int = 3, digits: int | None = 3) -> DataFrame:
    """(symbol, level, members): 1-D density clusters of pivot prices, as their means (V1).

    Points with min_samples neighbours within eps (themselves counted) are cores; cores within eps
    of each other share a cluster; a border point joins the cluster whose core was seen first. eps
    defaults to a share of the prices' population standard deviation. Only pivots are re-sorted.
    Equal prices are ordered by kind and time wherever order counts: clusters are numbered and means
    added up (cores first) in one fixed order, so neither depends on how rows are dealt out.
    """
    p = pivots.select("symbol", "kind", "ts", "price")
    scale = p.groupBy("symbol").agg((F.lit(eps) if eps > 0 else F.stddev_pop("price") * eps_share).alias("eps")).filter("eps > 0")
    p = p.join(scale, "symbol").withColumn("x", F.col("price") / F.col("eps"))
    p = p.withColumn("core", F.expr(f"count(*) OVER (PARTITION BY symbol ORDER BY x RANGE BETWEEN 1.0D PRECEDING AND 1.0D FOLLOWING) >= {min_samples}"))
    upward = Window.partitionBy("symbol").orderBy("x", "kind", "ts")
    cores = p.filter("core").withColumn("_new", F.coalesce((F.col("x") - F.lag("x").over(upward) > 1.0).cast("int"), F.lit(1)))
    cores = cores.withColumn("cluster", F.sum("_new").over(upward.rowsBetween(Window.unboundedPreceding, 0)))
    seen = cores.groupBy("symbol", "cluster").agg(F.min(F.struct("kind", "ts")).alias("seen"))
    cores = cores.join(seen, ["symbol", "cluster"])
    # A border point lies within eps of at most the nearest core below and the nearest above.
    everything = p.filter("NOT core").select("symbol", "kind", "ts", "x", "price", F.lit(None).cast("long").alias("cluster"), F.lit(None).cast(cores.schema["seen"].dataType).alias("seen")).unionByName(cores.select("symbol", "kind", "ts", "x", "price", F.col("cluster").cast("long"), "seen"))
    at = F.when(F.col("cluster").isNotNull(), F.struct("x", "cluster", "seen"))
    order = Window.partitionBy("symbol").orderBy("x")
    near = everything.withColumns({"_b": F.last(at, True).over(order.rangeBetween(Window.unboundedPreceding, 0)), "_a": F.first(at, True).over(order.rangeBetween(0, Window.unboundedFollowing))})
    below = F.when(F.col("x") - F.col("_b.x") <= 1.0, F.struct(F.col("_b.seen").alias("seen"), F.col("_b.cluster").alias("cluster")))
    above = F.when(F.col("_a.x") - F.col("x") <= 1.0, F.struct(F.col("_a.seen").alias("seen"), F.col("_a.cluster").alias("cluster")))
    joined = near.withColumn("_c", F.coalesce("cluster", F.least(below, above)["cluster"])).filter("_c IS NOT NULL")
    inward = Window.partitionBy("symbol", "_c").orderBy(F.col("cluster").isNull(), "x", "kind", "ts")
    sums = joined.select("symbol", "_c", F.row_number().over(inward).alias("n"), F.sum("price").over(inward.rowsBetween(Window.unboundedPreceding, 0)).alias("_s"))
    mean = sums.groupBy("symbol", "_c").agg((F.max_by("_s", "n") / F.max("n")).alias("level"), F.count("*").alias("members"))
    level = rounded_half(F.col("level"), digits) + 0.0 if digits is not None else F.col("level")
    return mean.groupBy("symbol", level.alias("level")).agg(F.sum("members").alias("members"))


def touched(buffer: float) -> Column:
    """Whether the bar spans the level or closes within the buffer of it."""
    return ((F.col("low") <= F.col("level")) & (F.col("high") >= F.col("level"))) | (F.abs(F.col("close") - F.col("level")) <= buffer)


def level_scores(bars: DataFrame, levels: DataFrame, buffer: float = 0.05, weights: tuple[float, float, float, float] = (0.3, 0.3, 0.2, 0.2)) -> DataFrame:
    """Levels by touches, nearness, session share and volatility, each scaled within the symbol (V2)."""
    hit = bars.join(levels.select("symbol", "level"), "symbol").filter(touched(buffer))
    counts = hit.groupBy("symbol", "level").agg(F.count("*").alias("touches"), F.avg((session_name(F.col("ts")) != "Other").cast("double")).alias("session_ratio"))
    last = true_range(bars).withColumn("atr", gated(F.avg, F.col("tr"), 14)).groupBy("symbol").agg(F.max_by("close", "ts").alias("close"), F.max_by("atr", "ts").alias("atr"))
    df = levels.select("symbol", "level").join(counts, ["symbol", "level"], "left").join(last, "symbol")
    df = df.withColumns({"touches": F.coalesce("touches", F.lit(0)), "session_ratio": F.coalesce("session_ratio", F.lit(0.0)), "near": 1 / (F.abs(F.col("close") - F.col("level")) + 1e-6), "atr_norm": F.coalesce("atr", F.lit(0.0)) / F.greatest(F.lit(1e-6), "close")})
    s = Window.partitionBy("symbol")
    for c in ("touches", "near", "session_ratio", "atr_norm"):
        lo, hi, n = F.min(c).over(s), F.max(c).over(s), F.count("*").over(s)
        same = F.abs(hi - lo) <= 1e-9 * F.greatest(F.abs(lo), F.abs(hi))
        rank = (F.rank().over(s.orderBy(c)) + (F.count("*").over(Window.partitionBy("symbol", c)) - 1) / 2) / n
        df = df.withColumn(f"{c}_n", F.when(same, rank).otherwise((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0))))
    total = sum(weights)
    score = sum((F.col(f"{c}_n") * (w / total) for c, w in zip(("touches", "near", "session_ratio", "atr_norm"), weights, strict=True)), F.lit(0.0)) * 100
    return df.withColumn("score", score).drop("close", "atr")


def top_levels(scored: DataFrame, k: int = 15, by: str = "score") -> DataFrame:
    """The k best levels of each symbol, the lower of equals first (O3)."""
    w = Window.partitionBy("symbol").orderBy(F.desc(F.round(by, 9)), "level")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def touch_counts(bars: DataFrame, levels: DataFrame, n: int = 200, buffer: float = 0.05) -> DataFrame:
    """For each bar and level, touches in the last n bars."""
    j = bars.join(levels.select("symbol", "level"), "symbol").withColumn("_t", touched(buffer).cast("int"))
    frame = Window.partitionBy("symbol", "level").orderBy("ts").rowsBetween(-(n - 1), 0)
    return j.withColumn("touches", F.sum("_t").over(frame)).drop("_t")


#: Prices are added up as whole numbers of 2 ** -UNIT, so that sums do not depend on order or chunks.
UNIT = 60
#: Bars of a chunk in which rolling levels are worked out.
LEVEL_CHUNK = 32_768
#: Cells of a width whose folded prices are carried through the chunks by one task.
CELL_BLOCK = 64


def _whole(price: float) -> int:
    return int(math.ldexp(price, UNIT))


def _deviation(n: int, s1: int, s2: int, of: int | None = None) -> float:
    """Population deviation by exact moments; with `of`, the least it can be once there are `of` prices."""
    return math.sqrt((n * s2 - s1 * s1) / (n * (of or n) << 2 * UNIT)) if n else 0.0


def _width(least_eps: float) -> float:
    """The power of two below eps that prices are folded by; 0 folds equal prices only."""
    return 2.0 ** math.floor(math.log2(least_eps * 0.999)) if least_eps > 0 else 0.0


@dataclass
class _Prices:
    """Sorted prices; each stands for `count` pivots that sum up to `total`, the first of them seen at `seen`."""

    price: np.ndarray
    seen: np.ndarray
    total: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, price, seen, total, count) -> _Prices:
        price, total = np.asarray(price, float), np.array([int(t) for t in total], object)
        order = np.argsort(price, kind="stable")
        return cls(price[order], np.asarray(seen, np.int64)[order], total[order], np.asarray(count, np.int64)[order])

    def __add__(self, more: _Prices) -> _Prices:
        both = ((getattr(self, f), getattr(more, f)) for f in ("price", "seen", "total", "count"))
        return _Prices.of(*map(np.concatenate, both))

    def insert(self, price: float, seen: int) -> None:
        at = int(np.searchsorted(self.price, price))
        self.price, self.seen = np.insert(self.price, at, price), np.insert(self.seen, at, seen)
        self.total, self.count = np.insert(self.total, at, _whole(price)), np.insert(self.count, at, 1)

    def folded(self, width: float, keep: int) -> _Prices:
        """Of each cell of `width` the `keep` lowest and highest prices; those between go to the one below.

        Where something lies between, the cell holds more than 2 * keep pivots. With width <= eps and
        keep >= min_samples - 1 they are all cores of one cluster, and no price outside sees a change.
        """
        if not len(self.price):
            return self
        cell = np.floor(self.price / width) if width > 0 else self.price
        start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        size = np.diff(np.append(start, len(cell)))
        place = np.arange(len(cell)) - np.repeat(start, size)
        at = np.flatnonzero((place < keep) | (np.repeat(size, size) - place <= keep))
        return _Prices(self.price[at], np.minimum.reduceat(self.seen, at), np.add.reduceat(self.total, at), np.add.reduceat(self.count, at))

    def means(self, eps: float, k: int) -> list[float]:
        """Means of the density clusters, in order; a border point within eps of two clusters goes to the
        one whose core was seen first."""
        if not eps > 0 or not len(self.price):
            return []
        p = self.price
        core = np.flatnonzero(np.searchsorted(p, p + eps, "right") - np.searchsorted(p, p - eps, "left") >= k)
        if not len(core):
            return []
        label = np.cumsum(np.concatenate(([0], np.diff(p[core]) > eps)))
        first = np.minimum.reduceat(self.seen[core], np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1]))))
        after = np.searchsorted(core, np.arange(len(p)))  # of the cores, the first at or above each price
        above, below = np.minimum(after, len(core) - 1), np.maximum(after - 1, 0)
        near_above = (after < len(core)) & (p[core[above]] - p <= eps)
        near_below = (after > 0) & (p - p[core[below]] <= eps)
        mine = np.where(near_above & near_below, np.where(first[label[below]] < first[label[above]], label[below], label[above]), np.where(near_above, label[above], np.where(near_below, label[below], -1)))
        mine[core] = label
        inside = np.flatnonzero(mine >= 0)
        starts = np.flatnonzero(np.concatenate(([True], np.diff(mine[inside]) != 0)))
        totals, counts = np.add.reduceat(self.total[inside], starts), np.add.reduceat(self.count[inside], starts)
        return [t / (int(c) << UNIT) for t, c in zip(totals, counts, strict=True)]

    def clusters(self, eps: float, k: int, digits: int) -> set[float]:
        """The rounded means of the density clusters."""
        return {round(x, digits) for x in self.means(eps, k)}


def _clusters(prices: np.ndarray, seen: np.ndarray, eps: float, k: int) -> list[float]:
    """Means of the density clusters of single prices; seen: each price's place in the order of kind and time."""
    return _Prices.of(prices, seen, map(_whole, prices), np.ones(len(prices))).means(eps, k)


def rolling_levels(pivots: DataFrame, look: int = 10, eps_share: float = 0.05, min_samples: int = 3, digits: int = 3, chunk: int = LEVEL_CHUNK) -> DataFrame:
    """(symbol, level, from_idx, to_idx): levels by the pivots visible so far (V3).

    A pivot is visible (look - 1) // 2 bars after it. Clusters change only when a pivot appears, so
    levels come as half-open bar intervals (to_idx NULL: still valid). Pivots without a symbol or a
    finite price take no part; a symbol whose prices are all the same has no levels.

    Each chunk of a symbol's bars is a task of its own. It begins with all earlier prices, folded into
    cells no wider than any eps of the chunk: what lies deep inside a cell counts by number and sum
    only. So a task holds some prices per cell and its own pivots, however long the series. Widths are
    powers of two; an earlier chunk is folded once for each width that later ones use.
    """
    keep, late = max(min_samples - 1, 1), (look - 1) // 2
    kind = pivots.schema["symbol"].dataType.simpleString()
    key, price = ("symbol", "_chunk"), F.col("price").cast("double")
    seen = F.col("bar_idx") + F.when(F.col("kind") == "high", 0).otherwise(1 << 40)  # in the order of kind and time
    at = F.col("bar_idx") + late
    dealt = pivots.filter(F.col("symbol").isNotNull() & price.isNotNull() & (F.abs(price) < float("inf"))).select("symbol", price.alias("price"), seen.cast("long").alias("seen"), at.cast("long").alias("at"), F.floor(at / chunk).cast("long").alias("_chunk"))

    def moments(p: pd.DataFrame) -> pd.DataFrame:
        x = [_whole(v) for v in p["price"]]
        return p[["symbol", "_chunk"]].iloc[:1].assign(n=len(x), s1=str(sum(x)), s2=str(sum(v * v for v in x)))

    def before(p: pd.DataFrame) -> pd.DataFrame:
        p, n, s1, s2, out = p.sort_values("_chunk"), 0, 0, 0, []
        for m, t1, t2 in zip(p["n"].tolist(), p["s1"], p["s2"], strict=True):
            out.append((n, str(s1), str(s2), _width(eps_share * _deviation(n, s1, s2, n + m))))
            n, s1, s2 = n + m, s1 + int(t1), s2 + int(t2)
        return pd.concat([p[["symbol", "_chunk"]].reset_index(drop=True), pd.DataFrame(out, columns=["n", "s1", "s2", "width"])], axis=1)

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        own, frames = _Prices.of(p["price"], p["seen"], map(_whole, p["price"]), np.ones(len(p))), []
        for width in p["widths"].iloc[0]:
            f = own.folded(width, keep)
            cell = np.floor(f.price / width) if width > 0 else f.price
            frames.append(pd.DataFrame({"width": width, "block": np.floor(cell / CELL_BLOCK), "price": f.price, "seen": f.seen, "total": [str(t) for t in f.total], "count": f.count}))
        out = pd.concat(frames)
        return out.assign(symbol=p["symbol"].iloc[0], _chunk=p["_chunk"].iloc[0])

    def carry(p: pd.DataFrame) -> pd.DataFrame:
        """The block's prices before each chunk that uses the width."""
        uses, held, frames = p["uses"].iloc[0], _Prices.of([], [], [], []), []
        width, of_chunk = p["width"].iloc[0], dict(list(p.groupby("_chunk")))
        waiting = sorted(of_chunk)
        for chunk_id in sorted(uses):
            while waiting and waiting[0] < chunk_id:
                more = of_chunk[waiting.pop(0)]
                held = (held + _Prices.of(more["price"], more["seen"], more["total"], more["count"])).folded(width, keep)
            frames.append(pd.DataFrame({"_chunk": chunk_id, "price": held.price, "seen": held.seen, "total": [str(t) for t in held.total], "count": held.count}))
        return pd.concat(frames).assign(symbol=p["symbol"].iloc[0])

    def replay(p: pd.DataFrame, earlier: pd.DataFrame) -> pd.DataFrame:
        if p.empty:
            return pd.DataFrame(columns=["symbol", "level", "at", "begins"])
        p = p.sort_values(["at", "price", "seen"])
        n, s1, s2 = int(p["n"].iloc[0]), int(p["s1"].iloc[0]), int(p["s2"].iloc[0])
        base = _Prices.of(earlier["price"], earlier["seen"], earlier["total"], earlier["count"])
        held, active = replace(base), base.clusters(eps_share * _deviation(n, s1, s2), min_samples, digits)
        price, seen, out = p["price"].to_numpy(), p["seen"].to_numpy(), []
        steps, starts = np.unique(p["at"].to_numpy(), return_index=True)
        until = width = room = 0
        for step, i, j in zip(steps.tolist(), starts, np.append(starts[1:], len(p)), strict=True):
            for x, s in zip(price[i:j].tolist(), seen[i:j].tolist(), strict=True):
                held.insert(x, s)
                v = _whole(x)
                n, s1, s2 = n + 1, s1 + v, s2 + v * v
            if n > until:  # a width holds until the number of prices has doubled; the next one starts from all of them
                until = 2 * n
                width = _width(eps_share * _deviation(n, s1, s2, until))
                held = (base + _Prices.of(price[:j], seen[:j], map(_whole, price[:j]), np.ones(j))).folded(width, keep)
                room = 2 * len(held.price) + 64
            elif len(held.price) > room:
                held = held.folded(width, keep)
                room = 2 * len(held.price) + 64
            now = held.clusters(eps_share * _deviation(n, s1, s2), min_samples, digits)
            out += [(x, step, True) for x in now - active] + [(x, step, False) for x in active - now]
            active = now
        frame = pd.DataFrame(out, columns=["level", "at", "begins"])
        frame.insert(0, "symbol", p["symbol"].iloc[0])
        return frame

    names = f"symbol {kind}, _chunk long"
    plan = dealt.groupBy(*key).applyInPandas(moments, f"{names}, n long, s1 string, s2 string").groupBy("symbol").applyInPandas(before, f"{names}, n long, s1 string, s2 string, width double")
    # One row a symbol and width: the chunks that use it. One row a chunk: the widths that later chunks use.
    uses = plan.filter("n > 0").groupBy("symbol", "width").agg(F.collect_list("_chunk").alias("uses"))
    spans = uses.groupBy("symbol").agg(F.collect_list(F.struct("width", F.array_max("uses").alias("last"))).alias("_w"))
    later = F.expr("transform(filter(_w, w -> w.last > _chunk), w -> w.width)")
    own = dealt.join(spans, "symbol").withColumn("widths", later).drop("_w").filter("size(widths) > 0")
    kept = own.groupBy(*key).applyInPandas(fold, f"{names}, width double, block double, price double, seen long, total string, count long")
    seeds = kept.join(uses, ["symbol", "width"]).groupBy("symbol", "width", "block").applyInPandas(carry, f"{names}, price double, seen long, total string, count long")
    # A named number of partitions, as adaptive execution would put chunks, small but slow, into one task.
    parts = int(pivots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = dealt.join(plan.drop("width"), list(key)).repartition(parts, *key).groupBy(*key).cogroup(seeds.groupBy(*key)).applyInPandas(replay, f"symbol {kind}, level double, at long, begins boolean")
    over = Window.partitionBy("symbol", "level").orderBy("at")
    return turns.withColumn("to_idx", F.lead("at").over(over)).filter("begins").select("symbol", "level", F.col("at").alias("from_idx"), "to_idx")
