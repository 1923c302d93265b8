"""Rolling levels in chunks against clustering all visible prices anew at each bar."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pandas as pd

from barlab.operators import levels as V

SCHEMA = "symbol string, kind string, bar_idx long, price double"


def plain_levels(points, share, k, digits=3):
    """Rounded means of the density clusters of [(price, kind, bar_idx)], by plain loops; means are exact before they are rounded."""
    n = len(points)
    mean = sum(p[0] for p in points) / n
    eps = share * math.sqrt(sum((p[0] - mean) ** 2 for p in points) / n)
    if eps <= 0:
        return set()
    ordered = sorted(points)
    core = [p for p in ordered if sum(abs(q[0] - p[0]) <= eps for q in ordered) >= k]
    groups = []
    for p in core:
        if groups and p[0] - groups[-1][-1][0] <= eps:
            groups[-1].append(p)
        else:
            groups.append([p])
    order = sorted(range(len(groups)), key=lambda g: min((p[1], p[2]) for p in groups[g]))
    members = [[p[0] for p in g] for g in groups]
    for p in ordered:
        if p not in core:
            mine = next((g for g in order if any(abs(p[0] - c[0]) <= eps for c in groups[g])), None)
            if mine is not None:
                members[mine].append(p[0])
    return {round(float(sum(map(Fraction, m)) / len(m)), digits) for m in members}


def plain_rolling(rows, look, share, k):
    late, out, active = (look - 1) // 2, [], {}
    for at in sorted({r[2] + late for r in rows}):
        now = plain_levels([(r[3], r[1], r[2]) for r in rows if r[2] + late <= at], share, k)
        out += [(x, active.pop(x), at) for x in sorted(set(active) - now)]
        active |= {x: at for x in now if x not in active}
    return sorted(out + [(x, at, None) for x, at in active.items()], key=repr)


def some_pivots(seed, n, symbol="A"):
    """Walking prices with jumps, repeated values and narrow and wide stretches."""
    rng, at, price, rows = random.Random(seed), 0, 100.0, []
    for _ in range(n):
        at += rng.choice([0, 1, 3, 9])
        price += rng.gauss(0, rng.choice([0.01, 0.3, 2.0]))
        rows.append((symbol, rng.choice(["high", "low"]), at, round(price, 2) if rng.random() < 0.7 else 101.25))
    return [r for i, r in enumerate(rows) if (r[1], r[2]) not in {(q[1], q[2]) for q in rows[:i]}]


def test_rolling_levels_by_brute_force(spark):
    for seed, share, k in ((0, 0.05, 3), (1, 0.02, 3), (2, 0.2, 5), (3, 0.1, 1)):
        rows = some_pivots(seed, 160)
        frame = spark.createDataFrame(rows, SCHEMA)
        want = plain_rolling(rows, 10, share, k)
        assert want
        for chunk in (70, 32_768):
            got = V.rolling_levels(frame, 10, share, k, chunk=chunk).collect()
            assert sorted(((r.level, r.from_idx, r.to_idx) for r in got), key=repr) == want, (seed, chunk)


def test_chunks_of_a_long_series_are_folded(spark):
    """Chunks carry far fewer prices than came before them, and give what one chunk gives."""
    rng = np.random.default_rng(5)
    n = 12_000
    price = np.where(np.arange(n) < 1000, rng.normal(100, 8, n), rng.normal(103, 1, n))  # eps shrinks on the way
    frame = spark.createDataFrame(pd.DataFrame({"symbol": "A", "kind": "high", "bar_idx": np.arange(n) * 3, "price": price}))
    whole = V.rolling_levels(frame, 10, 0.02, chunk=10**9).toPandas()
    parts = V.rolling_levels(frame, 10, 0.02, chunk=6000).toPandas()
    order = ["level", "from_idx"]
    pd.testing.assert_frame_equal(whole.sort_values(order, ignore_index=True), parts.sort_values(order, ignore_index=True))
    held = V._Prices.of(price, np.arange(n), map(V._whole, price), np.ones(n))
    width = V._width(0.02 * price.std())
    folded = held.folded(width, 2)
    assert len(folded.price) <= 4 * len(np.unique(np.floor(price / width))) < n / 4 and folded.count.sum() == n and sum(folded.total) == sum(held.total)


def test_rolling_levels_of_odd_pivots(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert V.rolling_levels(frame).collect() == []
    same = [("A", "high", i, 5.0) for i in range(40)] + [("B", "low", 3, None), ("B", "low", 9, float("nan"))]
    assert V.rolling_levels(spark.createDataFrame(same, SCHEMA), chunk=16).collect() == []
    late = [("A", "high", 100 + i, 5.0 + (i % 2)) for i in range(8)]
    got = V.rolling_levels(spark.createDataFrame(same + late + [(None, "low", i, float(i % 3)) for i in range(20)], SCHEMA), chunk=16)
    assert {(r.symbol, r.level) for r in got.filter("to_idx IS NULL").collect()} == {("A", 5.0), ("A", 6.0)}
