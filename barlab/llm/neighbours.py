"""Nearest neighbours by a block matrix join with int8 product tiles.

Queries and candidates are dealt into blocks; one task holds a block of queries against a block
of candidates and walks it in tiles. Vectors are quantised to int8 with one scale each. A tile of
integer products gives every inner product up to a known error; only pairs whose upper bound
reaches the query's current worst neighbour are recomputed in double precision, and heaps merge
tiles and blocks. No pair that could count is lost, so the result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a query block and of a candidate block (expected; rows are dealt by hash), and of a tile. Each
#: candidate is copied once per query block: wide query blocks keep the shuffle small.
QUERY_ROWS, CANDIDATE_ROWS, TILE_ROWS = 4096, 16384, 512
#: Components whose integer products float32 sums exactly: 1024 * 127 * 127 < 2 ** 24.
EXACT_WIDTH = 1024
#: Queries whose lists are merged in one task group, and lists of each that meet there; merging goes on in levels.
MERGED_QUERIES, MERGED_LISTS = 16, 64


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as int8, their scales, and the 1-norms of the rows as given."""
    scale = np.abs(x).max(axis=1) / 127.0
    whole = np.rint(x / np.where(scale > 0, scale, 1)[:, None])
    return np.clip(whole, -127, 127).astype(np.int8), scale, np.abs(x).sum(axis=1)


def integer_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of int8 rows, exact: float32 multiplies tiles of at most EXACT_WIDTH components
    without rounding, wider rows are summed over such tiles."""
    out = np.zeros((len(q), len(c)))
    for at in range(0, q.shape[1], EXACT_WIDTH):
        out += q[:, at : at + EXACT_WIDTH].astype(np.float32) @ c[:, at : at + EXACT_WIDTH].astype(np.float32).T
    return out


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, components added in order."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.cumsum(q * c, axis=1)[:, -1]


class Block:
    """Candidates' quantised tiles, made once for all queries of a task."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.whole, self.scale, self.norm = quantised(vectors)


def search_block(query_ids: np.ndarray, queries: np.ndarray, block: Block, k: int) -> list[list[tuple[float, int]]]:
    """For each query its k nearest of the block as a heap of (score, -id), the worst first."""
    whole, scale, norm = quantised(queries)
    reach = scale * np.abs(whole.astype(np.int32)).sum(axis=1)  # 1-norm of the quantised query
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    worst = np.full(len(query_ids), -np.inf)
    for at in range(0, len(block.ids), TILE_ROWS):
        tile = slice(at, at + TILE_ROWS)
        ids = block.ids[tile]
        with np.errstate(over="ignore", invalid="ignore"):
            near = integer_products(whole, block.whole[tile]) * (scale[:, None] * block.scale[tile][None, :])
            # x.y = (a+e).(b+f) with |e| <= scale_x / 2, |f| <= scale_y / 2 in every component
            error = 0.5 * (reach[:, None] * block.scale[tile][None, :] + scale[:, None] * block.norm[tile][None, :])
            error = error * (1 + 1e-5) + 1e-6 * np.abs(near) + 1e-300
            # Where products overflow, or scales underflow, nothing is known before the exact product.
            vague = ~(np.isfinite(near) & np.isfinite(error)) | (scale < 1e-150)[:, None] | (block.scale[tile] < 1e-150)[None, :]
            upper, lower = np.where(vague, np.inf, near + error), np.where(vague, -np.inf, near - error)
        own = query_ids[:, None] == ids[None, :]
        lower[own] = -np.inf
        floor = worst
        if len(ids) > k:  # k candidates of this tile are certain to reach their lower bounds
            floor = np.maximum(worst, np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k])
        rows, cols = np.nonzero((upper >= floor[:, None]) & ~own)
        scores = products(queries[rows], block.vectors[tile][cols])
        for r, s, i in zip(rows.tolist(), scores.tolist(), ids[cols].tolist(), strict=True):
            if s != s:  # an overflow of both signs is no number
                continue
            heap, item = heaps[r], (s, -i)
            if len(heap) < k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
        worst = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
    return heaps


def usable(vector: str) -> Column:
    """Vectors that take part: not null, no null or non-finite component, not all zero."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(False)) & F.exists(x, lambda v: v != 0)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for rows with id divisible by `every`, their k nearest rows.

    Nearest means the largest inner product; ties go to the smaller id. Products that overflow are
    infinite and count as such; a sum of both infinities is no number and takes no part. A query's own id is no
    candidate. Rows with a null id or an unusable vector take no part; vectors of different lengths
    are not compared. Of repeated rows (equal ids) the one with the smallest vector takes part, so
    ids in a list are distinct. An empty table gives an empty result; other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_x"))
    rows = rows.filter(F.col("_id").isNotNull()).filter(usable("_x")).groupBy("_id").agg(F.min("_x").alias("_x"))
    n = rows.count()
    n_cand = max(1, -(-n // CANDIDATE_ROWS))
    n_query = max(1, -(-n // (every * QUERY_ROWS)))
    block = lambda salt, m: F.pmod(F.xxhash64("_id", F.lit(salt)), F.lit(m)).cast("int")
    candidates = rows.withColumn("_c", block("candidate", n_cand)).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1)))).withColumn("_role", F.lit(0))
    queries = rows.filter(F.col("_id") % every == 0).withColumn("_q", block("query", n_query)).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(n_cand - 1)))).withColumn("_role", F.lit(1))

    def cell(both: pd.DataFrame) -> pd.DataFrame:
        size = both["_x"].map(len)
        out: list[tuple[int, int, float, int]] = []
        for width in sorted(set(size)):
            part = both[size == width]
            cand, quer = part[part["_role"] == 0], part[part["_role"] == 1]
            if cand.empty or quer.empty:
                continue
            tiles = Block(cand["_id"].to_numpy(), np.stack(cand["_x"].to_list()))
            ids = quer["_id"].to_numpy()
            for q, heap in zip(ids.tolist(), search_block(ids, np.stack(quer["_x"].to_list()), tiles, k), strict=True):
                out += [(q, -minus, s, int(both["_c"].iloc[0])) for s, minus in heap]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "_c"])

    found = candidates.unionByName(queries).groupBy("_q", "_c").applyInPandas(cell, "query_id long, vec_id long, score double, _c int")

    def merge(lists: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, float, int]] = []
        for q, own in lists.groupby("query_id", sort=False):
            best = heapq.nsmallest(k, zip((-own["score"]).tolist(), own["vec_id"].tolist(), strict=True))
            out += [(int(q), r, i, -s, int(own["_c"].iloc[0]) // MERGED_LISTS) for r, (s, i) in enumerate(best, 1)]
        return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score", "_c"])

    # A query has k rows for each candidate block: at most MERGED_LISTS blocks' meet in a group, then what is left.
    queries_of = F.xxhash64(F.floor(F.col("query_id") / (every * MERGED_QUERIES)))
    blocks = n_cand
    while True:
        found = found.groupBy(queries_of.alias("_g"), F.floor(F.col("_c") / MERGED_LISTS).alias("_b")).applyInPandas(merge, "query_id long, rank int, vec_id long, score double, _c int")
        blocks = -(-blocks // MERGED_LISTS)
        if blocks == 1:
            return found.drop("_c")


#: The same search in DuckDB: all products of the stated queries, ranked.
NEAREST_SQL = """
WITH v AS (
  SELECT vec_id, min(x) AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)
  WHERE vec_id IS NOT NULL AND x IS NOT NULL AND len(x) > 0
    AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
  GROUP BY vec_id),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
