"""Sharding by sampled splitters (native DataFrame operations only).

Records are ordered by a hash of their text, so copies of a text stay together. A bounded,
size-weighted sample of keys gives quantile splitters; the records are range-partitioned by
them, ranges that turn out overfull are subdivided, and the exact byte counts of all ranges,
laid end to end, are cut into shards of near equal bytes. Keys that would fill a range alone
are dealt first: whole to a shard with room for them, else subdivided by row.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Expected number of sampled keys (the only rows that reach the driver).
SAMPLE = 4096
#: Ranges per shard before subdivision.
RANGES_PER_SHARD = 16
#: A range over this share of a shard is subdivided.
OVERFULL = 1 / 64
#: The largest key there is.
_TOP = (1 << 63) - 1
#: Rows (expected) of a part of a piece within which slots are numbered.
NUMBERED_ROWS = 1 << 15


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus 1; a null text has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def sample_splitters(records: DataFrame, total: int, n_ranges: int, sample: int = SAMPLE) -> tuple[list[int], dict[int, int]]:
    """Splitters at the quantiles of a size-weighted key sample; the keys that fill a range alone, with their size.

    records: (_key, _size). Sizes are summed by key first; a key is drawn
    floor(size * sample / total + u) times, u uniform and a function of the key, so that the expected
    number of draws is `sample` and reruns draw the same.
    """
    if total <= 0:
        return [], {}
    unit = F.pmod(F.xxhash64("_key", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    draws = F.floor(F.col("_all") * F.lit(sample / total) + unit)
    drawn = records.groupBy("_key").agg(F.sum("_size").alias("_all")).withColumn("_n", draws).filter("_n > 0").collect()
    drawn.sort()
    n_drawn = sum(r._n for r in drawn)
    splitters, seen = [], 0
    for r in drawn:
        if (seen * n_ranges) // n_drawn != ((seen + r._n) * n_ranges) // n_drawn:
            splitters.append(r._key)
        seen += r._n
    return splitters, {r._key: r._all for r in drawn if r._all * n_ranges >= total}


def _count_below(key: Column, splitters: list[int]) -> Column:
    """Number of splitters at or below the key: a binary search over one array literal, by halvings."""
    if not splitters:
        return F.lit(0)
    # Padded to a power of 2 with what no key reaches, but for a key that is the largest number itself.
    steps = len(splitters).bit_length()
    held = F.lit(splitters + [_TOP] * ((1 << steps) - len(splitters)))
    halves = F.lit([1 << i for i in reversed(range(steps))])
    found = F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.element_at(held, at + half) <= key, at + half).otherwise(at))
    return F.least(found, F.lit(len(splitters)))


def place_heavy(heavy: dict[int, int], total: int, n_shards: int) -> dict[int, int]:
    """The shard of each heavy key that fits whole into the emptiest one, largest first."""
    room, out = [total / n_shards] * n_shards, {}
    for key, size in sorted(heavy.items(), key=lambda x: (-x[1], x[0])):
        best = max(range(n_shards), key=lambda i: room[i])
        if size <= room[best]:
            room[best] -= size
            out[key] = best
    return out


def cut_into_shards(units: list[tuple[int, int]], whole: dict[int, int], total: int, n_shards: int) -> list[int]:
    """The shard of each unit (range, bytes): ranges in `whole` go where that says; the others, end to end,
    fill what room these leave, each unit by its middle."""
    room = [total / n_shards] * n_shards
    for rng, size in units:
        if rng in whole:
            room[whole[rng]] -= size
    ends = [sum(room[: i + 1]) for i in range(n_shards)]
    out, upto = [], 0
    for rng, size in units:
        if rng in whole:
            out.append(whole[rng])
            continue
        out.append(min(n_shards - 1, bisect_right(ends, upto + size / 2)))
        upto += size
    return out


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Deal the rows of docs into n_shards shards of near equal bytes.

    Returns (id_col, size, text_crc32, shard, slot): size is UTF-8 bytes plus 1, slot is gapless
    from 0 within a shard. Rows with equal texts go to one shard unless they don't fit into one;
    those are split row by row, whatever their ids. A null text has size 1 and the checksum of the
    empty text, a null id is a value like any other, repeated rows (ties in all columns) each get
    a slot, a very long text is one row of its size (sizes are then near equal up to that row), an
    empty table gives an empty result; columns other than the two named are ignored.
    """
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    # One pass over the texts; everything after it reads this table of a few numbers a row. _row tells
    # repeated rows apart; it is written, so it stays.
    records = stored(docs.select(F.col(id_col).alias("_id"), text_size(F.col(text_col)).alias("_size"), crc.alias("_crc"), key.alias("_key"), F.monotonically_increasing_id().alias("_row")))
    total, n_ranges = records.agg(F.sum("_size")).first()[0] or 0, n_shards * RANGES_PER_SHARD
    splitters, heavy = sample_splitters(records, total, n_ranges, sample)
    # A heavy key is a range by itself: its own position and one after it.
    place = lambda k: 2 * bisect_right(splitters, k) + 1
    ranged = records.withColumn("_range", _count_below(F.col("_key"), splitters) * 2 + (F.col("_key").isin(list(heavy)).cast("int") if heavy else F.lit(0)))
    whole = {place(k): shard for k, shard in place_heavy(heavy, total, n_shards).items()}
    limit = max(1, int(total * OVERFULL / n_shards))
    # At most 2 * n_ranges + 2 ranges, and total / limit pieces more: bounded lists, whatever the input.
    held = {r._range: r for r in ranged.groupBy("_range").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows")).collect()}
    pieces = [1 if i in whole or i not in held else -(-held[i]._bytes // limit) for i in range(2 * len(splitters) + 2)]
    parts = [1 if i not in held else -(-held[i]._rows // (NUMBERED_ROWS * pieces[i])) for i in range(len(pieces))]
    first = [sum(pieces[:i]) for i in range(len(pieces))]
    at = lambda values, i: F.element_at(F.lit(values), i + 1)
    # Pieces of overfull ranges: by key where copies can stay together, by row inside a heavy key.
    spread = F.when(F.col("_range") % 2 == 1, F.xxhash64("_row")).otherwise(F.xxhash64("_key", F.lit("piece")))
    unit = at(first, F.col("_range")) + F.pmod(spread, at(pieces, F.col("_range"))).cast("int")
    part = F.pmod(F.xxhash64("_row", F.lit("part")), at(parts, F.col("_range"))).cast("int")
    placed = ranged.withColumn("_unit", unit).withColumn("_part", part)
    counts = placed.groupBy("_unit", "_part").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    bytes_of = {r._unit: r._bytes for r in counts.groupBy("_unit").agg(F.sum("_bytes").alias("_bytes")).collect()}
    units = [(i, bytes_of.get(first[i] + j, 0)) for i in range(len(pieces)) for j in range(pieces[i])]
    shard = at(cut_into_shards(units, whole, total, n_shards), F.col("_unit"))
    in_shard = Window.partitionBy("shard").orderBy("_unit", "_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("shard", shard).select("_unit", "_part", "shard", F.coalesce(F.sum("_rows").over(in_shard), F.lit(0)).alias("_first"))
    in_part = Window.partitionBy("_unit", "_part").orderBy("_key", "_id", "_size", "_crc", "_row")
    numbered = placed.withColumn("_number", F.row_number().over(in_part)).join(counts, ["_unit", "_part"])
    return numbered.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", (F.col("_first") + F.col("_number") - 1).cast("long").alias("slot"))
