"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer when the smallest of its inner s-mers stands at one
of its edges. Whether it is one depends on the k-mer alone, so an edit disturbs only the anchors
that it touches. A fingerprint keeps the anchors with the smallest hashes, more of them for longer
texts, each with the place where it first stands; two fingerprints are alike in the share of
anchors that both have in the same order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of a k-mer and of its inner s-mers; K - S + 1 must be 8 (three doublings).
K, S = 12, 5
#: Anchors in a fingerprint: at least so many (or all), and one of SHARE of a long text's.
ANCHORS, SHARE = 48, 128
#: Documents in a range of neighbours, and ranges at most (they are sorted externally, so a range of
#: any size fits); keys that are sampled for each range, and at most in all.
RANGE_ROWS, MAX_RANGES, RANGE_SAMPLE, MAX_SAMPLE = 512, 32_768, 32, 1 << 18
#: A row (same id, same text) met so often in the sample stands once in the order; its copies are counted.
HEAVY = 4
#: Copies that one task writes.
COPIES = 100_000


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Odd multipliers of the characters of an s-mer.
FACTORS = [int(x) | 1 for x in mix(np.arange(1, S + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))]


def closed_syncmers(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the closed syncmers of a text of at least K code points."""
    c = codes.astype(np.uint64)
    n = len(c) - S + 1
    h = c[:n] * np.uint64(FACTORS[0])
    for j in range(1, S):
        h += c[j : j + n] * np.uint64(FACTORS[j])
    h = mix(h)
    low = np.minimum(h[:-1], h[1:])
    low = np.minimum(low[:-2], low[2:])
    low = np.minimum(low[:-4], low[4:])
    at = np.flatnonzero((h[: len(low)] == low) | (h[K - S :] == low))
    # Three s-mers cover the k-mer.
    return at, mix(h[at] * np.uint64(3) + h[at + 4] * np.uint64(5) + h[at + K - S] * np.uint64(7))


def sketch(text: str) -> list[tuple[int, int]]:
    """(hash, place) of the kept anchors, by hash. A text without closed syncmers (below K code points, or
    little longer) is one anchor, the empty text none."""
    if not text:
        return []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at, h = closed_syncmers(codes) if len(codes) >= K else ((), None)
    if not len(at):
        return [(int.from_bytes(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:4], "big"), 0)]
    short = (h >> np.uint64(32)).astype(np.int64)
    most = max(ANCHORS, len(short) // SHARE)
    if len(short) > 16 * most:  # repeated anchors are few: look for the smallest among the smallest
        bound = np.partition(short, 8 * most)[8 * most]
        near = short <= bound
        if len(np.unique(short[near])) >= most:
            short, at = short[near], at[near]
    values, first = np.unique(short, return_index=True)
    return list(zip(values[:most].tolist(), at[first[:most]].tolist(), strict=True))


def written(anchors: list[tuple[int, int]]) -> str:
    """The fingerprint as text: 8 hex digits of hash and 8 of place for each anchor."""
    return "".join(f"{h:08x}{p:08x}" for h, p in anchors)


def read(fingerprint: str) -> list[tuple[int, int]]:
    """The anchors of a fingerprint."""
    return [(int(fingerprint[i : i + 8], 16), int(fingerprint[i + 8 : i + 16], 16)) for i in range(0, len(fingerprint), 16)]


def likeness(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> float:
    """Share of the anchors of either that both have, in one order of places; 0 to 1.

    Compared are the anchors up to the hash to which both fingerprints are complete. Two empty
    texts are alike (1), an empty and another text are not (0).
    """
    if not a or not b:
        return float(not a and not b)
    bound = min((x[-1][0] for x in (a, b) if len(x) >= ANCHORS), default=1 << 32)
    in_a, in_b = ({h: p for h, p in x if h <= bound} for x in (a, b))
    both = sorted((p, in_b[h]) for h, p in in_a.items() if h in in_b)
    tails: list[int] = []  # of the longest chain that doesn't step back
    for _, place in both:
        i = bisect_left(tails, place + 1)
        tails[i : i + 1] = [place]
    return len(tails) / (len(in_a) + len(in_b) - len(both))


def edited_text(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class Cuts:
    """Splitters of the order by (null ids last, descending id, hash), looked up for whole arrays."""

    def __init__(self, sample: list[tuple[int, int, int]], n_ranges: int):
        picked = sorted(sample)
        picked = [picked[(i * len(picked)) // n_ranges] for i in range(1, n_ranges)] if picked else []
        self.none, self.turned, self.hash = (np.array([x[j] for x in picked], np.int64) for j in range(3))

    def of(self, none: np.ndarray, turned: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(none), np.int32)
        for side in (0, 1):  # rows with an id, then those without
            mine, base = np.flatnonzero(none == side), np.searchsorted(self.none, side)
            cuts, last = self.turned[self.none == side], self.hash[self.none == side]
            low, high = (np.searchsorted(cuts, turned[mine], side=s) for s in ("left", "right"))
            out[mine] = base + low
            # Where the id itself is a cut (or several), the hash decides.
            for at in np.unique(low[low < high]):
                same = mine[(low == at) & (high > at)]
                end = np.searchsorted(cuts, cuts[at], side="right")
                out[same] = base + at + np.searchsorted(last[at:end], hashes[same], side="right")
        return out


def with_neighbours(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(_range, _tail, _id, _text), each range sorted within one partition; (_id, _text, _n) of copies.

    The order is descending id, null ids last, equal ids by a hash of the text. A range ends with
    a copy of the next range's first row, marked _tail (after the last range: of the first), so
    every row finds the one after it in its own range; texts are shuffled once. Of a row that
    occurs very often (same id and text) one stands in the order, where its copies would follow
    each other; the second result (None without such rows) has the number of the others.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = plain.withColumn("_hash", F.xxhash64("_text"))
    n = plain.count()
    n_ranges = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    rate = min(1.0, min(MAX_SAMPLE, RANGE_SAMPLE * n_ranges) / max(1, n))
    drawn = plain.sample(False, rate, 7).groupBy("_id", F.xxhash64("_text").alias("_hash")).agg(F.count("*").alias("_n")).collect()
    key = lambda i, h: (int(i is None), 0 if i is None else ~i, h)
    heavy = [(r._id, r._hash) for r in drawn if r._n >= HEAVY]
    cuts = Cuts([key(r._id, r._hash) for r in drawn for _ in range(1 if r._n >= HEAVY else r._n)], n_ranges)
    # At most a quarter of the sampled keys are heavy, so the table that is broadcast is bounded.
    often = F.broadcast(docs.sparkSession.createDataFrame(heavy, "_i long, _h long"))
    is_often = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h"))
    copies = rows.join(often, is_often, "left_semi").groupBy("_id", "_hash").agg(F.count("*").alias("_n"), F.first("_text").alias("_text"))
    if heavy:
        rows = rows.join(often, is_often, "left_anti").unionByName(copies.select("_id", "_text", "_hash"))

    @F.arrow_udf("int")
    def range_of(none: pa.Array, turned: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array(cuts.of(*(x.to_numpy(zero_copy_only=False) for x in (none, turned, hashes))))

    none, turned = F.col("_id").isNull().cast("long"), F.coalesce(F.bitwise_not("_id"), F.lit(0).cast("long"))
    placed = rows.withColumn("_range", range_of(none, turned, F.col("_hash")))
    down = F.struct(none.alias("_none"), turned.alias("_turned"), F.col("_hash"))
    heads = sorted((r._range, r._head) for r in placed.groupBy("_range").agg(F.min(down).alias("_head")).collect())
    tails = [(heads[i - 1][0] if i else heads[-1][0], r, head._hash, None if head._none else ~head._turned) for i, (r, head) in enumerate(heads)]
    # At most one row a range, so at most MAX_RANGES rows are broadcast.
    wanted = F.broadcast(docs.sparkSession.createDataFrame(tails, "_before int, _r int, _h long, _i long"))
    found = placed.join(wanted, (F.col("_range") == F.col("_r")) & is_often)
    # Repeated rows give the same text: one of them is enough.
    tail_rows = found.groupBy("_before").agg(F.first("_text").alias("_text"), F.first("_hash").alias("_hash")).select(F.col("_before").alias("_range"), F.lit(True).alias("_tail"), F.lit(None).cast("long").alias("_id"), "_text", "_hash")
    body = placed.select("_range", F.lit(False).alias("_tail"), "_id", "_text", "_hash")
    order = body.unionByName(tail_rows).repartition("_range").sortWithinPartitions("_range", "_tail", F.col("_id").desc_nulls_last(), "_hash").drop("_hash")
    return order, None if not heavy else copies.filter("_n > 1").select("_id", "_text", (F.col("_n") - 1).alias("_n"))


RESULT = [("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
SCHEMA = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(doc: int | None, text: str, anchors: list[tuple[int, int]], following: str, after: list[tuple[int, int]]) -> tuple:
    """One row of the result."""
    edited = edited_text(text, following)
    changed = sketch(edited)
    return doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(anchors), written(changed), likeness(anchors, changed), likeness(anchors, after)


def _batch(rows: list[tuple], more: tuple[str, pa.DataType] | None = None) -> pa.RecordBatch:
    fields = RESULT + ([more] if more else [])
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the fingerprints of its text and of its edited text.

    Returns (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next). A null text counts as empty and has the empty fingerprint; null ids come last in
    the order; rows with equal ids are ordered by a hash of their texts, repeated rows follow each
    other; the next of a lone row is the row itself; an empty table gives an empty result; other
    columns are ignored. Very long texts are read whole and have longer fingerprints.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # (range, id, text, anchors) of a row whose next one has not come yet
        for batch in batches:
            out = []
            for rng, tail, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                anchors = sketch(text)
                if waiting is not None and waiting[0] == rng:
                    out.append(compared(*waiting[1:], text, anchors))
                waiting = None if tail else (rng, doc, text, anchors)
            yield _batch(out)

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield _batch([(*compared(doc, text, s, text, s), n) for doc, text, n in rows for s in [sketch(text)]], ("_n", pa.int64()))

    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], SCHEMA).withColumnRenamed("id", id_col)
    order, copies = with_neighbours(docs, id_col, text_col)
    out = order.mapInArrow(run, SCHEMA)
    if copies is None:
        return out.withColumnRenamed("id", id_col)
    # Copies are followed by a copy: one comparison each, written out in parts of COPIES rows.
    again = copies.mapInArrow(repeat, f"{SCHEMA}, _n long").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES))))
    left = F.least(F.col("_n") - F.col("_part") * COPIES, F.lit(COPIES).cast("long"))
    again = again.repartition("id", "edited_sha256", "_part").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), left))).select(*[name for name, _ in RESULT])
    return out.unionByName(again).withColumnRenamed("id", id_col)
