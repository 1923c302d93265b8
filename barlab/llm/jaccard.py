"""N-gram Jaccard join with PartEnum signatures.

A document is the set of hashes of its five-word shingles. Sets are put into bands of like size.
For a band the domain of hashes is partitioned, and a set has one signature for each part that it
meets: the part with exactly the elements in it. Two sets that link differ in at most d elements,
d = floor((|r| + |s|) / 9), and so in at most d parts; all other parts of theirs agree. Hence a set
with m parts shares at least m - d signatures with every partner, and

* signatures that only one set has are dropped (most are),
* sets that share fewer than they need have no partner,
* of a set's shared signatures the need - 1 commonest can be left out (the same order for all).

What remains gives candidates; every candidate pair that matters is checked on whole sets. Members
of one signature are first compared with its best-connected member. Where this joins them into
one component nothing more is needed; the others are checked pair by pair, or, where a signature
has many members, block against block without giving out the pairs. Nothing is capped.

The enumerated subsets of parts are the single parts. Subsets of two of three second-level parts, with
one shared signature for each linked pair, were built and measured too (see README): at a similarity
of 0.8 a signature then holds two to five elements and needs no second one, so that every common
phrase makes candidates, whereas single parts can be counted and the commonest left out.
Hashes have 64 bits; equal sets (by size and a 63-bit key) are one set from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Intermediate, forget, give_back, stored

SHINGLE = 5
#: Elements a part holds on average in the largest sets of a band; bands double in size.
PART_ELEMENTS = 3.2
#: Up to this size every element is a part by itself.
SINGLE_ELEMENTS = 16
#: Sets of a signature up to which its unsettled members are checked pair by pair; beyond, block by block.
SMALL = 24
#: Sets of a block, and elements of a slice of the 0/1 matrix.
BLOCK_SETS, SLICE_ELEMENTS = 512, 2048
#: Pairs of one set that one task of a check takes.
PARTNERS = 512
#: Candidate ids (8 bytes each) are broadcast to the second reading of the texts up to this many.
BROADCAST_IDS = 1 << 20
#: Documents whose sets a task holds at a time.
SLICE_DOCS = 1024
#: Edges of which a task drops those that close a cycle among its own.
TASK_EDGES = 200_000
#: Set keys that a task remembers to skip the signatures of copies.
REMEMBER = 500_000

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _random(n: int, seed: int) -> np.ndarray:
    """n fixed odd numbers without pattern."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed << 32)) * U(0x9E3779B97F4A7C15)) | U(1)


_BY_PLACE = _random(1024, 1)
_BY_WORD = _random(SHINGLE, 2)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words, in order; a word is a run of bytes other than ASCII white space."""
    data = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    inside = ~_SPACE[data]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(starts):
        return np.zeros(0, U)
    ends = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
    begins = np.repeat(starts, np.diff(np.append(starts, len(data))))
    data, inside = data[starts[0] :], inside[starts[0] :]
    place = np.arange(starts[0], starts[0] + len(data)) - begins
    factors = _BY_PLACE if (ends - starts).max() <= len(_BY_PLACE) else _random(int((ends - starts).max()), 1)
    place = np.minimum(place, len(factors) - 1)
    value = np.where(inside, (data.astype(U) + U(1)) * factors[place], U(0))
    return mix(np.add.reduceat(value, starts - starts[0]))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; a shorter text is one shingle."""
    words = word_hashes(text or "")
    n = len(words)
    if n < SHINGLE:
        return mix(np.array([(words * _BY_WORD[:n]).sum() + U(n)], U)) if n else words
    h = words[: n - SHINGLE + 1] * _BY_WORD[0]
    for j in range(1, SHINGLE):
        h += words[j : n - SHINGLE + 1 + j] * _BY_WORD[j]
    return np.unique(mix(h))


def most_apart(r: int, s: int) -> int:
    """Elements in which linked sets of these sizes can differ: 100 * common >= 80 * union."""
    return (r + s) // 9


def band_top(size: int) -> int:
    """The largest size in the band of a set: 1, 2, 4, 8, ..."""
    return 1 << (size - 1).bit_length()


def signatures(elements: np.ndarray, top: int, reach: int) -> tuple[np.ndarray, int]:
    """Signatures of a set in the band that ends at `top`, and how many a partner of at most
    `reach` elements must share."""
    apart = most_apart(len(elements), reach)
    if not apart:  # only an equal set could link
        return np.zeros(0, U), 0
    with np.errstate(over="ignore"):
        if top <= SINGLE_ELEMENTS:
            out = mix(elements + U(top) * U(0x9E3779B97F4A7C15))
        else:
            n_parts = int(np.ceil(top / PART_ELEMENTS))
            part = ((elements >> U(32)) * U(n_parts)) >> U(32)  # rises with the sorted elements
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            out = mix(np.add.reduceat(mix(elements), first) + part[first] * U(0x9E3779B97F4A7C15) + U(top))
        need = len(out) - apart
        if need < 1:  # only two such sets could agree in nothing but empty parts
            out, need = np.append(out, mix(np.array([top], U) ^ U(0x5851F42D4C957F2D))), 1
    return out, need


SETS = "doc_id long, n long, key long, need_own int, need_next int, parts int, own array<long>, next array<long>"


def set_key(elements: np.ndarray) -> int:
    """The set's key: even, by all elements; 0 for the empty set."""
    if not len(elements):
        return 0
    with np.errstate(over="ignore"):
        return int(mix(np.array([elements.sum() + U(len(elements))], U) + mix(elements).sum())[0] & ~U(1)) - (1 << 63)


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """An Arrow array of lists of 64-bit hashes."""
    ends = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def document_sets(docs: DataFrame) -> DataFrame:
    """SETS of (_id, _text): size, key and signatures in the set's own and the next band.
    Copies within a task carry no signatures; the empty set has none and the key 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: set[int] = set()
        none = np.zeros(0, U)
        names = [c.split()[0] for c in SETS.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_DOCS):
                part = batch.slice(at, SLICE_DOCS)
                out = []
                for text in part.column(1).to_pylist():
                    with np.errstate(over="ignore"):
                        elements = shingle_set(text)
                    n, key = len(elements), set_key(elements)
                    if not n or key in seen:
                        out.append((n, key, 0, 0, 0, none, none))
                        continue
                    if len(seen) > REMEMBER:
                        seen.clear()
                    seen.add(key)
                    top, wide = band_top(n), n * 5 // 4
                    own, need = signatures(elements, top, min(wide, top))
                    after, need_after = signatures(elements, 2 * top, wide) if wide > top else (none, 0)
                    out.append((n, key, need, need_after, len(own), own, after))
                n, key, need, need_after, parts, own, after = zip(*out, strict=True)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(key, pa.int64()), *(pa.array(x, pa.int32()) for x in (need, need_after, parts)), lists(own), lists(after)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        out, seen = [], set()
        give_back()

    return docs.mapInArrow(run, SETS)


def shared_only(tokens: DataFrame) -> DataFrame:
    """Rows of (token, k), sorted within partitions, whose token another k has too; repeats once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_t, held_k, held_shared = np.zeros(0, np.int64), np.zeros(0, np.int64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            t = np.concatenate((held_t, batch.column(0).to_numpy(zero_copy_only=False)))
            k = np.concatenate((held_k, batch.column(1).to_numpy(zero_copy_only=False)))
            fresh = np.concatenate(([True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])))
            t, k = t[fresh], k[fresh]
            like = t[1:] == t[:-1]
            keep = np.concatenate(([False], like))
            keep[:-1] |= like
            keep[0] |= held_shared
            # The last row waits for the next batch.
            held_t, held_k, held_shared = t[-1:], k[-1:], bool(keep[-1])
            at = np.flatnonzero(keep[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(t[at]), pa.array(k[at])], names=["token", "k"])
        if held_shared:
            yield pa.RecordBatch.from_arrays([pa.array(held_t), pa.array(held_k)], names=["token", "k"])
        give_back()

    return tokens.repartition("token").sortWithinPartitions("token", "k").mapInArrow(run, "token long, k long")


def set_of(k: Column) -> Column:
    """The set's key of a key in its own (even) or the next (odd) band."""
    return F.when(k % 2 == 0, k).otherwise(k - 1)


def candidate_signatures(sets: DataFrame, tables: Intermediate) -> DataFrame:
    """(token, key, n, lonely): the shared signatures that can bring a pair together. lonely counts
    a set's signatures that no other set has; sets with few are well connected."""
    rows = [sets.select(F.explode(c).alias("token"), (F.col("key") + odd).alias("k")) for c, odd in (("own", 0), ("next", 1))]
    shared = tables.stored(shared_only(rows[0].unionByName(rows[1])))
    first = sets.filter(F.size("own") + F.size("next") > 0)
    facts = [first.filter(F.col(c) > 0).select((F.col("key") + odd).alias("k"), F.col(c).alias("need"), "n", "parts").distinct() for c, odd in (("need_own", 0), ("need_next", 1))]
    counts = shared.groupBy("k").agg(F.count("*").alias("have"))
    alive = tables.stored(counts.join(facts[0].unionByName(facts[1]), "k").filter("have >= need"))
    # Once more among the sets still there, then without the commonest signatures of each set. Rows travel bare;
    # what is known of their sets joins them where the sets meet.
    of_token = Window.partitionBy("token")
    rows = shared.join(alive.select("k"), "k", "left_semi").withColumn("c", F.count("*").over(of_token)).filter("c > 1")
    rank = "row_number() OVER (PARTITION BY k ORDER BY c DESC, token DESC)"
    kept = rows.withColumn("place", F.expr(rank)).select("token", "k", "place").join(alive, "k").filter(F.col("place") >= F.col("need"))
    kept = kept.select("token", set_of(F.col("k")).alias("key"), "n", (F.col("parts") - F.col("have")).alias("lonely"))
    # Most of what is left has lost its partners by now and brings no pair together.
    return kept.withColumn("c", F.count("*").over(of_token)).filter("c > 1").drop("c")


def verified(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """The stored pairs (a, b) whose sets link. The pairs of a set with many are dealt over several tasks."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    few = pairs.limit(BROADCAST_IDS // 2 + 1).count() <= BROADCAST_IDS // 2
    elements = elements.join(F.broadcast(keys) if few else keys, "key", "left_semi")
    left = elements.select(F.col("key").alias("a"), F.col("elements").alias("x"))
    right = elements.select(F.col("key").alias("b"), F.col("elements").alias("y"))
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("shares"))
    dealt = pairs.select("a", "b").join(shares, "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int")).drop("shares")
    left = left.join(shares, "a").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    both = dealt.join(right, "b").join(left, ["a", "share"]).withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.filter(100 * F.col("common") >= 80 * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


def forest(edges: DataFrame) -> DataFrame:
    """Edges that join the same keys as the given stored ones, without cycles within a task's share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            out = []
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"])
        parent.clear()
        give_back()

    return edges.coalesce(max(1, -(-edges.count() // TASK_EDGES))).mapInPandas(run, "a long, b long")


def components(edges: DataFrame, tables: Intermediate) -> DataFrame:
    """(key, label): the smallest key that edges lead to, for the keys in edges. Each round passes
    labels to neighbours and then jumps to the label's own label."""
    edges = forest(edges)
    both = tables.stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = tables.stored(both.groupBy(F.col("a").alias("key")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        passed = labels.join(near, "key").select("key", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        target = labels.select(F.col("key").alias("label"), F.col("label").alias("further"))
        new = tables.stored(passed.join(target, "label", "left").select("key", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = new.select("key", "label")
        if new.filter("old <> label").isEmpty():
            return labels


def set_elements(docs: DataFrame, wanted: DataFrame, tables: Intermediate) -> DataFrame:
    """(key, elements) of the sets in wanted (key, rep), from the documents with their ids. Ids may be null
    or stand on several texts: every such text is read, and the wanted sets are told by their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_DOCS):
                with np.errstate(over="ignore"):
                    found = [shingle_set(t) for t in batch.slice(at, SLICE_DOCS).column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(e) for e in found], pa.int64()), lists(found)], names=["key", "elements"])
        give_back()

    ids = wanted.select("rep").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    found = docs.join(F.broadcast(ids) if few else ids, F.col("_id").eqNullSafe(F.col("rep")), "left_semi").select("_text").mapInArrow(run, "key long, elements array<long>")
    keys = wanted.select("key")
    found = tables.stored(found.join(F.broadcast(keys) if few else keys, "key", "left_semi"))
    # Elements are shuffled only of sets that were read more than once.
    twice = tables.stored(found.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"))
    if twice.isEmpty():
        return found
    return found.join(twice, "key", "left_anti").unionByName(found.join(twice, "key", "left_semi").dropDuplicates(["key"]))


def block_links(members: DataFrame, elements: DataFrame) -> DataFrame:
    """(a, b): links that join the sets of each group, computed block against block.

    members: (group, key). The sets of a group fall into blocks of about BLOCK_SETS by hash; a task
    gets two blocks, counts common elements as a product of 0/1 matrices, slice by slice of the
    elements, and gives out no more links than join its sets into components.
    """

    def cell(sets: pd.DataFrame) -> pd.DataFrame:
        forget()
        rows = [np.asarray(e, np.int64) for e in sets["elements"]]
        keys, block = sets["key"].tolist(), sets["block"].to_numpy()
        size = np.array([len(r) for r in rows])
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        names, column = np.unique(np.concatenate(rows), return_inverse=True)
        row = np.repeat(np.arange(len(rows)), size)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(left), len(right)), np.int64)

        def held(side: np.ndarray, at: int) -> np.ndarray:
            """The side's sets as rows of 0 and 1, for a slice of the elements."""
            lo, hi = np.searchsorted(column, [at, at + SLICE_ELEMENTS])
            place = np.full(len(rows), -1)
            place[side] = np.arange(len(side))
            mine = place[row[lo:hi]] >= 0
            out = np.zeros((len(side), min(SLICE_ELEMENTS, len(names) - at)), np.float32)
            out[place[row[lo:hi][mine]], column[lo:hi][mine] - at] = 1
            return out

        for at in range(0, len(names), SLICE_ELEMENTS):
            # A slice's counts are small enough for float32; their sums are whole numbers of any size.
            common += (held(left, at) @ held(right, at).T).astype(np.int64)
        union = size[left][:, None] + size[right][None, :] - common
        parent = list(range(len(rows)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        out = []
        for i, j in zip(*np.nonzero(100 * common >= 80 * union), strict=True):
            x, y = root(left[i]), root(right[j])
            if x != y:
                parent[x] = y
                out.append((keys[left[i]], keys[right[j]]))
        give_back()
        return pd.DataFrame(out, columns=["a", "b"])

    blocks = members.groupBy("group").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("blocks"))
    placed = members.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).join(elements, "key")
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return dealt.select("group", "low", "high", "key", "block", "elements").groupBy("group", "low", "high").applyInPandas(cell, "a long, b long")


def links_between_sets(docs: DataFrame, sets: DataFrame, reps: DataFrame, tables: Intermediate) -> DataFrame | None:
    """(key, label) of the sets that link with another one; None if there are none."""
    tokens = tables.stored(candidate_signatures(sets, tables))
    wanted = tables.stored(tokens.select("key").distinct().join(reps, "key"))
    if wanted.isEmpty():
        return None
    elements = set_elements(docs, wanted, tables)
    alike = (5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")) & (F.col("a") != F.col("b"))
    pair = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    member = lambda rows, x: rows.select("token", F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("label").alias(f"l{x}"))
    # Every member of a signature with its best-connected one.
    rows = tokens.withColumn("label", F.col("key"))
    centre = rows.groupBy("token").agg(F.min_by(F.struct(F.col("key").alias("a"), F.col("n").alias("na"), F.col("label").alias("la")), F.struct("lonely", "key")).alias("s")).select("token", "s.*")
    tested = tables.stored(member(rows, "b").join(centre, "token").filter(alike).select(*pair).distinct())
    edges = tables.stored(verified(tested, elements))
    labels = components(edges, tables)
    # Signatures whose members are not all in one component yet: small ones pair by pair.
    rows = tokens.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    mixed = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("c")).filter("low <> high").select("token", "c")
    rows = tables.stored(rows.join(mixed, "token"))
    few = rows.filter(F.col("c") <= SMALL)
    pairs = member(few, "a").join(member(few, "b"), "token").filter(alike & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")))
    pairs = tables.stored(pairs.select(*pair).distinct().join(tested, ["a", "b"], "left_anti"))
    edges = edges.union(tables.stored(verified(pairs, elements)))
    # Large ones: sets that such signatures connect form groups, compared block by block.
    many = rows.filter(F.col("c") > SMALL)
    if not many.isEmpty():
        star = many.join(many.groupBy("token").agg(F.min("key").alias("a")), "token").filter(F.col("key") != F.col("a")).select("a", F.col("key").alias("b")).distinct()
        groups = components(tables.stored(star), tables).select("key", F.col("label").alias("group"))
        edges = edges.union(tables.stored(block_links(groups, elements)))
    return components(edges, tables)


def linked_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id_col, n_shingles, component_id).

    Documents link when their shingle sets have a Jaccard similarity of at least 0.8; component_id
    is the smallest id that links lead to. Null, empty and blank texts have the empty set, link
    with nothing and are their own component. Rows with a null id take part and are named only by
    others: their component is null where no member has an id. Repeated rows, also of one id on
    different texts, are judged each by its own text; very long texts are read whole; an empty table
    gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    sets = stored(document_sets(rows))
    tables = Intermediate(docs.sparkSession)
    try:
        reps = tables.stored(sets.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep")))
        labels = links_between_sets(rows, sets, reps, tables)
        if labels is not None:
            named = reps.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
            least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
            reps = named.join(least, "label").select("key", F.col("component_id").alias("rep"))
        reps = stored(reps.select("key", "rep"))
    finally:
        tables.clear()
    plain = sets.select("doc_id", "n", "key")
    full = plain.filter("n > 0").join(reps, "key").select("doc_id", "n", F.col("rep").alias("component_id"))
    empty = plain.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
