"""Phrase collocation mining: mergeable Misra-Gries summaries per hash partition, then exact counts.

Texts fall into chunks. Every chunk counts its own word sequences (one to three words) by hash and
sends the counts, sorted and packed, to hash partitions. A partition merges them into a Misra-Gries
summary whose capacity exceeds the partition's mass divided by the threshold, so that no frequent
sequence can drop out, and counts the survivors exactly in a second pass over the packed counts. The
hashes that are frequent go back to the chunks they came from; the first chunk of each names it. All
chunks add up a second hash of every occurrence: where the sum is not the names' second hashes times
their counts, other sequences share a hash, and the phrases concerned are named by all chunks and
summed up by their words. So a collision of hashes costs time but changes no count.

Nothing grows but the number of chunks and partitions: a task holds one chunk's batch of texts, or
one partition's packed counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Intermediate, give_back
from .jaccard import _random, mix

#: Rows of a chunk, bytes of text counted together within one, bytes of text for each hash partition.
CHUNK_ROWS, COUNTED_BYTES, PARTITION_BYTES = 8192, 2 << 20, 16 << 20
#: Counts that a task gathers before it sends them (a chunk sends several times), and phrases that it sums up.
GATHERED, SUMMED = 3_000_000, 400_000
#: Words of the longest phrase.
LONGEST = 3
#: Buckets of a language's candidates in the first step of the ranking; groups of hashes with a sum of their own.
BUCKETS, GROUPS = 64, 256

U = np.uint64
#: Bits of the hashes that are counted: as few as tell the corpus' sequences apart well, so that sorted ones pack
#: small. They grow with the text; a collision only means that a group of phrases is summed up by its words.
LEAST_BITS, MOST_BITS = 46, 62
#: Bytes that end a piece, and those that part words.
_STOPS, _BLANKS = [*b".,;:!?", *range(0x0A, 0x0E)], [0x20, 0x09]
_KIND = np.zeros(256, np.uint8)
_KIND[_STOPS], _KIND[_BLANKS] = 2, 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = _random(LONGEST + 1, 4)
#: Random numbers of the two hashes: of places in words, and of words in sequences.
_PLACES, _WORDS = {k: _random(1024, k) for k in (3, 5)}, {3: _WORD, 5: _random(LONGEST + 1, 6)}
#: Sizes of the rows that hold sums of second hashes (the lower and the upper 32 bits), and of those that count words.
LOWER, UPPER, ALL_WORDS = -1, -2, 0


class Sequences:
    """The words of some texts of one language, and the hashes of their sequences."""

    def __init__(self, texts: list[bytes], lang: str):
        # A stop after each text keeps texts apart.
        self.data = data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        kind = _KIND[data]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        self.start, self.end = edge[::2], edge[1::2]
        stops = np.cumsum(kind == 2)
        self.piece = stops[self.start]
        self.inside, self.lang, self.word = inside, lang, {}

    def words(self, hashed: int) -> np.ndarray:
        """Hashes of all words; `hashed` names one of the two hashes (3 or 5)."""
        if hashed not in self.word:
            size = self.end - self.start
            upto = np.cumsum(size)
            within = np.arange(int(upto[-1]) if len(upto) else 0) - np.repeat(upto - size, size)
            factors = _PLACES[hashed] if not len(size) or size.max() <= 1024 else _random(int(size.max()), hashed)
            seed = U(int.from_bytes(blake2b(self.lang.encode(), digest_size=8, salt=bytes([hashed])).digest(), "little"))
            with np.errstate(over="ignore"):
                value = (self.data[self.inside].astype(U) + U(1)) * factors[within]
                self.word[hashed] = mix(np.add.reduceat(value, upto - size) + seed) if len(size) else np.zeros(0, U)
        return self.word[hashed]

    def places(self, n: int) -> np.ndarray:
        """Where sequences of n words begin."""
        last = len(self.start) - n + 1
        return np.flatnonzero(self.piece[:last] == self.piece[n - 1 :]) if last > 0 else np.zeros(0, np.int64)

    def hashes_at(self, at: np.ndarray, n: int, hashed: int = 3) -> np.ndarray:
        """The 64-bit hashes of the sequences of n words that begin there."""
        word, factors = self.words(hashed), _WORDS[hashed]
        with np.errstate(over="ignore"):
            h = np.full(len(at), factors[n])
            for j in range(n):
                h = mix(h * factors[j] + word[at + j])
        return h

    def hashes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The places where sequences of n words begin, and the sequences' 64-bit hashes."""
        at = self.places(n)
        return at, self.hashes_at(at, n)

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[self.start[i] : self.end[i]].tobytes() for i in range(at, at + n))


def packed(keys: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Sorted keys, as their differences, and their counts: bytes of like weight stand together."""
    planes = [np.diff(keys, prepend=U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()]
    if counts is not None:
        width = 8 if len(counts) and counts.max() >> 32 else 4
        planes.append(counts.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n keys, and their counts where they have been packed."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    keys = np.cumsum(raw[: 8 * n].reshape(8, -1).T.copy().view("<u8").ravel())
    width = len(raw) // n - 8
    return keys.astype(U), raw[8 * n :].reshape(width, -1).T.copy().view(f"<u{width}").ravel().astype(np.int64) if width else np.zeros(0, np.int64)


def hash_mask(text_bytes: int) -> U:
    """The bits of hashes that are counted, for a corpus of so many bytes."""
    return U((1 << min(MOST_BITS, LEAST_BITS + (text_bytes >> 24).bit_length())) - 1)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class MisraGries:
    """A summary of weighted keys with at most `capacity` counters. A key's counter is at most its weight, and
    less by no more than mass / (capacity + 1). Summaries merge by adding one's counters to the other."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.keys, self.counts = np.zeros(0, U), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = added(np.concatenate((self.keys, keys)), np.concatenate((self.counts, counts)))
        if len(self.keys) > self.capacity:
            # The largest counter beyond the capacity is taken off all; those used up go.
            off = np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1]
            self.counts = self.counts - off
            stay = self.counts > 0
            self.keys, self.counts = self.keys[stay], self.counts[stay]

    def merge(self, other: MisraGries) -> None:
        self.add(other.keys, other.counts)


def frequent_keys(parts: list[tuple[int, bytes]], threshold: int) -> np.ndarray:
    """The keys whose counts in the packed parts (number of keys, data) come to the threshold, sorted."""
    return frequent_counts(parts, threshold)[0]


def frequent_counts(parts: list[tuple[int, bytes]], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys whose counts in the packed parts come to the threshold, sorted, and their counts."""
    mass = sum(int(unpacked(data, n)[1].sum()) for n, data in parts)
    summary = MisraGries(mass // threshold + 1)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merge() -> None:
        if held:
            summary.add(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()

    for n, data in parts:  # as many at a time as the summary has counters, so that sorting stays in proportion
        held.append(unpacked(data, n))
        if sum(len(k) for k, _ in held) >= summary.capacity:
            merge()
    merge()
    keys, counts = summary.keys, np.zeros(len(summary.keys), np.int64)
    for n, data in parts:
        mine, c = unpacked(data, n)
        at = np.minimum(np.searchsorted(keys, mine), max(0, len(keys) - 1))
        hit = keys[at] == mine if len(keys) else np.zeros(len(mine), bool)
        counts[at[hit]] += c[hit]  # keys of one part are distinct
    return keys[counts >= threshold], counts[counts >= threshold]


def group_of(keys: np.ndarray) -> np.ndarray:
    """The groups of keys with a sum of their own."""
    return (mix(keys ^ _WORD[1]) % U(GROUPS)).astype(np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, list[bytes]]]:
    """(chunk, lang, texts) of rows (chunk, lang, text), about COUNTED_BYTES at a time."""
    held: dict[tuple[int, str], list[bytes]] = {}
    size = 0
    for batch in batches:
        for chunk, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), pc.cast(batch.column(2), pa.binary()).to_pylist(), strict=True):
            if any(key[0] != chunk for key in held) or size > COUNTED_BYTES:
                yield from ((*key, texts) for key, texts in held.items())
                held, size = {}, 0
            held.setdefault((chunk, lang), []).append(text)
            size += len(text)
    yield from ((*key, texts) for key, texts in held.items())


def local_counts(texts: DataFrame, n_parts: int, mask: U) -> DataFrame:
    """(part, chunk, n, data): packed counts of each chunk for each hash partition. texts: (chunk, lang, text)."""
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at = None

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            keys, counts = added(*(np.concatenate(x) for x in zip(*held, strict=True))) if len(held) > 1 else held[0]
            held.clear()
            part = mix(keys) % U(n_parts)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(n_parts + 1))
            rows = [(p, at, int(hi - lo), packed(keys[order[lo:hi]], counts[order[lo:hi]])) for p, (lo, hi) in enumerate(zip(cut, cut[1:])) if hi > lo]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

        for chunk, lang, mine in _batches(batches):
            if chunk != at or sum(len(k) for k, _ in held) > GATHERED:
                yield from out()
            at = chunk
            s = Sequences(mine, lang)
            new = np.concatenate([s.hashes(n)[1] & mask for n in range(1, LONGEST + 1)])
            held.append(added(new, np.ones(len(new), np.int64)))
        yield from out()
        give_back()

    return texts.mapInArrow(run, "part int, chunk long, n int, data binary")


def frequent_by_chunk(counts: DataFrame, n_parts: int, threshold: int) -> DataFrame:
    """(chunk, n, data): the frequent keys of each hash partition, packed, for every chunk that has some; with the
    key's count in the first chunk that has it, else with 0."""
    schema = pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            found, total = frequent_counts([(n, data) for _, n, data in rows], threshold)
            if not len(found):
                return
            for chunk, n, data in rows:
                mine = unpacked(data, n)[0]
                at = np.minimum(np.searchsorted(found, mine), len(found) - 1)
                at = at[found[at] == mine]
                mine, count = found[at], total[at]
                total[at] = 0
                if len(mine):
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([len(mine)], pa.int32()), pa.array([packed(mine, count)], pa.binary())], schema=schema)

        part, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if rows and r["part"] != part:
                    yield from settle(rows)
                    rows = []
                part = r["part"]
                rows.append((r["chunk"], r["n"], r["data"]))
        if rows:
            yield from settle(rows)
        give_back()

    dealt = counts.repartition(n_parts, "part").sortWithinPartitions("part", "chunk")
    return dealt.mapInArrow(run, "chunk long, n int, data binary")


class Keys:
    """Distinct sorted keys of some bits, with their places."""

    def __init__(self, keys: np.ndarray, mask: U):
        self.keys = np.append(keys, ~U(0))
        bits = int(mask).bit_length()
        used = min(bits, max(1, len(keys).bit_length()))
        self.shift = U(bits - used)
        self.begin = np.searchsorted(keys, np.arange(1 << used, dtype=U) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are there, and the places of those."""
        at = self.begin[keys >> self.shift]
        todo = np.flatnonzero(self.keys[at] < keys)
        while len(todo):
            at[todo] += 1
            todo = todo[self.keys[at[todo]] < keys[todo]]
        found = np.flatnonzero(self.keys[at] == keys)
        return found, at[found]


def _by_chunk(texts: DataFrame, frequent: DataFrame, n_chunks: int) -> DataFrame:
    """A chunk's keys before its texts in one sorted stream, so that no chunk is held as a whole."""
    kind = lambda df, k: df.withColumn("kind", F.lit(k))
    both = kind(frequent, 0).unionByName(kind(texts, 1), allowMissingColumns=True).select("chunk", "kind", "n", "data", "lang", "text")
    return both.repartition(n_chunks, "chunk").sortWithinPartitions("chunk", "kind")


def _after_keys(batches: Iterator[pa.RecordBatch], keys: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """The texts of a stream; keys and counts before them go to `keys` by chunk."""
    for batch in batches:
        is_text = pc.equal(batch.column(1), 1)
        for r in batch.filter(pc.invert(is_text)).select(["chunk", "n", "data"]).to_pylist():
            keys.setdefault(r["chunk"], []).append(unpacked(r["data"], r["n"]))
        yield batch.filter(is_text).select(["chunk", "lang", "text"])


def _keys_of(chunk: int, keys: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's distinct keys, sorted, and their counts; `keys` gives them up."""
    held = keys.pop(chunk, [])
    return added(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else (np.zeros(0, U), np.zeros(0, np.int64))


def named(texts: DataFrame, frequent: DataFrame, n_chunks: int, mask: U) -> DataFrame:
    """(lang, size, phrase, f, group): the sequences of frequent keys, each named by the chunk that has the key's count.

    Rows of size ALL_WORDS have numbers of words. Those of sizes LOWER and UPPER have, for each group of keys, 32 bits of
    a sum modulo 2 ** 64: second hashes of all occurrences less those of the named sequences times f. Over all
    chunks it is 0 where each key is of one sequence.
    """
    schema = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("f", pa.int64()), ("group", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        rows: list[tuple[str, int, bytes, int, int]] = []
        n_words: dict[str, int] = {}
        sums = np.zeros(GROUPS, U)
        at_chunk = None

        def out() -> Iterator[pa.RecordBatch]:
            if rows:
                lang, size, phrase, f, group = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(f, pa.int64()), pa.array(group, pa.int32())], schema=schema)
            rows.clear()

        for chunk, lang, mine in _batches(_after_keys(batches, keys)):
            if len(rows) > SUMMED:
                yield from out()
            if chunk != at_chunk:
                at_chunk = chunk
                wanted, to_name = _keys_of(chunk, keys)
                index, group = Keys(wanted, mask), group_of(wanted)
            s = Sequences(mine, lang)
            n_words[lang] = n_words.get(lang, 0) + len(s.start)
            if not len(wanted):
                continue
            for n in range(1, LONGEST + 1):
                at, h = s.hashes(n)
                found, key = index.find(h & mask)
                at = at[found]
                second = s.hashes_at(at, n, 5)
                np.add.at(sums, group[key], second)
                fresh = np.flatnonzero(to_name[key])
                new, first = np.unique(key[fresh], return_index=True)
                first = fresh[first]
                f = to_name[new]
                to_name[new] = 0
                with np.errstate(over="ignore"):
                    np.subtract.at(sums, group[new], second[first] * f.astype(U))
                rows.extend((lang, n, s.phrase(place, n), count, g) for place, count, g in zip(at[first].tolist(), f.tolist(), group[new].tolist(), strict=True))
        rows.extend((lang, ALL_WORDS, b"", n, 0) for lang, n in n_words.items())
        for g in np.flatnonzero(sums).tolist():
            rows += [("", LOWER, b"", int(sums[g]) & 0xFFFFFFFF, g), ("", UPPER, b"", int(sums[g]) >> 32, g)]
        yield from out()
        give_back()

    return _by_chunk(texts, frequent, n_chunks).mapInArrow(run, "lang string, size int, phrase string, f long, group int")


def named_by_words(texts: DataFrame, frequent: DataFrame, n_chunks: int, mask: U, groups: list[int]) -> DataFrame:
    """(lang, size, phrase, f): counts, chunk by chunk, of the sequences whose keys are frequent and in these groups."""
    schema = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        sums: dict[tuple[str, int], tuple[np.ndarray, np.ndarray, list[bytes]]] = {}
        at_chunk = None

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, n), (_, count, names) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array([n] * len(names), pa.int32()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(count, pa.int64())], schema=schema)
            sums.clear()

        for chunk, lang, mine in _batches(_after_keys(batches, keys)):
            if chunk != at_chunk or sum(len(names) for *_, names in sums.values()) > SUMMED:
                yield from out()
            if chunk != at_chunk:
                at_chunk = chunk
                wanted = _keys_of(chunk, keys)[0]
                index = Keys(wanted[np.isin(group_of(wanted), groups)], mask)
            s = Sequences(mine, lang)
            for n in range(1, LONGEST + 1):
                at, h = s.hashes(n)
                found = index.find(h & mask)[0]
                new, first, count = np.unique(s.hashes_at(at[found], n, 5), return_index=True, return_counts=True)
                held, total, names = sums.get((lang, n), (np.zeros(0, U), np.zeros(0, np.int64), []))
                # held is sorted by hash, with the place of each one's sum and name.
                both, place = np.unique(np.concatenate((held, new)), return_inverse=True)
                summed = np.zeros(len(both), np.int64)
                summed[place[: len(held)]] = total
                summed[place[len(held) :]] += count
                named_now = np.full(len(both), None, object)
                named_now[place[: len(held)]] = np.array(names, object) if names else np.zeros(0, object)
                fresh = np.flatnonzero(np.array([x is None for x in named_now[place[len(held) :]]], bool))
                starts = at[found][first]
                for i in fresh.tolist():
                    named_now[place[len(held) + i]] = s.phrase(int(starts[i]), n)
                sums[lang, n] = both, summed, named_now.tolist()
        yield from out()
        give_back()

    return _by_chunk(texts, frequent, n_chunks).mapInArrow(run, "lang string, size int, phrase string, f long")


def frequent_phrases(docs: DataFrame, tables: Intermediate, threshold: int, lang_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all sequences of up to three words that occur `threshold` times or more, and
    (lang, n), the words of each language. Both are stored in `tables`."""
    # Rows are told apart by where they stand, so the table is written: chunks stay what they are.
    row = F.monotonically_increasing_id()
    chunk = F.shiftleft(F.shiftright(row, 33), 33) + F.floor(row.bitwiseAND(F.lit((1 << 33) - 1)) / CHUNK_ROWS)
    texts = docs.select(chunk.cast("long").alias("chunk"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = tables.stored(texts)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count_distinct("chunk").alias("chunks")).first()
    n_parts, mask = max(1, -(-size.bytes // PARTITION_BYTES)), hash_mask(size.bytes)
    frequent, n_chunks = frequent_by_chunk(local_counts(texts, n_parts, mask), n_parts, threshold), max(1, size.chunks)
    once = tables.stored(named(texts, frequent, n_chunks, mask))
    sums = once.filter("size < 0").groupBy("group").agg(*(F.coalesce(F.sum(F.when(F.col("size") == k, F.col("f"))), F.lit(0)) for k in (LOWER, UPPER)))
    shared = [g for g, lower, upper in sums.collect() if (lower + (upper << 32)) % (1 << 64)]  # GROUPS rows at most
    found = once.filter("size > 0").select("lang", "size", "phrase", "f", "group")
    if shared:
        counted = named_by_words(texts, frequent, n_chunks, mask, shared).groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= threshold)
        found = found.filter(~F.col("group").isin(shared)).drop("group").unionByName(tables.stored(counted))
    return found.select("lang", "size", "phrase", "f"), once.filter(F.col("size") == ALL_WORDS).groupBy("lang").agg(F.sum("f").alias("n"))


def words_of(phrase: Column, start: int, length: int) -> Column:
    """Some words of a phrase, space-joined."""
    return F.array_join(F.slice(F.split(phrase, " "), start, length), " ")


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)); counts up to 10 ** 15 (38 digits hold the products)."""
    wide = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1000000).cast("decimal(7,0)"), wide(left) * wide(right)).cast("long")


def collocations(docs: DataFrame, threshold: int = 10, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two and three words of each language.

    A phrase occurs a times, the words of the language n times. Of the ways to cut it in two, with parts
    that occur l and r times, the one with the lowest floor(10**6 * a * a / (l * r)) counts. Phrases
    with a >= threshold take part; those within a longer one that occurs at least half as often are
    dropped. Words are runs of bytes other than space and tab, in pieces that end at . , ; : ! ? and line
    breaks; A-Z are lower-cased; a null language is `und`, a null text empty. Whole texts of any length
    are read, repeated rows count each; an empty table gives an empty result; other columns are ignored.
    """
    tables = Intermediate(docs.sparkSession)
    try:
        f, words = frequent_phrases(docs, tables, threshold, lang_col, text_col)
        phrase = F.col("phrase")
        whole = f.filter("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))
        cuts = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
        cuts = cuts.withColumns({"first": words_of(phrase, F.lit(1), F.col("k")), "rest": words_of(phrase, F.col("k") + 1, F.col("size") - F.col("k"))})
        parts = f.select("lang", "phrase", "f")
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
        cuts = cuts.withColumn("score", exact_score(F.col("a"), F.col("l"), F.col("r")))
        best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("c")).select("lang", "phrase", "c.*")
        # A longer phrase stands on the shorter ones in it.
        longer = whole.filter(F.col("size") == LONGEST).select("lang", "a", F.explode(F.array_distinct(F.array(words_of(phrase, F.lit(1), F.lit(2)), words_of(phrase, F.lit(2), F.lit(2))))).alias("phrase"))
        over = longer.groupBy("lang", "phrase").agg(F.max("a").alias("over"))
        kept = best.join(over, ["lang", "phrase"], "left").filter("over IS NULL OR 100 * over < 50 * a").drop("over", "k")
        # The best of buckets, then of these: no task has all of a language.
        order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
        bucket = F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))
        first = kept.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).filter(F.col("rank") <= top)
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
        out = Intermediate(docs.sparkSession)
        return out.stored(ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    finally:
        tables.clear()


#: The same in DuckDB: occurrences of one to three words in pieces, counted, cut and ranked.
COLLOCATIONS_SQL = r"""
WITH p AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (
  SELECT lang, k AS size, array_to_string(ws[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
c AS (
  SELECT lang, size, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS part1, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS part2
  FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1)),
s AS (
  SELECT c.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = part1 JOIN f y ON y.lang = c.lang AND y.phrase = part2),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (
  SELECT lang, part, max(f) AS over FROM (
    SELECT lang, f, array_to_string(string_split(phrase, ' ')[1:2], ' ') AS part FROM f WHERE size = 3 UNION ALL
    SELECT lang, f, array_to_string(string_split(phrase, ' ')[2:3], ' ') AS part FROM f WHERE size = 3) GROUP BY 1, 2),
r AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM b LEFT JOIN o ON o.lang = b.lang AND part = phrase WHERE over IS NULL OR 100 * over < 50 * a)
SELECT lang, rank::INT AS rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""
