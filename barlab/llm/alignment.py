"""Alignment of two tokenizers' tokens by interval coalescing.

Every token of A and of B is an interval of the text's bytes. Sorted by start, a token whose start
reaches the running maximum of the ends before it begins a new group: the places where tokens of
both end. Within groups overlapping tokens are expanded to pairs. Texts are cut where neither
tokenizer can reach over (before a space after something else), so that each distinct piece of text is
aligned once; numpy takes all new pieces of a batch together.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import give_back, remembered, stored
from .token_counts import byte_symbols
from .words import Ragged, Words, slices, tokens_of_words

#: Fixed value: the symbol for a space inside pieces.
SPACE = "▁"
#: Pairs of ids whose counts are broadcast (17 bytes each); beyond, links and counts meet by a shuffle.
BROADCAST_PAIRS = 1 << 21
#: White space before a space, also before the one that is put in front: there a tokenizer may reach over.
_RUN = "^ |[\\t-\\r \\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] "
_APART = re.compile(r"(?<=\S)(?= )")


@dataclass
class Tokens:
    """Tokens of many texts that lie one after another: ids and the bytes they take."""

    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray


def coalesced(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each token of A and of each of B, numbered in order, and the number of groups."""
    start, end = np.concatenate((a.start, b.start)), np.concatenate((a.end, b.end))
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    order = np.lexsort((end, start))
    reached = np.maximum.accumulate(end[order])
    fresh = np.concatenate(([True], start[order][1:] >= reached[:-1]))
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return group[: len(a.start)], group[len(a.start) :], int(fresh.sum())


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and in B of all pairs of tokens that share a byte. Tokens of each follow one another."""
    first = np.searchsorted(b.end, a.start, side="right")
    last = np.searchsorted(b.start, a.end, side="left")
    n = np.maximum(last - first, 0)
    upto = np.cumsum(n)
    left = np.repeat(np.arange(len(n)), n)
    return left, np.repeat(first - (upto - n), n) + np.arange(len(left))


def given_back(texts: list[bytes], raw: Ragged, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the joined bytes of each text's ids (n of them, all end to end) are the text."""
    data, size = raw.rows(ids)
    upto = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(n)))]
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.diff(upto) == length
    # Texts of the right length lie byte by byte against each other.
    want = np.frombuffer(b"".join([t for t, x in zip(texts, out.tolist(), strict=True) if x]), np.uint8)
    have = data[np.repeat(out, np.diff(upto))]
    wrong = np.concatenate(([0], np.cumsum(want != have)))
    ends = np.cumsum(length[out])
    out[out] = wrong[ends] == wrong[ends - length[out]]
    return out


class Aligner:
    """Both tokenizers, and what is known of the pieces of text that came by."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        value = {c: i for i, c in enumerate(byte_symbols())}
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        names = {i: t for t, i in self.a.get_vocab(True).items()}
        self.raw_a = [special.get(i) or bytes(value[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.raw_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in raw]) for raw in (self.raw_a, self.raw_b))
        # Bytes of all ids, and their numbers in digits with room for what stands after, as ragged rows.
        self.bytes_a, self.bytes_b, self.digits = Ragged(np.uint8), Ragged(np.uint8), Ragged(np.uint8)
        marks = [f"{i};".encode() for i in range(max(len(self.raw_a), len(self.raw_b)))]
        for held, rows in ((self.bytes_a, self.raw_a), (self.bytes_b, self.raw_b), (self.digits, marks)):
            held.add(np.frombuffer(b"".join(rows), np.uint8), np.array([len(x) for x in rows]))
        self.space = self.b.piece_to_id(SPACE)
        # Pieces must not reach over the places where texts are cut.
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.lookup = self.table = None  # the counts of pairs, where they are known, and their name
        self._forget()
        self.words = Words()

    def _forget(self) -> None:
        self.n_a, self.n_b, self.n_groups, self.best, self.sums = (Ragged(np.int64) for _ in range(5))
        self.fits, self.links = Ragged(np.bool_), Ragged(np.int64)
        self.strings: list[bytes] = []

    def know(self, table: str, pair: np.ndarray, n: np.ndarray, best: np.ndarray) -> None:
        """Take up the counts of pairs; pieces that are known already get their sums."""
        if table == self.table:
            return

        def lookup(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(pair):  # links that are only in texts without tokens count nowhere
                return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
            at = np.minimum(np.searchsorted(pair, keys), len(pair) - 1)
            there = pair[at] == keys
            return n[at] * there, best[at] & there

        self.lookup, self.table, self.best, self.sums = lookup, table, Ragged(np.int64), Ragged(np.int64)
        for held, x in zip((self.sums, self.best), lookup(self.links.flat[: self.links.used]), strict=True):
            upto = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[self.links.ends[: self.links.n]]
            held.add(np.diff(upto, prepend=0), np.ones(self.links.n, np.int64))

    def parts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
        """(places of texts, their pieces without the space before each), of " " + text."""
        odd = pc.match_substring_regex(texts, _RUN).to_numpy(zero_copy_only=False) if self.apart else np.ones(len(texts), bool)
        plain = np.flatnonzero(~odd)
        if len(plain):
            yield plain, pc.split_pattern(texts.take(pa.array(plain)), " ")
        odd = np.flatnonzero(odd)
        if len(odd):
            cut = [_APART.split(" " + t) if self.apart else [" " + t] for t in texts.take(pa.array(odd)).to_pylist()]
            yield odd, pa.array([[p[1:] for p in x] for x in cut], pa.list_(pa.string()))

    def encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of " " + piece by A end to end and how many each has, and the same by B."""
        own = [not p or " " in p or p[-1].isspace() for p in pieces]
        alone = [i for i, x in enumerate(own) if x]
        flat, n = tokens_of_words(self.a, [p for p, x in zip(pieces, own, strict=True) if not x], " ")
        n_a = np.zeros(len(pieces), np.int64)
        n_a[~np.array(own, bool)] = n
        if alone:
            found = [e.ids for e in self.a.encode_batch_fast([" " + pieces[i] for i in alone], add_special_tokens=False)]
            n_a[alone] = [len(x) for x in found]
            is_own = np.repeat(np.array(own), n_a)
            both = np.empty(len(is_own), np.int32)
            both[~is_own], both[is_own] = flat, np.concatenate([np.array(x, np.int32) for x in found])
            flat = both
        found = [x if p else [self.space] for x, p in zip(self.b.encode(pieces, num_threads=1), pieces, strict=True)]
        n_b = np.fromiter(map(len, found), np.int64, len(found))
        return flat, n_a, np.fromiter((i for x in found for i in x), np.int32, int(n_b.sum())), n_b

    def learn(self, pieces: list[str]) -> None:
        """Align new pieces. One whose joined bytes differ from the text fits not and has no tokens."""
        ids_a, n_a, ids_b, n_b = self.encoded(pieces)
        text = [(" " + p).encode() for p in pieces]
        fits = given_back(text, self.bytes_a, ids_a, n_a) & given_back(text, self.bytes_b, ids_b, n_b)
        piece_a, piece_b = np.repeat(np.arange(len(pieces)), n_a), np.repeat(np.arange(len(pieces)), n_b)
        in_a, in_b = fits[piece_a], fits[piece_b]
        # The pieces that fit lie one after another: each token takes the bytes after the one before.
        tokens = []
        for ids, size in ((ids_a[in_a], self.size_a), (ids_b[in_b], self.size_b)):
            end = np.cumsum(size[ids])
            tokens.append(Tokens(ids, end - size[ids], end))
        a, b = tokens
        piece_a, piece_b = piece_a[in_a], piece_b[in_b]
        group_a, group_b, n_groups = coalesced(a, b)
        piece_of_group = np.empty(n_groups, np.int64)
        piece_of_group[group_a] = piece_a
        left, right = overlaps(a, b)
        together = a.end[left] == b.end[right]
        left, right = left[together], right[together]
        keys = (a.ids[left].astype(np.int64) << 32) | b.ids[right]
        n = len(pieces)
        per = lambda x, w=None: np.bincount(x, w, minlength=n).astype(np.int64)
        one = np.ones(n, np.int64)
        self.fits.add(fits, one)
        self.n_a.add(per(piece_a), one)
        self.n_b.add(per(piece_b), one)
        self.n_groups.add(per(piece_of_group), one)
        self.links.add(keys, per(piece_a[left]))
        if self.lookup is not None:
            count, is_best = self.lookup(keys)
            self.sums.add(per(piece_a[left], count), one)
            self.best.add(per(piece_a[left], is_best), one)
        # a1,a2|b1;a3|b2,b3: tokens by group, those of A first, each with what stands after it.
        group = np.concatenate((group_a, group_b))
        kind = np.repeat([0, 1], [len(group_a), len(group_b)])
        order = np.lexsort((np.arange(len(group)), kind, group))
        group, kind = group[order], kind[order]
        data, size = self.digits.rows(np.concatenate((a.ids, b.ids))[order])
        upto = np.cumsum(size)
        data[upto[:-1][kind[:-1] < kind[1:]] - 1] = ord("|")
        same = (kind[:-1] == kind[1:]) & (group[:-1] == group[1:])
        data[upto[:-1][same] - 1] = ord(",")
        whole = data.tobytes()
        tokens_upto = np.cumsum(per(piece_a) + per(piece_b))
        cut = np.concatenate(([0], upto))[tokens_upto].tolist()
        self.strings += [whole[lo : max(lo, hi - 1)] for lo, hi in zip([0, *cut], cut)]

    def seen(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
        """(places of texts, numbers of their pieces end to end, how many each has, whether numbers began afresh)."""
        for places, parts in self.parts(texts):
            which, count, new, afresh = self.words.of(parts)
            if afresh:
                self._forget()
            if new:
                self.learn(new)
            yield places, which, count, afresh

    def valid(self, which: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Whether all pieces of each text fit."""
        return np.minimum.reduceat(self.fits.flat[which], np.cumsum(count) - count) if len(count) else np.zeros(0, bool)


def _rows(rows: dict[str, list | np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def pair_counts(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """(pair, n, best): how many links of all texts hold the ids a and b (pair = a * 2**32 + b), and whether
    that is the highest number of b's pairs. Tasks add up links by piece and by pair before they are shuffled."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = remembered(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))
        times = np.zeros(0, np.int64)

        def pairs(times: np.ndarray, links: Ragged) -> pa.RecordBatch:
            at = np.flatnonzero(times)
            flat, length = links.rows(at)
            keys, place = np.unique(flat, return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, place, np.repeat(times[at], length))
            return _rows({"pair": keys, "n": n}, schema)

        for batch in batches:
            for _, texts in slices(batch.column(0)):
                links = model.links
                for _, which, count, afresh in model.seen(texts):
                    if afresh:
                        yield pairs(times, links)
                        times, links = np.zeros(0, np.int64), model.links
                    ok = np.repeat(model.valid(which, count), count)
                    new = np.bincount(which[ok], minlength=model.links.n)
                    new[: len(times)] += times
                    times = new
        yield pairs(times, model.links)
        give_back()

    texts = docs.select(text_col).filter(F.octet_length(text_col) > 0)
    counts = stored(texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    high = counts.groupBy((F.col("pair") % (1 << 32)).alias("b")).agg(F.max("n").alias("high"))
    return stored(counts.withColumn("b", F.col("pair") % (1 << 32)).join(high, "b").select("pair", "n", (F.col("n") == F.col("high")).alias("best")))


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _measured(docs: DataFrame, path_a: str, path_b: str, known, links: bool) -> DataFrame:
    """(_id, _row, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, links) of (_id, _row, _text)."""
    fields = [(c, pa.string() if c == "groups_sha256" else pa.int64()) for c in ALIGNED]
    schema = pa.schema([("_id", pa.int64()), ("_row", pa.int64()), *fields, ("links", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What a worker learnt when pairs were counted serves again.
        model = remembered(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))
        if known is not None:
            model.know(known.id, *known.value)
        for batch in batches:
            for first, texts in slices(batch.column(2)):
                out = {c: np.zeros(len(texts), np.int64) for c in ALIGNED[:-1]}
                digest, found = np.full(len(texts), "", object), [np.zeros(0, np.int64)] * len(texts)
                filled = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
                for places, which, count, _ in model.seen(texts):
                    ok = model.valid(which, count) & filled[places]
                    begin = np.cumsum(count) - count
                    for name, held in (("n_a", model.n_a), ("n_b", model.n_b), ("n_groups", model.n_groups), ("n_best", model.best), ("count_sum", model.sums)):
                        if known is not None or held not in (model.best, model.sums):
                            out[name][places] = np.add.reduceat(held.flat[which], begin) * ok
                    out["n_links"][places] = np.add.reduceat(model.links.lengths()[which], begin) * ok
                    numbers, strings = which.tolist(), model.strings
                    for j in np.flatnonzero(ok).tolist():
                        lo = int(begin[j])
                        mine = numbers[lo : lo + int(count[j])]
                        digest[places[j]] = sha256(b";".join([strings[i] for i in mine])).hexdigest()
                        if links:
                            found[places[j]] = model.links.rows(np.array(mine))[0]
                yield _rows(out | {"_id": batch.column(0).slice(first, len(texts)), "_row": batch.column(1).slice(first, len(texts)), "groups_sha256": digest.tolist(), "links": found if links else [None] * len(texts)}, schema)
        give_back()

    types = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in ALIGNED)
    return docs.mapInArrow(run, f"_id long, _row long, {types}, links array<long>")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): how the tokens of A (a byte-level
    tokenizer file) and of B (a piece model) of " " + text lie to each other; paths exist on every executor.

    Groups are cut where tokens of both end. Links are pairs of tokens of A and B that end together; a
    pair's count is the number of links in all texts that hold its ids, n_best the links whose count is
    the highest of their B id, count_sum the sum of counts. groups_sha256 is of `a1,a2|b1;a3|b2,b3`.
    Null and empty texts, and those that a tokenizer does not give back byte by byte, have zeros and ''.
    Whole texts of any length are aligned; null ids, repeated rows and an empty table pass through; other
    columns are ignored. Counts of pairs are broadcast up to broadcast_pairs, beyond that they are joined.
    """
    counts = pair_counts(docs, path_a, path_b, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.monotonically_increasing_id().alias("_row"), F.coalesce(text_col, F.lit("")).alias("_text"))
    if counts.limit(broadcast_pairs + 1).count() <= broadcast_pairs:
        table = counts.orderBy("pair").toArrow()
        arrays = tuple(table[c].to_numpy() for c in ("pair", "n", "best"))
        known = docs.sparkSession.sparkContext.broadcast(arrays)
        known.id = f"{len(arrays[0])}-{sha256(b''.join(x.tobytes() for x in arrays)).hexdigest()}"
        return _measured(rows, path_a, path_b, _Table(known, known.id), False).select(F.col("_id").alias(id_col), *ALIGNED)
    measured = stored(_measured(rows, path_a, path_b, None, True))
    held = measured.select("_row", F.explode("links").alias("pair")).groupBy("_row", "pair").agg(F.count("*").alias("k"))
    sums = held.join(counts, "pair").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("_best"), F.sum(F.col("k") * F.col("n")).alias("_sum"))
    out = measured.drop("n_best", "count_sum", "links").join(sums, "_row", "left")
    return out.withColumns({"n_best": F.coalesce("_best", F.lit(0)), "count_sum": F.coalesce("_sum", F.lit(0))}).select(F.col("_id").alias(id_col), *ALIGNED)


@dataclass
class _Table:
    """The broadcast counts with a name that tells them from others."""

    held: object
    id: str

    @property
    def value(self):
        return self.held.value


GROUPS = "doc_id long, group_no int, start long, a_ids array<int>, b_ids array<int>, bytes binary"


def aligned_groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """GROUPS: each group of each document with its place in the bytes of " " + text, ids of both sides and bytes.
    Documents as in `align`; those without tokens have no groups."""
    schema = pa.schema([("doc_id", pa.int64()), ("group_no", pa.int32()), ("start", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = remembered(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))
        for batch in batches:
            for first, texts in slices(batch.column(1), 1 << 20):
                out: dict[str, list] = {f.name: [] for f in schema}
                ids = batch.column(0).slice(first, len(texts)).to_pylist()
                for places, which, count, _ in model.seen(texts):
                    ok, begin = model.valid(which, count), np.cumsum(count) - count
                    for j in np.flatnonzero(ok).tolist():
                        if not texts[int(places[j])].as_py():
                            continue
                        at = 0
                        groups = b";".join([model.strings[i] for i in which[begin[j] : begin[j] + count[j]].tolist()]).decode()
                        for no, group in enumerate(groups.split(";")):
                            a, b = ([int(i) for i in side.split(",")] for side in group.split("|"))
                            raw = b"".join(model.raw_a[i] for i in a)
                            for name, x in zip(out, (ids[places[j]], no, at, a, b, raw), strict=True):
                                out[name].append(x)
                            at += len(raw)
                yield _rows(out, schema)
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("_text")).mapInArrow(run, GROUPS)
