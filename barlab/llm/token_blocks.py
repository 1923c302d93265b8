"""Token ids in compressed blocks: an adaptive context-mixing range coder.

Ids of all documents, in ascending order of doc_id and each document followed by an end id, are cut
into blocks. A block is coded by itself: its models start afresh, and it carries a checksum.

An id is predicted three ways. Order 2 and order 1 say the id that last followed the last two ids, or the
last one; order 0 is the frequency of the ids that those missed. The distribution used is their mixture,
whose weights go by the orders that were right about the ids before; an id that is new to its block is
named in full.

The symbols of a block are dealt over streams, and numpy arrays hold the state of all streams of many
blocks: one symbol of each is coded at a time. Counts are renewed in steps. Carries are left in the
digits and are added up at the end.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyspark
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import give_back, remembered, scratch
from .words import Ragged, Words, slices, tokens_of_words

#: Ids of a block, and blocks coded side by side (up to half as many more, so that no few are left over).
BLOCK_IDS, LANES = 8192, 640
#: Distinct words that a worker remembers.
REMEMBER = 700_000
#: Bytes of texts tokenized together.
SLICE = 1 << 23
#: Bytes of text of a file.
FILE_BYTES = 28 << 20
#: The id after each document.
END = 1
#: Slots of the tables of orders 1 and 2, as a power of 2.
SLOT_BITS = 13
#: The largest alphabet that a block may have.
MOST_IDS = 1 << 24
#: Streams of a block at most, and blocks whose streams are coded side by side.
STREAMS, TOGETHER = 8, 128
#: Counts are renewed after so many steps, and then whenever this part more are coded: of the literals, of the orders.
RENEWAL, GROWTH, ORDERS_GROWTH = 2, 4, 2
#: Weight of one event among the orders; each has 1 at first.
ORDERS_STEP = 6
#: A block's header: mark, size of the alphabet, ids, crc32 of the ids; then the crc32 of all else.
HEADER, SEAL = struct.Struct("<4sIII"), struct.Struct("<I")
MARK = b"TKB3"
#: The coder's reach, a whole number in double precision, has 48 bits and is kept above _LEAST; a digit has 16 bits.
_LEAST, _FULL = float(1 << 32), float(1 << 48)
#: Up to this total a symbol costs one digit at most; up to so many ids a stream's digits are counted in 16 bits.
_EASY, _SHORT = 1 << 15, 1 << 14
#: Which orders are right about three ids, from their number.
_THREE = np.array([[i % 3, i // 3 % 3, i // 9] for i in range(27)], np.uint8)
_MASK = (1 << SLOT_BITS) - 1


def _slots(alphabet: int) -> np.ndarray:
    """Fixed hashes of ids for the tables of orders 1 and 2, a slot in the upper and one in the lower bits."""
    return np.random.default_rng(alphabet).integers(0, 1 << 2 * SLOT_BITS, alphabet)


def _right(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The highest order that is right about each id of a block, 0 for none. Orders 1 and 2 say the id that last followed
    the last id, or the last two; contexts of the same slot count as the same, and at first id 0 follows."""
    n, out = len(ids), np.zeros(len(ids), np.uint8)
    hashed = hashes.take(ids)
    low, bits = hashed & _MASK, max(1, (n - 1).bit_length())
    first = hashes[0] & _MASK
    slots = np.empty((2, n), np.int32 if bits + SLOT_BITS < 32 else np.int64)
    slots[0, 0], slots[0, 1:] = first, low[:-1]
    slots[1, 0], slots[1, 1:] = hashes[0] >> SLOT_BITS, hashed[:-1] >> SLOT_BITS
    slots[1, :1] ^= first
    slots[1, 1:2] ^= first
    slots[1, 2:] ^= low[:-2]
    place = np.arange(n, dtype=slots.dtype)
    for order in (1, 2):
        # In order of slots and places, the id that last followed stands before each.
        both = np.sort((slots[order - 1] << bits) + place)
        at = both & ((1 << bits) - 1)
        follows = ids.take(at)
        slot = both >> bits
        said = np.zeros(n, ids.dtype)
        said[1:] = np.where(slot[1:] == slot[:-1], follows[:-1], 0)
        out[at[said == follows]] = order
    return out


def _fill(ids: np.ndarray, right: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> None:
    """Put in the ids about which an order is right; the others are there. Blocks stand side by side, longest first."""
    n = len(lengths)
    # The tables of order 1 and of order 2, each with a part for each block.
    base = np.arange(2 * n).reshape(2, -1) << SLOT_BITS
    table = np.zeros(2 * n << SLOT_BITS, ids.dtype)
    active = np.searchsorted(-lengths, -np.arange(len(ids)), side="left").tolist()
    place, lane = np.nonzero(right)
    which = lane + n * (right[place, lane].astype(np.int64) - 1)
    upto = np.searchsorted(place, np.arange(len(ids) + 1)).tolist()
    first = hashes[0] & _MASK
    at = base + np.array([[first], [(hashes[0] >> SLOT_BITS) ^ first]])
    flat, older, hashed, low, last = at.reshape(-1), np.full(n, first), *np.empty((3, n), np.int64)
    m = 0
    for t, blocks in enumerate(active):
        if blocks != m:
            m = blocks
            base1, base2, at1, at2, low, hashed, older, last = *base[:, :m], *at[:, :m], low[:m], hashed[:m], older[:m], last[:m]
        row = ids[t, :m]
        a, b = upto[t], upto[t + 1]
        if a < b:
            row[lane[a:b]] = table.take(flat.take(which[a:b]))
        table[at1] = row
        table[at2] = row
        np.copyto(last, row)
        hashes.take(last, mode="clip", out=hashed)
        np.add(base1, np.bitwise_and(hashed, _MASK, out=low), out=at1)
        np.right_shift(hashed, SLOT_BITS, out=hashed)
        np.add(base2, np.bitwise_xor(hashed, older, out=hashed), out=at2)
        older, low = low, older


class _Counts:
    """Adaptive counts of symbols in rows of cells. What was coded since is taken up when renewed."""

    def __init__(self, rows: int, cells: int, step: int, grows: bool):
        self.rows, self.room, self.step, self.grows, self.growth = rows, cells, step, grows, GROWTH if grows else ORDERS_GROWTH
        self.count, self.used = np.ones((rows, cells)), np.full(rows, cells)

    def renew(self, search: bool) -> None:
        if self.grows and (need := int(self.used.max())) > self.room:
            more = need + need // 4 - self.room
            self.count, self.room = np.pad(self.count, ((0, 0), (0, more)), constant_values=1), self.room + more
        upto = np.cumsum(self.count, axis=1)
        self.total = upto[np.arange(self.rows), self.used - 1]
        self.width, self.low = self.count.reshape(-1), (upto - self.count).reshape(-1)
        if search:  # the cell at each place of a row
            self.begin = np.cumsum(upto[:, -1].astype(np.int64)) - upto[:, -1].astype(np.int64)
            self.cell_at = np.repeat(np.arange(self.rows * self.room, dtype=np.int32), self.width.astype(np.int64))

    def learn(self, at: np.ndarray) -> None:
        """Take up symbols, given as places in the flat table. Where rows grow, each cell 0 opens a new cell."""
        new = np.bincount(at, minlength=self.rows * self.room).reshape(self.rows, self.room)
        self.count += new * self.step
        if self.grows:
            self.used = self.used + new[:, 0]


def _renewals(steps: int, growth: int) -> list[int]:
    """The steps before which counts are renewed, and the last."""
    out = [0]
    while out[-1] < steps:
        out.append(out[-1] + max(RENEWAL, out[-1] // growth))
    return [*out[:-1], steps] if steps else [0]


def _streams(n: int) -> int:
    """Among how many streams the symbols of a block of n ids are dealt, so that they can be coded side by side. As each costs some bytes,
    short blocks have few."""
    return max(1, min(STREAMS, (n - 1024) // 896))


def _encode(counts: _Counts, cells: np.ndarray, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code cells[step, stream] of rows[step, stream] (or of rows[0, stream] throughout): the streams' digits end to
    end, and how many each has. size: symbols of each stream, the rest is left out."""
    n, bounds = len(size), _renewals(len(cells), counts.growth)
    low, reach, at = np.zeros(n), np.full(n, _FULL), np.arange(n)
    digits = np.zeros((len(cells) + 8, n), np.int32)
    flat = digits.reshape(-1)
    part, room, is_short = np.empty(n), np.empty(n), np.empty(n, bool)  # new arrays at each step would take most of the time
    for a, b in zip(bounds, bounds[1:]):
        counts.renew(False)
        row = rows[a:b] if len(rows) > 1 else rows
        cell = row * counts.room + cells[a:b]
        live = np.arange(a, b)[:, None] < size
        lows, widths, totals = counts.low.take(cell), counts.width.take(cell), np.broadcast_to(counts.total.take(row), cell.shape)
        if not live.all():  # a symbol of the whole width changes nothing
            lows, widths, totals = np.where(live, lows, 0), np.where(live, widths, 1), np.where(live, totals, 1)
        turns = 1 if totals.max() <= _EASY else 2
        if int(at.max()) + (turns * (b - a) + 8) * n > len(flat):
            digits = np.concatenate((digits, np.zeros((turns * (b - a) + 8, n), np.int32)))
            flat = digits.reshape(-1)
        for k in range(b - a):
            np.floor(np.divide(reach, totals[k], out=part), out=part)
            np.add(low, np.multiply(part, lows[k], out=room), out=low)
            np.multiply(part, widths[k], out=reach)
            for _ in range(turns):
                short = np.less(reach, _LEAST, out=is_short).nonzero()[0]
                x, here = low.take(short), at.take(short)
                digit = np.floor(x * (1 / _LEAST))
                flat[here] = digit
                at[short] = here + n
                low[short] = (x - digit * _LEAST) * 65536
                reach[short] = reach.take(short) * 65536
        counts.learn(cell.reshape(-1) if live.all() else cell[live])
    flat[at] = np.ceil(low * (1 / _LEAST))  # the one digit that leads into what is left, before zeros
    over = np.flatnonzero(flat >> 16)
    while len(over):  # carries
        flat[over] &= 0xFFFF
        flat[over - n] += 1
        over = (over - n)[flat[over - n] >> 16 > 0]
    many = at // n + 1
    return digits.T.astype("<u2")[np.arange(len(digits)) < many[:, None]], many


def _decode(counts: _Counts, digits: np.ndarray, many: np.ndarray, rows: np.ndarray, size: np.ndarray, memory: bool = False) -> np.ndarray:
    """The cells that _encode was given, as [step, stream]; beyond a stream's symbols they mean nothing. With a memory, rows[stream] is the row
    after cell 0, and those after other cells follow."""
    n, steps = len(size), int(size.max(initial=0))
    bounds, out = _renewals(steps, counts.growth), np.zeros((steps, n), np.uint8 if memory else np.int32)
    data = np.zeros(len(digits) + 2 * n + 2 * steps + 8)
    data[np.arange(len(digits)) + 2 * np.repeat(np.arange(n), many)] = digits
    at = np.cumsum(many + 2) - (many + 2)
    value = (data[at] * 65536 + data[at + 1]) * 65536 + data[at + 2]
    at += 3
    reach, row = np.full(n, _FULL), rows.copy()
    part, room, is_short, place, found = np.empty(n), np.empty(n), np.empty(n, bool), np.empty(n, np.int64), np.empty(n, np.int32)
    for a, b in zip(bounds, bounds[1:]):
        counts.renew(True)
        turns = 1 if counts.total.max() <= _EASY else 2
        total, begin = counts.total.take(row), counts.begin.take(row)
        cells = np.zeros((b - a, n), np.int64)
        for k in range(b - a):
            cell = cells[k]
            np.floor(np.divide(reach, total, out=part), out=part)
            np.subtract(np.multiply(part, total, out=room), 1, out=room)
            np.minimum(value, room, out=value)  # only where a stream is over or damaged
            np.copyto(place, np.divide(value, part, out=room), casting="unsafe")
            np.copyto(cell, counts.cell_at.take(np.add(place, begin, out=place), mode="clip", out=found))
            np.multiply(part, counts.low.take(cell, mode="clip", out=room), out=room)
            np.subtract(value, room, out=value)
            np.multiply(part, counts.width.take(cell, mode="clip", out=room), out=reach)
            for _ in range(turns):
                short = np.less(reach, _LEAST, out=is_short).nonzero()[0]
                here = at.take(short)
                value[short] = value.take(short) * 65536 + data.take(here)
                reach[short] = reach.take(short) * 65536
                at[short] = here + 1
            if memory:
                np.subtract(cell, np.multiply(row, counts.room, out=row), out=row)
                np.add(row, rows, out=row)
                counts.total.take(row, mode="clip", out=total)
                counts.begin.take(row, mode="clip", out=begin)
        live = np.arange(a, b)[:, None] < size
        counts.learn(cells.reshape(-1) if live.all() else cells[live])
        cells -= rows * counts.room
        out[a:b] = (np.arange(counts.room**2) % counts.room).astype(np.uint8).take(cells) if memory else cells
    return out


def _cells(literals: np.ndarray, where: np.ndarray, streams: int, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a block's literals in order 0, and which of them are named in full. An id is named (cell 0) until counts are renewed;
    each name opens a cell, and later the id has the first of its cells. `where` is room for an integer for each id of the alphabet."""
    at = np.arange(len(literals), dtype=np.int32)
    where[literals[::-1]] = at[::-1]
    first = where[literals]
    when = period[at // streams]
    named = when[first] == when
    return np.where(named, 0, np.cumsum(named)[first]), named


def _layout(sizes: list[int]) -> tuple[list[int], np.ndarray]:
    """Number of streams of blocks of so many ids, and the block of each stream."""
    streams = [_streams(n) for n in sizes]
    return streams, np.repeat(np.arange(len(sizes)), streams)


def _shares(n: int, streams: int) -> list[int]:
    """How many of n symbols each stream has: as many steps as it takes, the last streams fewer."""
    steps = -(-n // streams)
    return [max(0, min(steps, n - i * steps)) for i in range(streams)]


def encode_blocks(blocks: list[np.ndarray], alphabet: int) -> list[bytes]:
    """Each block of ids (at least one, below `alphabet`, which is MOST_IDS at most) as bytes."""
    if alphabet > MOST_IDS:
        raise ValueError("too many ids for the tables of a block")
    hashes, where = _slots(alphabet), np.zeros(alphabet, np.int32)
    return [data for some in passes(len(blocks), TOGETHER) for data in _encoded(blocks[some], hashes, where)]


def _encoded(blocks: list[np.ndarray], hashes: np.ndarray, where: np.ndarray) -> list[bytes]:
    alphabet = len(hashes)
    streams, block_of = _layout([len(x) for x in blocks])
    lanes = np.cumsum(streams) - streams
    # Orders, three ids at a time: a stream has a stretch of the block.
    shares = [_shares(-(-len(x) // 3), n) for x, n in zip(blocks, streams, strict=True)]
    steps = max(x[0] for x in shares)
    orders = np.zeros((steps, len(block_of)), np.uint8)
    literals = []
    for lane, n, share, x in zip(lanes, streams, shares, blocks, strict=True):
        right = np.zeros(3 * n * share[0], np.uint8)
        right[: len(x)] = _right(x, hashes)
        orders[: share[0], lane : lane + n] = (right[::3] + 3 * right[1::3] + 9 * right[2::3]).reshape(n, -1).T
        literals.append(x[right[: len(x)] == 0])
    rows = np.zeros((steps, len(block_of)), np.int64)
    rows[1:] = orders[:-1]
    rows += block_of * 27
    order_digits, order_many = _encode(_Counts(27 * len(blocks), 27, ORDERS_STEP, False), orders, rows, np.concatenate(shares))
    # Literals: streams take turns.
    most = max(-(-len(x) // n) for x, n in zip(literals, streams, strict=True))
    period = np.searchsorted(_renewals(most, GROWTH), np.arange(most), side="right")
    cells, sizes, names = np.zeros((most, len(block_of)), np.int32), [], []
    for lane, n, x in zip(lanes, streams, literals, strict=True):
        cell, named = _cells(x, where, n, period)
        turns = -(-len(x) // n)
        padded = np.zeros(n * turns, np.int32)
        padded[: len(x)] = cell
        cells[:turns, lane : lane + n] = padded.reshape(-1, n)
        sizes.append((len(x) - np.arange(n) + n - 1) // n)
        names.append(x[named].astype(_name_type(alphabet)).tobytes())
    digits, many = _encode(_Counts(len(blocks), 1, 1, True), cells, block_of[None], np.concatenate(sizes))
    # Side by side, digits of the orders and of the literals.
    ends, order_ends = np.cumsum(many), np.cumsum(order_many)
    out = []
    for lane, n, x, name in zip(lanes, streams, blocks, names, strict=True):
        head = HEADER.pack(MARK, alphabet, len(x), crc32(x.astype("<u4").tobytes()))
        body = [np.concatenate((order_many[lane : lane + n], many[lane : lane + n])).astype("<u4" if len(x) > _SHORT else "<u2").tobytes()]
        for d, e, m in ((order_digits, order_ends, order_many), (digits, ends, many)):
            body.append(d[e[lane] - m[lane] : e[lane + n - 1]].tobytes())
        data = b"".join((*body, name))
        out.append(head + SEAL.pack(crc32(data, crc32(head))) + data)
    return out


def _name_type(alphabet: int) -> str:
    return "<u1" if alphabet <= 1 << 8 else "<u2" if alphabet <= 1 << 16 else "<u4"


def decode_blocks(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; a block that is damaged raises ValueError."""
    least = HEADER.size + SEAL.size
    heads = [HEADER.unpack_from(c) if len(c) >= least else (b"", 0, 0, 0) for c in coded]
    if any(h[0] != MARK or not 0 < h[1] <= MOST_IDS or not h[2] for h in heads):
        raise ValueError("not a block of token ids")
    for c in coded:
        if SEAL.unpack_from(c, HEADER.size)[0] != crc32(memoryview(c)[least:], crc32(c[: HEADER.size])):
            raise ValueError("the checksum of a coded block is wrong")
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(coded)
    for alphabet in sorted({h[1] for h in heads}):
        mine = sorted((i for i, h in enumerate(heads) if h[1] == alphabet), key=lambda i: -heads[i][2])
        for i, ids in zip(mine, _decoded([memoryview(coded[i])[least:] for i in mine], [heads[i][2] for i in mine], alphabet), strict=True):
            out[i] = ids
    for ids, head in zip(out, heads, strict=True):
        if crc32(ids.astype("<u4").tobytes()) != head[3]:
            raise ValueError("the checksum of a block of token ids is wrong")
    return out


def _decoded(coded: list[memoryview], sizes: list[int], alphabet: int) -> list[np.ndarray]:
    """The ids of blocks, longest first."""
    ids = np.zeros((len(coded), sizes[0]), np.uint16 if alphabet <= 1 << 16 else np.int32)
    right = np.zeros(ids.shape, np.uint8)
    for a in range(0, len(coded), TOGETHER):
        _literals(coded[a : a + TOGETHER], sizes[a : a + TOGETHER], alphabet, ids[a:], right[a:])
    ids = np.ascontiguousarray(ids.T)
    _fill(ids, np.ascontiguousarray(right.T), np.array(sizes), _slots(alphabet))
    ids = np.ascontiguousarray(ids.T)
    return [x[:n].astype(np.int32) for x, n in zip(ids, sizes, strict=True)]


def _literals(coded: list[memoryview], sizes: list[int], alphabet: int, ids: np.ndarray, right: np.ndarray) -> None:
    """Decode which order is right about each id of the blocks, and the ids about which none is."""
    streams, block_of = _layout(sizes)
    lanes = np.cumsum(streams) - streams
    parts: list[list[np.ndarray]] = [[], [], [], [], []]
    for data, size, n in zip(coded, sizes, streams, strict=True):
        kind = np.dtype("<u4" if size > _SHORT else "<u2")
        many = np.frombuffer(data, kind, 2 * n).astype(np.int64)
        first, both = int(many[:n].sum()), int(many.sum())
        digits = np.frombuffer(data, "<u2", both, 2 * n * kind.itemsize)
        names = np.frombuffer(data, _name_type(alphabet), offset=2 * n * kind.itemsize + 2 * both)
        for part, x in zip(parts, (many[:n], many[n:], digits[:first], digits[first:], names), strict=True):
            part.append(x)
    order_many, many, order_digits, digits = map(np.concatenate, parts[:4])
    shares = [_shares(-(-size // 3), n) for size, n in zip(sizes, streams, strict=True)]
    orders = _decode(_Counts(27 * len(coded), 27, ORDERS_STEP, False), order_digits, order_many, block_of * 27, np.concatenate(shares), True)
    counts = []
    for lane, n, share, size, r in zip(lanes, streams, shares, sizes, right):
        r[:size] = _THREE[orders[: share[0], lane : lane + n].T.reshape(-1)].reshape(-1)[:size]
        counts.append(size - np.count_nonzero(r[:size]))
    turns = [(x - np.arange(n) + n - 1) // n for x, n in zip(counts, streams, strict=True)]
    cells = _decode(_Counts(len(coded), 1, 1, True), digits, many, block_of, np.concatenate(turns))
    for lane, n, x, names, size, r, row in zip(lanes, streams, counts, parts[4], sizes, right, ids):
        cell = cells[: -(-x // n), lane : lane + n].reshape(-1)[:x]
        named = cell == 0
        if np.count_nonzero(named) != len(names):
            raise ValueError("a block of token ids lacks names")
        which = cell - 1
        which[named] = np.arange(len(names))
        row[:size][r[:size] == 0] = names[which] if x else 0


def passes(n: int, lanes: int) -> Iterator[slice]:
    """n blocks in even shares, of about as many as go side by side."""
    share = -(-n // max(1, round(n / lanes))) if n else 1
    return (slice(at, min(n, at + share)) for at in range(0, n, share))


#: The pattern of pre-tokens at which texts may be cut beyond white space.
PARTED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Classes of bytes (white space, letters, digits, the apostrophe, other ASCII, others), and whether a
#: text is cut between two of them. An apostrophe may belong to the letters after it, a sign of other bytes to any.
_WHITE = b" \t\n\v\f\r"
_CLASS = bytes(0 if b in _WHITE else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 if b == 39 else 4 for b in range(128)) + b"\5" * 128
_CUT = bytes((1, 1, 1, 1, 1, 1, 1, 0, 1, 1, 1, 0, 1, 1, 1, 1, 1, 0, 1, 0, 1, 0, 0, 0, 1, 1, 1, 0, 0, 0, 1, 0, 0, 0, 0, 0)).ljust(256)
_LOWER = bytes(range(256)).lower()


def pieces_of(texts: pa.Array, whole: re.Pattern | None) -> pa.ListArray:
    """The pieces of each text (no nulls) between which the pattern PARTED always parts tokens; what `whole` finds stays whole.

    A-Z are lower-cased, as the tokenizer does after composing characters: not before other bytes, which may be marks.
    """
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    raw = data.tobytes()
    kind = np.frombuffer(raw.translate(_CLASS), np.uint8)
    pair = kind[:-1] * np.uint8(6) + kind[1:]
    cut = np.ones(len(data), bool)
    cut[1:] = np.frombuffer(pair.tobytes().translate(_CUT), bool)
    if whole is not None:
        for found in whole.finditer(data):
            cut[found.start() + 1 : found.end()] = False
    cut[ends[:-1][ends[:-1] < len(data)]] = True
    white = kind == 0
    starts = cut & ~white
    first = np.cumsum([0, *(np.count_nonzero(starts[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()))])
    # Without white space, which has marks 2 and 3.
    marks = np.frombuffer((cut + (white.view(np.uint8) << 1)).tobytes().translate(None, b"\2\3"), bool)
    begin = np.append(np.flatnonzero(marks), len(marks)).astype(np.int32)
    lower = bytearray(raw.translate(_LOWER))
    before = np.flatnonzero(pair == 11)  # letters before other bytes
    np.frombuffer(lower, np.uint8)[before] = data[before]
    pieces = pa.StringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin), pa.py_buffer(bytes(lower).translate(None, _WHITE)))
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pieces)


#: Words of letters that normal forms and lower case leave single letters: one pre-token each.
_SINGLE = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")


#: The characters by which tokenizers write bytes, from those of the same number.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE_LEVEL = {b: b for b in _SHOWN} | dict(zip([b for b in range(256) if b not in _SHOWN], range(256, 512)))


class WordTokens:
    """Ids of texts as the tokenizer file at `path` gives them, one distinct word at a time.

    For tokenizers that drop white space and never join what it parts, so a text's ids are its words' ids. Where the
    tokenizer parts texts by PARTED, words are cut further, into letters, digits and signs, which leaves fewer distinct ones.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.alphabet = self.tokenizer.get_vocab_size(True)
        self.words, self.ids = Words(REMEMBER), Ragged(np.int32)
        file = json.loads(self.tokenizer.to_str())
        steps, forms = (file["pre_tokenizer"] or {}).get("pretokenizers") or [{}], (file["normalizer"] or {}).get("normalizers", [])
        self.parted = bool({"type": "Lowercase"} in forms and file["model"].get("end_of_word_suffix")) and tuple(map(steps[0].get, ("pattern", "invert", "behavior"))) == ({"Regex": PARTED}, True, "Removed")
        # Whether words of letters reach the model whole, in lower case and byte by byte.
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        self.direct = self.parted and [{k: v for k, v in x.items() if k != "trim_offsets"} for x in steps[1:]] == [plain] and all(
            x["type"] in ("NFC", "Lowercase") or (x["type"], x.get("pattern")) == ("Replace", {"Regex": r"\s+"}) for x in forms
        ) and not any(_SINGLE.fullmatch(t["content"]) for t in file["added_tokens"])
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile(b"|".join(map(re.escape, added))) if added else None

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word end to end, and how many each has. Single pre-tokens go to the tokenizer's model as they are, spelled as it has them."""
        single = np.fromiter((self.direct and w.isalpha() and (w.isascii() or _SINGLE.fullmatch(w) is not None) for w in words), bool, len(words))
        some, rest = ([w for w, x in zip(words, single.tolist(), strict=True) if x is kind] for kind in (True, False))
        spelled = (w.lower() if w.isascii() else w.lower().encode().decode("latin-1").translate(_BYTE_LEVEL) for w in some)
        ids, lengths = [], []
        for found in map(self.tokenizer.model.tokenize, spelled):
            ids += [t.id for t in found]
            lengths.append(len(found))
        flat = np.array(ids, np.int32)
        more, more_lengths = tokens_of_words(self.tokenizer, rest)
        length = np.zeros(len(words), np.int64)
        length[single], length[~single] = lengths, more_lengths
        mine, out = np.repeat(single, length), np.zeros(len(flat) + len(more), np.int32)
        out[mine], out[~mine] = flat, more
        return out, length

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (no nulls) end to end, without special tokens, and how many each has."""
        which, count, new, afresh = self.words.of(pieces_of(texts, self.whole) if self.parted else pc.split_pattern(texts, " "))
        if afresh:
            self.ids = Ragged(np.int32)
        self.ids.add(*self.tokens(new))
        flat, length = self.ids.rows(which)
        upto = np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum(count)))]
        return flat, np.diff(upto)


BLOCKS = "file int, block long, first_id long, first_doc long, n_ids long, opens boolean, doc_ids array<long>, counts array<int>, data binary"


def write_token_blocks(docs: DataFrame, path: str, out: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, block_ids: int = BLOCK_IDS, lanes: int = LANES, file_bytes: int = FILE_BYTES) -> None:
    """Write the token ids of all texts to the folder `out`, each document's followed by `end`.

    path names the tokenizer file, present on every executor. Files (about file_bytes of text each) follow
    one another in ascending id_col, null ids first, rows of one id by a hash of their text; a row of
    the table is a block: its file and number, ids and documents before it in the file, its ids' number,
    whether its first document began in the block before, its documents' ids and how many token ids
    each has in it, and the coded ids with their own header. Null and empty texts have the end id alone;
    texts of any length and repeated rows are written whole; an empty table gives no block; other
    columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text") + 16)).first()[0] or 0
    key = ("_id", "_hash", "_row")  # the row tells repeated ones apart, which may be many
    keyed = rows.withColumns({"_hash": F.xxhash64("_text"), "_row": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(max(1, -(-size // file_bytes)), *key).sortWithinPartitions(*key).select("_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = remembered(("token blocks", path), lambda: WordTokens(path))
        file = pyspark.TaskContext.get().partitionId()
        held, held_docs, held_counts = [np.zeros(0, np.int32)], [], []
        done = {"block": 0, "first": 0, "doc": 0, "opens": False}

        def blocks(all_of_it: bool) -> Iterator[pa.RecordBatch]:
            """Code the ids held: as many whole blocks as go side by side, but for a quarter of that; or all."""
            nonlocal held, held_docs, held_counts
            ids = np.concatenate(held)
            whole = len(ids) if all_of_it else (4 * len(ids) // (block_ids * lanes) - 1) // 4 * block_ids * lanes
            counts = np.array(held_counts, np.int64)
            ends = np.cumsum(counts)
            begins = ends - counts
            for some in passes(-(-whole // block_ids), lanes):
                cuts = [ids[i * block_ids : min((i + 1) * block_ids, whole)] for i in range(some.start, some.stop)]
                table: list[tuple] = []
                for ids_in, data in zip(cuts, encode_blocks(cuts, model.alphabet), strict=True):
                    lo = done["first"]
                    hi = lo + len(ids_in)
                    # Documents of which this block holds a part; places are counted from the ids held.
                    lo, hi = lo - offset, hi - offset
                    one, two = int(np.searchsorted(ends, lo, side="right")), int(np.searchsorted(begins, hi, side="left"))
                    part = np.minimum(ends[one:two], hi) - np.maximum(begins[one:two], lo)
                    opens = bool(begins[one] < lo) or (one == 0 and done["opens"])
                    table.append((file, done["block"], done["first"], base_doc + one, len(ids_in), opens, held_docs[one:two], part.tolist(), data))
                    done["first"] += len(ids_in)
                    done["block"] += 1
                    done["opens"] = False
                yield pa.RecordBatch.from_pandas(pd.DataFrame(table, columns=[c.split()[0] for c in BLOCKS.split(", ")]), schema=schema, preserve_index=False)
            gone = int(np.searchsorted(ends, whole, side="right"))
            done["doc"] = base_doc + gone
            rest = counts[gone:].copy()
            if len(rest):
                done["opens"] = bool(begins[gone] < whole)
                rest[0] = ends[gone] - max(whole, begins[gone])
            held, held_docs, held_counts = [ids[whole:]], held_docs[gone:], rest.tolist()

        schema = pa.schema([("file", pa.int32()), ("block", pa.int64()), ("first_id", pa.int64()), ("first_doc", pa.int64()), ("n_ids", pa.int64()), ("opens", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("data", pa.binary())])
        offset = base_doc = 0
        for batch in batches:
            for at, texts in slices(batch.column(1), SLICE):
                flat, count = model.encode(texts)
                with_end = np.full(len(flat) + len(count), end, np.int32)
                inner = np.ones(len(with_end), bool)
                inner[np.cumsum(count + 1) - 1] = False
                with_end[inner] = flat
                held.append(with_end)
                held_docs += batch.column(0).slice(at, len(count)).to_pylist()
                held_counts += (count + 1).tolist()
                if 4 * sum(map(len, held)) >= 5 * block_ids * lanes:
                    yield from blocks(False)
                    offset, base_doc = done["first"], done["doc"]
        if sum(map(len, held)):
            yield from blocks(True)
        give_back()

    dealt.mapInArrow(run, BLOCKS).write.parquet(out)


PARTS = "doc_id long, file int, doc_no long, first_id long, block long, ids array<int>"


def _read(blocks: DataFrame, schema: str, row, kinds: list[tuple[str, pa.DataType]], lanes: int) -> DataFrame:
    """One row for each document's part in a block, as row(doc_id, file, doc_no, first_id, block, ids) makes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in passes(batch.num_rows, lanes):
                part = batch.slice(some.start, some.stop - some.start).to_pylist()
                out = []
                for b, ids in zip(part, decode_blocks([b["data"] for b in part]), strict=True):
                    lo = 0
                    for j, (doc, n) in enumerate(zip(b["doc_ids"], b["counts"], strict=True)):
                        out.append(row(doc, b["file"], b["first_doc"] + j, b["first_id"] + lo, b["block"], ids[lo : lo + n]))
                        lo += n
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True), kinds, strict=True)], names=[name for name, _ in kinds])
            give_back()

    return blocks.select("file", "block", "first_id", "first_doc", "doc_ids", "counts", "data").mapInArrow(run, schema)


def read_token_blocks(spark: SparkSession, path: str, lanes: int = LANES) -> DataFrame:
    """(doc_id, file, doc_no, first_id, block, ids): the documents' parts in the blocks of the folder, decoded.

    A document that lies in one block has one row; doc_no and first_id count from the file's begin.
    """
    kinds = [("doc_id", pa.int64()), ("file", pa.int32()), ("doc_no", pa.int64()), ("first_id", pa.int64()), ("block", pa.int64()), ("ids", pa.list_(pa.int32()))]
    return _read(spark.read.parquet(path), PARTS, lambda *x: (*x[:5], x[5]), kinds, lanes)


def joined_crc(parts: list[dict]) -> int:
    """crc32 of the parts end to end, from each part's crc32 and number of ids, in order."""
    out = 0
    for p in parts:
        # crc32 is affine: what stood before is carried over zeros of the part's length.
        zeros = bytes(4 * p["n"])
        out = (crc32(zeros, out) ^ crc32(zeros) ^ p["crc"]) if p["n"] else out
    return out


def block_digest(spark: SparkSession, path: str, lanes: int = LANES) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents in the blocks of the folder, from the decoded ids.

    start counts the ids of all documents before, over the files in order. Parts of one document meet by
    (file, doc_no); damaged blocks raise an error.
    """
    blocks = spark.read.parquet(path)
    schema = "doc_id long, file int, doc_no long, first_id long, block long, n int, crc long"
    kinds = [("doc_id", pa.int64()), ("file", pa.int32()), ("doc_no", pa.int64()), ("first_id", pa.int64()), ("block", pa.int64()), ("n", pa.int32()), ("crc", pa.int64())]
    parts = _read(blocks, schema, lambda *x: (*x[:5], len(x[5]), crc32(x[5].astype("<u4").tobytes())), kinds, lanes)

    @F.pandas_udf("long")
    def crc(lists: pd.Series) -> pd.Series:
        return pd.Series([x[0]["crc"] if len(x) == 1 else joined_crc(list(x)) for x in lists], dtype="int64")

    docs = parts.groupBy("file", "doc_no").agg(F.first("doc_id").alias("doc_id"), F.min("first_id").alias("first_id"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("block", "n", "crc"))).alias("parts"))
    # One row a file: their number is that of the tasks that wrote them.
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return docs.join(before, "file").select("doc_id", (F.col("before") + F.col("first_id")).alias("start"), "n_tokens", crc("parts").alias("ids_crc32"))


def token_blocks(docs: DataFrame, path: str) -> DataFrame:
    """The digest of all documents after they were written to blocks in the shared folder and read again."""
    out = scratch(docs.sparkSession)
    write_token_blocks(docs, path, out)
    return block_digest(docs.sparkSession, out)
