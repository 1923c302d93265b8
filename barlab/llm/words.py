"""Texts as numbered words, so that what a tokenizer makes of a word is computed once.

A text is cut at its spaces; the distinct words of many texts get numbers, which a Python worker
keeps while its memory lasts. Features of words are ragged arrays by number.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words that a Python worker remembers before it starts afresh.
REMEMBER = 700_000
#: Words longer than this (in characters) are not remembered.
LONG = 256
#: Groups of words that the tokenizer has at a time.
GROUPS = 64


class Ragged:
    """Rows of numbers of different lengths, held end to end; rows can be added."""

    def __init__(self, dtype: type = np.int32):
        self.flat, self.ends, self.n, self.used = np.zeros(1 << 12, dtype), np.zeros(1 << 10, np.int64), 0, 0

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        """Take up len(lengths) more rows."""
        if self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, max(2 * len(self.flat), self.used + len(flat)))
        if self.n + len(lengths) > len(self.ends):
            self.ends = np.resize(self.ends, max(2 * len(self.ends), self.n + len(lengths)))
        self.flat[self.used : self.used + len(flat)] = flat
        self.ends[self.n : self.n + len(lengths)] = self.used + np.cumsum(lengths)
        self.n, self.used = self.n + len(lengths), self.used + len(flat)

    def lengths(self) -> np.ndarray:
        return np.diff(self.ends[: self.n], prepend=0)

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows `which` end to end, and their lengths."""
        begin = np.concatenate(([0], self.ends[: self.n]))[which]
        length = self.ends[which] - begin
        upto = np.cumsum(length)
        at = np.repeat(begin - (upto - length), length)
        at += np.arange(len(at))
        return self.flat[at], length


class Words:
    """Numbers of distinct words."""

    def __init__(self, remember: int = REMEMBER):
        self.number: dict[str, int] = {}
        self.remember, self.passing = remember, 0

    def of(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], bool]:
        """Number of each word in order, how many words each text has, the words that are new, and whether
        numbering began afresh. parts: the words of each text (lists, no nulls)."""
        afresh = len(self.number) > self.remember or self.passing > self.remember // 64
        if afresh:
            self.number.clear()
            self.passing = 0
        coded = parts.flatten().dictionary_encode()
        known, words = self.number, coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        first = len(known) + self.passing
        numbers = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(numbers < 0)
        numbers[fresh] = np.arange(first, first + len(fresh))
        new = [words[i] for i in fresh.tolist()]
        short = [(word, i) for i, word in enumerate(new, first) if len(word) <= LONG]
        known.update(short)
        self.passing += len(new) - len(short)
        count = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        return numbers[coded.indices.to_numpy()], count, new, afresh


def tokens_of_words(tokenizer, words: list[str], lead: str = "", together: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each word as the tokenizer gives them, end to end, and how many each has.

    Words stand `together` in one text, parted by spaces, which is less work; the tokens' places in it tell
    them apart. lead=" " is for tokenizers that take a space to the word after it. Words neither hold
    spaces nor, with a lead, end in white space or are empty.
    """
    groups = [words[i : i + together] for i in range(0, len(words), together)]
    flat, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    # What the tokenizer gives out is many times as large as the words, so it has a few groups at a time.
    found = (e for i in range(0, len(groups), GROUPS) for e in tokenizer.encode_batch([lead + " ".join(g) for g in groups[i : i + GROUPS]], add_special_tokens=False))
    for group, e in zip(groups, found, strict=True):
        size = np.fromiter(map(len, group), np.int64, len(group)) + 1
        begin = np.cumsum(size) - size
        places = np.fromiter((at for at, _ in e.offsets), np.int64, len(e.ids))
        flat.append(np.array(e.ids, np.int32))
        lengths.append(np.bincount(np.searchsorted(begin, places, side="right") - 1, minlength=len(group)))
    return np.concatenate(flat), np.concatenate(lengths)


def slices(texts: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, pa.Array]]:
    """(place of the first, texts): the texts in order, in slices of about `most` bytes, nulls as empty
    texts; a longer text comes alone."""
    texts = pc.fill_null(texts, "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield at, texts.slice(at, to - at)
        at = to
