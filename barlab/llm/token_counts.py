"""Token counts of byte-level BPE with word ends, by rank-synchronous array merging.

Distinct pre-tokens of a batch are held as one ragged numpy array of symbols. In each round
every sequence applies its lowest-ranked pair at all places at once; a sequence is finished
when it has no pair left, and its surviving symbols are its tokens. Merged symbols only occur
in later, higher-ranked merges, so rounds give what merging one pair at a time gives.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remembered

#: White space as the tokenizer's pattern engine knows it.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Characters of text that are split and looked up together.
CHUNK_CHARS = 1 << 21
#: Counts of distinct pre-tokens that a Python worker remembers before it starts afresh.
REMEMBER = 600_000
NO_PAIR = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in names]
    names |= {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class PairRanks:
    """Ranks and results of merges, looked up for whole arrays of pairs."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        key = np.array([(a << 17) | b for a, b, _ in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int32)
        self.result = np.array([c for *_, c in merges], np.int32)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.full(len(left), NO_PAIR, np.int32)
        key = (left.astype(np.int64) << 17) | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NO_PAIR)


def merged_lengths(symbols: np.ndarray, lengths: np.ndarray, pairs: PairRanks) -> np.ndarray:
    """Surviving symbols of each sequence; symbols holds them end to end, lengths are at least 1."""
    out = lengths.astype(np.int64).copy()
    who = np.arange(len(lengths))
    rank = np.full(len(symbols), NO_PAIR, np.int32)  # of the pair that begins here
    ends = np.cumsum(lengths)
    inner = np.ones(len(symbols), bool)
    inner[ends - 1] = False
    at = np.flatnonzero(inner)
    rank[at] = pairs.of(symbols[at], symbols[at + 1])
    while len(who):
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        lowest = np.minimum.reduceat(rank, starts)
        going = lowest < NO_PAIR
        if not going.all():
            out[who[~going]] = lengths[~going]
            keep = np.repeat(going, lengths)
            who, lengths, symbols, rank, lowest = who[going], lengths[going], symbols[keep], rank[keep], lowest[going]
            if not len(who):
                break
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        chosen = rank == np.repeat(lowest, lengths)
        # In a run of overlapping pairs (a a a) every second one counts, from the left.
        again = np.flatnonzero(chosen[1:] & chosen[:-1]) + 1
        if len(again):
            index = np.arange(len(chosen))
            fresh = chosen.copy()
            fresh[again] = False
            run = np.maximum.accumulate(np.where(fresh, index, 0))
            chosen &= (index - run) % 2 == 0
        first = np.flatnonzero(chosen)
        symbols = symbols.copy()
        symbols[first] = pairs.result[rank[first]]
        keep = np.ones(len(symbols), bool)
        keep[first + 1] = False
        lengths = lengths - np.add.reduceat(chosen, starts, dtype=np.int64)
        new = np.cumsum(keep)[first] - 1  # places of the merged symbols
        symbols, rank = symbols[keep], rank[keep]
        ends = np.zeros(len(symbols), bool)
        ends[np.cumsum(lengths) - 1] = True
        begins = np.zeros(len(symbols), bool)
        begins[np.cumsum(lengths) - lengths] = True
        rank[new[ends[new]]] = NO_PAIR
        stale = np.unique(np.concatenate((new[~ends[new]], new[~begins[new]] - 1)))
        rank[stale] = pairs.of(symbols[stale], symbols[stale + 1])
    return out


class WordBpe:
    """Counts tokens as the tokenizer file at `path` gives them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        suffix = spec["model"]["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.pairs = PairRanks([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        names = byte_symbols()
        self.inside = np.array([vocab[c] for c in names], np.int32)
        self.at_end = np.array([vocab[c + suffix] for c in names], np.int32)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        # The vocabulary's contractions.
        self.pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.known: dict[str, int] = {}

    def learn(self, words: list[str]) -> None:
        """Remember the counts of new pre-tokens, longest apart from the short ones."""
        data = [w.encode() for w in words]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b"".join(data), np.uint8)
        symbols = self.inside[raw]
        last = np.cumsum(lengths) - 1
        symbols[last] = self.at_end[raw[last]]
        self.known.update(zip(words, merged_lengths(symbols, lengths, self.pairs).tolist(), strict=True))

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of the text and the number of special strings in it."""
        found = 0
        if self.special is not None and "<|" in text:
            parts = self.special.split(text)
            found, parts = len(parts) - 1, [p for p in parts if p]
        else:
            parts = [text]
        words: list[str] = []
        for part in parts:
            plain = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
            words += self.pattern.findall(plain.lower())
        return words, found

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.split(t) for t in texts]
        if len(self.known) > REMEMBER:
            self.known.clear()
        new = set().union(*(w for w, _ in split)).difference(self.known) if split else set()
        if new:
            self.learn(sorted(new))
        get = self.known.__getitem__
        return [found + sum(map(get, words)) for words, found in split]


def loaded(path: str) -> WordBpe:
    """The vocabulary of the file at `path`, loaded once for a worker's tasks in a row."""
    return remembered(("word bpe", path), lambda: WordBpe(path))


def chunked(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """The texts in order, in lists of about `most` characters (a longer text comes alone)."""
    chunk, size = [], 0
    for t in texts:
        if chunk and size + len(t) > most:
            yield chunk
            chunk, size = [], 0
        chunk.append(t)
        size += len(t)
    if chunk:
        yield chunk


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id_col, n_bytes, n_tokens, over_limit).

    path names the tokenizer file, present on every executor (it belongs to an installed package).
    Whole texts are counted, without special tokens around them; special strings inside a text
    count 1 each. A null text counts as empty (0 tokens); null ids, repeated rows and empty tables
    pass through; other columns are ignored.
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = loaded(path)
        for batch in batches:
            out: list[int] = []
            for chunk in chunked([t or "" for t in batch.tolist()]):
                out += bpe.counts(chunk)
            yield pd.Series(out, dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
