"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

One pass over a word follows the automaton; at each position its output links name every piece
that ends there, and each relaxes the best way to reach the position. For unigram models the
best way has the highest sum of scores (Viterbi). BPE models have no sum to maximise: the way
to a position is the one whose last two pieces merging itself would leave side by side, which
is unique, so the same pass gives exactly the pieces that merging by rank gives.

The distinct words of a batch take the pass together: numpy arrays hold each word's node and best
steps, and one position of all words is relaxed at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import give_back, remembered

#: Fixed value: the symbol for a space inside pieces.
SPACE = "▁"
#: Encoded words that a Python worker remembers. A word is remembered when it comes in a second
#: batch; SEEN marks (by hash) tell which words have come.
REMEMBER_WORDS, SEEN = 100_000, 1 << 21
#: Slots of the table of pairs of pieces with their verdict (9 bytes each); cleared when 3/5 full.
PAIR_SLOTS = 1 << 20
#: Characters of text that are encoded together (a longer text comes alone), and of a word that
#: takes the pass by itself.
CHUNK_CHARS, LONG_WORD = 1 << 19, 64
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6


class Automaton:
    """Goto, failure and output links over the pieces' characters."""

    def __init__(self, pieces: dict[str, int]):
        self.goto: list[dict[str, int]] = [{}]
        self.piece, self.length = [-1], [0]
        for text, number in pieces.items():
            node = 0
            for c in text:
                nxt = self.goto[node].get(c)
                if nxt is None:
                    nxt = self.goto[node][c] = len(self.goto)
                    self.goto.append({})
                    self.piece.append(-1)
                    self.length.append(self.length[node] + 1)
                node = nxt
            self.piece[node] = number
        self.fail, self.output = [0] * len(self.goto), [0] * len(self.goto)
        queue = list(self.goto[0].values())
        for node in queue:  # breadth first: failure links of shorter prefixes are known
            back = self.fail[node]
            self.output[node] = back if self.piece[back] >= 0 else self.output[back]
            for c, nxt in self.goto[node].items():
                at = back
                while at and c not in self.goto[at]:
                    at = self.fail[at]
                self.fail[nxt] = self.goto[at].get(c, 0) if node else 0
                queue.append(nxt)
        # The matches at each node, longest first: the node's own piece and its output links.
        self.ends: list[tuple[tuple[int, int], ...]] = []
        for node in range(len(self.goto)):
            found, at = [], node if self.piece[node] >= 0 else self.output[node]
            while at:
                found.append((self.piece[at], self.length[at]))
                at = self.output[at]
            self.ends.append(tuple(found))
        # From here on transitions take up what following failures gives, as texts need it.
        self.moves = self.goto

    def move(self, node: int, c: str) -> int:
        """The node after reading c; remembered where it is not the root."""
        out = self.moves[node].get(c)
        if out is None:
            out = self.move(self.fail[node], c) if node else 0
            if out:
                self.moves[node][c] = out
        return out


class HashTable:
    """Values of 64-bit keys (not negative) by open addressing, looked up for whole arrays."""

    def __init__(self, slots: int, dtype: type = np.int32):
        self.mask, self.shift = slots - 1, np.uint64(64 - (slots - 1).bit_length())
        self.keys, self.values = np.full(slots, -1, np.int64), np.zeros(slots, dtype)
        self.used = 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, missing: int = -1) -> np.ndarray:
        at = self._home(keys)
        held = self.keys[at]
        hit = held == keys
        out = np.where(hit, self.values[at], missing)
        left = np.flatnonzero(~hit & (held >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            held = self.keys[at]
            hit = held == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (held >= 0)
            left, at = left[on], at[on]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Take up distinct keys that are not in the table; the caller keeps it from filling up."""
        at = self._home(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays
            done = self.keys[at] == keys
            self.values[at[done]] = values[done]
            self.used += int(done.sum())
            keys, values, at = keys[~done], values[~done], (at[~done] + 1) & self.mask

    def clear(self) -> None:
        self.keys.fill(-1)
        self.used = 0


class Pieces:
    """Encoder and decoder of the model file at `path`."""

    def __init__(self, path: str):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that keep their text as it is are supported")
        self.unigram = proto.trainer_spec.model_type == 1
        self.dummy_prefix = proto.normalizer_spec.add_dummy_prefix
        self.names = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        self.lone = min(self.scores) - 10.0  # of a character without a piece
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        plain = {CONTROL: b"", UNKNOWN: " ⁇ ".encode()}
        raw = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else plain.get(p.type, p.piece.encode()) for p in proto.pieces]
        self.raw, self.raw_length = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw])
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER_DEFINED)}
        self.automaton = a = Automaton(self.ids)
        # The same links as arrays, for many words at a time; characters are numbered from 1, 0 has no piece.
        letters = sorted(set("".join(self.ids)))
        self.letter = np.zeros(0x110000, np.uint16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.single = np.array([False] + [c in self.ids for c in letters])
        edges = [(node * len(self.single) + int(self.letter[ord(c)]), to) for node, moves in enumerate(a.goto) for c, to in moves.items()]
        self.edges = HashTable(1 << max(4, (4 * len(edges)).bit_length()))
        self.edges.add(*np.array(edges or np.zeros((0, 2)), np.int64).T)
        self.fail, self.output = np.array(a.fail, np.int32), np.array(a.output, np.int32)
        self.piece, self.length = np.array(a.piece, np.int32), np.array(a.length, np.int32)
        self.score = np.array(self.scores)
        # Text falls apart into words where no piece can reach over: before each run of spaces.
        apart = SPACE in self.ids and not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if apart else ".+", re.S)
        self.known: dict[str, int] = {}  # number of a remembered word
        self.kept, self.kept_end = np.zeros(0, np.int32), np.zeros(1, np.int64)  # their ids, end to end
        self.seen = bytearray(SEEN)
        self.pairs = HashTable(PAIR_SLOTS, np.int8)
        self.few: dict[int, bool] = {}  # of the pairs that long words met

    def merged(self, text: str) -> list[str]:
        """Plain BPE of a short text: the best-scored adjacent pair first, leftmost of equals."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best[0]):
                    best = (self.scores[piece], i)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def stays(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging leaves the two pieces side by side; after a character without a piece,
        or at the start (left is the number of pieces), whether it makes the right one alone."""
        size = len(self.names)
        keys = left.astype(np.int64) * (size + 1) + right
        found = self.pairs.get(keys)
        new = np.unique(keys[found < 0])
        if len(new):
            if self.pairs.used + len(new) > 0.6 * (self.pairs.mask + 1):
                self.pairs.clear()
            fits = []
            for key in new.tolist():
                before, piece = divmod(key, size + 1)
                both = [self.names[piece]] if before == size else [self.names[before], self.names[piece]]
                fits.append(self.merged("".join(both)) == both)
            if len(new) < 0.6 * (self.pairs.mask + 1):
                self.pairs.add(new, np.array(fits, np.int8))
            late = np.flatnonzero(found < 0)
            found[late] = np.array(fits, found.dtype)[np.searchsorted(new, keys[late])]
        return found > 0

    def spelled(self, c: str) -> tuple[int, ...]:
        """A character without a piece: its bytes, or the unknown piece (one for a run of them)."""
        return tuple(self.bytes[b] for b in c.encode("utf-8", "surrogatepass")) if self.bytes else (self.unknown,)

    def steps(self, word: str) -> list[tuple[int, int]]:
        """The (piece, length) steps of the best way through one long word, last first; the number of
        pieces stands for a character without one."""
        a, node = self.automaton, 0
        moves, ends, scores = a.moves, a.ends, self.scores
        size, unigram = len(self.names) + 1, self.unigram
        if len(self.few) > REMEMBER_WORDS:
            self.few.clear()
        pairs = self.few
        # Before the word stands the number size - 1; None marks a position that no way reaches.
        last: list[int | None] = [size - 1]
        length, best = [0], [0.0]
        for i, c in enumerate(word, 1):
            nxt = moves[node].get(c)
            node = a.move(node, c) if nxt is None else nxt
            step, far, top = None, 1, 0.0
            for piece, n in ends[node]:
                before = last[i - n]
                if before is None:
                    continue
                if unigram:
                    score = best[i - n] + scores[piece]
                    if step is None or score > top:
                        step, far, top = piece, n, score
                else:
                    fits = pairs.get(before * size + piece)
                    if fits is None:
                        fits = pairs[before * size + piece] = bool(self.stays(np.array([before]), np.array([piece]))[0])
                    if fits:
                        step, far = piece, n
                        break
            if step is None and last[i - 1] is not None and c not in self.ids:
                step, top = size - 1, best[i - 1] + self.lone
            last.append(step)
            length.append(far)
            best.append(top)
        out, at = [], len(word)
        while at:
            out.append((last[at], length[at]))
            at -= length[at]
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of distinct words, end to end, and how many each has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum(lengths) - lengths
        long = np.flatnonzero(lengths > LONG_WORD)
        short = np.flatnonzero(lengths <= LONG_WORD)
        short = short[np.argsort(-lengths[short], kind="stable")]  # the longest first
        row, step, letter = self.best_ways(self.letter[codes], starts[short], lengths[short])
        row = short[row]
        for i in long.tolist():
            way = self.steps(words[i])
            ends = lengths[i] - np.concatenate(([0], np.cumsum([n for _, n in way[:-1]]))).astype(np.int64)
            row, step, letter = np.append(row, np.full(len(way), i)), np.append(step, [p for p, _ in way]), np.append(letter, starts[i] + ends - 1)
        # Steps come last first: turn each word's round, and put words in their order.
        order = np.argsort(row, kind="stable")
        n_steps = np.bincount(row, minlength=len(words))
        first = np.cumsum(n_steps) - n_steps
        row, step, letter = row[order], step[order].astype(np.int64), letter[order]
        turned = first[row] + n_steps[row] - 1 - (np.arange(len(row)) - first[row])
        step[turned], letter[turned] = step.copy(), letter.copy()
        # A character without a piece gives its bytes: numbers beyond the pieces stand for them.
        lone = np.flatnonzero(step == len(self.names))
        kinds, kind = np.unique(codes[letter[lone]], return_inverse=True)
        spelled = [self.spelled(chr(c)) for c in kinds.tolist()]
        step[lone] += kind
        if not self.bytes:  # a run of such characters is one unknown piece
            run = lone[1:][(lone[1:] == lone[:-1] + 1) & (row[lone[1:]] == row[lone[:-1]])]
            step[run] = len(self.names) + len(spelled)
            spelled.append(())
        table = np.concatenate((np.arange(len(self.names)), *(np.array(x, np.int64) for x in spelled))).astype(np.int32)
        size = np.array([1] * len(self.names) + [len(x) for x in spelled])
        begin, size = (np.cumsum(size) - size)[step], size[step]
        upto = np.concatenate(([0], np.cumsum(size)))
        out = table[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
        return out, np.diff(upto[np.append(first, len(step))])

    def best_ways(self, letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The steps of the best ways through many words, each word's last step first: (word, piece, place of
        its last letter); the number of pieces stands for a character without one.

        Words come longest first, so those that reach position i are the first ones. last, far and
        top hold, position by position, the last piece of each word's best way to there, that
        piece's length, and the way's score.
        """
        n, longest = len(starts), int(lengths[0]) if len(lengths) else 0
        active = np.array([n, *(np.searchsorted(-lengths, -i, side="right") for i in range(1, longest + 1))])
        base = np.cumsum(active) - active
        last, far = np.full(active.sum(), -1, np.int32), np.zeros(active.sum(), np.int32)
        top = np.zeros(active.sum() if self.unigram else 0)
        last[:n] = len(self.names)
        node = np.zeros(n, np.int64)
        for i in range(1, longest + 1):
            m, here = active[i], base[i]
            letter = letters[starts[:m] + i - 1].astype(np.int64)
            node = self.moved(node[:m], letter)
            out = np.where(self.piece[node] >= 0, node, self.output[node])
            who = np.flatnonzero(out)
            out = out[who]
            while len(who):
                piece, length = self.piece[out], self.length[out]
                back = base[i - length] + who
                before = last[back]
                fits = before >= 0
                if self.unigram:
                    score = top[back] + self.score[piece]
                    fits &= (last[here + who] < 0) | (score > top[here + who])
                    top[here + who[fits]] = score[fits]
                else:
                    fits[fits] = self.stays(before[fits], piece[fits])
                last[here + who[fits]], far[here + who[fits]] = piece[fits], length[fits]
                out = self.output[out]
                on = (out > 0) if self.unigram else (out > 0) & ~fits  # one piece stays at most
                who, out = who[on], out[on]
            by_itself = np.flatnonzero((last[here : here + m] < 0) & ~self.single[letter] & (last[base[i - 1] : base[i - 1] + m] >= 0))
            last[here + by_itself], far[here + by_itself] = len(self.names), 1
            if self.unigram:
                top[here + by_itself] = top[base[i - 1] + by_itself] + self.lone
        who, at = np.arange(n), lengths.copy()
        rows, pieces, places = [who[:0]], [last[:0]], [who[:0]]
        while len(who):
            step = base[at] + who
            rows.append(who)
            pieces.append(last[step])
            places.append(starts[who] + at - 1)
            at = at - far[step]
            who, at = who[at > 0], at[at > 0]
        return np.concatenate(rows), np.concatenate(pieces), np.concatenate(places)

    def moved(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The nodes after reading one letter each, over failure links where there is no edge."""
        out = np.zeros(len(node), np.int64)
        left = np.arange(len(node))
        while len(left):
            to = self.edges.get(node[left] * len(self.single) + letter[left])
            out[left] = np.maximum(to, 0)
            left = left[(to < 0) & (node[left] > 0)]
            node = node.copy()
            node[left] = self.fail[node[left]]
        return out

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, end to end, and where each text's begin and end (one more than texts)."""
        parts: list[str] = []
        words = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts, 1):
            if text:
                plain = text.replace(" ", SPACE)
                parts += self.word.findall(SPACE + plain if self.dummy_prefix else plain)
            words[i] = len(parts)
        number = {w: i for i, w in enumerate(dict.fromkeys(parts))}
        which = np.fromiter(map(number.__getitem__, parts), np.int64, len(parts))
        distinct = list(number)
        held = np.fromiter((self.known.get(w, -1) for w in distinct), np.int64, len(distinct))
        new = [distinct[i] for i in np.flatnonzero(held < 0).tolist()]
        fresh, counts = self.encode_words(new)
        flat = np.concatenate((self.kept, fresh))
        ends = np.concatenate((self.kept_end, len(self.kept) + np.cumsum(counts)))
        held[held < 0] = len(self.known) + np.arange(len(new))
        begin, count = ends[held], np.diff(ends)[held]
        self._remember(new, fresh, counts)
        taken = count[which]
        upto = np.concatenate(([0], np.cumsum(taken)))
        values = flat[np.repeat(begin[which] - upto[:-1], taken) + np.arange(upto[-1])]
        return values, upto[words]

    def _remember(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Keep the pieces of words that came before."""
        if len(self.known) > REMEMBER_WORDS:
            self.known, self.kept, self.kept_end = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        again, seen = [], self.seen
        for i, word in enumerate(words):
            mark = hash(word) & (SEEN - 1)
            if not seen[mark]:
                seen[mark] = 1
            elif len(word) < LONG_WORD:
                again.append(i)
        if again:
            chosen = np.zeros(len(words), bool)
            chosen[again] = True
            self.known.update(zip([words[i] for i in again], range(len(self.known), len(self.known) + len(again)), strict=True))
            self.kept = np.concatenate((self.kept, ids[np.repeat(chosen, counts)]))
            self.kept_end = np.concatenate((self.kept_end, self.kept_end[-1] + np.cumsum(counts[again])))

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode_batch(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of the pieces ids[ends[i]:ends[i + 1]]; bytes that are no UTF-8 become replacement characters."""
        length = self.raw_length[ids]
        upto = np.concatenate(([0], np.cumsum(length)))
        data = self.raw[np.repeat(self.raw_start[ids] - upto[:-1], length) + np.arange(upto[-1])].tobytes()
        cuts = upto[ends].tolist()
        out = []
        for lo, hi in zip(cuts, cuts[1:]):
            text = data[lo:hi].decode("utf-8", "replace").replace(SPACE, " ")
            out.append(text[1:] if self.dummy_prefix and text.startswith(" ") else text)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_batch(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


def loaded(path: str) -> Pieces:
    """The model of the file at `path`, loaded once for a worker's tasks in a row."""
    return remembered(("pieces", path), lambda: Pieces(path))


def chunks(texts: pa.Array) -> Iterator[list[str]]:
    """The texts (null: empty) in order, in lists of about CHUNK_CHARS bytes; a longer text comes alone."""
    if not len(texts):
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + CHUNK_CHARS, side="right")))
        yield [t or "" for t in texts.slice(at, to - at).to_pylist()]
        at = to


def encode_pieces(docs: DataFrame, path: str, text_col: str = "text", out: str = "piece_ids") -> DataFrame:
    """Add the array of piece ids of each whole text (null and empty texts: an empty array).

    path names the model file, present on every executor. Texts of any length are encoded whole; a very
    long one takes memory in proportion to its length. All rows (repeated ones, null ids) and columns
    are kept, but for a column called like `out`, which is replaced; an empty table stays empty.
    """

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # A batch's ids take several times its texts' memory: they are given out chunk by chunk.
        model = loaded(path)
        for batch in batches:
            for texts in chunks(batch):
                ids, ends = model.encode_batch(texts)
                yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            give_back()

    return docs.withColumn(out, encode(F.col(text_col)))


def decode_pieces(encoded: DataFrame, path: str, ids_col: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """Add the text of each array of piece ids (null: the empty text)."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = loaded(path)
        for batch in batches:
            ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False))))
            ids = batch.flatten().to_numpy(zero_copy_only=False)
            yield pa.array(model.decode_batch(ids, ends.astype(np.int64)), pa.string())

    return encoded.withColumn(out, decode(F.col(ids_col)))


def piece_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_pieces, ids_sha256, exact): exact tells whether decoding gives back the whole text.

    Texts that hold the space symbol itself come back with a space in its place, as the library
    gives them, and are not exact. ids_sha256 is taken over the ids as little-endian 32-bit numbers.
    One row per row of docs: null texts count as empty (no ids), ids of any type stay as they are,
    null and repeated ones too; an empty table gives an empty result; other columns are ignored.
    """
    fields = [("n_pieces", pa.int64()), ("ids_sha256", pa.string()), ("exact", pa.bool_())]

    @F.arrow_udf("n_pieces long, ids_sha256 string, exact boolean")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # Ids are several times the texts' memory: they live for one chunk only.
        model = loaded(path)
        for batch in batches:
            rows: list[tuple[int, str, bool]] = []
            for texts in chunks(batch):
                ids, ends = model.encode_batch(texts)
                plain = ids.astype("<i4")
                back = model.decode_batch(ids, ends)
                rows += [(int(hi - lo), sha256(plain[lo:hi].tobytes()).hexdigest(), t == b) for lo, hi, t, b in zip(ends[:-1], ends[1:], texts, back, strict=True)]
            columns = zip(*rows, strict=True) if rows else [[], [], []]
            yield pa.StructArray.from_arrays([pa.array(list(c), kind) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])
            give_back()

    return docs.select(F.col(id_col), digest(F.col(text_col)).alias("_d")).select(id_col, "_d.n_pieces", "_d.ids_sha256", "_d.exact")
