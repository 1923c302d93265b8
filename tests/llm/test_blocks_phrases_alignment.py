"""Token blocks, phrases and alignment against the libraries, brute force and round trips."""

from __future__ import annotations

import hashlib
import random
import tempfile
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from barlab.llm import alignment, phrases, token_blocks, words
from barlab.llm.queries import QUERIES
from ..conftest import rows_of
from .test_operators import ODD, SCHEMA, SF, docs, empty, odd

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TRICKY = ["a", "a ", "a  ", " ", "  ", "   x", " x", "a\n b", "a\n  b  c", "foo▁bar ok", "é 中文 𝄞 z", "<|endoftext|> <s> </s> <unk>", "\x00\x01 \x1c q", "don't 's  ' s", "\t\t x  y", "  a", "x  y", "ΑΣ Σ", "é ́"]


# --- token blocks


def library_digest(rows, tokenizer=WORD_BPE, end=1):
    """What the contract asks for, one document after another."""
    t = Tokenizer.from_file(tokenizer)
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def digest(spark, frame, **options):
    path = tempfile.mkdtemp(prefix="spark-") + "/blocks"
    token_blocks.write_token_blocks(frame, WORD_BPE, path, **options)
    rows = token_blocks.block_digest(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    return path, sorted(map(tuple, rows), key=lambda r: r[1])


def test_blocks_of_all_documents_equal_the_library(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op11_token_blocks"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == library_digest([(r.doc_id, r.text) for r in table.collect()])


def test_documents_over_many_blocks_and_files(spark):
    texts = [*TRICKY, *ODD, "word " * 3000, "again and again " * 900]
    ids = random.Random(3).sample(range(-50, 50), len(texts))
    for options in ({"block_ids": 64, "lanes": 4, "file_bytes": 20_000}, {"block_ids": 1000, "lanes": 2}):
        _, got = digest(spark, docs(spark, texts, ids).repartition(5), **options)
        assert got == library_digest(zip(ids, texts))


def test_blocks_with_odd_rows(spark):
    # Null and repeated ids: rows of one id stand in some fixed order.
    rows = odd(spark).collect()
    _, got = digest(spark, odd(spark), block_ids=256, lanes=3)
    want = library_digest([(r.doc_id, r.text) for r in rows])
    assert Counter((d, n, c) for d, _, n, c in got) == Counter((d, n, c) for d, _, n, c in want)
    assert [g[0] for g in got] == [w[0] for w in want]
    starts = [0, *np.cumsum([n for _, _, n, _ in got])]
    assert [s for _, s, _, _ in got] == starts[:-1]
    assert digest(spark, empty(spark))[1] == []


def test_many_copies_of_one_row_are_dealt_over_files(spark):
    path, got = digest(spark, docs(spark, ["one and the same row " * 40] * 300, [7] * 300), file_bytes=50_000, block_ids=512, lanes=8)
    assert len(got) == 300 and {r[2:] for r in got} == {got[0][2:]}
    assert spark.read.parquet(path).select("file").distinct().count() > 1


def test_read_token_blocks_gives_ids(spark):
    path, _ = digest(spark, docs(spark, ["hello world", "", "more words here"]), block_ids=3, lanes=2)
    parts = sorted(token_blocks.read_token_blocks(spark, path).collect(), key=lambda r: (r.file, r.doc_no, r.block))
    t = Tokenizer.from_file(WORD_BPE)
    for doc, text in enumerate(["hello world", "", "more words here"]):
        assert [i for p in parts if p.doc_id == doc for i in p.ids] == t.encode(text, add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("alphabet", [2, 300, 49408])
def test_block_round_trip(alphabet):
    rng = np.random.default_rng(alphabet)
    blocks = [np.minimum(rng.zipf(1.3, n), alphabet) - 1 for n in (1, 2, 5, 700, 3000)]
    blocks += [np.zeros(2000, int), np.full(100, alphabet - 1), np.tile(rng.integers(0, alphabet, 40), 60), rng.integers(0, alphabet, 2500), np.arange(1500) % alphabet]
    coded = token_blocks.encode_blocks(blocks, alphabet)
    for block, back in zip(blocks, token_blocks.decode_blocks(coded), strict=True):
        assert np.array_equal(block, back)
    # A block is coded by itself, whatever stands beside it.
    assert [token_blocks.encode_blocks([b], alphabet)[0] for b in blocks] == coded
    assert len(coded[7]) < 2 * 40 + 16 + 200  # the repeated passage costs next to nothing


def test_damaged_blocks_are_found():
    block = np.random.default_rng(5).integers(0, 1000, 500)
    good = token_blocks.encode_blocks([block], 1000)[0]
    for place in (0, 5, 9, 13, 16, 40, 300):
        bad = bytearray(good)
        bad[place] ^= 0x11
        with pytest.raises(ValueError):
            token_blocks.decode_blocks([bytes(bad)])
    with pytest.raises(ValueError):
        token_blocks.decode_blocks([good[:200]])


def test_ids_that_cost_many_digits_and_large_alphabets():
    # Every id new: each costs more digits than the coder first has room for.
    most = token_blocks.MOST_IDS
    blocks = [np.random.default_rng(2).permutation(most)[:600], np.array([most - 1, 0, most - 1] * 50)]
    coded = token_blocks.encode_blocks(blocks, most)
    assert all(np.array_equal(x, y) for x, y in zip(blocks, token_blocks.decode_blocks(coded), strict=True))
    with pytest.raises(ValueError):
        token_blocks.encode_blocks(blocks, most + 1)
    with pytest.raises(ValueError):
        token_blocks.decode_blocks([token_blocks.HEADER.pack(token_blocks.MARK, most + 1, 5, 0) + bytes(20)])


def test_symbols_of_a_block_are_dealt_over_streams():
    # Whole blocks have several streams, which end at different steps; orders and literals alike come back.
    rng = np.random.default_rng(6)
    blocks = [np.minimum(rng.zipf(1.2, n), 5000) - 1 for n in (8192, 8191, 4097, 2817, 1, 3)] + [np.arange(8192) % 5000, np.tile(rng.integers(0, 5000, 100), 82)[:8190]]
    assert [token_blocks._streams(len(b)) for b in blocks] == [8, 7, 3, 2, 1, 1, 8, 7]
    for block, back in zip(blocks, token_blocks.decode_blocks(token_blocks.encode_blocks(blocks, 5000)), strict=True):
        assert np.array_equal(block, back)
    # Totals that take two digits a symbol.
    long = [np.minimum(rng.zipf(1.2, 1_500_000), 70_000) - 1]
    assert np.array_equal(long[0], token_blocks.decode_blocks(token_blocks.encode_blocks(long, 70_000))[0])


def test_followers_are_those_of_plain_loops():
    ids, hashes = np.random.default_rng(7).integers(0, 12, 3000), token_blocks._slots(12)
    one, two, want = {}, {}, []
    last, older = 0, 0
    for x in ids.tolist():
        at1, at2 = hashes[last] & token_blocks._MASK, (hashes[last] >> token_blocks.SLOT_BITS) ^ (hashes[older] & token_blocks._MASK)
        want.append(2 if two.get(at2, 0) == x else 1 if one.get(at1, 0) == x else 0)
        one[at1] = two[at2] = x
        last, older = x, last
    assert token_blocks._right(ids, hashes).tolist() == want


def test_any_digits_under_a_good_checksum_end_in_an_error():
    rng = np.random.default_rng(8)
    least = token_blocks.HEADER.size + token_blocks.SEAL.size
    good = token_blocks.encode_blocks([np.minimum(rng.zipf(1.3, 5000), 900) - 1], 900)[0]
    head, sizes = good[: token_blocks.HEADER.size], 2 * 2 * token_blocks._streams(5000)
    for cut in (0, 10, 11, 500, None):
        body = good[least : least + sizes] + rng.bytes(len(good) - least - sizes)[:cut]
        with pytest.raises(ValueError):
            token_blocks.decode_blocks([head + token_blocks.SEAL.pack(zlib.crc32(body, zlib.crc32(head))) + body])


def test_words_of_letters_have_the_library_s_tokens():
    model, t, rng = token_blocks.WordTokens(WORD_BPE), Tokenizer.from_file(WORD_BPE), random.Random(9)
    assert model.direct
    letters = [c for c in map(chr, range(0x41, 0x180)) if token_blocks._SINGLE.fullmatch(c)]
    words_ = [*letters, *["".join(rng.choices(letters if i % 2 else letters[:52], k=rng.randint(1, 20))) for i in range(3000)]]
    flat, length = model.tokens(words_)
    ends = np.cumsum(length)
    for word, lo, hi in zip(words_, ends - length, ends):
        assert flat[lo:hi].tolist() == t.encode(word, add_special_tokens=False).ids, word


@pytest.mark.parametrize("n", [1, 4, 5, 6, 10, 11, 999])
def test_passes_take_even_shares(n):
    shares = [s.stop - s.start for s in token_blocks.passes(n, 4)]
    assert sum(shares) == n and max(shares) <= 6 and (len(shares) == 1 or min(shares) >= max(shares) - len(shares))


def test_crc_of_parts():
    data = np.arange(1000, dtype="<u4")
    cuts = [0, 1, 400, 400, 999, 1000]
    parts = [{"n": hi - lo, "crc": zlib.crc32(data[lo:hi].tobytes())} for lo, hi in zip(cuts, cuts[1:])]
    assert token_blocks.joined_crc(parts) == zlib.crc32(data.tobytes())


def test_pieces_of_texts_have_the_library_s_tokens():
    import pyarrow as pa

    atoms = ["'", "''", "'s", "'t", "'VE", "s", "ll", "d", "1", "23", "Ab", "J", ".", "!?", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", "<", ">", "-", "_", "é", "Σ", "K", "İ", "中", "ſ", "½", "١"]
    atoms += ["\u030c", "\u0301", "\u0338", "\u0308", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2003"]
    rng = random.Random(4)
    texts = [*TRICKY, *["".join(rng.choices(atoms, k=rng.randint(0, 14))) for _ in range(5000)]]
    model, t = token_blocks.WordTokens(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    assert model.parted
    array = pa.array(["left out", *texts])[1:]
    flat, count = model.encode(array)
    ends = np.cumsum(count)
    for text, lo, hi in zip(texts, ends - count, ends):
        assert flat[lo:hi].tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
    got = token_blocks.pieces_of(pa.array(["New york, NEW York!", "", "don't stop"]), model.whole).to_pylist()
    assert got == [["new", "york", ",", "new", "york", "!"], [], ["don", "'t", "stop"]]
    assert token_blocks.pieces_of(pa.array([], pa.string()), model.whole).to_pylist() == []


def test_words_begin_afresh_when_memory_is_full():
    import pyarrow as pa
    import pyarrow.compute as pc

    w = words.Words(remember=3)
    first = w.of(pc.split_pattern(pa.array(["a b a", "c"]), " "))
    assert first[0].tolist() == [0, 1, 0, 2] and first[1].tolist() == [3, 1] and first[2] == ["a", "b", "c"] and not first[3]
    w.of(pc.split_pattern(pa.array(["d"]), " "))
    assert w.of(pc.split_pattern(pa.array(["d b"]), " "))[2:] == (["d", "b"], True)
    long = "x" * 999
    w = words.Words()
    assert w.of(pc.split_pattern(pa.array([long]), " "))[2] == [long] == w.of(pc.split_pattern(pa.array([long]), " "))[2]


# --- phrases


def phrases_by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, lang VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    r = con.execute(phrases.COLLOCATIONS_SQL)
    return rows_of([c[0] for c in r.description], r.fetchall())


def test_phrases_of_odd_texts(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(400):
        parts = [rng.choice(["New York", "new york City", "to be", "to be or", "a", "b", "İ ß", "漢字 x"]) + rng.choice([" ", "  ", "\t", ". ", "\n", "!", " ; "]) for _ in range(rng.randint(0, 30))]
        texts.append("".join(parts))
    texts += [*ODD, None, "a a a a a a a a a a a a", "same row", "same row"]
    rows = [(i % 350, rng.choice(["en", "de", None]), t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(*r, "s", 1, "clash", 0) for r in rows], "doc_id long, lang string, text string, phrase string, size int, k string, f int")
    got = phrases.collocations(frame.repartition(6))
    assert rows_of(got.columns, got.collect()) == phrases_by_sql(rows)
    assert got.filter("phrase = 'new york'").count() > 0
    assert phrases.collocations(frame.limit(0)).collect() == []


def phrase_rows():
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(40)]
    return [(i, rng.choice(["en", "language one", "language two", None]), " ".join(rng.choices(vocabulary, weights=range(1, 41), k=60))) for i in range(300)]


@pytest.mark.parametrize("bits", [3, 9, 60])
def test_each_phrase_is_named_once_and_shared_hashes_change_no_count(spark, monkeypatch, bits):
    made, named = [], phrases.named
    monkeypatch.setattr(phrases, "CHUNK_ROWS", 20)
    monkeypatch.setattr(phrases, "hash_mask", lambda size: np.uint64((1 << bits) - 1))
    monkeypatch.setattr(phrases, "named", lambda *x: made.append(named(*x).cache()) or made[0])
    rows = phrase_rows()
    got = phrases.collocations(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3))
    assert rows_of(got.columns, got.collect()) == phrases_by_sql(rows)
    phrase_rows_made = made[0].filter("size > 0")
    assert phrase_rows_made.count() == phrase_rows_made.select("lang", "size", "phrase").distinct().count() > 0


def test_counts_beyond_32_bits_are_packed():
    keys, counts = np.array([1, 9, 2**61], np.uint64), np.array([3, 2**40 + 1, 0])
    back = phrases.unpacked(phrases.packed(keys, counts), 3)
    assert np.array_equal(back[0], keys) and np.array_equal(back[1], counts)


def test_misra_gries_keeps_every_frequent_key():
    rng = np.random.default_rng(1)
    keys = np.concatenate((rng.integers(0, 50_000, 40_000), np.repeat(np.arange(100, 140), 10), np.repeat([7], 5000))).astype(np.uint64)
    rng.shuffle(keys)
    true = Counter(keys.tolist())
    threshold = 10
    summaries = []
    for part in np.array_split(keys, 13):
        s = phrases.MisraGries(len(keys) // threshold + 1)
        for piece in np.array_split(part, 3):
            s.add(*phrases.added(piece, np.ones(len(piece), np.int64)))
        summaries.append(s)
    total = summaries[0]
    for s in summaries[1:]:
        total.merge(s)
    assert len(total.keys) <= total.capacity
    held = dict(zip(total.keys.tolist(), total.counts.tolist()))
    assert all(k in held for k, n in true.items() if n >= threshold)
    assert all(n <= true[k] and true[k] - n <= len(keys) / (total.capacity + 1) for k, n in held.items())
    parts = []
    for part in np.array_split(keys, 13):
        k, n = phrases.added(part, np.ones(len(part), np.int64))
        parts.append((len(k), phrases.packed(k, n)))
        back = phrases.unpacked(*reversed(parts[-1]))
        assert np.array_equal(back[0], k) and np.array_equal(back[1], n)
    assert phrases.frequent_keys(parts, threshold).tolist() == sorted(k for k, n in true.items() if n >= threshold)


def test_scores_beyond_64_bits(spark):
    big = 10**14 + 7
    row = spark.createDataFrame([(big, big + 1, big + 3), (10, 10, 10), (3, 7, 11)], "a long, l long, r long")
    got = [r[0] for r in row.select(phrases.exact_score(*map(row.__getitem__, "alr"))).collect()]
    assert got == [10**6 * a * a // (x * y) for a, x, y in ((big, big + 1, big + 3), (10, 10, 10), (3, 7, 11))]


# --- alignment


def aligned_by_hand(texts):
    """The contract's columns, text by text, with the libraries on whole texts."""
    a, b = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    from barlab.llm.token_counts import byte_symbols

    value = {c: i for i, c in enumerate(byte_symbols())}
    name = {i: t for t, i in a.get_vocab(True).items()}
    raw_a = lambda i: b"<|endoftext|>" if i == 50256 else bytes(value[c] for c in name[i])
    raw_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for text in texts:
        if not text:
            found.append(None)
            continue
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
        spans = []
        for side, raw in zip(ids, (raw_a, raw_b)):
            at, mine = 0, []
            for i in side:
                at += len(raw(i))
                mine.append((at, i))
            spans.append(mine)
        if any(b"".join(map(raw, side)) != (" " + text).encode() for side, raw in zip(ids, (raw_a, raw_b))):
            found.append(None)
            continue
        ends_b = dict(spans[1])
        links = [(i, ends_b[at]) for at, i in spans[0] if at in ends_b]
        sides = []
        for side, other in ((spans[0], ends_b), (spans[1], dict(spans[0]))):
            mine = [[]]
            for at, i in side:
                mine[-1].append(str(i))
                if at in other:
                    mine.append([])
            sides.append([",".join(x) for x in mine if x])
        groups = ["|".join(x) for x in zip(*sides, strict=True)]
        counts.update(links)
        found.append((len(ids[0]), len(ids[1]), links, groups))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            links = f[2]
            out.append((f[0], f[1], len(f[3]), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(f[3]).encode()).hexdigest()))
    return out


def test_alignment_of_all_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], aligned_by_hand([r.text for r in rows])))
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_alignment"](spark, SF).select("doc_id", *alignment.ALIGNED).collect()}
    assert got == want


@pytest.mark.parametrize("limit", [1 << 21, 0])
def test_alignment_of_odd_texts(spark, limit):
    texts = [*TRICKY, *ODD, "plain words", "plain words", "x  ", *[f"shared start {i % 4}" for i in range(40)]]
    ids = [*range(len(texts) - 2), None, 3]
    got = alignment.align(docs(spark, texts, ids).repartition(4), BYTE_BPE, PIECES, broadcast_pairs=limit)
    want = [(i, *x) for i, x in zip(ids, aligned_by_hand(texts))]
    assert rows_of(got.columns, got.collect()) == rows_of(["doc_id", *alignment.ALIGNED], want)
    assert alignment.align(empty(spark), BYTE_BPE, PIECES, broadcast_pairs=limit).collect() == []


def test_groups_give_the_text_back(spark):
    texts = ["Hello there, world", "é 中文 𝄞 z", "a  b\n c", "", None]
    out = sorted(alignment.aligned_groups(docs(spark, texts), BYTE_BPE, PIECES).collect(), key=lambda r: (r.doc_id, r.group_no))
    for i, text in enumerate(texts):
        mine = [r for r in out if r.doc_id == i]
        assert b"".join(bytes(r.bytes) for r in mine) == ((" " + text).encode() if text else b"")
        assert all(r.a_ids and r.b_ids for r in mine)


def test_coalescing_and_overlaps_by_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        sides = []
        for _ in range(2):
            cuts = sorted(rng.sample(range(1, 30), rng.randint(0, 12)))
            edges = [0, *cuts, 30]
            sides.append(alignment.Tokens(np.arange(len(edges) - 1), np.array(edges[:-1]), np.array(edges[1:])))
        a, b = sides
        ga, gb, n = alignment.coalesced(a, b)
        common = sorted(set(a.end.tolist()) & set(b.end.tolist()))
        assert n == len(common)
        assert ga.tolist() == [sum(c <= s for c in common) for s in a.start.tolist()] and gb.tolist() == [sum(c <= s for c in common) for s in b.start.tolist()]
        pairs = {(i, j) for i in range(len(a.ids)) for j in range(len(b.ids)) if a.start[i] < b.end[j] and b.start[j] < a.end[i]}
        assert set(zip(*(x.tolist() for x in alignment.overlaps(a, b)))) == pairs
        assert all(ga[i] == gb[j] for i, j in pairs)


def test_tokenizer_has_few_words_at_a_time():
    class Watched:
        """The tokenizer, with the most groups that it was given at once."""

        def __init__(self, path):
            self.inner, self.most = Tokenizer.from_file(path), 0

        def encode_batch(self, texts, **options):
            self.most = max(self.most, len(texts))
            return self.inner.encode_batch(texts, **options)

    watched = Watched(public_tokenizers.path("word_bpe_49k.json"))
    made = [f"word{i}s" for i in range(3 * words.GROUPS * 64 + 5)]
    flat, lengths = words.tokens_of_words(watched, made)
    assert watched.most == words.GROUPS
    sample = [0, 63, 64, words.GROUPS * 64 - 1, words.GROUPS * 64, len(made) - 1]
    ends = lengths.cumsum()
    for i in sample:
        assert flat[ends[i] - lengths[i] : ends[i]].tolist() == watched.inner.encode(made[i], add_special_tokens=False).ids
