"""The training-data operators against brute force, libraries and round trips, on small frames."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from barlab.llm import jaccard, mixing, neighbours, sentencepieces, sharding, syncmers, token_counts, toxicity, url_lists, warc
from ..conftest import rows_of

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, score double, _id string"
WORDS = [f"w{i}" for i in range(300)]
#: An id that no double can hold.
BIG = 2**53 + 1
ODD = ["", " \n\t ", None, "one", "Ünï 漢字 😀", "x" * 5000, "a b c d", "A B C D", "long " * 30000]


def docs(spark, texts, ids=None):
    """Documents with clashing extra columns, a null id and a repeated row."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, None, f"s{k % 3}" if k % 5 else None, None, 1, 2, 0.5, "z") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    return docs(spark, [*ODD, "one", "null id"], [*range(len(ODD)), 3, None])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def near_copies(n=60, seed=2):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = [rng.choice(WORDS) for _ in range(rng.choice([3, 5, 8, 30, 120, 400]))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            out.append(" ".join(copy) + rng.choice(["", " ", "\n"]))
    return out


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def test_toxicity_separates_held_out(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = toxicity.toxicity_scores(d, labels).toPandas()
    assert len(out) == d.count() and out.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    assert ((out.score >= 0.7) == (out.predicted == 1)).all()


def test_toxicity_learns_planted_words(spark):
    rng = random.Random(5)
    texts, toxic = [], []
    for i in range(1500):
        words = [rng.choice(WORDS) for _ in range(40)]
        bad = i % 7 == 0
        if bad:
            words[rng.randrange(40)] = rng.choice(["vileword", "nastyword"])
        texts.append(" ".join(words))
        toxic.append(bad)
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic) if i % 2], "doc_id long, toxic int")
    out = toxicity.toxicity_scores(docs(spark, texts), labels).toPandas().set_index("doc_id")
    held = out[out.held_out]
    truth = np.array(toxic)[held.index]
    assert (held.predicted[truth] == 1).mean() > 0.95 and (held.predicted[~truth] == 1).mean() < 0.02


def test_toxicity_odd_inputs(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    out = toxicity.toxicity_scores(odd(spark), none).toPandas()
    assert len(out) == len(ODD) + 2 and (out.score == 0).all()
    assert toxicity.toxicity_scores(empty(spark), none).count() == 0


def test_nnpu_risk_separates():
    rng = np.random.default_rng(0)
    rows = [np.array([0]) if i < 100 else np.array([0, 1]) if rng.random() < 0.1 else np.array([1]) for i in range(600)]
    w = toxicity.fit_nnpu(rows, np.arange(600) < 100, 2, 0.1)
    assert w[0] + w[-1] > 0.85 > 0 > w[1] + w[-1]


def test_token_counts_are_the_librarys(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(1)
    alphabet = "aA'sStTrReE 1٣²½ΣσςİıẞßéÉé̀\n\t\x1c\x85\xa0😀漢字한_-.!'ll've"
    texts = [*ODD, "<|endoftext|>x<|startoftext|>", "<|ENDOFTEXT|>"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    out = token_counts.token_counts(docs(spark, texts), path).toPandas().set_index("doc_id")
    assert out.n_tokens.to_dict() == {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert out.n_bytes.to_dict() == {i: len((t or "").encode()) for i, t in enumerate(texts)}
    assert token_counts.token_counts(empty(spark), path).count() == 0


def test_overlapping_pairs_merge_from_the_left():
    pairs = token_counts.PairRanks([(0, 0, 1)])
    assert token_counts.merged_lengths(np.zeros(5, np.int32), np.array([5]), pairs).tolist() == [3]


def test_pieces_are_the_librarys(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    texts = [*ODD, "<s>hello</s><0x41>", "a" * 2000] + ["".join(rng.choice("abcdeeetthhSTR    1²Σı漢字한\n\t\x00▁é😀") for _ in range(rng.randint(0, 50))) for _ in range(500)]
    enc = sentencepieces.encode_pieces(docs(spark, texts), path)
    out = sentencepieces.decode_pieces(enc, path).select("doc_id", "piece_ids", "decoded").collect()
    for r in out:
        ids = lib.encode(texts[r.doc_id] or "")
        assert list(r.piece_ids) == ids and r.decoded == lib.decode(ids)
    digest = sentencepieces.piece_digest(docs(spark, texts), path).toPandas().set_index("doc_id")
    assert digest.exact.to_dict() == {i: "▁" not in (t or "") for i, t in enumerate(texts)}
    assert sentencepieces.piece_digest(empty(spark), path).count() == 0


def unigram_model(folder, pieces):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type = 1
    for p, score in [("<unk>", 0.0), *pieces]:
        m.pieces.add(piece=p, score=score, type=2 if p == "<unk>" else 1)
    m.normalizer_spec.remove_extra_whitespaces = False
    path = folder / "unigram.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


def test_viterbi_finds_the_best_sum(tmp_path):
    path = unigram_model(tmp_path, [("▁", -1), ("a", -2), ("b", -2), ("ab", -5), ("ba", -1), ("aba", -2.5)])
    x = sentencepieces.Pieces(path)
    # The sums: aba b -4.5, a ba b -5, ab ab -10.
    assert [x.names[i] for i in x.encode("abab")] == ["▁", "aba", "b"]
    assert x.decode(x.encode("abab")) == "abab"


def test_viterbi_is_the_librarys_on_a_unigram_model(spark, tmp_path):
    rng = random.Random(14)
    names = {c: rng.uniform(-9, -6) for c in "▁abcdeé漢"}
    while len(names) < 400:
        names["".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))] = rng.uniform(-9, -3)
        names["▁" + "".join(rng.choice("abcde") for _ in range(rng.randint(1, 5)))] = rng.uniform(-9, -3)
    path = unigram_model(tmp_path, list(names.items()))
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["".join(rng.choice("aabbccdde   éx漢") for _ in range(rng.randint(0, 300))) for _ in range(300)] + ["abcde" * 400, "x" * 100, "", None, " "]
    out = sentencepieces.encode_pieces(docs(spark, texts), path).select("doc_id", "piece_ids").collect()
    for r in out:  # of equal sums either may come: compare the sums as well
        want, got = lib.encode(texts[r.doc_id] or ""), list(r.piece_ids)
        assert got == want or sum(lib.get_score(i) for i in got) == pytest.approx(sum(lib.get_score(i) for i in want), abs=1e-3)
    assert sum(list(r.piece_ids) == lib.encode(texts[r.doc_id] or "") for r in out) > 270


def test_piece_digest_is_of_the_librarys_ids(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*ODD, "word " * 3, "null id", "near", "nearer"]
    ids = [*range(len(ODD)), 3, None, BIG, BIG + 2]
    out = sentencepieces.piece_digest(docs(spark, texts, ids).coalesce(1), path).collect()
    want = [(i, len(e := lib.encode(t or "")), hashlib.sha256(np.array(e, "<i4").tobytes()).hexdigest(), lib.decode(e) == (t or "")) for i, t in zip(ids, texts, strict=True)]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_components_are_exact(spark):
    texts = [*near_copies(), *ODD, *ODD[:3]]
    want, sizes = brute_components(texts)
    out = jaccard.linked_components(docs(spark, texts)).toPandas().set_index("doc_id")
    assert out.component_id.to_dict() == dict(enumerate(want))
    assert out.n_shingles.to_dict() == dict(enumerate(sizes))


def test_large_groups_go_block_by_block(spark, monkeypatch):
    rng = random.Random(9)
    base = [rng.choice(WORDS) for _ in range(150)]
    texts = []
    for _ in range(120):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(150)] = rng.choice(WORDS)
        texts.append(" ".join(copy))
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    monkeypatch.setattr(jaccard, "SLICE_ELEMENTS", 64)
    want, _ = brute_components(texts)
    out = jaccard.linked_components(docs(spark, texts)).toPandas().set_index("doc_id")
    assert out.component_id.to_dict() == dict(enumerate(want))


def test_chained_group_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 64)
    rng = random.Random(19)
    words = [rng.choice(WORDS) for _ in range(120)]
    texts = []
    for i in range(150):  # each a small step from the one before: far ones have nothing in common
        words = list(words)
        words[(7 * i) % 120] = f"new{i}"
        texts.append(" ".join(words))
    out = jaccard.linked_components(docs(spark, texts).repartition(8)).toPandas()
    assert len(out) == 150 and (out.component_id == 0).all()


def test_component_ids_are_exact_and_null_ids_link(spark):
    rng = random.Random(20)
    base = [rng.choice(WORDS) for _ in range(200)]
    step = lambda n: " ".join(["x"] * n + base[n:])
    # BIG + 2 and BIG + 4 link only by the row without an id between them; one id stands on two texts.
    texts = [step(0), step(18), step(36), "other " * 3, step(120), step(120) + " end", "lone text of its own words", "y z"]
    ids = [BIG + 4, None, BIG + 2, None, 7, BIG, 7, BIG]
    want = {(BIG + 4, BIG + 2), (None, BIG + 2), (BIG + 2, BIG + 2), (None, None), (7, 7), (BIG, 7), (BIG, BIG)}
    out = jaccard.linked_components(docs(spark, texts, ids).coalesce(1)).collect()
    assert {(r.doc_id, r.component_id) for r in out} == want and len(out) == 8


def test_component_odd_inputs(spark):
    out = jaccard.linked_components(docs(spark, ["a b c d e f", "a b c d e f", "x"], [5, None, None])).toPandas()
    assert sorted(out.component_id.tolist(), key=str)[:2] == [5, 5]
    assert jaccard.linked_components(empty(spark)).count() == 0


def test_nearest_is_exact_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16)).astype(np.float32).tolist()
    x[40], x[60], x[41] = x[20], x[20], x[20]
    x[80], x[100], x[120], x[5] = None, [0.0] * 16, [float("nan")] * 16, [None] * 16
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, score string, rank int")
    out = neighbours.nearest(df).toPandas()
    good = {i: np.array(v, float) for i, v in enumerate(x) if i not in (80, 100, 120, 5)}
    for q in (i for i in good if i % 20 == 0):
        score = {i: float(np.cumsum(good[q] * v)[-1]) for i, v in good.items() if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:20]
        got = out[out.query_id == q].sort_values("rank")
        assert got.vec_id.tolist() == best and got.score.tolist() == [score[i] for i in best]
    assert set(out.query_id) == {i for i in good if i % 20 == 0}
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_nearest_of_huge_tiny_and_wide_vectors(spark):
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=(60, 8)) * 1e200, rng.normal(size=(60, 8)) * 1e-160, rng.normal(size=(60, 3000)), rng.integers(-1, 2, size=(60, 1500)) * 127.0):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
        out = neighbours.nearest(df).toPandas()
        for q in (0, 20, 40):
            with np.errstate(over="ignore", invalid="ignore"):
                score = {i: float(np.cumsum(x[q] * x[i])[-1]) for i in range(60) if i != q}
            best = sorted((i for i in score if score[i] == score[i]), key=lambda i: (-score[i], i))[:20]
            assert out[out.query_id == q].sort_values("rank").vec_id.tolist() == best


def test_derivatives_link_and_round_trip(spark, tmp_path):
    page = '<html lang="en"><head><title>T &amp; U</title><script>no()</script></head><body><p>One&nbsp;<b>two</b></p><!-- x --><a href="/y">z</a></body></html>'
    pages = spark.createDataFrame([(1, "http://a.example/", page), (2, None, None), (3, "http://b.example/", ""), (1, "http://a.example/", page)], "page_id long, url string, html string")
    responses = warc.responses_from_pages(pages)
    out = warc.build_derivatives(responses, keep=("page_id",)).toPandas()
    assert Counter(out.record_type) == {"metadata": 4, "conversion": 4}
    conv = out[(out.page_id == 1) & (out.record_type == "conversion")].iloc[0]
    assert conv.block == "T & U\nOne two\nz" and set(out.refers_to) == {r.record_id for r in responses.collect()}
    assert out.record_id.nunique() == 6 and conv.payload_digest == warc.digest(page.encode())
    records = warc.build_derivatives(responses)
    warc.write_warc(records, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).toPandas()
    key = ["record_id", "block", "source_headers", "block_digest"]
    assert sorted(map(tuple, back[key].values)) == sorted(map(tuple, records.toPandas()[key].values))


class PageText(HTMLParser):
    """The text, title, links and language of a page by the standard library's parser."""

    def __init__(self, page):
        super().__init__()
        self.parts, self.links, self.title, self.lang, self.hidden, self.inside = [], [], None, "", 0, False
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        self.hidden += tag in ("script", "style")
        if tag == "a" and "href" in attrs:
            self.links.append(attrs["href"])
        if tag == "html":
            self.lang = self.lang or attrs.get("lang", "").lower()
        if tag == "title" and self.title is None:
            self.title, self.inside = "", True
        self.parts.append("\n" if tag in warc._BREAKS else " " if tag in ("td", "th") else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")
        self.inside &= tag != "title"
        self.parts.append("\n" if tag in warc._BREAKS else " " if tag in ("td", "th") else "")

    def handle_data(self, data):
        if self.inside:
            self.title += data
        self.parts.append(" " if self.hidden else data)


def test_derivatives_of_all_pages_are_the_parsers(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    records = warc.build_derivatives(warc.responses_from_pages(pages), keep=("page_id",)).collect()
    of = {(r.page_id, r.record_type): r for r in records}
    for page_id, url, source in pages.select("page_id", "url", "html").collect():
        want = PageText(source or "")
        lines = [" ".join(x.split()) for x in "".join(want.parts).split("\n")]
        conv, meta = of[page_id, "conversion"], of[page_id, "metadata"]
        assert [" ".join(x.split()) for x in conv.block.split("\n") if x] == [x for x in lines if x]
        fields = [x.split(": ", 1) for x in meta.block.split("\r\n") if x]
        assert dict(fields)["title"] == " ".join((want.title or "").split()) and dict(fields)["declaredLanguage"] == want.lang
        assert [v for k, v in fields if k == "outlink"] == [" ".join(x.split()) for x in want.links if x.strip()]
        assert conv.target_uri == meta.target_uri == url and conv.refers_to == meta.refers_to
        assert conv.payload_digest == meta.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1((source or "").encode()).digest()).decode()
        assert conv.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(conv.block.encode()).digest()).decode()


def test_hostile_pages_take_linear_time():
    began = time.time()
    for part in ("<a ", "<title>", "<script ", "<!-- ", "<p ", "<html ", "</title ", "<a href = ", "<svg>", "&lt", "< "):
        for end in ("", ">", "<b>x</b>"):
            page = part * 100_000 + end
            warc.page_fields(page, warc.plain_text(page))
    assert time.time() - began < 60


def test_unclosed_parts_of_pages():
    assert warc.plain_text("a<script>b > c") == "a" and warc.plain_text("a<!-- b <p> c") == "a"
    assert warc.plain_text("a <b>c</b> < d > e <i") == "a c < d > e <i"
    assert warc.page_fields("<title>never closed <a href=x>", "")[0] == ("title", "")


def test_derivatives_of_odd_responses(spark, tmp_path):
    schema = "record_id string, target_uri string, record_date string, source_headers string, payload string, block string, _keep_page_id int, page_id long"
    rows = [("<r1>", "http://a/\r\nX: y", "d", "A: b | c\\n\r\nB: \n", "<p>x</p>" * 50_000, "z", 1, BIG), (None, None, None, None, None, None, None, None), ("<r3>", "", "", "", "", "", 3, 3)]
    responses = spark.createDataFrame([*rows, rows[2]], schema)
    out = warc.build_derivatives(responses, keep=("page_id",)).collect()
    assert len(out) == 8 and Counter(r.page_id for r in out) == {BIG: 2, None: 2, 3: 4}
    assert warc.build_derivatives(responses.limit(0)).count() == 0
    records = warc.build_derivatives(responses)
    warc.write_warc(records, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    show = lambda r: (r.record_type, r.record_id, r.target_uri.replace("\r\n", "%0D%0A"), r.source_headers, r.block_digest, r.block)
    assert sorted(map(show, back)) == sorted(map(show, records.collect()))


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    texts = [" ".join(["w"] * rng.randint(0, 60)) for _ in range(600)] + [None, "  "]
    d = docs(spark, texts)
    out = mixing.mix_sources(d).toPandas()
    assert len(out) == len(texts) and (out["taken"] <= 3 * out["size"]).all()
    sums = out.groupby(["source_size", "target"])["taken"].sum().reset_index()
    assert (abs(sums["taken"] - sums["target"]) <= 0.5).all()
    assert out["size"].sum() == pytest.approx(sums["target"].sum())
    again = mixing.mix_sources(d.repartition(5)).toPandas()
    assert sorted(map(str, out.values.tolist())) == sorted(map(str, again.values.tolist()))
    assert mixing.mix_sources(empty(spark)).count() == 0


def brute_schedule(targets, n_slots):
    """Source of each slot, by comparing every point with every edge."""
    bits = max(1, (n_slots - 1).bit_length())
    edges = [0]
    for i in range(len(targets)):
        edges.append(math.ceil(sum(targets[: i + 1]) / sum(targets) * 2**bits))
    point = lambda t: int(format(t, f"0{bits}b")[::-1], 2)
    return [next(i for i in range(len(targets)) if edges[i] <= point(t) < edges[i + 1]) for t in range(n_slots)]


def test_slots_are_ranked_by_arithmetic(spark):
    for weights, n in (([5.0, 2.0, 1.0, 0.01], 700), ([1.0], 1), ([3.0, 3.0], 64), ([0.2, 900.0, 7.0], 1500)):
        frame = spark.createDataFrame([(i + 1, w * 100) for i, w in enumerate(weights)], "_src int, target double")
        sources = mixing.source_slots(frame, n)
        got = sorted((r.slot, r._src, r._r) for r in mixing.slot_schedule(sources, n).collect())
        seen, want = Counter(), []
        for t, src in enumerate(brute_schedule([w * 100 for w in weights], n)):
            want.append((t, src + 1, seen[src]))
            seen[src] += 1
        limit = {r._src: r._slots for r in sources.collect()}
        assert [x for x in got if seen[x[1] - 1]] == [x for x in want if x[2] < limit[x[1]]]
        assert {x[1] for x in got} == set(range(1, len(weights) + 1))  # a source that no point meets has its slot


def test_tiny_sources_stay_in_the_mix(spark):
    texts = ["big " * 500] * 400 + ["a few words of a small source"] * 5 + ["one"]
    sources = ["huge"] * 400 + [f"tiny{i}" for i in range(5)] + ["z"]
    d = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(zip(texts, sources, strict=True))], "doc_id long, text string, source string")
    out = mixing.mix_sources(d).toPandas()
    sums = out.groupby("source_size").agg(taken=("taken", "sum"), n=("taken", "size")).reset_index()
    assert out[out["size"] == 7].taken.tolist() == [21] * 5 and out[out["size"] == 1].taken.tolist() == [3]
    assert abs(out[out["size"] == 500].taken.sum() - out[out["size"] == 500].target.iloc[0]) <= 0.5 and len(sums) == 3


def test_mix_of_repeated_rows_and_odd_texts(spark, oracle):
    rows = [(7, "same row again", "a")] * 400 + [(None, "no id", "a")] * 50 + [(i, t, None) for i, t in enumerate(ODD)] + [(1, "x", "b"), (1, "y y", "b"), (1, "x", "b")]
    d = spark.createDataFrame([(*r, 1, 2.0, "q") for r in rows], "doc_id long, text string, source string, size int, target double, _key string")
    out = mixing.mix_sources(d).drop("first_slot").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = con.sql(mixing.MIX_SQL)
    assert rows_of(["doc_id", "size", "source_size", "target", "taken"], out) == rows_of(want.columns, want.fetchall())


def brute_sketch(text):
    """Anchors of a text, character by character."""
    c = [ord(x) for x in text]
    spread = lambda x: int(syncmers.mix(np.array([x % 2**64], np.uint64))[0])
    h = [spread(sum(f * x for f, x in zip(syncmers.FACTORS, c[i : i + 5], strict=True))) for i in range(len(c) - 4)]
    first = {}
    n = 0
    for i in range(len(c) - 11):
        if min(h[i : i + 8]) in (h[i], h[i + 7]):
            n += 1
            first.setdefault(spread(h[i] * 3 + h[i + 4] * 5 + h[i + 7] * 7) >> 32, i)
    if text and not n:
        return {int(hashlib.sha256(text.encode()).hexdigest()[:8], 16): 0}
    return dict(sorted(first.items())[: max(48, n // 128)])


def brute_likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    bound = min([max(x) for x in (a, b) if len(x) >= 48], default=2**32)
    a, b = ({h: p for h, p in x.items() if h <= bound} for x in (a, b))
    pairs = sorted((a[h], b[h]) for h in a if h in b)
    best = []
    for i, (_, y) in enumerate(pairs):
        best.append(1 + max([best[j] for j in range(i) if pairs[j][1] <= y], default=0))
    return max(best, default=0) / len(a.keys() | b.keys())


def test_fingerprints_are_the_brute_force_ones(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 120))) for _ in range(40)] + [t for t in ODD if len(t or "") < 9000] + ["copy of a row, met often"] * 9 + ["", "tie", None]
    ids = [*range(len(texts) - 12 - 5), *[None] * 5, *[BIG] * 4, *[None] * 5, BIG, BIG, BIG + 2]
    d = docs(spark, texts, ids)
    out = syncmers.fingerprint_edits(d).collect()
    hashes = {r.t: r.h for r in d.selectExpr("coalesce(text, '') AS t", "xxhash64(coalesce(text, '')) AS h").collect()}
    rows = sorted(zip(ids, ((t or "") for t in texts), strict=True), key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        a, b, c = map(brute_sketch, (t, edited, following))
        show = lambda s: "".join(f"{h:08x}{p:08x}" for h, p in s.items())
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(b), brute_likeness(a, b), brute_likeness(a, c)))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert syncmers.fingerprint_edits(odd(spark)).count() == len(ODD) + 2 and syncmers.fingerprint_edits(empty(spark)).count() == 0


def test_ranges_of_neighbours_split_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 4)
    rng = random.Random(16)
    texts = [f"text {rng.random()}" for _ in range(200)]
    ids = [None] * 70 + [5] * 60 + [BIG + i for i in range(70)]
    d = docs(spark, texts, ids)
    out = syncmers.fingerprint_edits(d).collect()
    hashes = {r.text: r.h for r in d.selectExpr("text", "xxhash64(text) AS h").collect()}
    rows = sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = [(i, hashlib.sha256(syncmers.edited_text(t, rows[(k + 1) % 200][1]).encode()).hexdigest()) for k, (i, t) in enumerate(rows)]
    assert sorted(((r.doc_id, r.edited_sha256) for r in out), key=str) == sorted(want, key=str)
    order, _ = syncmers.with_neighbours(d, "doc_id", "text")
    assert max(r["count"] for r in order.groupBy("_range").count().collect()) < 40


def test_places_of_long_texts_are_exact():
    rng = random.Random(17)
    parts = ["".join(rng.choice("abcdefghij ") for _ in range(40_000)) for _ in range(16)]
    turned = parts[:8] + parts[8:][::-1]
    a, b = syncmers.sketch("".join(parts)), syncmers.sketch("".join(turned))
    assert syncmers.likeness(a, syncmers.read(syncmers.written(a))) == 1 and syncmers.likeness(a, b) < 0.75
    assert len(a) > 5 * syncmers.ANCHORS


def test_texts_without_syncmers_are_told_apart(spark):
    rng = random.Random(12)
    texts = ["Withthesones |", "The esingor.", "Reouti anatha."] + ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in range(12, 19) for _ in range(40)]
    bare = [t for t in texts if not len(syncmers.closed_syncmers(np.frombuffer(t.encode("utf-32-le"), np.uint32))[0])]
    assert set(texts[:3]) <= set(bare) and len({*bare}) == len(bare) > 20
    prints = [syncmers.sketch(t) for t in bare]
    assert all(prints) and len({syncmers.written(p) for p in prints}) == len(bare)
    assert all(syncmers.likeness(a, b) == (i == j) for i, a in enumerate(prints) for j, b in enumerate(prints)) and syncmers.likeness(prints[0], []) == 0
    out = syncmers.fingerprint_edits(docs(spark, [bare[0], "", bare[1], bare[2]])).toPandas().set_index("doc_id")
    assert out.near_next.to_dict() == {0: 0, 1: 0, 2: 0, 3: 0} and (out.fingerprint != "").to_dict() == {0: True, 1: False, 2: True, 3: True}


def test_closed_syncmers_by_definition():
    codes = np.frombuffer("the quick brown fox jumps over the lazy dog again".encode("utf-32-le"), np.uint32)
    c = [int(x) for x in codes]
    smer = [int(syncmers.mix(np.array([sum(f * x for f, x in zip(syncmers.FACTORS, c[i : i + 5], strict=True)) % 2**64], np.uint64))[0]) for i in range(len(c) - 4)]
    want = [i for i in range(len(c) - 11) if min(smer[i : i + 8]) in (smer[i], smer[i + 7])]
    assert syncmers.closed_syncmers(codes)[0].tolist() == want


def test_shards_are_even_and_gapless(spark):
    rng = random.Random(8)
    texts = [" ".join(["word"] * rng.randint(0, 90)) + str(rng.random()) for _ in range(3000)] + ["same text of a hot group " * 5] * 1500
    out = sharding.shard_by_bytes(docs(spark, texts)).toPandas()
    size = out.groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() < 1.1 * size.mean()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    crc = {i: zlib.crc32(t.encode()) for i, t in enumerate(texts)}
    assert out.set_index("doc_id").text_crc32.to_dict() == crc
    assert sharding.shard_by_bytes(odd(spark)).count() == len(ODD) + 2 and sharding.shard_by_bytes(empty(spark)).count() == 0


def shards_of(out, n=8):
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    return out.groupby("shard")["size"].sum().reindex(range(n), fill_value=0)


def test_shards_hold_their_law_for_repeated_rows(spark):
    # One text under null ids, under one id, or as wholly repeated rows: still near equal bytes.
    for ids in ([None] * 4000, [7] * 4000, list(range(4000))):
        out = sharding.shard_by_bytes(docs(spark, ["the same text of all rows"] * 4000, ids)).toPandas()
        size = shards_of(out)
        assert len(out) == 4000 and size.max() < 1.1 * size.mean() and size.min() > 0.9 * size.mean()


def test_shards_keep_groups_whole_where_they_fit(spark):
    rng = random.Random(18)
    groups = {f"group {k} " * 9: n for k, n in enumerate([900, 700, 500, 300, 200, 90, 40])}
    texts = [t for t, n in groups.items() for _ in range(n)] + [str(rng.random()) * rng.randint(1, 20) for _ in range(9000)]
    out = sharding.shard_by_bytes(docs(spark, texts, [None if i % 3 else i for i in range(len(texts))])).toPandas()
    size = shards_of(out)
    assert size.max() < 1.06 * size.mean() and size.min() > 0.94 * size.mean()
    assert (out.groupby("text_crc32")["shard"].nunique() == 1).all()


def test_heavy_keys_are_placed_by_room():
    assert sharding.place_heavy({1: 50, 2: 60, 3: 99, 4: 10}, 800, 8) == {3: 0, 2: 1, 1: 2, 4: 3}
    assert sharding.place_heavy({1: 150}, 800, 8) == {}
    assert sharding.cut_into_shards([(0, 40), (1, 60), (2, 60), (4, 40)], {1: 1}, 200, 2) == [0, 1, 0, 1]


def test_lists_hold_from_day_to_day(spark):
    import datetime as dt

    day = lambda m, x: dt.date(2023, m, x)
    entries = spark.createDataFrame([("l", "Bad.example", day(1, 10), "add", "spam"), ("l", "bad.example", day(3, 1), "remove", None), ("l", "ok.example/a", day(1, 1), "add", "adult"), ("l", None, day(1, 1), "add", "x")], "list_name string, pattern string, effective date, action string, category string")
    captures = spark.createDataFrame(
        [(1, "http://www.bad.example/x", day(1, 9)), (2, "http://www.bad.example/x", day(1, 10)), (3, "https://BAD.example:8/", day(2, 28)), (4, "http://bad.example", day(3, 1)), (5, "http://ok.example/a/b?q", day(5, 5)), (6, "http://ok.example/b", day(5, 5)), (7, None, day(1, 15)), (8, "junk", None), (2, "http://www.bad.example/x", day(1, 10))],
        "page_id long, url string, fetched date",
    )
    out = url_lists.judge_captures(captures, entries).toPandas()
    assert len(out) == 9 and set(out[out.blocked].page_id) == {2, 3, 5}
    assert url_lists.judge_captures(captures.limit(0), entries).count() == 0


def test_lists_hold_at_any_depth_and_case(spark):
    import datetime as dt
    from urllib.parse import urlsplit

    rng = random.Random(10)
    path = lambda n: "".join("/" + rng.choice("aAbB") for _ in range(n))
    day = lambda: dt.date(2023, rng.randint(1, 6), rng.randint(1, 28))
    host = lambda: rng.choice(["Bad.example", "bad.example", "BAD.EXAMPLE", "ok.example", "www.ok.example"])
    listed = [("l", host() + path(rng.choice([0, 1, 1, 2, 3, 3, 5, 8])), day(), rng.choice(["add", "add", "remove"]), "spam") for _ in range(60)]
    listed += [("m", "Bad.example", dt.date(2023, 1, 1), "add", "spam"), ("m", "bad.example", dt.date(2023, 3, 1), "remove", None), ("m", "ok.example/A/b/C/d", dt.date(2023, 1, 1), "add", "adult")]
    fetched = [(i, f"http://{host()}{path(rng.randint(0, 9))}?q", day()) for i in range(300)] + [(300, "http://OK.example/A/b/C/d/e", dt.date(2023, 2, 2)), (301, "http://ok.example/a/b/c/d", dt.date(2023, 2, 2))]
    last: dict = {}
    for name, pattern, when, action, _ in listed:
        at, slash, rest = pattern.partition("/")
        key = (name, at.lower() + slash + rest)
        last.setdefault(key, {}).setdefault(when, set()).add(action)
    want = {}
    for i, url, when in fetched:
        u = urlsplit(url)
        whole = u.netloc.lower() + u.path
        n = 0
        for (_, pattern), days in last.items():
            over = whole == pattern or whole.startswith(pattern + "/") or ("/" not in pattern and u.netloc.lower().endswith("." + pattern))
            past = [d for d in days if d <= when]
            n += over and bool(past) and "remove" not in days[max(past)]
        want[i] = n
    entries = spark.createDataFrame(listed, "list_name string, pattern string, effective date, action string, category string")
    captures = spark.createDataFrame(fetched, "page_id long, url string, fetched date")
    out = url_lists.judge_captures(captures, entries).toPandas().set_index("page_id")
    assert out.n_active.to_dict() == want and 0 < sum(map(bool, want.values())) < len(want)
    assert "ok.example/A/b/C/d" in set(out.pattern)


def test_lists_odd_captures(spark):
    import datetime as dt

    rows = [(1, "http://bad.example/" + "a/" * 20_000, dt.date(2023, 2, 1), "x"), (None, "http://bad.example/", dt.date(2023, 2, 1), "y"), (None, None, None, None), (1, "", None, "z")] * 2
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched date, pattern string")
    entries = spark.createDataFrame([("l", "bad.example", dt.date(2023, 1, 1), "add", "spam", 1)] * 3, "list_name string, pattern string, effective date, action string, category string, _id int")
    out = url_lists.judge_captures(captures, entries).toPandas()
    assert len(out) == 8 and out.blocked.sum() == 4 and set(out[out.blocked].n_active) == {1}
    assert not url_lists.judge_captures(captures, entries.limit(0)).filter("blocked").count()
    assert url_lists.entries_from_pages(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in p.STAGES:
        out = stage(spark, d, SF)
        if name != p.STAGES[-1][0]:
            assert set(out.columns) == set(p.COLUMNS)
        d = out.limit(60) if name == "toxicity" else out
    assert "piece_ids" in d.columns and d.count() > 0


def test_pipeline_is_the_brute_force_one(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(21)
    texts, toxic = [], []
    for i in range(700):
        words = [rng.choice(WORDS) for _ in range(20 + i % 60)]
        if i % 7 == 0:
            words[rng.randrange(20)] = rng.choice(["vileword", "nastyword"])
        texts.append(" ".join(words))
        toxic.append(int(i % 7 == 0))
    ids = [None if i % 3 == 0 else i - 1 if i % 10 == 1 else i for i in range(700)]  # a third without an id, some ids on two texts
    for i in (0, 3, 7, 8, 10, 11, 12, 700, 700):  # copies of rows, and copies under other ids
        texts.append(texts[i] if i < 700 else texts[-1])
        ids.append([ids[i], None, 5][i % 3] if i < 700 else ids[-1])
    texts += ["", " ", None, "", ""]
    ids += [None, 900, 901, None, None]
    rows = [(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    rows += [rows[4], rows[4], rows[6]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, t) for i, t in zip(ids, toxic) if i is not None and i % 10], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = p.run(spark, str(tmp_path)).select("doc_id", "text", "source").collect()

    model = toxicity.train(d, labels)
    clean = [r for r in rows if model.score(r[1]) < 0.7]
    assert sum(r[0] is None for r in rows) - sum(r[0] is None for r in clean) > 20
    root, sizes = brute_components([r[1] for r in clean])
    best = {}
    for k, r in enumerate(clean):
        if sizes[k]:
            mine = (r[0] is None, r[0] or 0, k)
            best[root[k]] = min(best.get(root[k], mine), mine)
    kept = [r for k, r in enumerate(clean) if not sizes[k] or best[root[k]][2] == k]
    assert len(kept) < len(clean)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", kept)
    words = lambda t: len((t or "").split())
    want = Counter()
    for doc_id, size, _, _, taken in con.execute(mixing.MIX_SQL).fetchall():
        want[doc_id, size] += 1 if size == 0 else int(taken / size + 0.5)
    assert Counter((r.doc_id, words(r.text)) for r in out) == +want
    assert {(r.doc_id, r.text, r.source) for r in out} <= {(r[0], r[1], r[3]) for r in kept}
    assert sum(n for (i, _), n in want.items() if i is None) > 100
