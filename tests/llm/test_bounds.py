"""Bounds of samples and groups, and arithmetic at sizes that small tables don't reach."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.llm import jaccard, neighbours, sharding, toxicity

from .test_operators import ODD, WORDS


def test_training_sample_is_bounded_in_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 300)
    monkeypatch.setattr(toxicity, "MAX_UNLABELLED", 900)
    ids = [i for i in range(9000) if crc32(str(i).encode()) % 3 != 1]
    hot = ids[0]
    # One toxic id on a third of all rows, each with a text of its own; and many copies of one clean row.
    rows = [(hot, f"vile words {i}") for i in range(3000)] + [(i, f"plain words {i}") for i in ids[1:3001]] + [(ids[5], "copy")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(hot, 1), *[(i, 0) for i in ids[1:400]]], "doc_id long, toxic int")
    sample, prior = toxicity.training_sample(docs, labels, "doc_id", "text")
    counts = {(r._positive, r._part): r["count"] for r in sample.groupBy("_positive", "_part").count().collect()}
    assert sum(n for (p, _), n in counts.items() if p) == 300 and sum(n for (p, _), n in counts.items() if not p) <= 900
    assert max(n for (p, _), n in counts.items() if p) < 150  # dealt over all parts
    assert prior == pytest.approx(max(0.01, 1 / 400))


def test_odd_texts_meet_a_fitted_model(spark):
    bad = "horridword nastyterm vileness"
    rows = [(i, f"{bad if i % 4 == 0 else 'pleasant'} {WORDS[i % 300]} {WORDS[i % 7]} text") for i in range(2000)]
    odd = [*ODD, f"{bad} " * 20_000, bad, bad]
    docs = spark.createDataFrame(rows + [(10_000 + i, t) for i, t in enumerate(odd)] + [(None, bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(2000) if i % 2 == 0], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    held = [r for k, r in got.items() if k is not None and k < 2000 and r.held_out]
    assert min(r.score for r in held if r.doc_id % 4 == 0) > max(r.score for r in held if r.doc_id % 4)
    assert all(r.predicted == (r.score >= 0.7) for r in got.values())
    same = lambda i: got[10_000 + i].score
    assert same(0) == same(1) == same(2) and same(len(odd) - 1) == same(len(odd) - 2) == got[None].score > 0.7 and same(len(odd) - 3) > 0.7


def test_nnpu_gradient_by_finite_differences():
    """One small step of the fit against the slope of the risk written as a plain loop."""
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(40)]
    positive = np.arange(40) < 12
    prior = 0.2

    def risk(w):
        plus, minus_p, minus_u = 0.0, 0.0, 0.0
        for r, p in zip(rows, positive):
            g = sum(w[i] for i in r) + w[-1]
            if p:
                plus += np.log1p(np.exp(-g)) / positive.sum()
                minus_p += np.log1p(np.exp(g)) / positive.sum()
            else:
                minus_u += np.log1p(np.exp(g)) / (~positive).sum()
        corrected = minus_u - prior * minus_p
        return (prior * plus + corrected) if corrected >= 0 else -corrected

    start = np.append(np.zeros(6), np.log(prior / (1 - prior)))
    slope = np.array([(risk(start + 1e-6 * e) - risk(start - 1e-6 * e)) / 2e-6 for e in np.eye(7)])
    # Adam's first step goes by the sign of the gradient.
    step = toxicity.fit_nnpu(rows, positive, 6, prior, steps=1, rate=1e-3, decay=0.0) - start
    clear = np.abs(slope) > 1e-6
    assert clear.any() and np.array_equal(np.sign(step[clear]), -np.sign(slope[clear]))
    fitted = toxicity.fit_nnpu(rows, positive, 6, prior)
    assert risk(fitted) < risk(start)


def test_large_sets_are_compared_in_whole_numbers(spark):
    # 671,089 common elements: 100 times that is no float32.
    common = 671_089
    elements = np.arange(common, dtype=np.int64)
    a = np.concatenate((elements, np.arange(10**7, 10**7 + 83_886)))
    # 100 * common >= 80 * union holds for the first pair and fails for the second by one element.
    most = common * 100 // 80 - len(a)
    groups = [(1, "yes", a, most), (2, "no", a, most + 1)]
    rows, members = [], []
    for group, _, x, more in groups:
        y = np.concatenate((elements, np.arange(2 * 10**7, 2 * 10**7 + more)))
        assert (100 * common >= 80 * (len(x) + len(y) - common)) == (group == 1)
        for k, s in ((10 * group, x), (10 * group + 1, y)):
            rows.append((k, s.tolist()))
            members.append((group, k))
    found = jaccard.block_links(spark.createDataFrame(members, "group long, key long"), spark.createDataFrame(rows, "key long, elements array<long>"))
    assert {tuple(sorted(r)) for r in found.collect()} == {(10, 11)}


def test_merging_in_levels(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CANDIDATE_ROWS", 8)
    monkeypatch.setattr(neighbours, "MERGED_LISTS", 2)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(200, 5)), 1)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in neighbours.nearest(frame, k=7).collect()}
    for q in range(0, 200, 20):
        order = sorted((i for i in range(200) if i != q), key=lambda i: (-float(np.cumsum(x[q] * x[i])[-1]), i))
        assert [got[q, r] for r in range(1, 8)] == order[:7]


def test_splitters_are_counted_like_bisect(spark):
    from bisect import bisect_right

    for splitters in ([], [5], [-(2**63), 0, 7, 7 + 2**40], list(range(-300, 300, 3)), [2**63 - 1]):
        keys = [-(2**63), -301, -300, -1, 0, 5, 6, 7, 8, 2**50, 2**63 - 2, 2**63 - 1]
        got = {r.k: r.n for r in spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding._count_below(F.col("k"), splitters).alias("n")).collect()}
        assert got == {k: bisect_right(splitters, k) for k in keys}


def test_signatures_without_a_second_set_are_left_out(spark, tmp_path):
    rng = np.random.default_rng(3)
    common = [" ".join(rng.choice(WORDS, 30)) for _ in range(6)]
    # Texts share passages, few are near copies: sets lose partners when the commonest signatures are left out.
    texts = [" ".join([*(common[j] for j in rng.choice(6, 3, replace=False)), *(f"w{i}x{j}" for j in range(40))]) for i in range(120)]
    texts += [t + " more" for t in texts[:5]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_id long, _text string")
    tables = jaccard.Intermediate(spark)
    try:
        rows = jaccard.candidate_signatures(tables.stored(jaccard.document_sets(docs)), tables).collect()
    finally:
        tables.clear()
    members = {}
    for r in rows:
        members.setdefault(r.token, set()).add(r.key)
    assert rows and min(map(len, members.values())) > 1
    keys = [jaccard.set_key(jaccard.shingle_set(t)) for t in texts]
    for i in range(5):
        assert any({keys[i], keys[120 + i]} <= m for m in members.values())
