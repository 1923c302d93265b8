"""Toxicity scores by non-negative positive-unlabelled (nnPU) learning.

Only confirmed toxic documents and unlabelled text are used. With the class prior pi, the
risk of calling unlabelled text clean is corrected by the share that toxic text has in it:

    pi * E_P[l(+g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)])

Linear numpy classifiers on the presence of words and word beginnings are fitted to overlapping
parts of a bounded sample, one Spark task each; a document's score is their mean probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, give_back, stored

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of a word's beginnings that make features of their own.
BEGINNINGS = (5, 6, 7, 8)
#: Bounds of the training sample in rows: confirmed toxic documents, unlabelled documents.
MAX_POSITIVE, MAX_UNLABELLED = 4000, 12000
#: Ids of confirmed toxic documents are broadcast (8 bytes each) up to this many.
MAX_IDS = 1 << 20
#: Classifiers, each fitted to the sample without one part.
MEMBERS = 4
#: Features kept: those that toxic documents have most surely more often than text at large.
MAX_FEATURES = 4096
MIN_POSITIVE_DOCS = 4
#: Least gain in log likelihood: by chance it is reached by about one feature in e ** 10.
MIN_GAIN = 10.0
#: Words that a Python worker remembers the features of.
REMEMBER = 200_000


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 1 on division by 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def features_of(word: str) -> tuple[int, ...]:
    """Hashes of a lower-case word and of its beginnings."""
    return (crc32(word.encode()), *(crc32(b"^" + word[:n].encode()) for n in BEGINNINGS if len(word) > n))


def text_features(text: str | None) -> np.ndarray:
    """The distinct features of a whole text, sorted."""
    found: set[int] = set()
    for word in set(WORD.findall((text or "").lower())):
        found.update(features_of(word))
    return np.sort(np.fromiter(found, np.int64, len(found)))


def fit_nnpu(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float, steps: int = 2000, rate: float = 0.05, decay: float = 1e-5) -> np.ndarray:
    """Weights and, last, the bias of a linear classifier with logistic loss under the nnPU risk.

    rows: each document's feature numbers. Full-batch Adam; where the corrected risk of the
    unlabelled part is negative the step follows its negated gradient, as nnPU prescribes.
    """
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    who = np.repeat(np.arange(len(rows)), lengths)
    positive = positive.astype(bool)
    n_pos, n_unl = max(1, positive.sum()), max(1, (~positive).sum())
    w = np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        g = np.bincount(who, w[flat], len(rows)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
        loss_clean = np.logaddexp(0, g)  # l(-g)
        negative_risk = loss_clean[~positive].sum() / n_unl - prior * loss_clean[positive].sum() / n_pos
        slope = np.zeros(len(rows))
        slope[~positive] = p[~positive] / n_unl
        slope[positive] = -prior * p[positive] / n_pos
        if negative_risk < 0:
            slope = -slope
        else:
            slope[positive] += prior * (p[positive] - 1) / n_pos
        grad = np.append(np.bincount(flat, slope[who], n_features), slope.sum()) + decay * np.append(w[:-1], 0)
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w


class Model:
    """Selected features and each member's weights; small, shipped with the scoring tasks."""

    def __init__(self, features: list[int], weights: np.ndarray):
        self.place = {f: i for i, f in enumerate(features)}
        self.weights = weights
        self.words: dict[str, tuple[int, ...]] = {}

    def score(self, text: str | None) -> float:
        if not len(self.weights):
            return 0.0
        found: set[int] = set()
        known = self.words
        for word in set(WORD.findall((text or "").lower())):
            at = known.get(word)
            if at is None:
                if len(known) > REMEMBER:
                    known.clear()
                at = known[word] = tuple(self.place[f] for f in features_of(word) if f in self.place)
            if at:
                found.update(at)
        g = self.weights[:, sorted(found)].sum(axis=1) + self.weights[:, -1]
        return float((1 / (1 + np.exp(-np.clip(g, -40, 40)))).mean())


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, float]:
    """(_part, _positive, _features) of the bounded sample, and the class prior.

    A document sampled both as toxic and as unlabelled text counts in both roles. Rows that agree in id and
    text count once; rows of one id with different texts count each, so an id on many rows is bounded as
    any others are. The prior is the toxic share of all labelled ids that may be learnt from.
    """
    usable = labels.filter(~held_out(F.col(id_col)) & F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("toxic").alias("_toxic"))
    share = usable.agg(F.avg("_toxic")).first()[0] or 0.0
    prior = min(0.5, max(0.01, float(share)))
    toxic = usable.filter("_toxic = 1").select(F.col(id_col).alias("_id"))
    row = F.xxhash64("_id", "_text", F.lit("sample"))
    mine = docs.filter(~held_out(F.col(id_col))).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # Rows are counted by id and text, so that copies of a row cannot fill the sample: one of them stands for all.
    # The rows drawn are those of the lowest hashes, as many as the bounds say.
    copies = lambda rows: rows.groupBy("_id", row.alias("_row")).agg(F.first("_text").alias("_text"))
    lowest = lambda rows, most: rows.orderBy("_row", "_id").limit(most)
    few = toxic.limit(MAX_IDS + 1).count() <= MAX_IDS
    known = lowest(copies(mine.join(F.broadcast(toxic) if few else toxic, "_id", "left_semi")), MAX_POSITIVE).withColumn("_positive", F.lit(True))
    # A rate that leaves somewhat more than the bound saves sorting all rows.
    rate = min(1.0, 1.5 * MAX_UNLABELLED / max(1, mine.count()) + 1e-9)
    some = mine.filter(F.pmod(row, F.lit(1 << 30)) < int(rate * (1 << 30)))
    drawn = lowest(copies(some), MAX_UNLABELLED).withColumn("_positive", F.lit(False))
    roles = known.unionByName(drawn)

    @F.pandas_udf("array<long>")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        for batch in batches:
            yield pd.Series([text_features(t) for t in batch.tolist()])
        give_back()

    part = F.pmod(F.xxhash64("_row", F.lit("part")), F.lit(MEMBERS)).cast("int")
    return stored(roles.select(part.alias("_part"), "_positive", extract("_text").alias("_features"))), prior


def select_features(sample: DataFrame) -> list[int]:
    """The features that toxic documents have most surely more often than unlabelled ones."""
    sizes = sample.agg(F.coalesce(F.sum(F.col("_positive").cast("int")), F.lit(0)).alias("p"), F.count("*").alias("n")).first()
    n_pos, n_unl = sizes.p, sizes.n - sizes.p
    if not n_pos or not n_unl:
        return []
    counts = sample.select("_positive", F.explode("_features").alias("_f")).groupBy("_f").agg(F.sum(F.col("_positive").cast("int")).alias("_p"), F.sum((~F.col("_positive")).cast("int")).alias("_u"))
    base = (F.col("_u") + 1) / F.lit(n_unl + 2.0)
    # Log-likelihood gain of a Poisson count over the count that text at large makes one expect.
    expected = base * n_pos
    gain = F.col("_p") * F.log(F.col("_p") / expected) - F.col("_p") + expected
    kept = counts.filter((F.col("_p") >= MIN_POSITIVE_DOCS) & (F.col("_p") > expected)).withColumn("_gain", gain).filter(F.col("_gain") > MIN_GAIN).orderBy(F.desc("_gain"), "_f").limit(MAX_FEATURES)
    return sorted(r._f for r in kept.select("_f").collect())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit the members to the training sample. Without confirmed toxic rows every score is 0."""
    sample, prior = training_sample(docs, labels, id_col, text_col)
    features = select_features(sample)
    if not features:
        return Model([], np.zeros((0, 1)))
    chosen = np.array(features)

    @F.pandas_udf("array<int>")
    def places(features: pd.Series) -> pd.Series:
        out = []
        for f in features:
            at = np.minimum(np.searchsorted(chosen, f), len(chosen) - 1)
            out.append(at[chosen[at] == f].astype(np.int32))
        return pd.Series(out)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        rows = [np.asarray(at) for at in part["_at"]]
        positive = part["_positive"].to_numpy()
        if not positive.any() or positive.all():
            return pd.DataFrame({"weights": pd.Series([], dtype=object)})
        return pd.DataFrame({"weights": [fit_nnpu(rows, positive, len(chosen), prior).tolist()]})

    # Each member learns from all parts but its own; the sample's size is bounded, so its groups are.
    # Only the few selected features of a document are shuffled.
    small = sample.select("_part", "_positive", places("_features").alias("_at"))
    others = small.withColumn("_member", F.explode(F.sequence(F.lit(0), F.lit(MEMBERS - 1)))).filter("_member <> _part").drop("_part")
    fitted = others.withColumnRenamed("_member", "_part").groupBy("_part").applyInPandas(fit, "weights array<double>").collect()
    weights = np.array(sorted(r.weights for r in fitted)).reshape(len(fitted), -1)
    return Model(features, weights if len(fitted) else np.zeros((0, 1)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: (id_col, *keep, held_out, score, predicted).

    labels: (id_col, toxic 0/1/null); rows held out, null labels and null ids teach nothing.
    Whole texts of any length are scored, by their words alone; empty and null texts get the score of a text
    without any feature. Repeated rows get equal scores; an empty table gives an empty result;
    other columns of either table are ignored, but for those of docs in keep.
    """
    model = train(docs, labels.select(id_col, "toxic"), id_col, text_col)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        for batch in batches:
            yield pd.Series([model.score(t) for t in batch.tolist()], dtype="float64")
        model.words.clear()
        give_back()

    out = docs.select(F.col(id_col), *keep, held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
