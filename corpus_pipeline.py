"""A corpus pipeline of four stages over the table of documents.

run() filters toxic documents, keeps one document of each group of near duplicates, mixes the
sources to their target weights and encodes what is left to pieces. Each stage's result is
written as Parquet to the shared folder and read again as the next stage's input.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.llm.common import stored, table
from barlab.llm.jaccard import linked_components
from barlab.llm.mixing import mix_sources
from barlab.llm.sentencepieces import encode_pieces
from barlab.llm.toxicity import toxicity_scores

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids (8 bytes each, and a count) are broadcast to a join with the texts up to this many rows.
BROADCAST_IDS = 1 << 20


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _doc, a 64-bit hash of the whole row: ids may be null or stand on several rows, and
    rows that agree in all columns can stand for each other."""
    return docs.select(*COLUMNS, F.xxhash64(*[x for c in COLUMNS for x in (F.col(c).isNull(), F.col(c))]).alias("_doc"))


def _joined(docs: DataFrame, ids: DataFrame, how: str, on: str = "_doc") -> DataFrame:
    """docs joined with a small-rowed table: broadcast while it is small enough."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, on, how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, each row by its own text."""
    return toxicity_scores(docs, table(spark, sf_dir, "labels"), keep=COLUMNS[1:]).filter("predicted = 0").select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component (one without an id only where no member
    has one); repeated rows of it once.

    Documents without words are no duplicates and all stay.
    """
    docs = _keyed(docs)
    found = linked_components(docs, "_doc").filter("n_shingles > 0").groupBy("_doc").agg(F.count("*").alias("_n"), F.first("component_id").alias("component_id"))
    found = stored(found.join(docs.select("_doc", "doc_id").dropDuplicates(["_doc"]), "_doc"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_doc"))
    groups = stored(found.groupBy("component_id").agg(F.count("*").alias("_members"), F.min_by("_doc", order).alias("_kept")).filter("_members > 1").select("component_id", "_kept"))
    dropped = stored(_joined(found, groups, "inner", "component_id").filter("_doc <> _kept").select("_doc"))
    repeated = stored(found.filter("_n > 1").select("_doc"))
    kept = _joined(docs, dropped, "left_anti")
    if not repeated.isEmpty():
        kept = _joined(kept, repeated, "left_anti").unionByName(_joined(kept, repeated, "left_semi").dropDuplicates(["_doc"]))
    return kept.select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it (to the nearest whole number).

    Documents without words weigh nothing and stay once.
    """
    docs = _keyed(docs)
    times = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size"))).cast("long")
    # Equal rows share what the mix takes of them; one of them stands for the rest of the division.
    taken = mix_sources(docs, keep=("_doc",)).groupBy("_doc").agg(F.count("*").alias("_n"), F.sum(times).alias("_sum"))
    taken = stored(taken.select("_doc", F.expr("_sum div _n").alias("_times"), (F.col("_sum") % F.col("_n")).alias("_rest")))
    copies = lambda rows, n: rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*COLUMNS)
    out = copies(_joined(docs, taken.filter("_times > 0").select("_doc", "_times"), "inner"), "_times")
    rest = taken.filter("_rest > 0").select("_doc", "_rest")
    if rest.isEmpty():
        return out
    return out.unionByName(copies(_joined(docs, rest, "inner").dropDuplicates(["_doc"]), "_rest"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids."""
    encoded = encode_pieces(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.withColumn("n_pieces", F.size("piece_ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: The stages' classifiers, hashes and pieces are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
