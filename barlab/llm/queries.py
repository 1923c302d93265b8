"""The registered queries of the training-data operators, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align
from .common import table
from .jaccard import linked_components
from .mixing import SCHEDULE_SQL, mix_sources
from .neighbours import NEAREST_SQL, nearest
from .phrases import COLLOCATIONS_SQL, collocations
from .sentencepieces import piece_digest
from .sharding import shard_by_bytes
from .syncmers import fingerprint_edits
from .token_blocks import token_blocks
from .token_counts import token_counts
from .toxicity import toxicity_scores
from .url_lists import URL_SQL, entries_from_pages, judge_captures, pages_as_captures
from .warc import build_derivatives, responses_from_pages


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by classifiers learnt from confirmed toxic and unlabelled text."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents in the 49k vocabulary with word ends."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded to pieces and decoded again."""
    return piece_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked by the similarity of their five-word shingles."""
    return linked_components(table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, among all vectors."""
    return nearest(table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by weights 5, 2, 1 in turn."""
    return mix_sources(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes."""
    out = shard_by_bytes(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages."""
    return build_derivatives(responses_from_pages(table(spark, sf_dir, "pages")), keep=("page_id",))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as captures, judged by list entries that were active when they were fetched."""
    pages = table(spark, sf_dir, "pages")
    return judge_captures(pages_as_captures(pages), entries_from_pages(pages))


def op11_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to compressed blocks and read back."""
    return token_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of each language."""
    return collocations(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens of a byte-level and of a piece vocabulary, aligned."""
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_jaccard": op4_jaccard,
    "op5_nearest": op5_nearest,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_fingerprints": op8_fingerprints,
    "op9_sharding": op9_sharding,
    "op10_url_filters": op10_url_filters,
    "op11_token_blocks": op11_token_blocks,
    "op12_phrases": op12_phrases,
    "op13_alignment": op13_alignment,
}

ORACLES: dict[str, str] = {
    "op5_nearest": NEAREST_SQL,
    "op7_mixing": SCHEDULE_SQL,
    "op10_url_filters": URL_SQL,
    "op12_phrases": COLLOCATIONS_SQL,
}
