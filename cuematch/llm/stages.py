"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> docs, each over all that came before.

Nulls and edges, for every stage: a null text counts as empty, has no secret, is
never a near-duplicate, and is encoded as begin and end; a null id, language or
source is a value of its own. Very long texts are read whole. Rows that repeat are
judged alike; of those with words the second stage keeps one. An empty table gives
an empty table. All but the last stage return the columns they were given, of any
name and type, maps included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuematch.llm import mixing, ngram_join, pieces, quality, secret_scan
from cuematch.llm.queries import piece_model


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.trusted_ids(labels))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8)."""
    return ngram_join.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets masked in the text and n_chars counted anew."""
    return secret_scan.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids (four bytes each, little-endian) of every document."""
    out = pieces.encode(docs, piece_model(), keep=["doc_id", "lang", "source"])
    return out.select("doc_id", "lang", "source", pieces.n_tokens(F.col("ids")).alias("n_tokens"), "ids")
