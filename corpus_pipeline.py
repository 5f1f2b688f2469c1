"""Documents to token ids in five stages, each written as Parquet before the next one reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuematch.llm import stages
from cuematch.plans.storage import materialize
from cuematch.session import ship

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", stages.keep_good),
    ("jaccard_join", stages.keep_one_of_each_group),
    ("secret_scan", stages.redact_secrets),
    ("source_mix", stages.mix_sources),
    ("sentence_pieces", stages.sentence_pieces),
]

ORACLE_SQL = None  # the classifier, the forest and the tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over all documents."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
