"""Check queries of this package, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuematch.llm import bpe, language_model, merkle, mixing, ngram_join, pieces, prefix_forest, quality, repeats, resampling, secret_scan, sharding, vector_dedup
from cuematch.llm.sql import SQL  # noqa: F401
from cuematch.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """The public SentencePiece model; the same path on every worker."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pstable_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def prefix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.nearest(_table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents")).drop("cls")


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    mixed = mixing.mix(narrow, size=F.col("words"))
    return mixed.select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(_table(spark, sf_dir, "documents"), piece_model(), keep=["doc_id"])
    return out.select(
        "doc_id", pieces.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "number", "begin", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "secret")


def kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality.classify(docs, quality.trusted_ids(labels)).drop("row")


def repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.feistel_shards(_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "position"
    )


def gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language_model.score_texts(docs, ~language_model.held_out(F.col("doc_id")))
    return out.withColumn("held_out", language_model.held_out(F.col("doc_id")))


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    touched = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(2)) == 0
    text = F.when(touched, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = merkle.manifest(docs, replacement=merkle.leaf(docs, changed={"text": text})).proofs()
    return rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


def target_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    drawn = resampling.resample(docs, benchmark, n=1, buckets=10_000, percent=10, least_words=20, seed="2024")
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def bpe_model() -> str:
    """The public tokenizer that marks word ends; the same path on every worker."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(_table(spark, sf_dir, "documents"), bpe_model(), keep=["doc_id"])
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pstable_duplicates": pstable_duplicates,
    "op2_jaccard_join": jaccard_join,
    "op3_prefix_neighbours": prefix_neighbours,
    "op4_mix_sources": mix_sources,
    "op5_secret_findings": secret_findings,
    "op6_sentence_pieces": sentence_pieces,
    "op7_kneser_ney_quality": kneser_ney_quality,
    "op8_repeated_bytes": repeated_bytes,
    "op9_feistel_shards": feistel_shards,
    "op10_gru_scores": gru_scores,
    "op11_merkle_manifest": merkle_manifest,
    "op12_target_resample": target_resample,
    "op13_bpe_tree": bpe_tree,
}
