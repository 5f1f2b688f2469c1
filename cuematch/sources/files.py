"""File listings and text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuematch import fixed_values as fv
from cuematch.functions.text import episode_number, normalize_whitespace


def is_audio_name(name: Column) -> Column:
    """An audio suffix in any case, and not a ``._`` sidecar."""
    lowered = F.lower(name)
    suffix = F.lit(False)
    for one in fv.AUDIO_SUFFIXES:
        suffix = suffix | F.endswith(lowered, F.lit(one))
    return suffix & ~F.startswith(name, F.lit("._"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def keep_audio(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Audio files of a listing, sorted by path."""
    return (
        files.withColumn("filename", base_name(F.col(path_col)))
        .filter(is_audio_name(F.col("filename")))
        .orderBy(path_col)
    )


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """Audio files below a folder: (path, length, modificationTime, filename).

    Works for every file system Spark can read. File contents are not read:
    the binary column is pruned.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ).select("path", "length", "modificationTime")
    return keep_audio(listing)


def screenplays(spark: SparkSession, path: str) -> DataFrame:
    """Text files as (file_name, episode_nr, text), one row per file."""
    # The name comes percent-encoded; a plus sign stands for itself there.
    encoded = F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))
    raw = spark.read.text(path, wholetext=True).select(
        F.url_decode(encoded).alias("file_name"), F.col("value").alias("text")
    )
    return prepare_screenplays(raw)


def prepare_screenplays(raw: DataFrame) -> DataFrame:
    """Any (file_name, text) table: number from the name, text normalised."""
    return raw.select(
        "file_name",
        episode_number(F.col("file_name")).alias("episode_nr"),
        normalize_whitespace(F.col("text")).alias("text"),
    )
