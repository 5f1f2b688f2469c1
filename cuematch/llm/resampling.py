"""Draw documents that look like a target: importance resampling over hashed word runs.

A 256-byte table lower-cases A-Z and blanks the separators of a UTF-8 text, so
``bytes.split`` yields its words (digits, letters a-z, bytes from 0x80). Runs of
1 to ``n`` words are hashed with ``zlib.crc32``: the sum of a run is the seed of
the run that is one word longer, so no run is put together. Counters reduce each
text, then each task's texts, to counts per bucket; Spark adds the counts of the
tasks, at most ``buckets`` rows each. A second walk over the texts adds up the
gains of their features. The gains, one number per bucket, go to all tasks: their
size is the parameter ``buckets``, whatever the tables hold.

The draw is the top of weight plus Gumbel noise that the id and the seed decide,
so it is without replacement and reruns agree. Ranks come from one range
partitioned sort of narrow rows.

Nulls and edges: a null, empty or wordless text has no features, weight 0, and is
not drawn unless ``least_words`` is 0. A null id is hashed as an empty one and
sorts first. Rows that repeat are rows of their own; ties in score go to the
smaller id, rows equal in both are equal in all that shows but their weight, and
go by that. Very long texts are walked whole. An empty table gives no rows; an
empty target, or an empty corpus, has only zero counts. Columns that are not
named are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cuematch.llm.sharding import numbered
from cuematch.llm.words import trimmed
from cuematch.plans.storage import materialize

_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
TABLE = bytes(x if x in _WORD else x + 32 if 0x41 <= x <= 0x5A else 0x20 for x in range(256))
GUMBEL_STEPS = 1 << 32


def features(text: bytes, n: int) -> tuple[Counter, int]:
    """How often each run's checksum occurs, and the number of words."""
    words = text.translate(TABLE).split()
    codes = list(map(zlib.crc32, words))
    found = Counter(codes)
    spaced = [b" " + w for w in words[1:]] if n > 1 else []
    for _ in range(1, n):
        codes = list(map(zlib.crc32, spaced, codes))  # each seed is the run that ends before the word
        found.update(codes)
        spaced = spaced[1:]
    return found, len(words)


def _hashed(found: Counter, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    codes = np.fromiter(found.keys(), np.int64, len(found))
    return codes % buckets, np.fromiter(found.values(), np.int64, len(found))


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[bytes]:
    for value in batch.column(at).cast(pa.large_binary()):
        yield value.as_py() or b""


def _counter(n: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _texts(batch, 0):
                bucket, count = _hashed(features(text, n)[0], buckets)
                np.add.at(total, bucket, count)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, n: int, buckets: int, text: str = "text") -> DataFrame:
    """(bucket, n) of all features of all texts; buckets without any are left out."""
    sent = texts.select(F.col(f"`{text}`").alias("text"))
    return sent.mapInArrow(trimmed(_counter(n, buckets)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, n: int, buckets: int, text: str = "text") -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the documents."""
    counts = (
        bucket_counts(docs, n, buckets, text).withColumn("side", F.lit(0))
        .unionByName(bucket_counts(target, n, buckets, text).withColumn("side", F.lit(1)))
    )
    count = np.zeros((2, buckets), np.int64)
    for row in counts.collect():  # 2 x buckets rows at most
        count[row["side"], row["bucket"]] = row["n"]
    (s, t), (total_s, total_t) = count.astype(np.float64), count.sum(axis=1).astype(np.float64)
    ratio = ((t + 1) * (total_s + buckets)) / ((s + 1) * (total_t + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weigher(n: int, gains: np.ndarray, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((3, len(batch)), np.int64)
            for i, text in enumerate(_texts(batch, at)):
                found, words = features(text, n)
                bucket, count = _hashed(found, len(gains))
                rows[:, i] = count.sum(), words, (gains[bucket] * count).sum()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(at)), *map(pa.array, rows)], names=[f"c{i}" for i in range(at + 3)]
            )

    return run


def weights(docs: DataFrame, gains: np.ndarray, n: int, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with n_features, n_words and weight."""
    made = ["n_features", "n_words", "weight"]
    keep = [c for c in keep if c not in made]
    sent = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("text"))
    kept = sent.schema.fields[:-1]
    schema = StructType([*kept, *(StructField(f"c{len(keep) + i}", LongType()) for i in range(3))])
    out = sent.mapInArrow(trimmed(_weigher(n, gains, len(keep))), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate([*keep, *made])])


def noise(id_: Column, seed: str) -> Column:
    """floor(1000 Gumbel) from the first 32 bits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(float(GUMBEL_STEPS)))))


def resample(
    docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20,
    seed: str = "2024", id_: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Each document's id, n_features, n_words, weight, score and rank; rank is null for those not drawn.

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred
    (rounded down) are drawn. ``target`` has a text column of the same name.
    """
    gains = bucket_gains(docs, target, n, buckets, text)
    weighed = materialize(weights(docs, gains, n, [id_], text), "weights")  # else finding the sort's ranges walks the texts once more
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col(f"`{id_}`"), seed))
    scored = scored.withColumn("_late", F.col("n_words") < least_words).withColumn("_down", -F.col("score"))
    placed, _total = numbered(scored, ["_late", "_down", id_, "weight"], "_row")
    drawn = percent * placed.where(~F.col("_late")).count() // 100
    rank = F.when(F.col("_row") < drawn, F.col("_row") + 1).cast("long")
    return placed.withColumn("rank", rank).drop("_late", "_down", "_row")
