"""Shards by a keyed permutation of row numbers (Feistel network with cycle walking).

Rows get global numbers 0 to n - 1 in the order of (doc_id, checksum, size). A
Feistel network over the smallest even number of bits that holds n permutes
them; a value of n or more walks on through the network until it falls below n.
The position p of a row is its place in the shuffle: shard p mod s, slot p div
s. Number, position, shard and slot follow from each other by arithmetic
(``permuted``, ``unpermuted``), so any row's place can be computed alone.

Nulls: a null text has no bytes and checksum 0; a null doc_id sorts first and
is kept. Rows that repeat keep one number each; they are equal in every column,
so their order does not show. An empty table gives no rows. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from cuematch.plans.storage import materialize

ROUNDS = 6
_U = np.uint64


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _round(half: np.ndarray, key: int, turn: int, mask: np.uint64) -> np.ndarray:
    x = half + _U((key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return (x ^ (x >> _U(31))) & mask


def _network(x: np.ndarray, n: int, key: int, back: bool) -> np.ndarray:
    bits = _half_bits(n)
    mask, shift = _U(2**bits - 1), _U(bits)
    left, right = x >> shift, x & mask
    for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if back:
            left, right = right ^ _round(left, key, turn, mask), left
        else:
            left, right = right, left ^ _round(right, key, turn, mask)
    return (left << shift) | right


def _walk(x: np.ndarray, n: int, key: int, back: bool) -> np.ndarray:
    out = _network(np.asarray(x, np.uint64), n, key, back)
    while len(far := np.flatnonzero(out >= _U(n))):
        out[far] = _network(out[far], n, key, back)
    return out.astype(np.int64)


def permuted(numbers: np.ndarray, n: int, key: int = 0) -> np.ndarray:
    """Positions of the row numbers, each in 0 to n - 1."""
    return _walk(numbers, n, key, False)


def unpermuted(positions: np.ndarray, n: int, key: int = 0) -> np.ndarray:
    """Row numbers of the positions."""
    return _walk(positions, n, key, True)


def numbered(rows: DataFrame, order: list[str], name: str = "row_no") -> tuple[DataFrame, int]:
    """Rows with numbers from 0 in the given order, and their count.

    The rows are range-partitioned and sorted once; only the row count of each
    partition comes to the driver. Rows that tie in the whole order are spread
    by a salt, so that one frequent key is not one task.
    """
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(4096))
    placed = (
        rows.withColumn("_salt", salt)
        .repartitionByRange(*order, "_salt")
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
        .drop("_salt")
    )
    placed = materialize(placed, "numbered")
    counts = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    small = rows.sparkSession.createDataFrame(offsets, "_part int, _first long")
    joined = placed.join(F.broadcast(small), "_part").withColumn(name, F.col("_first") + F.col("_at"))
    return joined.drop("_part", "_at", "_first"), total


def feistel_shards(docs: DataFrame, shards: int = 24, key: int = 0) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 8), text_crc32, row_no, position, shard, slot.

    Shards hold the same number of rows, give or take one; slots are gapless.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    rows, n = numbered(rows, ["doc_id", "text_crc32", "size"])

    @pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted(numbers.to_numpy(), n, key))

    out = rows.withColumn("position", place("row_no"))
    return out.withColumn("shard", F.pmod("position", F.lit(shards)).cast("int")).withColumn(
        "slot", F.floor(F.col("position") / F.lit(shards)).cast("long")
    )
