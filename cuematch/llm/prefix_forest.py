"""Nearest neighbours by a forest of sorted hash strings with variable prefix lengths.

Each tree gives a vector a string of ``BITS`` bits: the sides of as many random
planes through the mean of all vectors. A task sorts the strings of a block of
vectors, one array per tree. A query descends by binary search: the vectors that
share a prefix with it are a range of each array. Ascending is synchronous: one
prefix length for all trees, shortened until the ranges of all trees and all
blocks together hold the wanted number of entries. The numbers of entries per
prefix length add up over blocks, so the candidates are those of one forest
over all vectors, while vectors stay where they are and are never copied.

First walk: entries per query and prefix length. Then each query's longest
prefix with enough entries. Second walk: the vectors in its ranges, with exact
distances; a task keeps k per query, and the tasks' results meet in one shuffle.
The wanted number is ``share`` of all vectors (tuned for evenly spread vectors,
which have no near neighbours to be found early; a vector counts once per tree),
``least`` at the least.

Queries come to the driver and go out in slices of ``SLICE`` vectors, with one
pair of walks for each slice.

Nulls and edges: vectors that are null, empty, zero, or hold null or non-finite
components, and rows without vec_id, take no part. A query meets only vectors of
its length. Rows that repeat are candidates each; rows with the query's id are
not. Of several query rows with one id the one with the smallest vector code
searches. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuematch.llm.vectors import blob, from_blobs, row_codes, valid_rows
from cuematch.plans.storage import materialize

BITS = 32
BLOCK = 8192
SLICE = 8192
_U = np.uint64


def _strings(matrix: np.ndarray, mean: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Strings as numbers below 2 ** BITS (trees x vectors)."""
    rng = np.random.default_rng([seed, matrix.shape[1]])
    planes = rng.normal(size=(matrix.shape[1], trees * BITS))
    side = ((matrix - mean) @ planes > 0).reshape(len(matrix), trees, BITS)
    return (side @ (_U(1) << np.arange(BITS - 1, -1, -1, dtype=_U))).T.astype(_U)


def _ranges(ordered: np.ndarray, query: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the entries that share ``depth`` bits with the query strings."""
    span = _U(1) << (_U(BITS) - depth.astype(_U))
    low = query // span * span
    return np.searchsorted(ordered, low), np.searchsorted(ordered, low + span)


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, matrix in valid_rows(batch.column(1)):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), matrix.shape[1]), pa.int32()), blob(matrix), pa.array(row_codes(matrix))],
                names=["vec_id", "dim", "vector", "code"],
            )


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for _, matrix in from_blobs(batch.column(0)):
            n, s = total.get(matrix.shape[1], (0, 0.0))
            total[matrix.shape[1]] = n + len(matrix), s + matrix.sum(0)
    for dim, (n, s) in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(dim, dim), pa.int32()), pa.array(np.arange(dim), pa.int32()), pa.array(np.full(dim, n), pa.int64()), pa.array(s)],
            names=["dim", "at", "n", "s"],
        )


class _Queries:
    def __init__(self, ids: np.ndarray, vectors: list[bytes], means: dict[int, np.ndarray], trees: int, seed: int):
        self.by_dim, self.trees, self.seed, self.means = {}, trees, seed, means
        for rows, matrix in from_blobs(pa.array(vectors, pa.binary())):
            dim = matrix.shape[1]
            self.by_dim[dim] = ids[rows], matrix, _strings(matrix, means[dim], trees, seed)
        self.depth: dict[int, int] = {}


def _blocks(batches: Iterator[pa.RecordBatch], q: _Queries) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Dimension, ids, vectors and strings of blocks of rows that some query can meet."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for rows, matrix in from_blobs(batch.column(1)):
            dim = matrix.shape[1]
            if dim in q.by_dim:
                for at in range(0, len(rows), BLOCK):
                    part = matrix[at : at + BLOCK]
                    yield dim, ids[rows[at : at + BLOCK]], part, _strings(part, q.means[dim], q.trees, q.seed)


def _counted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = model.value
        total = {dim: np.zeros((len(x[0]), BITS + 1), np.int64) for dim, x in q.by_dim.items()}
        for dim, _ids, _matrix, strings in _blocks(batches, q):
            own = q.by_dim[dim][2]
            for t in range(q.trees):
                ordered = np.sort(strings[t])
                for depth in range(BITS + 1):
                    a, b = _ranges(ordered, own[t], np.full(own.shape[1], depth))
                    total[dim][:, depth] += b - a
        for dim, counts in total.items():
            ids = q.by_dim[dim][0]
            i, depth = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(depth, pa.int32()), pa.array(counts[i, depth])], names=["query_id", "depth", "n"])

    return run


def _searched(model, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = model.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim, ids, matrix, strings in _blocks(batches, q):
            own_ids, own, own_strings = q.by_dim[dim]
            depth = np.array([q.depth.get(int(i), 0) for i in own_ids])
            order = np.argsort(strings, axis=1)
            cuts = [_ranges(strings[t][order[t]], own_strings[t], depth) for t in range(q.trees)]
            norms = (matrix * matrix).sum(1)
            for at in range(0, len(own), 256):
                rough = norms - 2 * (own[at : at + 256] @ matrix.T)
                for j, i in enumerate(range(at, min(at + 256, len(own)))):
                    met = np.zeros(len(ids), bool)
                    for t in range(q.trees):
                        met[order[t, cuts[t][0][i] : cuts[t][1][i]]] = True
                    met &= ids != own_ids[i]
                    rows = np.flatnonzero(met)
                    if len(rows) > k:
                        near = rough[j, rows]
                        cut = np.partition(near, k - 1)[k - 1]
                        rows = rows[near <= cut + 1e-9 * (1 + abs(cut) + (own[i] @ own[i]))]
                    gap = matrix[rows] - own[i]
                    score = np.sqrt((gap * gap).sum(1))
                    held = best.get(int(own_ids[i]), (np.zeros(0), np.zeros(0, np.int64)))
                    score, found = np.append(held[0], score), np.append(held[1], ids[rows])
                    first = np.lexsort((found, score))[:k]
                    best[int(own_ids[i])] = score[first], found[first]
        for query, (score, found) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), query)), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame, query: Column, k: int = 10, trees: int = 24, share: float = 1.0, least: int = 2000, seed: int = 5, slice_size: int = SLICE
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that ``query`` (over vec_id) marks."""
    spark = vectors.sparkSession
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = materialize(rows.mapInArrow(_valid, "vec_id long, dim int, vector binary, code long"), "vectors")
    sums = rows.select("vector").mapInArrow(_sums, "dim int, at int, n long, s double").groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    own = rows.where(query)
    asked = materialize(own.groupBy("vec_id").agg(F.min_by("vector", "code").alias("vector"), F.min_by("dim", "code").alias("dim")), "queries")
    sums = materialize(sums.groupBy("dim").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", (F.col("s") / F.col("n")).alias("mean"))))["mean"].alias("means")), "means")
    schema = "query_id long, vec_id long, score double"
    parts = [spark.createDataFrame([], schema)]
    slices = max(1, -(-asked.count() // slice_size))
    for s in range(slices):
        got = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(slices)) == s).toArrow()
        if not got.num_rows:
            continue
        dims = got.column("dim").unique().to_pylist()  # at most one a query of the slice
        found = sums.where(F.col("dim").isin(dims)).collect()
        means, sizes = {r["dim"]: np.array(r["means"]) for r in found}, {r["dim"]: r["n"] for r in found}
        q = _Queries(got.column("vec_id").to_numpy(), got.column("vector").to_pylist(), means, trees, seed)
        data = rows.select("vec_id", "vector")
        wanted = {int(i): max(least, int(share * sizes[dim])) for dim, x in q.by_dim.items() for i in x[0]}
        counts = data.mapInArrow(_counted(spark.sparkContext.broadcast(q)), "query_id long, depth int, n long")
        for r in counts.groupBy("query_id", "depth").agg(F.sum("n").alias("n")).toLocalIterator():
            if r["n"] >= wanted[r["query_id"]]:
                q.depth[r["query_id"]] = max(q.depth.get(r["query_id"], 0), r["depth"])
        parts.append(materialize(data.mapInArrow(_searched(spark.sparkContext.broadcast(q), k), schema), "neighbours"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
