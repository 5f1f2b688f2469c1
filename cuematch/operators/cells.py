"""Measures of very many (scene, track) pairs without a wide row for each.

Scenes and tracks are dealt to blocks by a hash of their ids, and every block of
scenes meets every block of tracks in a cell. The rows of both sides travel packed,
once per block of the other side; a pair travels as its two ids. A task holds the two
blocks of one cell and measures its pairs in slices: dot products of vectors, words
that two sets share, words that are listed. What grows with the pairs is two ids
before and one narrow row after; what is shuffled of the sides is their size times the
blocks of the other side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_BLOCK_BYTES = 160 << 20  # rows of one side in a cell, numbers as doubles
_PACKED = 512            # rows of a side that travel as one
_SLICE = 1 << 20         # numbers of one vector column that are multiplied at once
_MET = "cell long, part int, data binary, s_id long, t_id long"

Sides = dict[str, tuple[str, str]]  # name of the measure: its column of the scene and of the track


def to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def block_keys(spark: SparkSession, n: int) -> list[int]:
    """Keys that ``repartition(n, key)`` deals to one partition each."""
    at = F.pmod(F.hash("id"), F.lit(n))
    rows = spark.range(32 * n).groupBy(at.alias("at")).agg(F.min("id").alias("id")).collect()
    keys = [r["id"] for r in rows]  # one number per block
    return (keys + [32 * n + i for i in range(n)])[:n]


def _bytes(df: DataFrame) -> int:
    """Size of the rows in memory, by one aggregate."""
    total = F.lit(8 * len(df.columns))
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "string":
            total = total + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind == "array" and f.dataType.elementType.typeName() == "string":
            total = total + F.coalesce(F.octet_length(F.to_json(f.name)), F.lit(0))
        elif kind == "array":
            total = total + F.greatest(F.size(f.name), F.lit(0)) * 8
    return int(df.agg(F.sum(total).alias("n")).first()["n"] or 0)


def _grid(scene_bytes: int, track_bytes: int, tasks: int) -> tuple[int, int]:
    """Blocks of scenes and of tracks: bounded in size, and cells enough for all cores."""
    s, t = max(1, -(-scene_bytes // _BLOCK_BYTES)), max(1, -(-track_bytes // _BLOCK_BYTES))
    while s * t < tasks:
        # one more block of scenes sends the tracks once more, and the other way round
        if track_bytes * s <= scene_bytes * t:
            s += 1
        else:
            t += 1
    return s, t


def _pack(part: int, size: int):
    """Batches led by a block number, as one packed row for each block and ``size`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block = np.asarray(batch.column(0))
            order = np.argsort(block, kind="stable")
            block, cuts = np.unique(block[order], return_index=True)
            rows = batch.select(batch.schema.names[1:])
            for at, some in zip(block, np.split(order, cuts[1:])):
                # taken, as slices of lists cannot be written
                data = [to_bytes(rows.take(pa.array(some[i : i + size]))) for i in range(0, len(some), size)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(data), at, np.int64)), pa.array(np.full(len(data), part, np.int32)),
                     pa.array(data, pa.binary())],
                    names=["block", "part", "data"],
                )

    return run


def _padded(column: pa.Array, flat: np.ndarray, empty) -> tuple[np.ndarray, np.ndarray]:
    """A list column as a matrix of its values ``flat`` and ``empty`` beyond each row's length."""
    sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    out = np.full((len(sizes), int(sizes.max(initial=0))), empty, dtype=flat.dtype)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


def _words(*columns: pa.Array) -> list[np.ndarray]:
    """The words of text or list columns as numbers, the same word by the same number."""
    flat = [c.flatten() if pa.types.is_list(c.type) else c for c in columns]
    coded = pa.concat_arrays([f.cast(pa.string()) for f in flat]).dictionary_encode(null_encoding="encode")
    codes = np.asarray(coded.indices, dtype=np.int32)
    return np.split(codes, np.cumsum([len(f) for f in flat])[:-1])


def _matches(ids: np.ndarray, rows: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ids, row) of all rows of each id, as an inner join; ``order`` sorts the rows."""
    first, end = (np.searchsorted(rows, ids, side, sorter=order) for side in ("left", "right"))
    n = end - first
    at = np.repeat(np.arange(len(ids)), n)
    return at, order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]


class _Cell:
    """The rows of one block of scenes and one of tracks."""

    def __init__(self, s: pa.Table, t: pa.Table, dots: Sides, shared: Sides, listed: Sides, carried: list[str]):
        column = lambda side, name: side.column(name).combine_chunks()
        self.ids = [np.asarray(column(side, name)) for side, name in ((s, "scene_query_id"), (t, "track_query_id"))]
        self.orders = [np.argsort(ids, kind="stable") for ids in self.ids]
        self.dots, self.shared, self.listed = {}, {}, {}
        vectors: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for name, pair in dots.items():
            for side, c in zip((s, t), pair):
                if c not in vectors:
                    lists = column(side, c)
                    vectors[c] = _padded(lists, np.asarray(lists.flatten()), 0)
            self.dots[name] = [vectors[c] for c in pair]
        for name, (a, b) in shared.items():
            a, b = column(s, a), column(t, b)
            in_a, in_b = _words(a, b)
            self.shared[name] = _padded(a, in_a, -1)[0], _padded(b, in_b, -2)[0]
        for name, (a, b) in listed.items():
            a, b = column(s, a), column(t, b)
            in_a, in_b = _words(a, b)
            self.listed[name] = np.where(np.asarray(a.is_null()), -1, in_a)[:, None], _padded(b, in_b, -2)[0]
        measured = {c for sides in (dots, shared, listed) for pair in sides.values() for c in pair}
        self.sides = [{c: column(side, c) for c in side.column_names if c not in measured or c in carried} for side in (s, t)]
        widest = max((m.shape[1] for m, _sizes in vectors.values()), default=1)
        self.slice = max(256, _SLICE // max(1, widest))

    def measure(self, s_ids: np.ndarray, t_ids: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Rows of ``schema`` for the pairs of ids."""
        at, s_rows = _matches(s_ids, self.ids[0], self.orders[0])
        more, t_rows = _matches(t_ids[at], self.ids[1], self.orders[1])
        s_rows = s_rows[more]
        for lo in range(0, len(s_rows), self.slice):
            yield self._slice(s_rows[lo : lo + self.slice], t_rows[lo : lo + self.slice], schema)

    def _slice(self, i: np.ndarray, j: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        found: dict[str, np.ndarray] = {}
        for name, ((x, nx), (y, ny)) in self.dots.items():
            width = min(x.shape[1], y.shape[1])
            products = x[i, :width].astype(np.float64) * y[j, :width]
            found[name] = np.where((nx[i] == ny[j]) & (nx[i] > 0), products.sum(axis=1), 0.0)
        for name, (a, b) in [*self.shared.items(), *self.listed.items()]:
            n = np.zeros(len(i), dtype=np.int32)
            of_b = b[j]
            for place in range(a.shape[1]):  # of sets, so a word is found once at most
                n += (a[i, place][:, None] == of_b).any(axis=1)
            found[name] = n > 0 if name in self.listed else n
        rows = pa.array(i), pa.array(j)
        out = []
        for field in schema:
            if field.name in found:
                out.append(pa.array(found[field.name]).cast(field.type))
                continue
            at = 0 if field.name in self.sides[0] else 1
            out.append(self.sides[at][field.name].take(rows[at]).cast(field.type))
        return pa.RecordBatch.from_arrays(out, schema=schema)


def meet(
    pairs: DataFrame, scenes: DataFrame, tracks: DataFrame, schema: StructType, dots: Sides, shared: Sides, listed: Sides
) -> DataFrame:
    """Rows of ``schema`` for the inner join of pairs, scenes and tracks by their ids.

    ``dots`` names dot products of two list columns (0 where the lengths differ),
    ``shared`` the number of words in both of two sets and ``listed`` whether a word is in
    a list. Every other column of the schema is one of the scene or of the track.
    """
    spark = pairs.sparkSession
    n_s, n_t = _grid(_bytes(scenes), _bytes(tracks), 2 * spark.sparkContext.defaultParallelism)
    keys = F.array(*[F.lit(k).cast("long") for k in block_keys(spark, n_s * n_t)])

    def block(c: str, n: int) -> Column:
        return F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(n))

    def cell(s: Column, t: Column) -> Column:
        return F.element_at(keys, (s * n_t + t + 1).cast("int"))

    def side(df: DataFrame, part: int, c: str, n: int, others: Column, at) -> DataFrame:
        packed = df.filter(F.col(c).isNotNull()).select(block(c, n).alias("block"), "*").mapInArrow(
            _pack(part, _PACKED), "block long, part int, data binary"
        )
        spread = packed.withColumn("other", F.explode(others))
        return spread.select(at.alias("cell"), "part", "data", F.lit(0).cast("long").alias("s_id"), F.lit(0).cast("long").alias("t_id"))

    numbers = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    block_, other = F.col("block"), F.col("other")
    s_id, t_id = F.col("scene_query_id").cast("long"), F.col("track_query_id").cast("long")
    met = (
        side(scenes, 0, "scene_query_id", n_s, numbers(n_t), cell(block_, other))
        .unionByName(side(tracks, 1, "track_query_id", n_t, numbers(n_s), cell(other, block_)))
        .unionByName(
            pairs.filter(s_id.isNotNull() & t_id.isNotNull()).select(
                cell(block("scene_query_id", n_s), block("track_query_id", n_t)).alias("cell"),
                F.lit(2).alias("part"), F.lit(None).cast("binary").alias("data"), s_id.alias("s_id"), t_id.alias("t_id"),
            )
        )
    )
    target = to_arrow_schema(schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides, held = None, ([], []), None
        for batch in batches:
            cells = np.asarray(batch.column("cell"))
            parts = np.asarray(batch.column("part"))
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(parts) != 0)) + 1
            for rows in np.split(np.arange(batch.num_rows), cuts) if batch.num_rows else []:
                lo, n = int(rows[0]), len(rows)
                if cells[lo] != at:
                    at, sides, held = cells[lo], ([], []), None
                if parts[lo] < 2:
                    data = batch.column("data").slice(lo, n)
                    sides[parts[lo]].extend(pa.ipc.open_stream(d.as_buffer()).read_next_batch() for d in data)
                    continue
                if not sides[0] or not sides[1]:
                    continue
                if held is None:
                    held = _Cell(*[pa.Table.from_batches(s) for s in sides], dots, shared, listed, target.names)
                    sides[0][1:], sides[1][1:] = [], []
                ids = [np.asarray(batch.column(c).slice(lo, n)) for c in ("s_id", "t_id")]
                yield from held.measure(*ids, target)

    dealt = met.repartition(n_s * n_t, "cell").sortWithinPartitions("cell", "part")
    return dealt.mapInArrow(walk, schema)
