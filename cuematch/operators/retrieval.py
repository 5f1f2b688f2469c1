"""Exact nearest-neighbour search and candidate lists.

Three exact ways, same result and same tie-break (distance, then item id):

* ``scan``: the query vectors, after a check of their size, go to every task;
  each task walks its own items once and keeps the k nearest per query, so a
  shuffle moves at most k rows per query and task. Items are never shuffled.
* ``slices``: query vectors beyond the limit are cut by a hash of the id into
  slices that fit it, and each slice is a scan of its own. Items are read once
  per slice and never shuffled. Slices run one after the other, so the driver and
  the tasks hold one of them at a time.
* ``blocks``: where the running results of the queries would not fit a task, or the
  slices would be many. The queries lie in blocks of bounded size, and chunks of
  items are shuffled to every block. A task holds one block and a few chunks and
  finishes its queries, so nothing but the answer leaves it and nothing is merged.

Many tasks would each send k rows per query, nearly all of them far from the
answer. With ``floors`` a first walk over an eighth of the items, chosen by hash,
gives each query two bounds: the k-th best of the sample, which at least k items
surely reach, and a nearer one that about 1.5 k items are expected to reach. The
second walk stores what reaches the sure bound; only what reaches the nearer one
is shuffled, and for the few queries that got less than k that way all their
stored rows. The answer is the same. In ``blocks`` the sampled items come first, and
the k-th best of them is the bound for all others.

NULL item vectors sort last, by id. A query without a vector has no neighbours.
An item vector of another length than the query's has cosine 0 with it.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuematch.functions import vectors as V
from cuematch.operators.cells import block_keys, to_bytes
from cuematch.plans.storage import materialize

_SLACK = 1e-9        # wider than the error of a matrix product in double
_FLOAT_STEP = 2.0**-23  # a product of unit vectors in float is off by less than this for each number
_QUERY_BLOCK = 256   # queries per matrix product inside a task
_PAIR_NUMBERS = 1 << 22  # numbers of pairs whose exact distance is computed at once
_PAIRS = "query_id long, item_id long, distance double"


# --- inside tasks ------------------------------------------------------------

def _lengths(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(column), 0))


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as a matrix of ``width`` numbers, and which rows are missing.

    Rows of another length become zero rows, so their cosine is 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), width))
    good = _lengths(column) == width
    if width and good.any():
        picked = column.filter(pa.array(good))
        out[good] = np.asarray(picked.flatten(), dtype=np.float64).reshape(-1, width)
    return out, np.asarray(column.is_null())


def _by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the filled rows of each length."""
    sizes = _lengths(column)
    for width in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == width)
        yield rows, _matrix(column.take(pa.array(rows)), int(width))[0]


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((m * m).sum(axis=1))
    return m / np.where(norms > 0, norms, 1.0)[:, None], norms


def _summed(m: np.ndarray) -> np.ndarray:
    """Sums of the rows in element order."""
    return np.cumsum(m, axis=1)[:, -1] if m.shape[1] else np.zeros(len(m))


def _exact_distance(q: np.ndarray, x: np.ndarray, nq: np.ndarray, nx: np.ndarray) -> np.ndarray:
    """1 - cosine of paired columns with their norms, summed in element order: equal
    vectors give equal numbers wherever they stand."""
    if not len(nq) or not len(q):
        return np.ones(len(nq))
    dots = q[0] * x[0]
    for a, b in zip(q[1:], x[1:]):
        dots += a * b
    den = nq * nx
    return 1.0 - np.where(den > 0, dots / np.where(den > 0, den, 1.0), 0.0)


def _few_of_each(rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """The rows without those whose vector stands in k rows of smaller id."""
    if len(rows) <= k or not vectors.shape[1]:
        return rows
    bits = (vectors[rows] + 0.0).view(np.uint64)
    odd = np.random.default_rng(vectors.shape[1]).integers(1, 2**63, vectors.shape[1], dtype=np.uint64) | np.uint64(1)
    code = ((bits ^ (bits >> np.uint64(29))) * odd).sum(axis=1)
    order = np.lexsort((ids[rows], code))
    sorted_code = code[order]
    first = np.searchsorted(sorted_code, sorted_code)
    many = np.arange(len(order)) - first >= k
    # equal codes are taken for equal vectors only if they are
    many[many] = (bits[order[many]] == bits[order[first[many]]]).all(axis=1)
    return np.sort(rows[order[~many]])


def _hits(reached: np.ndarray) -> np.ndarray:
    """Flat places of the true cells; eight cells are looked at together, as few are true."""
    flat = reached.ravel()
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64))
    if len(eights) > whole // 64:
        return np.flatnonzero(flat)
    cells = np.flatnonzero(flat[:whole].reshape(-1, 8)[eights])
    return np.concatenate([eights[cells >> 3] * 8 + (cells & 7), whole + np.flatnonzero(flat[whole:])])


def _nearest_order(rows: np.ndarray, dist: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Order by row, distance and item: one sort by row and rounded distance, then what is equal in both."""
    if not len(rows) or int(rows.max()) >= 1 << 24:
        return np.lexsort((items, dist, rows))
    near = (np.clip(dist, -1.0, 3.0) + 1.0) * 2.0**37  # below 2^39 + 1, no rounding out of order
    key = (rows.astype(np.int64) << 40) + near.astype(np.int64)
    order = np.argsort(key)
    key = key[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    if len(same):
        some = np.union1d(same, same + 1)
        tied = order[some]
        order[some] = tied[np.lexsort((items[tied], dist[tied], key[some]))]
    return order


class _Nearest:
    """Running k nearest items of a block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, sure: np.ndarray | None = None):
        self.ids, self.k = ids, k
        self.norms = np.sqrt(_summed(vectors * vectors))
        self.turned = np.ascontiguousarray(vectors.T)
        self.raw = self.turned.T
        self.units = _unit(vectors)[0].astype(np.float32)
        none = np.full(len(ids), -np.inf)
        self.bounded = (none if sure is None else sure) > -np.inf
        self.floor = none if sure is None else sure.copy()  # k-th similarity so far
        self.rows = np.zeros(0, dtype=np.int64)
        self.items = np.zeros(0, dtype=np.int64)
        self.dist = np.zeros(0)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # found since the last trim
        self.waiting = 0

    def add(self, item_ids: np.ndarray, vectors: np.ndarray, missing: np.ndarray) -> None:
        here = _few_of_each(np.flatnonzero(~missing), item_ids, vectors, self.k)
        if len(here):
            x, ids = vectors[here], item_ids[here]
            ux = _unit(x)[0].astype(np.float32)
            norms, turned = np.sqrt(_summed(x * x)), np.ascontiguousarray(x.T)
            slack = _SLACK + (x.shape[1] + 8) * _FLOAT_STEP
            for lo in range(0, len(self.ids), _QUERY_BLOCK):
                hi = min(lo + _QUERY_BLOCK, len(self.ids))
                sims = self.units[lo:hi] @ ux.T
                floor = self.floor[lo:hi]
                hits = _hits(sims >= (floor - slack).astype(np.float32)[:, None])
                if len(hits) > self.k * (hi - lo) and sims.shape[1] > self.k:
                    # a far floor: this chunk alone gives a nearer one
                    at = sims.shape[1] - self.k
                    floor = np.maximum(floor, np.partition(sims, at, axis=1)[:, at] - slack)
                    hits = _hits(sims >= (floor - slack).astype(np.float32)[:, None])
                q, j = np.divmod(hits, sims.shape[1])
                self._take(q + lo, ids, turned, norms, j)
        gone = item_ids[missing]
        if len(gone):
            # Only the k smallest ids without a vector can ever be wanted.
            gone = np.sort(gone)[: self.k]
            free = np.flatnonzero(~self.bounded)  # k items with a vector reach a bound
            q = np.repeat(free, len(gone))
            self._append(q, np.tile(gone, len(free)), np.full(len(q), np.inf))
        if self.waiting > self.k * len(self.ids):
            self._trim()

    def _take(self, q: np.ndarray, ids: np.ndarray, turned: np.ndarray, norms: np.ndarray, j: np.ndarray) -> None:
        """Exact distances of the pairs, a bounded number at a time, and the k best of each query.

        ``turned`` holds the items as columns: a number of all items is in the cache when it is looked up.
        """
        if not len(q):
            return
        part = max(1, _PAIR_NUMBERS // max(1, len(turned)))
        cuts = [(q[i : i + part], j[i : i + part]) for i in range(0, len(q), part)]
        columns = lambda m, at: np.take(m, at, axis=1)
        dist = np.concatenate([
            _exact_distance(columns(self.turned, a), columns(turned, b), self.norms[a], norms[b]) for a, b in cuts
        ])
        items = ids[j]
        if np.bincount(q - q[0]).max() > self.k:
            order = _nearest_order(q, dist, items)
            rows = q[order]
            keep = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k]
            q, items, dist = q[keep], items[keep], dist[keep]
        self._append(q, items, dist)

    def _append(self, rows: np.ndarray, items: np.ndarray, dist: np.ndarray) -> None:
        self.parts.append((rows, items, dist))
        self.waiting += len(rows)

    def _trim(self) -> None:
        rows, items, dist = (np.concatenate(c) for c in zip((self.rows, self.items, self.dist), *self.parts))
        self.parts, self.waiting = [], 0
        order = _nearest_order(rows, dist, items)
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(self.ids)))[rows]
        kept = place < self.k
        self.rows, order, place = rows[kept], order[kept], place[kept]
        self.items, self.dist = items[order], dist[order]
        full = place == self.k - 1
        last = self.rows[full]
        self.floor[last] = np.maximum(self.floor[last], 1.0 - self.dist[full])

    def result(self) -> pa.RecordBatch:
        self._trim()
        dist = pa.array(self.dist, mask=np.isinf(self.dist))
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[self.rows]), pa.array(self.items), dist],
            names=["query_id", "item_id", "distance"],
        )


# --- plans -------------------------------------------------------------------

def _narrow(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))


def _top_k(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(*_order())
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _order():
    return F.col("distance").asc_nulls_last(), F.col("item_id").asc()


def _collect_lists(df: DataFrame) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """(ids, matrix) per length, per vector column, without the rows that lack the vector."""
    table = df.toArrow()
    ids = np.asarray(table.column(0), dtype=np.int64)
    columns = [table.column(no).combine_chunks() for no in range(1, table.num_columns)]
    return [[(ids[rows], matrix) for rows, matrix in _by_width(column)] for column in columns]


def vector_bytes(df: DataFrame, *vec_cols: str) -> int:
    """Size of the vectors as doubles and of an id per row, found by one narrow aggregate."""
    return query_size(df, *vec_cols)[1]


_MERGE_WIDTH = 64   # tasks whose results are merged first
_SAMPLED = 8        # one item in so many gives the floors
_MANY_TASKS = 16    # from here on floors are worth a second walk

# (list number, query ids, vectors, k, sure bounds, near bounds)
Lists = list[tuple[int, np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]


def _lists(queries: DataFrame, ks: list[int]) -> Lists:
    some = functools.reduce(operator.or_, [V.is_filled(F.col(c)) for c in queries.columns[1:]])
    sides = enumerate(zip(_collect_lists(queries.filter(some)), ks))
    open_ = lambda ids: np.full(len(ids), -np.inf)
    return [(no, ids, m, k, open_(ids), open_(ids)) for no, (found, k) in sides for ids, m in found]


def _hoped(k: int) -> int:
    """The place in the sample that stands for a little more than k items of all."""
    share = k / _SAMPLED
    return int(np.ceil(share + 2 * np.sqrt(share) + 1))


def _with_floors(lists: Lists, items: DataFrame) -> Lists:
    """The lists with bounds from a walk over one item in ``_SAMPLED``."""
    shared = items.sparkSession.sparkContext.broadcast(lists)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(no, _Nearest(ids, vectors, k)) for no, ids, vectors, k, *_ in shared.value]
        for batch in batches:
            ids = np.asarray(batch.column(0), dtype=np.int64)
            for no, found in best:
                matrix, missing = _matrix(batch.column(no + 1), found.raw.shape[1])
                found.add(ids[~missing], matrix[~missing], missing[~missing])
        group = TaskContext.get().partitionId() // _MERGE_WIDTH
        for no, found in best:
            out = found.result()
            rows = pa.table({"at": found.rows, "sim": 1.0 - out.column("distance").to_numpy(zero_copy_only=False)})
            packed = rows.group_by("at", use_threads=False).aggregate([("sim", "list")])
            n = packed.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, no, np.int32)), pa.array(np.full(n, group, np.int32)),
                 pa.array(found.ids[packed.column("at").to_numpy()]), packed.column("sim_list").combine_chunks()],
                names=["list_no", "task_group", "query_id", "sims"],
            )

    ks = {no: k for no, _ids, _m, k, *_ in lists}
    most = F.element_at(F.create_map(*[F.lit(x) for no, k in ks.items() for x in (no, k)]), F.col("list_no"))
    best = lambda c: F.slice(F.sort_array(F.flatten(F.collect_list(c)), asc=False), F.lit(1), F.first(most))
    sampled = items.filter(F.pmod(F.xxhash64("id"), F.lit(_SAMPLED)) == 0)
    found = sampled.mapInArrow(walk, "list_no int, task_group int, query_id long, sims array<double>")
    merged = found.groupBy("list_no", "query_id", "task_group").agg(best("sims").alias("sims"))
    merged = merged.groupBy("list_no", "query_id").agg(best("sims").alias("sims"))
    hoped = F.element_at(F.create_map(*[F.lit(x) for no, k in ks.items() for x in (no, _hoped(k))]), F.col("list_no"))
    bounds = merged.select(
        "list_no", "query_id", F.get("sims", most - 1).alias("sure"), F.get("sims", F.least(hoped, most) - 1).alias("near")
    ).collect()  # two numbers per query of a list that was broadcast
    shared.destroy()
    known = {(r["list_no"], r["query_id"]): (r["sure"], r["near"]) for r in bounds if r["sure"] is not None}
    out = []
    for no, ids, vectors, k, *_ in lists:
        pairs = [known.get((no, int(i)), (-np.inf, -np.inf)) for i in ids]
        sure, near = np.array(pairs, dtype=np.float64).reshape(-1, 2).T
        out.append((no, ids, vectors, k, sure - _SLACK, near - _SLACK))
    return out


def _walked(lists: Lists, items: DataFrame):
    """(rows, broadcast) of one walk over the items: at most k rows per list, query and task."""
    shared = items.sparkSession.sparkContext.broadcast(lists)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(no, _Nearest(ids, vectors, k, sure), near) for no, ids, vectors, k, sure, near in shared.value]
        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            item_ids = np.asarray(batch.column(0), dtype=np.int64)
            for no, nearest_items, _near in best:
                matrix, missing = _matrix(batch.column(no + 1), nearest_items.raw.shape[1])
                nearest_items.add(item_ids, matrix, missing)
        group = TaskContext.get().partitionId() // _MERGE_WIDTH
        for no, nearest_items, near in best:
            if seen:
                out = nearest_items.result()
                n = out.num_rows
                is_near = nearest_items.dist <= 1.0 - near[nearest_items.rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, no, dtype=np.int32)), pa.array(np.full(n, group, dtype=np.int32)),
                     *out.columns, pa.array(is_near)],
                    names=["list_no", "task_group", *out.schema.names, "near"],
                )

    return items.mapInArrow(walk, "list_no int, task_group int, " + _PAIRS + ", near boolean"), shared


def _merged(found: DataFrame, ks: list[int]) -> DataFrame:
    """With very many tasks a query gets k rows from each: groups of tasks are
    merged first, so no single sort sees them all."""
    limits = F.element_at(F.array(*[F.lit(k) for k in ks]), F.col("list_no") + 1)
    group = Window.partitionBy("list_no", "query_id", "task_group").orderBy(*_order())
    return (
        found.withColumn("place", F.row_number().over(group))
        .filter(F.col("place") <= limits)
        .drop("place", "task_group", "near")
    )


def _many_tasks(items: DataFrame) -> bool:
    """Whether a walk over the items takes many tasks, by the size its plan expects."""
    spark = items.sparkSession
    size = int(str(items._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    part = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    return size >= _MANY_TASKS * part


def _near_rows(lists: Lists, items: DataFrame) -> DataFrame:
    """Rows of a walk with floors that can still be wanted; the walk's own rows are stored."""
    walked, shared = _walked(_with_floors(lists, items), items)
    stored = materialize(walked, "walked")
    shared.destroy()
    counts = stored.filter("near").groupBy("list_no", "query_id").count()
    enough = {(r["list_no"], r["query_id"]): r["count"] for r in counts.collect()}  # a number per query of the broadcast lists
    short = [(no, int(i)) for no, ids, _m, k, *_ in lists for i in ids if enough.get((no, int(i)), 0) < k]
    if not short:
        return stored.filter("near")
    few = stored.sparkSession.createDataFrame(short, "list_no int, query_id long").withColumn("short", F.lit(True))
    return stored.join(F.broadcast(few), ["list_no", "query_id"], "left").filter("near or short").drop("short")


def _scan_lists(queries: DataFrame, ks: list[int], items: DataFrame, floors: bool | None = None) -> DataFrame:
    """One search of the items for several lists.

    ``queries`` and ``items`` hold id and one vector column per list, in the
    same order; ``ks`` the number of neighbours of each. A query without a
    vector takes no part in that list. Returns (list_no, query_id, item_id,
    distance) with at most k rows per list, query and group of tasks.
    """
    lists = _lists(queries, ks)
    if floors if floors is not None else _many_tasks(items):
        return _merged(_near_rows(lists, items), ks)
    return _merged(_walked(lists, items)[0], ks)


def _scan(queries: DataFrame, items: DataFrame, k: int, floors: bool | None = None) -> DataFrame:
    return _top_k(_scan_lists(queries, [k], items, floors).drop("list_no"), k)


# --- blocks ------------------------------------------------------------------

_BLOCK_BYTES = 160 << 20  # running results and vectors of the queries of one block
_HELD_BYTES = 64 << 20    # running results of all queries up to which each task may hold them
_ROW_BYTES = 128          # of running results, for each neighbour wanted
_MOST_SLICES = 8          # beyond so many walks the items go to blocks of queries
_CHUNK = 2048             # items that travel as one row
_BLOCKS = "block long, part int, data binary"
_RANKED = "list_no int, " + _PAIRS + ", rank int"
_PLACED = "query_id long, item_id long, place int"


def query_size(df: DataFrame, *vec_cols: str) -> tuple[int, int]:
    """Rows, and :func:`vector_bytes`, by one narrow aggregate."""
    numbers = sum((F.greatest(F.size(c), F.lit(0)) for c in vec_cols or ("vec",)), F.lit(1))
    row = df.agg(F.count("*").alias("rows"), F.sum(numbers).alias("n")).first()
    return row["rows"], int(row["n"] or 0) * 8


def route(rows: int, size: int, ks: list[int], limit_bytes: int) -> str:
    """How to search for ``rows`` queries whose vectors take ``size`` bytes."""
    if rows * sum(ks) * _ROW_BYTES > _HELD_BYTES:
        return "blocks"
    return "scan" if size <= limit_bytes else "slices"


def _slices(size: int, limit_bytes: int) -> int:
    return max(1, -(-2 * size // max(1, limit_bytes)))


def _union_of_block(lists: list[tuple], limit: int) -> Iterator[pa.RecordBatch]:
    """:func:`union_candidates` of the (list number, query ids, items, distances, ranks) of whole queries."""
    if not lists:
        return
    ids, items, rank = (np.concatenate([found[c] for found in lists]) for c in (1, 2, 4))
    source = np.concatenate([np.full(len(found[1]), found[0]) for found in lists])
    order = np.lexsort((rank, source, items, ids))
    again = (np.diff(ids[order]) == 0) & (np.diff(items[order]) == 0)
    order = order[np.concatenate([[True], ~again])] if len(order) else order
    order = order[np.lexsort((rank[order], source[order], ids[order]))]
    ids, items = ids[order], items[order]
    place = np.arange(len(ids)) - np.searchsorted(ids, ids) + 1
    kept = place <= limit
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids[kept]), pa.array(items[kept]), pa.array(place[kept].astype(np.int32))],
        names=["query_id", "item_id", "place"],
    )


def _block_lists(
    queries: DataFrame, ks: list[int], items: DataFrame, floors: bool = False, size: tuple[int, int] | None = None,
    union_limit: int | None = None,
) -> DataFrame:
    """(list_no, query_id, item_id, distance, rank) of all queries, block by block; with
    ``union_limit`` the union of a query's lists, (query_id, item_id, place).

    ``queries``, ``items`` and ``ks`` are as in :func:`_scan_lists`. Every block is
    met by all items, so the work is rows times items, and what is shuffled is the
    items once per block.
    """
    spark = items.sparkSession
    rows, numbers = size or query_size(queries, *queries.columns[1:])
    needed = -(-(rows * sum(ks) * _ROW_BYTES + 3 * numbers) // _BLOCK_BYTES)
    n = max(1, needed, min(2 * spark.sparkContext.defaultParallelism, -(-rows // _QUERY_BLOCK)))
    keys = block_keys(spark, n)

    def pack(part: int, by_block: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = np.arange(batch.num_rows)
                if by_block:
                    at = np.asarray(batch.column(0))
                    rows = np.argsort(at, kind="stable")
                    at, cuts = np.unique(at[rows], return_index=True)
                    batch = batch.select(batch.schema.names[1:])
                else:
                    cuts = rows[::_CHUNK]
                    at = np.zeros(len(cuts), dtype=np.int64)
                # taken, as slices of lists cannot be written
                data = [to_bytes(batch.take(pa.array(some))) for some in np.split(rows, cuts[1:])]
                parts = pa.array(np.full(len(data), part, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int64()), parts, pa.array(data, pa.binary())], names=["block", "part", "data"]
                )

        return run

    some = functools.reduce(operator.or_, [V.is_filled(F.col(c)) for c in queries.columns[1:]])
    block = F.element_at(F.array(*[F.lit(k).cast("long") for k in keys]), (F.pmod(F.xxhash64("id"), F.lit(n)) + 1).cast("int"))
    met = queries.filter(some).select(block.alias("block"), "*").mapInArrow(pack(0, True), _BLOCKS)
    sampled = F.pmod(F.xxhash64("id"), F.lit(_SAMPLED)) == 0
    sides = [(1, items.filter(sampled)), (2, items.filter(~sampled))] if floors else [(2, items)]
    everywhere = F.explode(F.array(*[F.lit(k).cast("long") for k in keys]))
    for part, side in sides:
        packed = side.mapInArrow(pack(part, False), _BLOCKS).withColumn("block", everywhere)
        met = met.unionByName(packed)

    def ranked(lists) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for no, k in enumerate(ks):
            found = [nearest_items.result() for at, nearest_items in lists if at == no]
            if not found:
                continue
            table = pa.Table.from_batches(found)
            ids, items_, dist = (table.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            dist = np.where(np.isnan(dist), np.inf, dist)
            order = np.lexsort((items_, dist, ids))
            ids = ids[order]
            rank = np.arange(len(ids)) - np.searchsorted(ids, ids)
            kept = rank < k  # rows of one id count as one query
            order, ids, rank = order[kept], ids[kept], rank[kept]
            yield no, ids, items_[order], dist[order], rank + 1

    def finish(lists) -> Iterator[pa.RecordBatch]:
        if union_limit is not None:
            yield from _union_of_block(list(ranked(lists)), union_limit)
            return
        for no, ids, items_, dist, rank in ranked(lists):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), no, dtype=np.int32)), pa.array(ids), pa.array(items_),
                 pa.array(dist, mask=np.isinf(dist)), pa.array(rank.astype(np.int32))],
                names=["list_no", "query_id", "item_id", "distance", "rank"],
            )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last, waiting, lists = None, None, [], []

        def open_lists():
            table = pa.Table.from_batches(waiting)
            waiting.clear()
            ids = np.asarray(table.column(0), dtype=np.int64)
            for no, k in enumerate(ks):
                column = table.column(no + 1).combine_chunks()
                lists.extend((no, _Nearest(ids[rows], matrix, k)) for rows, matrix in _by_width(column))

        for batch in batches:
            for at, part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if at != block:
                    yield from finish(lists)
                    lists.clear()
                    waiting.clear()
                    block = at
                elif part == 2 and last == 1:
                    for _no, nearest_items in lists:
                        nearest_items._trim()  # from here on the sample's k-th best is the floor
                last = part
                chunk = pa.ipc.open_stream(data.as_buffer()).read_next_batch()
                if part == 0:
                    waiting.append(chunk)
                    continue
                if waiting:
                    open_lists()
                ids = np.asarray(chunk.column(0), dtype=np.int64)
                matrices = {}
                for no, nearest_items in lists:
                    width = nearest_items.raw.shape[1]
                    if (no, width) not in matrices:
                        matrices[no, width] = _matrix(chunk.column(no + 1), width)
                    nearest_items.add(ids, *matrices[no, width])
        yield from finish(lists)

    dealt = met.repartition(n, "block").sortWithinPartitions("block", "part")
    return dealt.mapInArrow(walk, _RANKED if union_limit is None else _PLACED)


def _sliced_lists(
    queries: DataFrame, ks: list[int], items: DataFrame, limit_bytes: int, floors: bool | None = None
) -> DataFrame:
    """:func:`_scan_lists` once per slice of the queries; a slice is about half the limit.

    Each slice is walked and stored before the next one is read.
    """
    slices = _slices(vector_bytes(queries, *queries.columns[1:]), limit_bytes)
    number = F.pmod(F.xxhash64("id"), F.lit(slices))
    floors = _many_tasks(items) if floors is None else floors
    found = []
    for s in range(slices):
        lists = _lists(queries.filter(number == s), ks)
        if not lists:
            continue
        if floors:
            found.append(materialize(_merged(_near_rows(lists, items), ks), "slice"))
            continue
        walked, shared = _walked(lists, items)
        found.append(materialize(_merged(walked, ks), "slice"))
        shared.destroy()
    if not found:
        return _merged(_walked([], items)[0], ks)
    return functools.reduce(DataFrame.unionByName, found)


def nearest(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    query_vec: str = "embedding_hybrid",
    item_vec: str | None = None,
    query_id: str = "id",
    item_id: str = "id",
    limit_bytes: int = 64 << 20,
    method: str | None = None,
    floors: bool | None = None,
) -> DataFrame:
    """The k nearest items of every query: (query_id, item_id, distance, rank).

    ``method`` forces ``"scan"``, ``"slices"`` or ``"blocks"``; by default the size of
    the query vectors and of their results decides, and too many slices become
    blocks (see :func:`route`). ``floors`` forces the walk for bounds or leaves it
    out; by default the expected number of tasks decides.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    q = _narrow(queries, query_id, query_vec).filter(V.is_filled(F.col("vec")))
    x = _narrow(items, item_id, item_vec or query_vec)
    size = None
    if method in (None, "slices"):
        size = query_size(q)
        wanted = route(*size, [k], limit_bytes)
        method = "blocks" if wanted == "blocks" else method or wanted
        if method == "slices" and _slices(size[1], limit_bytes) > _MOST_SLICES:
            method = "blocks"
    if method == "blocks":
        return _block_lists(q, [k], x, bool(floors), size).drop("list_no")
    if method == "scan":
        return _scan(q, x, k, floors)
    return _top_k(_sliced_lists(q, [k], x, limit_bytes, floors).drop("list_no"), k)


def nearest_of_few(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    query_vec: str,
    item_vec: str,
    query_id: str = "id",
    item_id: str = "id",
    limit_bytes: int = 64 << 20,
) -> DataFrame:
    """k nearest items when the items are few, such as the tag vectors.

    Every task holds all items, so each query is finished where it lies: no
    shuffle. Falls back to :func:`nearest` when the items are too large.
    """
    few = _narrow(items, item_id, item_vec)
    if vector_bytes(few) > limit_bytes:
        return nearest(queries, items, k, query_vec, item_vec, query_id, item_id, limit_bytes)
    spark = queries.sparkSession
    table = few.toArrow()
    item_ids = np.asarray(table.column("id"), dtype=np.int64)
    shared = spark.sparkContext.broadcast((item_ids, table.column("vec").combine_chunks()))

    def walk(batches):
        ids, column = shared.value
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            query_ids = np.asarray(batch.column(0), dtype=np.int64)
            for at, q in _by_width(batch.column(1)):
                if q.shape[1] not in known:
                    known[q.shape[1]] = _matrix(column, q.shape[1])
                best = _Nearest(query_ids[at], q, k)
                best.add(ids, *known[q.shape[1]])
                done = best.result()
                rows = best.rows
                first = np.searchsorted(rows, np.arange(len(best.ids)))
                rank = np.arange(len(rows)) - first[rows] + 1
                yield pa.RecordBatch.from_arrays(
                    [*done.columns, pa.array(rank.astype(np.int32))],
                    names=["query_id", "item_id", "distance", "rank"],
                )

    q = _narrow(queries, query_id, query_vec).filter(V.is_filled(F.col("vec")))
    return q.mapInArrow(walk, _PAIRS + ", rank int")


def union_candidates(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """First list in rank order, then the unseen of the second, cut at ``limit``.

    Both are (query_id, item_id, distance, rank); ``place`` is the new order.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    both = first.select("query_id", "item_id", F.lit(0).alias("source"), "rank").unionByName(
        second.select("query_id", "item_id", F.lit(1).alias("source"), "rank")
    )
    return _merge_lists(both.repartition("query_id"), limit)


def _merge_lists(both: DataFrame, limit: int) -> DataFrame:
    """Of an item in both lists the earlier place counts; then cut.

    The rows are already partitioned by query, which serves both windows; each
    list holds at most k rows per query.
    """
    seen = Window.partitionBy("query_id", "item_id").orderBy("source", "rank")
    order = Window.partitionBy("query_id").orderBy("source", "rank")
    return (
        both.withColumn("copy", F.row_number().over(seen))
        .filter(F.col("copy") == 1)
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= limit)
        .select("query_id", "item_id", "source", "rank", "place")
    )


def candidates(
    scenes: DataFrame, tracks: DataFrame, config, method: str | None = None, floors: bool | None = None
) -> DataFrame:
    """Candidate (scene_query_id, track_query_id, place) of every scene.

    The nearest by hybrid vector come first, then unseen ones by ensemble
    vector. Both vectors are read in one walk over the tracks, for all scenes or
    for each slice of them that fits the broadcast limit.
    """
    k_hybrid, k_ensemble = config.candidate_pool_hybrid, config.candidate_pool_ensemble
    by = ["embedding_hybrid", "embedding_clap_ensemble"]
    narrow = [F.col("id").cast("long").alias("id"), *by]
    sides, ks = (scenes.select(*narrow), tracks.select(*narrow)), [k_hybrid, k_ensemble]
    size = None
    if method in (None, "slices"):
        size = query_size(scenes, *by)
        wanted = route(*size, ks, config.broadcast_limit_bytes)
        method = "blocks" if wanted == "blocks" else method or wanted
        if method == "slices" and _slices(size[1], config.broadcast_limit_bytes) > _MOST_SLICES:
            method = "blocks"
    if method == "blocks":
        union = _block_lists(sides[0], ks, sides[1], bool(floors), size, config.candidate_union_limit)
    else:
        if method == "scan":
            found = _scan_lists(sides[0], ks, sides[1], floors)
        else:
            found = _sliced_lists(sides[0], ks, sides[1], config.broadcast_limit_bytes, floors)
        found = found.repartition("query_id")
        limits = F.when(F.col("list_no") == 0, k_hybrid).otherwise(k_ensemble)
        order = Window.partitionBy("query_id", "list_no").orderBy(*_order())
        both = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limits)
        union = _merge_lists(both.withColumnRenamed("list_no", "source"), config.candidate_union_limit)
    return union.select(
        F.col("query_id").alias("scene_query_id"), F.col("item_id").alias("track_query_id"), "place"
    )
