"""Merkle manifest of a dataset: one tree per source and one over the sources, with kept hash states.

A leaf is the hash of a row's columns. Rows are ordered by (source, id, leaf) in
one range partitioned sort; nodes of a source are hashed in runs of ``arity``
until one is left, its subroot, and the subroots in the order of their sources
likewise, up to the root. A digest as hex text is one block of the hash, so what
a parent's hash holds before a child slot is eight numbers. The manifest keeps
them beside each child. Folding a changed child needs the kept state at its slot,
the new digest and the siblings to the right only; nothing to the left is read.

A task turns up to ``arity ** LEVELS`` neighbouring nodes into one (a block), so
ten thousand million leaves take three shuffles up, and a source with a third of
all rows is many blocks. Proofs go down the same way: a block's way to the root
is found once, and its rows add their own way within the block.

Nulls: each null column is ``-`` in the leaf; a null source is the first source,
a null id the first of its source. An empty text is no null text. Rows that
repeat are leaves of their own. A lone leaf is its source's subroot, a lone
subroot the root. Very long texts are hashed whole. An empty table has no rows,
no sources and a null root. Columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType, VariantType

from cuematch.llm import sha
from cuematch.llm.sharding import numbered
from cuematch.llm.words import trimmed
from cuematch.plans.storage import materialize

LEVELS = 7
BATCH = 1 << 14
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf(docs: DataFrame, columns: list[str] | None = None, changed: dict[str, Column] | None = None) -> Column:
    """Hex digest of the columns in order, each ``-`` or its UTF-8 length, ``:`` and value."""

    def part(name: str) -> Column:
        col = (changed or {}).get(name, F.col(f"`{name}`"))
        kind = docs.schema[name].dataType
        if isinstance(kind, (StructType, MapType, VariantType)):
            col = F.to_json(col)
        value = col.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in columns or COLUMNS]).cast("binary"), 256)


def _runs(block: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """For rows sorted by (block, place): the number of the run each one belongs to."""
    return np.cumsum(np.concatenate(([True], (slot[1:] == 0) | (block[1:] != block[:-1])))) - 1


def _hashed_runs(digest: np.ndarray, run: np.ndarray, slot: np.ndarray, arity: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs' digests, and the state before each of the given nodes."""
    state = np.tile(sha.START, (run[-1] + 1, 1))
    before = np.empty((len(run), 8), np.uint32)
    for s in range(arity):
        at = np.flatnonzero(slot == s)
        before[at] = state[run[at]]
        state[run[at]] = sha.absorb(state[run[at]], sha.hex_block(digest[at]))
    return sha.finish(state, np.bincount(run)), before


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = BATCH) -> Iterator[pa.Table]:
    """Tables of about ``least`` rows or more that do not cut a group of equal keys; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        last = np.ones(rows, bool)
        for k in keys:
            values = table.column(k).to_numpy()
            last &= values == values[-1]
        cut = rows - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut).combine_chunks().to_batches()
        held, rows = rest, sum(map(len, rest))
    if held:
        yield pa.Table.from_batches(held)


def _builder(arity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted (tree, block, place, n, digest) to one row per block: its digest and its levels.

    A level is the digests of a block's nodes and the states before them, 64 bytes a node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["tree", "block"]):
            tree, group, place, left = (table.column(c).to_numpy() for c in ("tree", "block", "place", "n"))
            digest = _matrix(table.column("digest"))
            new = np.concatenate(([True], (tree[1:] != tree[:-1]) | (group[1:] != group[:-1])))
            first, block = np.flatnonzero(new), np.cumsum(new) - 1
            final = np.empty((len(first), 32), np.uint8)
            kept: list[list[bytes]] = [[] for _ in first]
            place = place % arity**LEVELS
            for _level in range(LEVELS + 1):
                going = left > 1 if _level < LEVELS else np.zeros(len(left), bool)
                final[block[~going]] = digest[~going]
                digest, block, place, left = digest[going], block[going], place[going], left[going]
                if not len(block):
                    break
                slot = place % arity
                run_of = _runs(block, slot)
                up, before = _hashed_runs(digest, run_of, slot, arity)
                nodes = np.concatenate([digest, sha.as_bytes(before)], axis=1)
                starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
                for a, z in zip(starts, [*starts[1:], len(block)], strict=True):
                    kept[block[a]].append(nodes[a:z].tobytes())
                heads = np.flatnonzero(np.concatenate(([True], run_of[1:] != run_of[:-1])))
                digest, block, place, left = up, block[heads], place[heads] // arity, -(-left[heads] // arity)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree[first]), pa.array(group[first]), _binary(final), pa.array(kept, pa.list_(pa.binary()))],
                names=["tree", "block", "digest", "levels"],
            )

    return run


def _after(n: Column, size: int) -> Column:
    """How many nodes are left where there were n."""
    return F.ceil(n / F.lit(size)).cast("long")


@dataclass
class Tree:
    """Nodes (tree, place, n, digest and others) and the blocks above them, one table per step."""

    leaves: DataFrame
    steps: list[DataFrame]
    arity: int

    @property
    def size(self) -> int:
        return self.arity**LEVELS

    def roots(self) -> DataFrame:
        """(tree, digest) of every tree."""
        done = [s.where("n = 1").select("tree", "digest") for s in self.steps]
        out = done[0]
        for d in done[1:]:
            out = out.unionByName(d)
        return out


def grow(leaves: DataFrame, arity: int, name: str) -> Tree:
    """Trees over stored rows (tree, place from 0, n rows of the tree, digest)."""
    steps: list[DataFrame] = []
    nodes, size = leaves.select("tree", "place", "n", "digest"), arity**LEVELS
    while True:
        dealt = nodes.withColumn("block", F.floor(F.col("place") / F.lit(size)))
        counts = dealt.where("block = 0 and place = 0").select("tree", _after(F.col("n"), size).alias("n"))
        built = (
            dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
            .select("tree", "block", "place", "n", "digest")
            .mapInArrow(trimmed(_builder(arity)), "tree long, block long, digest binary, levels array<binary>")
        )
        steps.append(materialize(built.join(counts, "tree"), name))
        nodes = steps[-1].where("n > 1").select("tree", F.col("block").alias("place"), "n", "digest")
        if nodes.isEmpty():
            return Tree(leaves, steps, arity)


def _way(arity: int, carried: list[str], replaced: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by (tree, block, place), each block's own row first (place -1), to the rows with their way to the root.

    ``proof``: the siblings as hex text, level by level. ``way``: for each level
    the state before the node, and its right siblings. With ``replaced``: the
    ``folded`` root if the node had the digest in ``replacement``, in place of ``way``.
    """
    unit = 33 + 32 * (arity - 1)  # run length, state, right siblings

    def levels_of(table: pa.Table, own: np.ndarray) -> list[list[np.ndarray]]:
        parts = table.column("levels").take(pa.array(own)).to_pylist()
        return [[np.frombuffer(x, np.uint8).reshape(-1, 64) for x in p or []] for p in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["tree", "block"]):
            place = table.column("place").to_numpy()
            own = np.flatnonzero(place < 0)
            rows = np.flatnonzero(place >= 0)
            block = (np.cumsum(place < 0) - 1)[rows]
            kept = levels_of(table, own)
            depth = max((len(k) for k in kept), default=0)
            at, records, proofs = place[rows] % arity**LEVELS, [], []
            for level in range(depth):
                sizes = np.array([len(k[level]) if level < len(k) else 0 for k in kept])
                nodes = np.concatenate([k[level] for k in kept if level < len(k)])
                base = np.cumsum(sizes) - sizes
                here = sizes[block] > 0
                slot = np.where(here, at % arity, 0)
                record = np.zeros((len(rows), unit), np.uint8)
                proof = np.zeros((len(rows), arity, 64), np.uint8)
                node = np.where(here, base[block] + at, 0)
                width = np.where(here, np.minimum(sizes[block] - (at - slot), arity), 0)
                record[:, 0] = width
                record[:, 1:33] = nodes[node, 32:]
                for s in range(arity):
                    other = np.flatnonzero((s < width) & (s != slot))
                    found = nodes[node[other] - slot[other] + s, :32]
                    proof[other, s] = sha.hex_text(found)
                    right = s > slot[other]
                    for d in range(1, arity):
                        to = right & (s - slot[other] == d)
                        record[other[to], 33 + 32 * (d - 1) : 33 + 32 * d] = found[to]
                records.append(np.concatenate([record, slot[:, None].astype(np.uint8)], axis=1))
                proofs.append(proof)
                at = at // arity
            upper = [table.column(c).take(pa.array(own)).to_pylist() for c in ("up_proof", "up_way")]
            mine = np.stack(proofs, 1).reshape(len(rows), -1) if depth else np.zeros((len(rows), 0), np.uint8)
            proof = [m[m > 0].tobytes() + upper[0][b] for m, b in zip(mine, block, strict=True)]
            part = table.take(pa.array(rows))
            out = [part.column(c).combine_chunks() for c in carried] + [pa.array(proof, pa.binary())]
            if replaced:
                steps = [np.frombuffer(w, np.uint8).reshape(-1, unit + 1) for w in upper[1]]
                folded = _matrix(part.column("replacement"))
                for record in records:
                    folded = _folded(folded, record, arity)
                for level in range(max(map(len, steps), default=0)):
                    table_of = np.zeros((len(own), unit + 1), np.uint8)
                    for i, s in enumerate(steps):
                        if level < len(s):
                            table_of[i] = s[level]
                    folded = _folded(folded, table_of[block], arity)
                out.append(_binary(folded))
            else:
                own_way = np.stack(records, 1) if records else np.zeros((len(rows), 0, unit + 1), np.uint8)
                out.append(pa.array([w[w[:, 0] > 0].tobytes() + upper[1][b] for w, b in zip(own_way, block, strict=True)], pa.binary()))
            names = [*carried, "proof", "folded" if replaced else "way"]
            for batch in pa.table(dict(zip(names, out, strict=True))).to_batches(2048):
                yield batch

    return run


def _folded(digest: np.ndarray, record: np.ndarray, arity: int) -> np.ndarray:
    """Digests one level up: the kept state goes on with the digest and what is right of it."""
    width, slot = record[:, 0].astype(np.int64), record[:, -1].astype(np.int64)
    going = np.flatnonzero(width)
    if not len(going):
        return digest
    state = sha.absorb(sha.as_state(record[going, 1:33]), sha.hex_block(digest[going]))
    rights = (width - slot)[going] - 1
    for d in range(arity - 1):
        more = np.flatnonzero(rights > d)
        if len(more):
            state[more] = sha.absorb(state[more], sha.hex_block(record[going[more], 33 + 32 * d : 65 + 32 * d]))
    out = digest.copy()
    out[going] = sha.finish(state, width[going])
    return out


def descend(tree: Tree, tops: DataFrame, carried: list[str], replaced: bool, name: str) -> DataFrame:
    """Each leaf's ``carried`` columns with proof and way (or folded root); ``tops`` has each tree's own (tree, proof, way)."""
    above: DataFrame | None = None
    for i in reversed(range(len(tree.steps))):
        blocks = tree.steps[i]
        ended = blocks.where("n = 1").join(tops, "tree").select("tree", "block", F.col("proof").alias("up_proof"), F.col("way").alias("up_way"), "levels")
        if above is not None:
            up = above.select("tree", F.col("place").alias("block"), F.col("proof").alias("up_proof"), F.col("way").alias("up_way"))
            ended = ended.unionByName(blocks.where("n > 1").join(up, ["tree", "block"]).select(*ended.columns))
        last = i == 0
        nodes = tree.leaves if last else tree.steps[i - 1].where("n > 1").withColumn("place", F.col("block"))
        columns = carried if last else ["tree", "place"]
        rows = nodes.select(
            *dict.fromkeys(["tree", "place", *columns, *(["replacement"] if last and replaced else [])]),
        ).withColumn("block", F.floor(F.col("place") / F.lit(tree.size)))
        mixed = rows.unionByName(ended.withColumn("place", F.lit(-1).cast("long")), allowMissingColumns=True)
        sent = mixed.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
        end = "folded" if last and replaced else "way"
        schema = StructType([f for c in columns for f in rows.schema.fields if f.name == c]).add("proof", "binary").add(end, "binary")
        above = sent.mapInArrow(trimmed(_way(tree.arity, columns, last and replaced)), schema)
    return above


@dataclass
class Manifest:
    """Stored trees of the sources and of their subroots; ``root`` is hex text, or None without rows."""

    sources: Tree
    top: Tree
    root: str | None

    def proofs(self) -> DataFrame:
        """id, source, leaf, subroot, proof (hex text of the siblings, leaf to root), folded (root with ``replacement``)."""
        tops = descend(self.top, self.top.leaves.sparkSession.createDataFrame([(0, b"", b"")], "tree long, proof binary, way binary"),
                       ["source_tree", "digest"], False, "top")
        tops = materialize(tops.withColumnRenamed("source_tree", "tree"), "merkle-tops")
        out = descend(self.sources, tops.drop("digest"), ["tree", "id", "source", "digest"], True, "sources")
        subroots = tops.select("tree", F.lower(F.hex("digest")).alias("subroot"))
        return out.join(subroots, "tree").select(
            "id", "source", F.lower(F.hex("digest")).alias("leaf"), "subroot", F.lit(self.root).alias("root"),
            F.col("proof").cast("string").alias("proof"), F.lower(F.hex("folded")).alias("folded"),
        )


def manifest(
    docs: DataFrame, id_: str = "doc_id", source: str = "source", columns: list[str] | None = None,
    replacement: Column | None = None, arity: int = 3,
) -> Manifest:
    """The manifest of all rows; ``replacement`` is the leaf digest (hex) that folding puts in a leaf's place."""
    own = leaf(docs, columns)
    rows = docs.select(
        F.col(f"`{source}`").alias("source"), F.col(f"`{id_}`").alias("id"), own.alias("leaf"),
        F.unhex(own).alias("digest"), F.unhex(own if replacement is None else replacement).alias("replacement"),
    )
    rows = materialize(rows, "merkle-rows")  # else finding the sort's ranges hashes the texts once more
    placed, _n = numbered(rows, ["source", "id", "leaf"], "row")
    starts = placed.groupBy("source").agg(F.min("row").alias("tree"), F.count(F.lit(1)).alias("n")).withColumnRenamed("source", "of")
    leaves = placed.join(starts, placed["source"].eqNullSafe(starts["of"])).select(
        "tree", (F.col("row") - F.col("tree")).alias("place"), "n", "digest", "id", "source", "replacement"
    )
    sources = grow(materialize(leaves, "merkle-leaves"), arity, "merkle-blocks")
    order, n = numbered(sources.roots().withColumnRenamed("tree", "source_tree"), ["source_tree"], "place")
    tops = order.select(F.lit(0).cast("long").alias("tree"), "place", F.lit(n).cast("long").alias("n"), "digest", "source_tree")
    top = grow(materialize(tops, "merkle-subroots"), arity, "merkle-top")
    found = top.roots().first()
    return Manifest(sources, top, found["digest"].hex() if found else None)
