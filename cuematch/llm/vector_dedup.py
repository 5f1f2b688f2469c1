"""Near-duplicate vectors by Euclidean p-stable hashing, checked by exact cosines.

Equal unit vectors are one node with a count. Cliques: a wide hash of many
narrow buckets groups nodes with the bucket's smallest node, and those within
half the angle of the threshold form a clique, all of whose pairs are links
without a look at them. So a group of copies, exact or near, is a few nodes.

Tables. Unit vectors are projected on random directions, shifted, and quantised
by ``width``; ``m`` quantised projections are a bucket of one table. m grows with
the logarithm of the number of nodes, so that unrelated vectors meet rarely, and
the number of tables follows from m and the wanted recall at the threshold.
Cliques that share a bucket in any table are candidates.

Check. For two cliques the angle of their centres and their radii decide: all
pairs are links, none is, or the members are compared one by one in double
precision.

Nulls and edges: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different length never link. A null
vec_id takes part, and is skipped when the smallest id is taken. Rows that
repeat are linked with each other. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuematch.llm.components import components
from cuematch.llm.vectors import from_blobs, row_codes, units, valid_rows
from cuematch.llm.words import mixed
from cuematch.plans.storage import materialize

WIDTH = 2.0
_U = np.uint64


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection agrees at a Euclidean distance."""
    x = width / max(distance, 1e-9)
    inside = math.erf(x / math.sqrt(2))
    return inside - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def plan(n: int, threshold: float, recall: float = 0.995) -> tuple[int, int]:
    """Projections per table and tables for n nodes."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    m = max(2, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return m, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**m)))


def _hashed(matrix: np.ndarray, tables: int, m: int, width: float, seed: int) -> np.ndarray:
    """Bucket of each vector in each table (vectors x tables)."""
    rng = np.random.default_rng([seed, matrix.shape[1]])
    directions = rng.normal(size=(matrix.shape[1], tables * m))
    cells = np.floor((matrix @ directions + rng.uniform(0, width, tables * m)) / width).astype(np.int64).view(_U)
    code = np.tile(np.arange(tables, dtype=_U) + _U(matrix.shape[1] << 32), (len(matrix), 1))
    for i in range(m):
        code = mixed(code * _U(0x9E3779B97F4A7C15) + cells[:, i::m][:, :tables])
    return code.view(np.int64)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, unit = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, None, object)
        for rows, matrix in valid_rows(batch.column(1)):
            u = units(matrix)
            node[rows] = row_codes(u)
            unit[rows] = [r.tobytes() for r in np.ascontiguousarray(u, "<f8")]
        none = np.array([x is None for x in unit], bool)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, mask=none), pa.array(unit.tolist(), pa.binary())], names=["vec_id", "node", "unit"])


def _buckets(tables: int, m: int, width: float, seed: int):
    """(id, bucket) from (id, unit), each once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, matrix in from_blobs(batch.column(1)):
                for at in range(0, len(rows), 4096):
                    code = _hashed(matrix[at : at + 4096], tables, m, width, seed)
                    pairs = np.unique(np.stack((np.repeat(ids[rows[at : at + 4096]], tables), code.ravel()), 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["id", "bucket"])

    return run


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cosine of the last two columns, behind the others."""
    for batch in batches:
        n = batch.num_columns - 2
        x, y = batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()
        cos = np.array([float(np.frombuffer(a, "<f8") @ np.frombuffer(b, "<f8")) if len(a) == len(b) else -2.0 for a, b in zip(x, y, strict=True)], float)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(cos)], names=[*batch.schema.names[:n], "cos"])


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.995, seed: int = 17) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept, of every row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_nodes, "vec_id long, node long, unit binary")
    rows = materialize(rows, "vectors")
    nodes = rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("w"), F.first("unit").alias("unit"))
    nodes = materialize(nodes, "nodes")
    n = nodes.count()
    m, tables = plan(n, threshold, recall)

    wide = nodes.select("node", "unit").mapInArrow(_buckets(1, max(4, m), 1.5 * WIDTH, seed + 1), "node long, bucket long")
    first = wide.groupBy("bucket").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "centre")
    led = wide.join(first, "bucket").select("node", "centre").join(nodes.select("node", F.col("unit").alias("u")), "node")
    led = led.join(nodes.select(F.col("node").alias("centre"), F.col("unit").alias("v")), "centre")
    half = math.sqrt((1 + threshold) / 2) + 1e-9
    near = led.select("node", "centre", "u", "v").mapInArrow(_angles, "node long, centre long, cos double").where(F.col("cos") >= half)
    members = nodes.join(near, "node", "left").select("node", "w", "unit", F.coalesce("centre", "node").alias("clique"), F.acos(F.least(F.coalesce("cos", F.lit(1.0)), F.lit(1.0))).alias("angle"))
    members = materialize(members, "members")
    radius = F.max(F.when(F.col("clique") == F.col("node"), 0.0).otherwise(F.col("angle")))
    cliques = members.groupBy("clique").agg(F.sum("w").alias("weight"), radius.alias("radius"), F.count(F.lit(1)).alias("size"))
    cliques = materialize(cliques.join(nodes.select(F.col("node").alias("clique"), "unit"), "clique"), "cliques")

    hashed = members.select("clique", "unit").mapInArrow(_buckets(tables, m, WIDTH, seed), "clique long, bucket long").distinct()
    hashed = materialize(hashed, "buckets")
    pairs = hashed.join(hashed.withColumnRenamed("clique", "other"), "bucket").where("clique < other").select("clique", "other").distinct()
    sides = [cliques.select(*[F.col(c).alias(f"{c}_{s}") for c in cliques.columns]) for s in "ab"]
    met = pairs.join(sides[0], F.col("clique") == F.col("clique_a")).join(sides[1], F.col("other") == F.col("clique_b"))
    met = met.select("clique_a", "clique_b", "weight_a", "weight_b", "radius_a", "radius_b", "unit_a", "unit_b").mapInArrow(
        _angles, "clique_a long, clique_b long, weight_a long, weight_b long, radius_a double, radius_b double, cos double"
    )
    angle, most, slack = F.acos(F.greatest(F.least("cos", F.lit(1.0)), F.lit(-1.0))), math.acos(threshold), 1e-9
    spread = F.col("radius_a") + F.col("radius_b")
    kind = (
        F.when(spread == 0, F.when(F.col("cos") >= threshold, "all").otherwise("none"))
        .when(angle + spread <= most - slack, "all").when(angle - spread > most + slack, "none").otherwise("some")
    )
    met = materialize(met.withColumn("kind", kind).where("kind <> 'none'").drop("cos"), "met")
    every, some = met.where("kind = 'all'"), met.where("kind = 'some'").select("clique_a", "clique_b")
    x, y = (members.select(F.col("clique").alias(f"clique_{s}"), F.col("node").alias(f"node_{s}"), F.col("w").alias(f"w_{s}"), F.col("unit").alias(f"unit_{s}")) for s in "ab")
    single = some.join(x, "clique_a").join(y, "clique_b").select("clique_a", "clique_b", "node_a", "node_b", "w_a", "w_b", "unit_a", "unit_b")
    single = single.mapInArrow(_angles, "clique_a long, clique_b long, node_a long, node_b long, w_a long, w_b long, cos double")
    single = materialize(single.where(F.col("cos") >= threshold).drop("cos"), "single")

    by_clique = every.select(F.col("clique_a").alias("clique"), F.col("weight_b").alias("k")).unionByName(every.select(F.col("clique_b").alias("clique"), F.col("weight_a").alias("k")))
    by_clique = by_clique.groupBy("clique").agg(F.sum("k").alias("k_clique"))
    by_node = single.select(F.col("node_a").alias("node"), F.col("w_b").alias("k")).unionByName(single.select(F.col("node_b").alias("node"), F.col("w_a").alias("k")))
    by_node = by_node.groupBy("node").agg(F.sum("k").alias("k_node"))
    edges = every.select("clique_a", "clique_b").unionByName(single.select("clique_a", "clique_b")).distinct()
    roots = components(edges).withColumnRenamed("node", "clique")

    zero = F.lit(0).cast("long")
    found = members.select("node", "clique").join(cliques.select("clique", "weight"), "clique").join(by_clique, "clique", "left")
    found = found.join(by_node, "node", "left").join(roots, "clique", "left").select(
        "node", (F.col("weight") - 1 + F.coalesce("k_clique", zero) + F.coalesce("k_node", zero)).alias("n_links"), F.coalesce("root", "clique").alias("root")
    )
    placed = rows.drop("unit").join(found, "node", "left")
    smallest = placed.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("first"))
    out = placed.join(smallest, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("first"))
    kept = F.coalesce(F.col("vec_id") == component, component.isNull())
    return out.select("vec_id", F.coalesce("n_links", zero).alias("n_links"), component.alias("component_id"), kept.alias("kept"))
