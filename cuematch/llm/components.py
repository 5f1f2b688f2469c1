"""Connected components of link tables, by alternating star contraction.

Each round rewires every node to the smallest node it knows of, seen from the
larger side and then from the smaller one; the rounds end when nothing changes,
after about the logarithm of the longest chain. Minima are combined before the
shuffle, and joins may be split by adaptive execution, so a hub with a third of
all links is not one task. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuematch.plans.storage import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that occurs in a link but is not its component's smallest node.

    ``links`` has two integer columns a and b, in any order, with repetition;
    rows with a null and links of a node with itself are left out. No links give
    no rows.
    """
    a, b = links.columns[:2]
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = materialize(_small(edges), "links")
    state = _state(edges)
    while state[0]:
        edges = materialize(_small(_large(edges)), "links")
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
