"""Pairs measured in cells against the plain join, on odd rows."""

import numpy as np
from pyspark.sql import functions as F

from checks import standins as fx
from cuematch import MatchConfig
from cuematch.operators import cells, retrieval, scoring


def _odd(spark, sf):
    """Repeated and null ids, null sets and words, vectors missing, of another length or with null numbers."""
    s, t = fx.scenes(spark, sf).filter("id < 40"), fx.tracks(spark, sf).filter(F.col("id") < fx.TRACK_BASE + 60)
    n = F.col("id") % 7
    holed = lambda c: F.when(n == 0, F.transform(c, lambda x: F.when(x > 0, x))).when(n == 1, F.slice(c, 1, 5)).when(n != 2, F.col(c))
    sets = lambda c: F.when(n == 3, F.array(F.lit(None).cast("string"), F.lit("hope"))).when(n != 4, F.col(c))
    s = s.withColumn("embedding_main", holed("embedding_main")).withColumn("embedding_tags", F.when(n == 5, F.array().cast("array<float>")).otherwise(F.col("embedding_tags")))
    t = t.withColumn("embedding_main", F.when(n == 6, F.slice("embedding_main", 1, 5)).otherwise(F.col("embedding_main")))
    s = s.withColumn("scene_tag_selection", F.col("scene_tag_selection").withField("must_not_tags", sets("scene_tag_selection.must_not_tags")))
    t = t.withColumn("track_tag_selection", F.col("track_tag_selection").withField("should_have_tags", sets("track_tag_selection.should_have_tags")))
    t = t.withColumn("track_music_semantics", F.col("track_music_semantics").withField("weight_profile_candidates", sets("track_music_semantics.weight_profile_candidates")))
    none = F.lit(None).cast("long")
    s = s.unionByName(s.filter("id < 5")).unionByName(s.filter("id = 1").withColumn("id", none))
    t = t.unionByName(t.filter(F.col("id") < fx.TRACK_BASE + 7)).unionByName(t.filter(F.col("id") == fx.TRACK_BASE + 1).withColumn("id", none))
    pairs = s.select(F.col("id").alias("scene_query_id")).crossJoin(t.select(F.col("id").alias("track_query_id")).limit(50))
    return pairs, s, t


def test_cells_are_the_join(spark, sf, monkeypatch):
    pairs, s, t = _odd(spark, sf)
    for size in (cells._BLOCK_BYTES, 40_000):
        monkeypatch.setattr(cells, "_BLOCK_BYTES", size)
        got, want = (scoring.score_pairs(pairs, s, t, MatchConfig(), False, route) for route in ("shuffle", "spread"))
        assert got.dtypes == want.dtypes
        rounded = lambda df: sorted(
            str([round(v, 10) if isinstance(v, float) else v for v in row])
            for row in df.collect()
        )
        rows = rounded(got)
        assert rows and rows == rounded(want)


def test_pairs_carry_ids_only(spark, sf):
    """No row of a pair with its vectors is sorted or shuffled where the pairs are many."""
    pairs, s, t = _odd(spark, sf)
    plan = scoring.score_pairs(pairs, s, t, MatchConfig(), False, "shuffle")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.replace("CartesianProduct", "").replace("BroadcastNestedLoopJoin", "")
    assert "ArrowEvalPython" not in plan


def test_empty_sides(spark, sf):
    pairs, s, t = _odd(spark, sf)
    for a, b, c in [(pairs.limit(0), s, t), (pairs, s.limit(0), t), (pairs, s, t.limit(0))]:
        assert scoring.score_pairs(a, b, c, MatchConfig(), False, "shuffle").count() == 0


def test_order_and_hits():
    rng = np.random.default_rng(3)
    rows, items = rng.integers(0, 9, 5000), rng.integers(0, 50, 5000)
    dist = rng.choice([0.0, 0.5, 0.5 + 1e-15, 1.0, -1e-16, 2.0, np.inf], 5000)
    order, want = retrieval._nearest_order(rows, dist, items), np.lexsort((items, dist, rows))
    for values in (rows, dist, items):
        assert (values[order] == values[want]).all()
    for share in (0.0, 0.001, 0.5):
        some = rng.random((37, 29)) < share
        assert (retrieval._hits(some) == np.flatnonzero(some)).all()


def test_union_within_blocks(spark, sf):
    """Blocks give the union themselves, with ids that repeat on both sides, and shuffle no list."""
    pairs, s, t = _odd(spark, sf)
    s, t = s.filter("id is not null"), t.filter("id is not null")
    config = MatchConfig(candidate_pool_hybrid=9, candidate_pool_ensemble=7, candidate_union_limit=11)
    blocks, scan = (retrieval.candidates(s, t, config, method) for method in ("blocks", "scan"))
    assert blocks.dtypes == scan.dtypes
    rows = sorted(map(tuple, blocks.collect()))
    assert rows and rows == sorted(map(tuple, scan.collect()))
    assert "Window" not in blocks._jdf.queryExecution().executedPlan().toString()
