import random

import pytest
from pyspark.sql import functions as F

from checks import standins as fx
from cuematch import MatchConfig
from cuematch.operators import ranking, scoring
from cuematch.plans import matching

COLUMNS = ("episode_nr int, scene_nr int, theme_nr int, scene_query_id long, track_query_id long, style_signature string, "
           "weighted_score double, dialogue_conflict double, duration_conflict double, forbidden_tag_conflict double, "
           "missing_data_penalty double, embedding_score double, semantic_score double, targets_score double, hybrid_similarity double")


def plain_rank(rows, limit, top_n):
    """The rule as a loop over scenes, for comparison."""
    scenes = {}
    for r in rows:
        scenes.setdefault((r[0], r[1], r[2], r[3]), []).append(r)
    out, episode = [], None
    for key in sorted(scenes):
        if key[0] != episode:
            episode, won, used = key[0], None, []
        scored = []
        for r in scenes[key]:
            style = 0.10 * max(0, used.count(r[5]) - max(0, limit - 1))
            same = 0.12 if r[4] == won else 0.0
            total = r[7] + r[8] + r[9] + style + same + r[10]
            final = max(0.0, min(1.0, r[6] - total))
            scored.append((-final, -r[11], -r[12], -r[13], -r[14], r[4], r[5], style, same))
        scored.sort()
        for place, s in enumerate(scored[:top_n], 1):
            out.append((key[3], place, s[5], round(-s[0], 9), round(s[7], 9), round(s[8], 9)))
        won = scored[0][5]
        used.append(scored[0][6])
    return sorted(out)


def made_rows(seed, episodes, scenes, tracks, styles, low):
    rng = random.Random(seed)
    rows = []
    for e in range(1, episodes + 1):
        for s in range(scenes if e > 1 else scenes * 4):  # the first episode holds most scenes
            for t in rng.sample(range(tracks), rng.randint(1, tracks)):
                rows.append((e, s // 2 + 1, s % 2 + 1, e * 1000 + s, t, f"style{t % styles}", rng.choice(low),
                             rng.choice([0.0, 0.2]), rng.choice([0.0, 0.05]), rng.choice([0.0, 0.08]), rng.choice([0.0, 0.05]),
                             rng.choice([0.3, 0.5]), rng.choice([0.4, 0.6]), 0.5, rng.choice([0.1, 0.2, 0.3])))
    return rows


@pytest.mark.parametrize("limit", [0, 1, 2, 3])
@pytest.mark.parametrize("low", [[0.8, 0.7, 0.65], [0.1, 0.05, 0.3], [0.0, 1.0, 0.4]])
def test_episode_ranking_equals_a_loop(spark, limit, low):
    rows = made_rows(7 * limit + len(low), 4, 6, 9, 3, low)
    config = MatchConfig(style_duplicate_limit=limit, rank_top_n=4)
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    got = ranking.rank_episodes(df, config).select(
        "scene_query_id", "rank_position", "track_query_id", F.round("final_score", 9),
        F.round("style_redundancy_penalty", 9), F.round("same_track_consecutive_penalty", 9)).collect()
    assert sorted(map(tuple, got)) == plain_rank(rows, limit, 4)


def test_only_rows_that_can_be_kept_are_ranked_whole(spark, monkeypatch):
    rows = made_rows(5, 2, 6, 150, 40, [i / 200 for i in range(20, 180)])
    seen, inner = [], ranking.rank_within_scene
    monkeypatch.setattr(ranking, "rank_within_scene", lambda scored: (seen.append(scored.count()), inner(scored))[1])
    got = ranking.rank_episodes(spark.createDataFrame(rows, COLUMNS), MatchConfig(rank_top_n=4)).select(
        "scene_query_id", "rank_position", "track_query_id", F.round("final_score", 9),
        F.round("style_redundancy_penalty", 9), F.round("same_track_consecutive_penalty", 9)).collect()
    assert sorted(map(tuple, got)) == plain_rank(rows, 2, 4)
    assert len(seen) == 1 and len(got) <= seen[0] < len(rows) / 2


def test_fold_streams_over_small_batches(spark):
    rows = made_rows(3, 2, 10, 8, 2, [0.8, 0.6])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = ranking.rank_episodes(spark.createDataFrame(rows, COLUMNS), MatchConfig(rank_top_n=3)).select(
            "scene_query_id", "rank_position", "track_query_id", F.round("final_score", 9),
            F.round("style_redundancy_penalty", 9), F.round("same_track_consecutive_penalty", 9)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == plain_rank(rows, 2, 3)


def test_ranks_are_dense_and_scores_bounded(spark, sf):
    rows = matching.rank_all(fx.scenes(spark, sf), fx.tracks(spark, sf), MatchConfig(candidate_pool_hybrid=20, candidate_pool_ensemble=10, candidate_union_limit=25)).select(
        "scene_query_id", "rank_position", "final_score").collect()
    by_scene = {}
    for r in rows:
        assert 0.0 <= r["final_score"] <= 1.0
        by_scene.setdefault(r["scene_query_id"], []).append(r["rank_position"])
    assert all(sorted(v) == list(range(1, 11)) for v in by_scene.values())


def test_routes_agree(spark, sf):
    config = MatchConfig(candidate_pool_hybrid=9, candidate_pool_ensemble=5, candidate_union_limit=12)
    s, t = fx.scenes(spark, sf).filter(F.col("episode_nr") <= 2), fx.tracks(spark, sf)
    from cuematch.operators import retrieval

    pairs = retrieval.candidates(s, t, config).select("scene_query_id", "track_query_id")
    results = []
    for send, route in [(True, "send"), (True, "spread"), (False, "shuffle")]:
        rows = scoring.score_pairs(pairs, s, t, config, send, route).select(
            "scene_query_id", "track_query_id", F.round("weighted_score", 9)).collect()
        results.append(sorted(map(tuple, rows)))
    assert results[0] == results[1] == results[2] and results[0]
    by_slices = retrieval.candidates(s, t, config, "slices").select("scene_query_id", "track_query_id").collect()
    assert sorted(map(tuple, by_slices)) == sorted(map(tuple, pairs.collect()))


def test_preview_and_unknown_scene(spark, sf):
    s, t = fx.scenes(spark, sf), fx.tracks(spark, sf)
    config = MatchConfig(candidate_pool_hybrid=12, candidate_pool_ensemble=6)
    assert matching.preview_scene(s, t, 5, config).count() == 5
    assert matching.preview_scene(s, t, -1, config).count() == 0
    cells = scoring.score_breakdown(s, t, 5, fx.TRACK_BASE + 9, config).collect()
    assert {r["grp"] for r in cells} == {"embedding", "semantic", "targets", "tag_selection", "penalties", "final"}
    assert scoring.score_breakdown(s, t, 5, -1, config).count() == 0


@pytest.mark.parametrize("seconds, want", [(None, 0.10), (0.0, 0.10), (29.9, 0.15), (30.0, 0.05), (59.9, 0.05), (60.0, 0.0)])
def test_duration_penalty(spark, seconds, want):
    col = scoring.duration_penalty(F.lit(seconds).cast("double"))
    assert spark.range(1).select(col).first()[0] == want


def test_small_penalties(spark):
    row = spark.range(1).select(
        *[scoring.missing_data_penalty(F.lit(n)) for n in (0, 1, 2, 3, 20)],
        *[scoring.forbidden_penalty(F.lit(n)) for n in (0, 1, 4)],
        *[scoring.style_penalty(F.lit(n), 2) for n in (0, 1, 2, 4)],
        scoring.dialogue_penalty(F.lit(True), F.lit(False), True), scoring.dialogue_penalty(F.lit(True), F.lit(False), False),
        scoring.dialogue_penalty(F.lit(True), F.lit(True), True), scoring.dialogue_penalty(F.lit(False), F.lit(False), True),
    ).first()
    assert list(row) == pytest.approx([0, 0.05, 0.05, 0.06, 0.25, 0, 0.08, 0.25, 0, 0, 0.10, 0.30, 0.20, 0.10, 0, 0])


def test_run_summary_of_nothing(spark, sf):
    scored = spark.createDataFrame([], "scene_query_id long")
    empty = spark.createDataFrame([], "final_score double, embedding_score double")
    row = matching.run_summary(empty, matching.telemetry(fx.scenes(spark, sf), scored)).first()
    assert row["match_count"] == 0 and row["scene_without_candidates"] == row["scene_count"] > 0


def test_pairs_are_sent_to_the_tracks(spark, sf, tmp_path):
    """On the route for a large catalog no track vector is shuffled."""
    fx.tracks(spark, sf).write.parquet(str(tmp_path / "t"))
    tracks = spark.read.parquet(str(tmp_path / "t"))
    pairs = spark.createDataFrame([(0, fx.TRACK_BASE + 1)], "scene_query_id long, track_query_id long")
    scored = scoring.score_pairs(pairs, fx.scenes(spark, sf), tracks, MatchConfig(), True, "send")
    plan = scored._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Exchange hashpartitioning" not in plan and "NestedLoop" not in plan and plan.count("BroadcastExchange") == 2
    assert scored.count() == 1


def test_route_follows_the_sizes(spark, sf):
    s, t = fx.scenes(spark, sf), fx.tracks(spark, sf)
    n = s.count()
    few = MatchConfig(candidate_union_limit=1)
    assert matching.check_sizes(s.limit(n // 2), t, few).pairs == "send"
    assert matching.check_sizes(s, t, MatchConfig()).pairs == "spread"
    tight = matching.check_sizes(s, t, MatchConfig(broadcast_limit_bytes=1000))
    assert (tight.method, tight.send_scenes, tight.pairs) == ("slices", False, "shuffle")


def test_tight_limit_gives_the_same_matches(spark, sf):
    s = fx.scenes(spark, sf).filter("episode_nr <= 3")
    small = dict(candidate_pool_hybrid=15, candidate_pool_ensemble=8, candidate_union_limit=20)
    rows = [
        sorted((r["scene_query_id"], r["rank_position"], r["track_query_id"], round(r["final_score"], 9))
               for r in matching.rank_all(s, fx.tracks(spark, sf), MatchConfig(**small, **extra)).collect())
        for extra in ({}, {"broadcast_limit_bytes": 1000})
    ]
    assert rows[0] == rows[1] and len(rows[0]) == 600


def test_scores_are_written_with_methods_the_jit_compiles(spark, sf, monkeypatch):
    key = "spark.sql.codegen.hugeMethodLimit"
    seen, before = [], spark.conf.get(key)
    monkeypatch.setattr(matching, "materialize", lambda rows, _name: seen.append(spark.conf.get(key)) or rows)
    spark.conf.set(key, "65535")
    try:
        matching.stored_scores(fx.scenes(spark, sf), fx.tracks(spark, sf), MatchConfig())
        assert (seen, spark.conf.get(key)) == (["8000"], "65535")
    finally:
        spark.conf.set(key, before)
