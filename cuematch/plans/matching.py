"""The matching run: retrieve, score, rank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuematch.config import MatchConfig
from cuematch.functions import vectors as V
from cuematch.operators import ranking, retrieval, scoring, validate
from cuematch.plans.storage import materialize, short_methods

_PAIR_BYTES = 32  # a candidate pair in memory


@dataclass(frozen=True)
class Sizes:
    """What a check of the sizes allows; see :func:`check_sizes`."""

    method: str          # how to search: "scan", "slices" or "blocks"
    send_scenes: bool    # scenes may be sent to the pairs
    pairs: str           # "send", "spread" or "shuffle", see scoring.score_pairs


def _row_bytes(df: DataFrame):
    """Size of a row in memory: numbers and texts, nested ones as JSON, 16 for each column."""
    total = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind == "array" and f.dataType.elementType.typeName() in ("float", "double", "integer", "long"):
            total = total + F.greatest(F.size(c), F.lit(0)) * 8
        elif kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind in ("array", "struct", "map"):
            total = total + F.coalesce(F.octet_length(F.to_json(c)), F.lit(0))
    return total


def check_sizes(scenes: DataFrame, tracks: DataFrame, config: MatchConfig) -> Sizes:
    """Decide from one narrow aggregate what may be sent whole.

    Nothing above ``broadcast_limit_bytes`` is. Pairs are sent only to a
    catalog with more rows than there can be pairs.
    """
    row = scenes.agg(
        F.count("*").alias("n"),
        F.sum(F.greatest(F.size("embedding_hybrid"), F.lit(0)) + F.greatest(F.size("embedding_clap_ensemble"), F.lit(0)) + 1).alias("numbers"),
        F.sum(_row_bytes(scenes)).alias("bytes"),
    ).first()
    limit = config.broadcast_limit_bytes
    pairs = row["n"] * config.candidate_union_limit
    if pairs * _PAIR_BYTES > limit:
        route = "shuffle"
    else:
        route = "send" if tracks.count() > pairs else "spread"
    return Sizes(
        method=retrieval.route(  # by both vectors as doubles, ids and results
            row["n"], (row["numbers"] or 0) * 8, [config.candidate_pool_hybrid, config.candidate_pool_ensemble], limit
        ),
        send_scenes=(row["bytes"] or 0) <= limit,
        pairs=route,
    )


def scored_candidates(scenes: DataFrame, tracks: DataFrame, config: MatchConfig) -> DataFrame:
    """All candidates of all scenes with scores and static penalties.

    Only (scene, track) ids travel through the search; wide columns join after
    the cut.
    """
    sizes = check_sizes(scenes, tracks, config)
    pairs = retrieval.candidates(scenes, tracks, config, sizes.method)
    return scoring.score_pairs(
        pairs.select("scene_query_id", "track_query_id"), scenes, tracks, config,
        sizes.send_scenes, sizes.pairs,
    )


def stored_scores(scenes: DataFrame, tracks: DataFrame, config: MatchConfig) -> DataFrame:
    """:func:`scored_candidates`, written once for its several readers."""
    with short_methods(scenes.sparkSession):
        return materialize(scored_candidates(scenes, tracks, config), "scored")


def preview_scene(scenes: DataFrame, tracks: DataFrame, scene_id: int, config: MatchConfig) -> DataFrame:
    """Top rows of one scene without history; no rows for an unknown id."""
    one = scenes.filter(F.col("id") == scene_id)
    return ranking.rank_alone(scored_candidates(one, tracks, config), config.preview_top_n)


def rank_all(scenes: DataFrame, tracks: DataFrame, config: MatchConfig) -> DataFrame:
    """Ranked matches of every episode in ``scenes``."""
    return ranking.rank_episodes(stored_scores(scenes, tracks, config), config)


def match_episode(scenes: DataFrame, tracks: DataFrame, episode_nr: int, config: MatchConfig) -> DataFrame:
    return rank_all(scenes.filter(F.col("episode_nr") == episode_nr), tracks, config)


def telemetry(scenes: DataFrame, scored: DataFrame) -> DataFrame:
    """One row: scenes, scenes processed, scenes without candidates."""
    found = scored.select("scene_query_id").distinct()
    flagged = scenes.select(F.col("id").alias("scene_query_id")).join(
        found.withColumn("found", F.lit(1)), "scene_query_id", "left"
    )
    return flagged.agg(
        F.count("*").alias("scene_count"),
        F.count("*").alias("scenes_processed"),
        F.sum(F.when(F.col("found").isNull(), 1).otherwise(0)).cast("long").alias("scene_without_candidates"),
    )


def run_summary(matches: DataFrame, counters: DataFrame) -> DataFrame:
    """Match count and mean scores beside the telemetry; means are NULL without matches."""
    totals = matches.agg(
        F.count("*").alias("match_count"),
        F.avg("final_score").alias("avg_final_score"),
        F.avg("embedding_score").alias("avg_embedding_score"),
    )
    # Two single-row tables.
    return totals.withColumn("one", F.lit(1)).join(counters.withColumn("one", F.lit(1)), "one").drop("one")


def low_confidence(matches: DataFrame, threshold: float) -> DataFrame:
    return matches.filter(F.col("final_score") < threshold)


def usable_tracks(tracks: DataFrame) -> DataFrame:
    """Tracks that meet the minimum contract: a hybrid vector."""
    return tracks.filter(V.is_filled(F.col("embedding_hybrid")))


def episode_validation(
    scenes: DataFrame, tracks: DataFrame, episode_nr: int, sample: int = 20, config: MatchConfig = MatchConfig()
) -> DataFrame:
    """Input check before a run: the episode's scenes, and the ``sample`` tracks
    nearest to its first scene. One row, with the size of the whole catalog."""
    own = scenes.filter(F.col("episode_nr") == episode_nr)
    first = own.orderBy("scene_nr", "theme_nr", "id").limit(1)
    near = retrieval.nearest(first, tracks, sample, limit_bytes=config.broadcast_limit_bytes)
    sampled = tracks.join(near.select(F.col("item_id").alias("id")), "id", "left_semi")
    report = validate.validation_report(own, sampled)
    total = tracks.agg(F.count("*").alias("track_query_rows"))
    # Two single-row tables.
    return report.withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one").drop("one")
