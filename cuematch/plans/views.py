"""Analytic views over matches, scenes and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuematch import fixed_values as fv

_SCORES = ["final_score", "embedding_score", "semantic_score", "targets_score",
           "tag_selection_score", "dialogue_score"]
_MATCH_ORDER = ["episode_nr", "scene_nr", "theme_nr", "rank_position"]


def _with_sides(matches: DataFrame, scenes: DataFrame, tracks: DataFrame, scene_columns, track_columns):
    """Matches with columns of their scene and track.

    Catalog columns are cut before the join; the optimizer chooses the join
    from the sizes it sees.
    """
    s = scenes.select(F.col("id").alias("scene_query_id"), *scene_columns)
    t = tracks.select(F.col("id").alias("track_query_id"), *track_columns)
    return matches.join(s, "scene_query_id").join(t, "track_query_id")


def match_debug(matches: DataFrame, scenes: DataFrame, tracks: DataFrame) -> DataFrame:
    """Matches beside the present texts of scene and track, in report order."""
    own = matches.drop("scene_theme_title_en", "track_semantic_title_en")
    return _with_sides(
        own, scenes, tracks,
        [F.col("theme_title_en").alias("scene_theme_title_en"),
         F.col("description_en").alias("scene_description_en")],
        [F.col("semantic_title_en").alias("track_semantic_title_en"),
         F.col("description_en").alias("track_description_en"),
         F.col("tags_summary_en").alias("track_tags_summary_en")],
    ).orderBy(*_MATCH_ORDER)


def match_compare(matches: DataFrame, scenes: DataFrame, tracks: DataFrame) -> DataFrame:
    """Contracts of scene and track side by side."""
    own = matches.select(
        F.col("id").alias("match_id"), "episode_nr", "scene_query_id", "scene_nr", "theme_nr",
        "track_query_id", *_SCORES, "penalty_total", "match_explanation",
    )
    track_columns = ["semantic_title_en", F.col("description_en").alias("track_description_en"),
                     F.col("tags_summary_en").alias("track_tags_summary_en"),
                     "track_music_semantics", "track_music_targets", "track_tag_selection"]
    for extra in ("track_clap_prompt_ensemble", "audio_analysis", "segmentation"):
        if extra in tracks.columns:
            track_columns.append(extra)
    return _with_sides(
        own, scenes, tracks,
        ["theme_title_en", F.col("description_en").alias("scene_description_en"),
         F.col("tags_summary_en").alias("scene_tags_summary_en"), "scene_music_semantics",
         "scene_music_targets", "scene_tag_selection",
         F.col("clap_prompt_ensemble").alias("scene_clap_prompt_ensemble")],
        track_columns,
    )


def match_top1(matches: DataFrame, scenes: DataFrame, tracks: DataFrame) -> DataFrame:
    """Best match of each scene, cut before the catalogs join."""
    order = Window.partitionBy("scene_query_id").orderBy("rank_position", F.col("final_score").desc(), "track_query_id")
    best = matches.withColumn("row", F.row_number().over(order)).filter(F.col("row") == 1)
    own = best.drop("row", "scene_theme_title_en", "track_semantic_title_en")
    columns = [
        "id", "episode_nr", "scene_query_id", "scene_nr", "theme_nr", "scene_theme_title_en",
        "scene_description_en", "track_query_id", "track_semantic_title_en", "track_filename",
        "track_filepath", "rank_position", *_SCORES, "penalty_total", "style_signature",
        "dialogue_safe_applied", "match_explanation",
    ]
    joined = _with_sides(
        own, scenes, tracks,
        [F.col("theme_title_en").alias("scene_theme_title_en"),
         F.col("description_en").alias("scene_description_en")],
        [F.col("semantic_title_en").alias("track_semantic_title_en")],
    )
    return joined.select(*[c for c in columns if c in joined.columns])


def episode_summary(matches: DataFrame) -> DataFrame:
    """Counts and means per episode, with exact distinct counts."""
    means = [F.avg(c).alias(f"avg_{c}") for c in [*_SCORES, "penalty_total"]]
    return matches.groupBy("episode_nr").agg(
        F.count("*").alias("total_match_rows"),
        F.countDistinct("scene_query_id").alias("total_scene_themes"),
        F.countDistinct("track_query_id").alias("distinct_tracks_used"),
        F.max("final_score").alias("max_final_score"),
        F.min("final_score").alias("min_final_score"),
        *means,
    )


def style_redundancy(matches: DataFrame) -> DataFrame:
    """Styles that occur more than once in a scene theme, with their tracks by rank.

    A group holds at most the matches kept per scene theme.
    """
    rows = matches.groupBy("episode_nr", "scene_nr", "theme_nr", "style_signature").agg(
        F.count("*").alias("style_count"),
        F.array_sort(F.collect_list(F.struct("rank_position", "track_query_id", "track_filename"))).alias("rows"),
    )
    return rows.filter(F.col("style_count") > 1).select(
        "episode_nr", "scene_nr", "theme_nr", "style_signature", "style_count",
        F.col("rows.track_query_id").alias("track_query_ids"),
        F.col("rows.track_filename").alias("track_filenames"),
    ).orderBy("episode_nr", "scene_nr", "theme_nr", F.col("style_count").desc(), "style_signature")


def low_confidence(matches: DataFrame, threshold: float = fv.LOW_FINAL) -> DataFrame:
    weak = (
        (F.col("final_score") < threshold) | (F.col("semantic_score") < fv.LOW_SEMANTIC)
        | (F.col("targets_score") < fv.LOW_TARGETS) | (F.col("penalty_total") > fv.HIGH_PENALTY)
    )
    columns = ["id", "episode_nr", "scene_nr", "theme_nr", "scene_query_id", "track_query_id",
               "track_filename", "rank_position", *_SCORES, "penalty_total", "match_explanation"]
    return matches.filter(weak).select(*[c for c in columns if c in matches.columns]).orderBy(
        *_MATCH_ORDER, "track_query_id"
    )


def track_debug(tracks: DataFrame) -> DataFrame:
    """Every track column except the vectors."""
    return tracks.select(*[c for c in tracks.columns if not c.startswith("embedding_")])


def track_contract_debug(tracks: DataFrame) -> DataFrame:
    columns = ["filename", "filepath", "semantic_title_en", "description_en", "tags_summary_en",
               "track_music_semantics", "track_music_targets", "track_tag_selection",
               "track_clap_prompt_ensemble"]
    return tracks.select(F.col("id").alias("track_query_id"), *[c for c in columns if c in tracks.columns])
