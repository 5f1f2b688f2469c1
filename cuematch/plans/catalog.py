"""Lookups and searches over the catalogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuematch.functions.arrays import or_empty
from cuematch.schemas import PENALTY_COLUMNS, SCORE_COLUMNS

SCENE_COLUMNS = [
    "id", "episode_nr", "scene_nr", "theme_nr", "theme_title_pl", "theme_title_en",
    "description_en", "theme_txt", "tags_summary_en", "scene_music_semantics",
    "scene_music_targets", "scene_tag_selection", "clap_prompt_ensemble",
]
SCENE_VECTORS = ["embedding_main", "embedding_tags", "embedding_clap_ensemble", "embedding_hybrid"]
THEME_MATCH_COLUMNS = [
    "rank_position", "scene_query_id", "track_query_id", "track_filename",
    "track_semantic_title_en", "duration_sec", "bpm", "musical_key", "final_score",
    "embedding_score", "semantic_score", "targets_score", "tag_selection_score", "dialogue_score",
    "main_similarity", "tags_similarity", "ensemble_similarity", "hybrid_similarity",
    "audio_similarity_aux", *PENALTY_COLUMNS, "style_signature", "dialogue_safe_applied",
    "match_explanation",
]
DETAIL_COLUMNS = [
    "id", "filename", "filepath", "duration_sec", "bpm", "musical_key", "semantic_title_en",
    "description_en", "tags_summary_en", "track_music_semantics", "track_music_targets",
    "track_tag_selection", "track_clap_prompt_ensemble", "audio_analysis", "segmentation",
    "updated_at",
]
SEARCH_COLUMNS = [
    "id", "filepath", "filename", "duration_sec", "bpm", "musical_key", "semantic_title_en",
    "tags_summary_en", "updated_at",
]


def _present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def scenes_of_episode(scenes: DataFrame, episode_nr: int) -> DataFrame:
    return (
        scenes.filter(F.col("episode_nr") == episode_nr)
        .select(*_present(scenes, SCENE_COLUMNS + SCENE_VECTORS))
        .orderBy("scene_nr", "theme_nr")
    )


def scene_by_id(scenes: DataFrame, scene_id: int) -> DataFrame:
    return scenes.filter(F.col("id") == scene_id).select(*_present(scenes, SCENE_COLUMNS + SCENE_VECTORS))


def scene_by_place(scenes: DataFrame, episode_nr: int, scene_nr: int, theme_nr: int) -> DataFrame:
    """One scene without vectors; ``segmentation_reason`` when the table has it."""
    columns = SCENE_COLUMNS[:9] + ["segmentation_reason"] + SCENE_COLUMNS[9:]
    place = (
        (F.col("episode_nr") == episode_nr) & (F.col("scene_nr") == scene_nr) & (F.col("theme_nr") == theme_nr)
    )
    return scenes.filter(place).select(*_present(scenes, columns)).limit(1)


def matches_of_theme(matches: DataFrame, episode_nr: int, scene_nr: int, theme_nr: int) -> DataFrame:
    place = (
        (F.col("episode_nr") == episode_nr) & (F.col("scene_nr") == scene_nr) & (F.col("theme_nr") == theme_nr)
    )
    return matches.filter(place).select(*THEME_MATCH_COLUMNS).orderBy("rank_position")


def with_match_defaults(matches: DataFrame) -> DataFrame:
    """Missing texts become empty, missing scores 0; duration, bpm and key stay NULL."""
    out = matches
    for name in ("scene_theme_title_en", "track_semantic_title_en", "track_filename", "track_filepath",
                 "style_signature"):
        out = out.withColumn(name, F.coalesce(name, F.lit("")))
    for name in ["final_score", *SCORE_COLUMNS, *PENALTY_COLUMNS]:
        out = out.withColumn(name, F.coalesce(name, F.lit(0.0)))
    out = out.withColumn("dialogue_safe_applied", F.coalesce("dialogue_safe_applied", F.lit(False)))
    for name in ("match_metadata", "match_explanation"):
        if name in out.columns:
            out = out.withColumn(name, F.coalesce(name, F.lit("{}")))
    return out


def matches_of_episode(matches: DataFrame, episode_nr: int) -> DataFrame:
    rows = matches.filter(F.col("episode_nr") == episode_nr)
    return with_match_defaults(rows).orderBy("scene_nr", "theme_nr", "rank_position")


def track_detail(tracks: DataFrame, track_id: int) -> DataFrame:
    return tracks.filter(F.col("id") == track_id).select(*_present(tracks, DETAIL_COLUMNS))


def with_inspection(tracks: DataFrame) -> DataFrame:
    """Detail columns plus ``rms_mean``, ``zcr_mean`` and ``pipeline_version``."""
    zero = F.lit(0.0)
    return tracks.select(
        *_present(tracks, DETAIL_COLUMNS),
        F.round(F.coalesce("audio_analysis.rms", zero), 6).alias("rms_mean"),
        F.round(F.coalesce("audio_analysis.zero_crossing_rate", zero), 6).alias("zcr_mean"),
        F.coalesce("segmentation.pipeline_version", F.lit("–")).alias("pipeline_version"),
    )


def tracks_by_ids(tracks: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Tracks whose id is listed; no ids give no rows."""
    return tracks.join(ids.select(F.col(id_col).alias("id")), "id", "left_semi")


def episodes(df: DataFrame) -> DataFrame:
    """Distinct episode numbers, newest first."""
    return df.select("episode_nr").distinct().orderBy(F.col("episode_nr").desc())


def scene_numbers(matches: DataFrame, episode_nr: int) -> DataFrame:
    return matches.filter(F.col("episode_nr") == episode_nr).select("scene_nr").distinct().orderBy("scene_nr")


def theme_numbers(matches: DataFrame, episode_nr: int, scene_nr: int) -> DataFrame:
    place = (F.col("episode_nr") == episode_nr) & (F.col("scene_nr") == scene_nr)
    return matches.filter(place).select("theme_nr").distinct().orderBy("theme_nr")


def episode_options(scenes: DataFrame, matches: DataFrame | None, limit: int | None = None) -> DataFrame:
    """(episode_nr, matched, label) of all scene episodes, newest first."""
    own = scenes.select("episode_nr").distinct()
    if matches is None:
        flagged = own.withColumn("matched", F.lit(False))
    else:
        done = matches.select("episode_nr").distinct().withColumn("hit", F.lit(True))
        flagged = own.join(done, "episode_nr", "left").select(
            "episode_nr", F.coalesce("hit", F.lit(False)).alias("matched")
        )
    name = F.concat(F.lit("Episode "), F.col("episode_nr").cast("string"))
    out = flagged.withColumn(
        "label", F.when(F.col("matched"), F.concat(name, F.lit(" - matched"))).otherwise(name)
    ).orderBy(F.col("episode_nr").desc())
    return out if limit is None else out.limit(limit)


def row_counts(tables: dict[str, DataFrame | None], like: DataFrame) -> DataFrame:
    """(table_name, n_rows); a missing table counts 0. ``like`` gives the session."""
    out = None
    for name, df in tables.items():
        if df is None:
            one = like.sparkSession.range(1).select(
                F.lit(name).alias("table_name"), F.lit(0).cast("long").alias("n_rows")
            )
        else:
            one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def search_tracks(
    tracks: DataFrame,
    text: str = "",
    tags: Sequence[str] = (),
    starts_with: bool = False,
    newest_first: bool = False,
) -> DataFrame:
    """Tracks by text and tags; no filter gives all rows.

    Text is searched in file name and title, or as a prefix of the file name
    only. ``%`` and ``_`` in it are wildcards. All tags must be present.
    """
    out = tracks
    if text and starts_with:
        out = out.filter(F.col("filename").ilike(f"{text}%"))
    elif text:
        out = out.filter(
            F.col("filename").ilike(f"%{text}%") | F.col("semantic_title_en").ilike(f"%{text}%")
        )
    for tag in tags:
        out = out.filter(F.array_contains(or_empty(F.col("track_tag_selection.should_have_tags")), tag))
    order = F.col("updated_at").desc() if newest_first else F.col("filename").asc()
    return out.select(*_present(out, SEARCH_COLUMNS)).orderBy(order, "id")


def tag_vocabulary(tags: DataFrame) -> DataFrame:
    """Sorted tags per category; a taxonomy category holds a bounded number of tags."""
    return tags.groupBy("category").agg(F.sort_array(F.collect_set("name")).alias("names"))


def tags_in(tags: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Sorted distinct tags of the chosen categories."""
    return tags.filter(F.col("category").isin(*categories)).select("name").distinct().orderBy("name")
