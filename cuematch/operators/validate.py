"""Issues of scene and track records, and violations of table rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuematch import fixed_values as fv
from cuematch.functions import vectors as V
from cuematch.functions.arrays import as_set


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _overlap_issue(kind: str, selection: str) -> Column:
    both = F.sort_array(
        F.array_intersect(
            as_set(F.col(f"{selection}.should_have_tags")), as_set(F.col(f"{selection}.must_not_tags"))
        )
    )
    names = F.concat(F.lit("["), F.concat_ws(", ", F.transform(both, lambda t: F.concat(F.lit("'"), t, F.lit("'")))), F.lit("]"))
    return F.when(F.size(both) > 0, F.concat(F.lit(f"overlapping {kind} tags: "), names))


def scene_issues() -> Column:
    """ARRAY<STRING> of the issues of a scene row."""
    return F.array_compact(
        F.array(
            F.when(_blank(F.col("theme_title_en")), "missing theme_title_en"),
            F.when(_blank(F.col("description_en")), "missing description_en"),
            F.when(~V.is_filled(F.col("embedding_hybrid")), "missing embedding_hybrid"),
            _overlap_issue("scene", "scene_tag_selection"),
        )
    )


def track_issues() -> Column:
    """ARRAY<STRING> of the issues of a track row."""
    return F.array_compact(
        F.array(
            F.when(_blank(F.col("semantic_title_en")), "missing semantic_title_en"),
            F.when(~V.is_filled(F.col("embedding_hybrid")), "missing embedding_hybrid"),
            _overlap_issue("track", "track_tag_selection"),
        )
    )


def validation_report(scenes: DataFrame, tracks: DataFrame, samples: int = 10) -> DataFrame:
    """One row: counts, issue counts, and the first issue texts of each side.

    The texts follow (episode, scene, theme) and track id. The first
    ``samples`` rows with issues are picked by a top-n sort before their texts
    are gathered, so the gathered list is short at any catalog size.
    """

    def side(df: DataFrame, issues: Column, name: str, order: list[str]) -> DataFrame:
        rows = df.select(*order, issues.alias("issues"))
        totals = rows.agg(
            F.count("*").alias(f"{name}_count"),
            F.coalesce(F.sum(F.size("issues")), F.lit(0)).alias(f"{name}_issue_count"),
        )
        first = rows.filter(F.size("issues") > 0).orderBy(*order).limit(samples)
        texts = first.agg(
            F.slice(
                F.flatten(
                    F.transform(
                        F.array_sort(F.collect_list(F.struct(*order, "issues"))),
                        lambda r: r["issues"],
                    )
                ),
                1,
                samples,
            ).alias(f"{name}_issue_samples")
        )
        # Both sides are single-row aggregates.
        return totals.withColumn("one", F.lit(1)).join(texts.withColumn("one", F.lit(1)), "one")

    left = side(scenes, scene_issues(), "scene", ["episode_nr", "scene_nr", "theme_nr", "id"])
    right = side(tracks, track_issues(), "track", ["id"])
    return left.join(right, "one").select(
        "scene_count", "track_count", "scene_issue_count", "track_issue_count",
        "scene_issue_samples", "track_issue_samples",
    )


_REQUIRED_TEXT = {
    "scenes": ["segmentation_reason", "theme_title_pl", "theme_title_en", "description_en",
               "theme_txt", "tags_summary_en"],
    "tracks": ["filename", "filepath", "semantic_title_en", "description_en", "tags_summary_en"],
    "matches": [],
}
_REQUIRED_NUMBER = {
    "scenes": ["episode_nr", "scene_nr", "theme_nr"],
    "tracks": [],
    "matches": ["episode_nr", "scene_query_id", "scene_nr", "theme_nr", "track_query_id",
                "rank_position", "final_score"],
}
_OBJECTS = {
    "scenes": {
        "scene_music_semantics": ["emotional_direction", "narrative_function", "weight_profile",
                                  "dialogue_safe_required"],
        "scene_music_targets": ["energy_target", "tempo_target", "rhythm_target",
                                "intensity_shape_target", "sound_character_target"],
        "scene_tag_selection": ["should_have_tags", "must_not_tags"],
        "clap_prompt_ensemble": list(fv.ENSEMBLE_PROMPTS),
    },
    "tracks": {
        "track_music_semantics": ["emotional_direction", "narrative_function",
                                  "weight_profile_candidates", "dialogue_safe_score", "dialogue_safe"],
        "track_music_targets": ["energy_target", "tempo_target", "rhythm_target",
                                "intensity_shape_target", "sound_character_target"],
        "track_tag_selection": ["should_have_tags", "must_not_tags"],
        "track_clap_prompt_ensemble": list(fv.ENSEMBLE_PROMPTS),
    },
    "matches": {},
}
_ARRAYS = {
    "scene_music_semantics": ["emotional_direction", "narrative_function"],
    "scene_music_targets": ["sound_character_target"],
    "scene_tag_selection": ["should_have_tags", "must_not_tags"],
    "track_music_semantics": ["emotional_direction", "narrative_function", "weight_profile_candidates"],
    "track_music_targets": ["sound_character_target"],
    "track_tag_selection": ["should_have_tags", "must_not_tags"],
}
_VECTORS = {
    "scenes": ["embedding_main", "embedding_tags", "embedding_clap_ensemble", "embedding_hybrid"],
    "tracks": ["embedding_audio", "embedding_main", "embedding_tags", "embedding_clap_ensemble",
               "embedding_hybrid"],
    "matches": [],
}
_UNIQUE = {
    "scenes": [["episode_nr", "scene_nr", "theme_nr"]],
    "tracks": [["filepath"]],
    "matches": [["scene_query_id", "rank_position"], ["scene_query_id", "track_query_id"]],
}


def _row_rules(df: DataFrame, table: str, dim: int) -> list[Column]:
    """Rule names broken by a row; objects may be typed structs or JSON text."""
    kinds = dict(df.dtypes)
    broken = []
    for name in _REQUIRED_NUMBER[table] + _REQUIRED_TEXT[table]:
        if name in kinds:
            broken.append(F.when(F.col(name).isNull(), f"{name} not null"))
    for name, keys in _OBJECTS[table].items():
        if name not in kinds:
            continue
        c = F.col(name)
        if kinds[name] == "string":
            present = F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
            is_object = F.coalesce(F.substring(F.ltrim(c), 1, 1) == "{", F.lit(False))
            broken.append(F.when(~is_object, f"{name} is an object"))
            missing = F.array_except(F.array(*[F.lit(k) for k in keys]), present)
            broken.append(F.when(F.size(missing) > 0, f"{name} required keys"))
            for key in _ARRAYS.get(name, []):
                value = F.get_json_object(c, f"$.{key}")
                is_array = F.coalesce(F.substring(F.ltrim(value), 1, 1) == "[", F.lit(False))
                broken.append(F.when(~is_array, f"{name}.{key} is an array"))
        else:
            broken.append(F.when(c.isNull(), f"{name} is an object"))
            lacking = [F.col(f"{name}.{key}").isNull() for key in keys]
            any_lacking = lacking[0]
            for one in lacking[1:]:
                any_lacking = any_lacking | one
            broken.append(F.when(c.isNotNull() & any_lacking, f"{name} required keys"))
    for name in _VECTORS[table]:
        if name in kinds:
            wrong = F.col(name).isNotNull() & (F.size(name) != dim)
            broken.append(F.when(wrong, f"{name} has {dim} numbers"))
    return broken


def constraint_report(df: DataFrame, table: str, key: str, dim: int = fv.VECTOR_DIM) -> DataFrame:
    """Violations (table_name, rule, key) of a catalog: ``scenes``, ``tracks`` or ``matches``.

    ``key`` is the column that names a row; a broken unique rule names its key
    values instead. Duplicates are counted with a map-side combine.
    """
    broken = _row_rules(df, table, dim)
    reports = []
    if broken:
        rows = df.select(F.col(key).cast("string").alias("key"), F.array_compact(F.array(*broken)).alias("r"))
        reports.append(
            rows.select(F.lit(table).alias("table_name"), F.explode("r").alias("rule"), "key")
        )
    for columns in _UNIQUE[table]:
        if not set(columns) <= set(df.columns):
            continue
        twice = df.groupBy(*columns).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
        reports.append(
            twice.select(
                F.lit(table).alias("table_name"),
                F.lit(f"unique ({', '.join(columns)})").alias("rule"),
                F.concat_ws("/", *[F.col(c).cast("string") for c in columns]).alias("key"),
            )
        )
    out = reports[0]
    for more in reports[1:]:
        out = out.unionByName(more)
    return out
