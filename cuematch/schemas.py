"""Fixed schemas of the three catalogs and their nested contracts."""

from __future__ import annotations

from pyspark.sql import types as T

from cuematch import fixed_values as fv

_S, _D, _I, _L, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()
_STRINGS = T.ArrayType(_S)
_VECTOR = T.ArrayType(T.FloatType())
_TIME = T.TimestampNTZType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCENE_SEMANTICS = _struct(
    emotional_direction=_STRINGS,
    narrative_function=_STRINGS,
    weight_profile=_S,
    dialogue_safe_required=_B,
)
TARGETS = _struct(
    energy_target=_S,
    tempo_target=_S,
    rhythm_target=_S,
    intensity_shape_target=_S,
    sound_character_target=_STRINGS,
)
SCENE_TAG_SELECTION = _struct(should_have_tags=_STRINGS, must_not_tags=_STRINGS)
PROMPT_ENSEMBLE = _struct(**{name: _S for name in fv.ENSEMBLE_PROMPTS})
TRACK_SEMANTICS = _struct(
    emotional_direction=_STRINGS,
    narrative_function=_STRINGS,
    weight_profile_candidates=_STRINGS,
    dialogue_safe_score=_D,
    dialogue_safe=_B,
)
TRACK_TAG_SELECTION = _struct(
    should_have_tags=_STRINGS,
    must_not_tags=_STRINGS,
    confidence_profile=_struct(
        mean_selected_tag_score=_D, max_selected_tag_score=_D, min_selected_tag_score=_D
    ),
)
AUDIO_ANALYSIS = _struct(
    rms=_D,
    zero_crossing_rate=_D,
    spectral_centroid=_D,
    spectral_rolloff=_D,
    energy_target_hint=_S,
    tempo_target_hint=_S,
    rhythm_target_hint=_S,
    intensity_shape_hint=_S,
    sound_character_hints=_STRINGS,
)
SEGMENTATION = _struct(
    segment_seconds=_I,
    num_segments=_I,
    segment_ranges=T.ArrayType(_struct(start_sec=_D, end_sec=_D)),
    pipeline_version=_S,
    clap_model_name=_S,
    hybrid_weights=T.MapType(_S, _D),
)

SCENES = _struct(
    id=_L,
    episode_nr=_I,
    scene_nr=_I,
    theme_nr=_I,
    segmentation_reason=_S,
    theme_title_pl=_S,
    theme_title_en=_S,
    description_en=_S,
    theme_txt=_S,
    tags_summary_en=_S,
    scene_music_semantics=SCENE_SEMANTICS,
    scene_music_targets=TARGETS,
    scene_tag_selection=SCENE_TAG_SELECTION,
    clap_prompt_ensemble=PROMPT_ENSEMBLE,
    embedding_main=_VECTOR,
    embedding_tags=_VECTOR,
    embedding_clap_ensemble=_VECTOR,
    embedding_hybrid=_VECTOR,
    created_at=_TIME,
    updated_at=_TIME,
)
TRACKS = _struct(
    id=_L,
    filename=_S,
    filepath=_S,
    duration_sec=_D,
    bpm=_I,
    musical_key=_S,
    semantic_title_en=_S,
    description_en=_S,
    tags_summary_en=_S,
    track_music_semantics=TRACK_SEMANTICS,
    track_music_targets=TARGETS,
    track_tag_selection=TRACK_TAG_SELECTION,
    track_clap_prompt_ensemble=PROMPT_ENSEMBLE,
    embedding_audio=_VECTOR,
    embedding_main=_VECTOR,
    embedding_tags=_VECTOR,
    embedding_clap_ensemble=_VECTOR,
    embedding_hybrid=_VECTOR,
    audio_analysis=AUDIO_ANALYSIS,
    segmentation=SEGMENTATION,
    created_at=_TIME,
    updated_at=_TIME,
)
SCORE_COLUMNS = [
    "main_similarity", "tags_similarity", "ensemble_similarity", "hybrid_similarity",
    "audio_similarity_aux", "embedding_score", "semantic_score", "targets_score",
    "tag_selection_score", "dialogue_score",
]
PENALTY_COLUMNS = [
    "dialogue_conflict", "duration_conflict", "forbidden_tag_conflict",
    "style_redundancy_penalty", "same_track_consecutive_penalty", "missing_data_penalty",
    "penalty_total",
]
MATCHES = _struct(
    id=_L,
    episode_nr=_I,
    scene_query_id=_L,
    scene_nr=_I,
    theme_nr=_I,
    track_query_id=_L,
    rank_position=_I,
    scene_theme_title_en=_S,
    track_semantic_title_en=_S,
    track_filename=_S,
    track_filepath=_S,
    duration_sec=_D,
    bpm=_I,
    musical_key=_S,
    final_score=_D,
    **{name: _D for name in SCORE_COLUMNS + PENALTY_COLUMNS},
    style_signature=_S,
    dialogue_safe_applied=_B,
    match_metadata=_S,
    match_explanation=_S,
    created_at=_TIME,
    updated_at=_TIME,
)
THEME = _struct(theme_title_pl=_S, theme_title_en=_S, description_en=_S, theme_txt=_S)
THEME_LIST = _struct(themes=T.ArrayType(THEME), segmentation_reason=_S)
THEME_QUERY = _struct(
    tags_summary_en=_S,
    scene_music_semantics=SCENE_SEMANTICS,
    scene_music_targets=TARGETS,
    scene_tag_selection=SCENE_TAG_SELECTION,
    clap_prompt_ensemble=PROMPT_ENSEMBLE,
)
