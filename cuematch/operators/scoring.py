"""Scores and penalties of (scene, track) pairs, as column expressions.

What depends on one side only (sets, norms, issue counts, the style
signature) is computed once per scene or track before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuematch import fixed_values as fv
from cuematch.config import MatchConfig
from cuematch.functions import vectors as V
from cuematch.functions.arrays import as_set, or_empty, scale_match, shared
from cuematch.functions.text import strip
from cuematch.operators import cells, validate

_VECTORS = ["main", "tags", "clap_ensemble", "hybrid"]


def _clean(c: str) -> Column:
    return strip(F.coalesce(F.col(c), F.lit("")))


def style_signature() -> Column:
    """First profile | energy | tempo | shape | sorted first three sound words."""
    text = lambda c: F.coalesce(F.col(f"track_music_targets.{c}"), F.lit(""))
    profiles = or_empty(F.col("track_music_semantics.weight_profile_candidates"))
    sounds = or_empty(F.col("track_music_targets.sound_character_target"))
    return F.concat_ws(
        "|",
        F.coalesce(F.get(profiles, F.lit(0)), F.lit("")),
        text("energy_target"),
        text("tempo_target"),
        text("intensity_shape_target"),
        F.concat_ws("-", F.sort_array(F.slice(sounds, 1, 3))),
    )


def duration_penalty(duration: Column) -> Column:
    d = F.coalesce(duration, F.lit(0.0))
    return (
        F.when(d <= 0, fv.DURATION_PENALTY_NONE)
        .when(d < 30, fv.DURATION_PENALTY_30)
        .when(d < 60, fv.DURATION_PENALTY_60)
        .otherwise(0.0)
    )


def missing_data_penalty(issues: Column) -> Column:
    some = F.least(
        F.lit(fv.MISSING_MAX), F.greatest(F.lit(fv.MISSING_MIN), F.lit(fv.MISSING_STEP) * issues)
    )
    return F.when(issues <= 0, 0.0).otherwise(some)


def forbidden_penalty(conflicts: Column) -> Column:
    return F.least(F.lit(fv.FORBIDDEN_MAX), F.lit(fv.FORBIDDEN_STEP) * conflicts)


def dialogue_penalty(required: Column, safe: Column, strict: bool) -> Column:
    amount = fv.DIALOGUE_PENALTY_STRICT if strict else fv.DIALOGUE_PENALTY_LAX
    return F.when(required & ~safe, amount).otherwise(0.0)


def style_penalty(uses: Column, limit: int) -> Column:
    """Grows with the scenes already won by the same style, beyond the limit."""
    return F.lit(fv.STYLE_STEP) * F.greatest(F.lit(0), uses - F.lit(max(0, limit - 1)))


def prepare_scenes(scenes: DataFrame) -> DataFrame:
    """Scene side of a pair, prefixed ``s_``."""
    sem, tgt, sel = "scene_music_semantics", "scene_music_targets", "scene_tag_selection"
    vectors = [F.col(f"embedding_{v}").alias(f"s_{v}") for v in _VECTORS]
    norms = [V.norm(F.col(f"embedding_{v}")).alias(f"s_{v}_norm") for v in _VECTORS]
    return scenes.select(
        F.col("id").alias("scene_query_id"),
        "episode_nr", "scene_nr", "theme_nr",
        F.coalesce("theme_title_en", F.lit("")).alias("scene_theme_title_en"),
        as_set(F.col(f"{sem}.emotional_direction")).alias("s_emotion"),
        as_set(F.col(f"{sem}.narrative_function")).alias("s_narrative"),
        _clean(f"{sem}.weight_profile").alias("s_profile"),
        F.coalesce(F.col(f"{sem}.dialogue_safe_required"), F.lit(False)).alias("s_dialogue"),
        _clean(f"{tgt}.energy_target").alias("s_energy"),
        _clean(f"{tgt}.tempo_target").alias("s_tempo"),
        _clean(f"{tgt}.rhythm_target").alias("s_rhythm"),
        _clean(f"{tgt}.intensity_shape_target").alias("s_shape"),
        as_set(F.col(f"{tgt}.sound_character_target")).alias("s_sound"),
        as_set(F.col(f"{sel}.should_have_tags")).alias("s_should"),
        as_set(F.col(f"{sel}.must_not_tags")).alias("s_must_not"),
        F.size(validate.scene_issues()).alias("s_issues"),
        *vectors, *norms,
    )


def prepare_tracks(tracks: DataFrame) -> DataFrame:
    """Track side of a pair, prefixed ``t_``; tracks without a hybrid vector are left out."""
    sem, tgt, sel = "track_music_semantics", "track_music_targets", "track_tag_selection"
    names = [*_VECTORS, "audio"]
    vectors = [F.col(f"embedding_{v}").alias(f"t_{v}") for v in names]
    norms = [V.norm(F.col(f"embedding_{v}")).alias(f"t_{v}_norm") for v in names]
    return tracks.filter(V.is_filled(F.col("embedding_hybrid"))).select(
        F.col("id").alias("track_query_id"),
        F.coalesce("semantic_title_en", F.lit("")).alias("track_semantic_title_en"),
        F.col("filename").alias("track_filename"),
        F.col("filepath").alias("track_filepath"),
        F.coalesce("duration_sec", F.lit(0.0)).alias("duration_sec"),
        "bpm", "musical_key",
        as_set(F.col(f"{sem}.emotional_direction")).alias("t_emotion"),
        as_set(F.col(f"{sem}.narrative_function")).alias("t_narrative"),
        as_set(F.col(f"{sem}.weight_profile_candidates")).alias("t_profiles"),
        F.coalesce(F.col(f"{sem}.dialogue_safe"), F.lit(False)).alias("t_safe"),
        _clean(f"{tgt}.energy_target").alias("t_energy"),
        _clean(f"{tgt}.tempo_target").alias("t_tempo"),
        _clean(f"{tgt}.rhythm_target").alias("t_rhythm"),
        _clean(f"{tgt}.intensity_shape_target").alias("t_shape"),
        as_set(F.col(f"{tgt}.sound_character_target")).alias("t_sound"),
        as_set(F.col(f"{sel}.should_have_tags")).alias("t_should"),
        duration_penalty(F.col("duration_sec")).alias("duration_conflict"),
        style_signature().alias("style_signature"),
        F.size(validate.track_issues()).alias("t_issues"),
        *vectors, *norms,
    )


def _weighted(group: dict[str, float], columns: dict[str, str]) -> Column:
    total = None
    for name, column in columns.items():
        part = F.lit(group[name]) * F.col(column)
        total = part if total is None else total + part
    return total


def embedding_score(weights: dict[str, float]) -> Column:
    """Weighted mean of the five similarities; 0 when the weights sum to 0 or less."""
    total = sum(weights.values())
    if total <= 0:
        return F.lit(0.0)
    columns = {
        "main": "main_similarity", "tags": "tags_similarity", "ensemble": "ensemble_similarity",
        "hybrid": "hybrid_similarity", "audio_aux": "audio_similarity_aux",
    }
    return V.clamp01(_weighted(weights, columns) / F.lit(float(total)))


# What a pair of rows is measured by; the audio cosine compares the scene's hybrid vector.
_COSINES = {
    "main_similarity": ("main", "main"),
    "tags_similarity": ("tags", "tags"),
    "ensemble_similarity": ("clap_ensemble", "clap_ensemble"),
    "hybrid_similarity": ("hybrid", "hybrid"),
    "audio_similarity_aux": ("hybrid", "audio"),
}
_SHARED = {
    "n_emotion": ("s_emotion", "t_emotion"),
    "n_narrative": ("s_narrative", "t_narrative"),
    "n_sound": ("s_sound", "t_sound"),
    "n_should": ("s_should", "t_should"),
    "n_must_not": ("s_must_not", "t_should"),
}
_SETS = {
    "s": ["s_emotion", "s_narrative", "s_sound", "s_should", "s_must_not"],
    "t": ["t_emotion", "t_narrative", "t_sound", "t_should", "t_profiles"],
}


def _sized(side: DataFrame, name: str) -> DataFrame:
    """A prepared side with the sizes of its sets."""
    return side.select("*", *[F.size(c).alias(f"{c}_size") for c in _SETS[name]])


def _cosine_columns(config: MatchConfig) -> dict[str, tuple[str, str]]:
    return {k: v for k, v in _COSINES.items() if config.enable_audio_aux or k != "audio_similarity_aux"}


def _share(common: str, first: str) -> Column:
    return F.when(F.col(f"{first}_size") > 0, F.col(common) / F.col(f"{first}_size")).otherwise(F.lit(0.0))


def _jaccard(common: str, a: str, b: str) -> Column:
    na, nb = F.col(f"{a}_size"), F.col(f"{b}_size")
    return F.when((na > 0) & (nb > 0), F.col(common) / (na + nb - F.col(common))).otherwise(F.lit(0.0))


def _measured(joined: DataFrame, config: MatchConfig) -> DataFrame:
    """Joined rows with dot products, numbers of shared words and whether the profile is listed."""
    wide = [c for names in _SETS.values() for c in names]
    wide += [f"s_{v}" for v in _VECTORS] + [f"t_{v}" for v in [*_VECTORS, "audio"]]
    dots = [V.dot_batch(F.col(f"s_{s}"), F.col(f"t_{t}")).alias(f"{name}_dot")
            for name, (s, t) in _cosine_columns(config).items()]
    counts = [shared(F.col(a), F.col(b)).alias(name) for name, (a, b) in _SHARED.items()]
    listed = F.coalesce(F.array_contains("t_profiles", F.col("s_profile")), F.lit(False)).alias("profile_listed")
    return joined.select(*[c for c in joined.columns if c not in wide], *dots, *counts, listed)


def similarities(config: MatchConfig) -> dict[str, Column]:
    """Five cosines of a measured pair."""
    def pair(name: str, s: str, t: str) -> Column:
        scale = F.col(f"s_{s}_norm") * F.col(f"t_{t}_norm")
        return F.when(scale > 0, F.col(f"{name}_dot") / scale).otherwise(F.lit(0.0))

    found = _cosine_columns(config)
    return {name: pair(name, *sides) if name in found else F.lit(0.0) for name, sides in _COSINES.items()}


def score_pairs(
    pairs: DataFrame,
    scenes: DataFrame,
    tracks: DataFrame,
    config: MatchConfig,
    send_scenes: bool = False,
    pair_route: str = "shuffle",
) -> DataFrame:
    """Every score and static penalty of (scene_query_id, track_query_id) pairs.

    ``weighted_score`` is the weighted sum before penalties; the two penalties
    that depend on earlier scenes are added by the ranking.

    ``send_scenes`` says that the size of the scenes was checked
    (plans/matching.py): they go to the pairs, so no vector is moved again.
    ``pair_route`` says how pairs and tracks meet:

    * ``send``: few pairs, large catalog. The pairs go to the tracks, which
      are scored where they are scanned.
    * ``spread``: few pairs, small catalog. Pairs are spread by track over a
      fixed number of tasks, so the costly part uses every core.
    * ``shuffle``: many pairs. Blocks of scenes and blocks of tracks meet in cells
      (operators/cells.py), and a pair travels as two ids to the cell of its rows.
    """
    w = config.weights
    left, right = _sized(prepare_scenes(scenes), "s"), _sized(prepare_tracks(tracks), "t")
    if pair_route == "send":
        pairs = F.broadcast(pairs)
    elif pair_route == "spread":
        n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # The hint keeps the pairs from being sent to a catalog of few tasks.
        pairs = pairs.repartition(n, "track_query_id").hint("merge")
    sent = F.broadcast(left) if send_scenes and pair_route != "shuffle" else left
    measured = _measured(pairs.join(right, "track_query_id").join(sent, "scene_query_id"), config)
    if pair_route == "shuffle":
        dots = {f"{name}_dot": (f"s_{s}", f"t_{t}") for name, (s, t) in _cosine_columns(config).items()}
        measured = cells.meet(
            pairs, left, right, measured.schema, dots, _SHARED, {"profile_listed": ("s_profile", "t_profiles")}
        )
    parts = {
        **similarities(config),
        "emotion_match_score": F.when(F.col("t_emotion_size") > 0, _share("n_emotion", "s_emotion")).otherwise(0.0),
        "narrative_match_score": F.when(F.col("t_narrative_size") > 0, _share("n_narrative", "s_narrative")).otherwise(0.0),
        "weight_profile_match_score": F.when((F.col("s_profile") != "") & F.col("profile_listed"), 1.0).otherwise(0.0),
        "dialogue_score": F.when(F.col("s_dialogue") & ~F.col("t_safe"), 0.0).otherwise(1.0),
        "energy_match_score": scale_match(F.col("s_energy"), F.col("t_energy"), fv.ENERGY_SCALE, fv.ORDINAL_STEP),
        "tempo_match_score": scale_match(F.col("s_tempo"), F.col("t_tempo"), fv.TEMPO_SCALE, fv.ORDINAL_STEP),
        "rhythm_match_score": scale_match(F.col("s_rhythm"), F.col("t_rhythm"), None, fv.ORDINAL_STEP),
        "intensity_shape_match_score": scale_match(F.col("s_shape"), F.col("t_shape"), fv.INTENSITY_SCALE, fv.ORDINAL_STEP),
        "sound_character_match_score": _jaccard("n_sound", "s_sound", "t_sound"),
        "should_have_hit_rate": _share("n_should", "s_should"),
        "must_not_conflict_rate": _share("n_must_not", "s_must_not"),
        "dialogue_conflict": dialogue_penalty(F.col("s_dialogue"), F.col("t_safe"), config.strict_dialogue_safe),
        "forbidden_tag_conflict": forbidden_penalty(F.col("n_must_not")),
        "missing_data_penalty": missing_data_penalty(F.col("s_issues") + F.col("t_issues")),
        "dialogue_safe_applied": F.col("s_dialogue"),
    }
    carried = [
        "episode_nr", "scene_query_id", "scene_nr", "theme_nr", "track_query_id",
        "scene_theme_title_en", "track_semantic_title_en", "track_filename", "track_filepath",
        "duration_sec", "bpm", "musical_key", "style_signature", "duration_conflict",
    ]
    scored = measured.select(*carried, *[c.alias(name) for name, c in parts.items()])
    groups = {
        "embedding_score": embedding_score(w.embedding),
        "semantic_score": V.clamp01(_weighted(w.semantic, {
            "emotion": "emotion_match_score", "narrative": "narrative_match_score",
            "weight_profile": "weight_profile_match_score", "dialogue": "dialogue_score"})),
        "targets_score": V.clamp01(_weighted(w.targets, {
            "energy": "energy_match_score", "tempo": "tempo_match_score",
            "rhythm": "rhythm_match_score", "intensity_shape": "intensity_shape_match_score",
            "sound_character": "sound_character_match_score"})),
        "tag_selection_score": V.clamp01(
            F.lit(w.tag_selection["should_have"]) * F.col("should_have_hit_rate")
            - F.lit(w.tag_selection["must_not"]) * F.col("must_not_conflict_rate")
        ),
    }
    scored = scored.select("*", *[c.alias(name) for name, c in groups.items()])
    return scored.withColumn(
        "weighted_score",
        _weighted(w.final, {
            "embedding": "embedding_score", "semantic": "semantic_score",
            "targets": "targets_score", "tag_selection": "tag_selection_score"}),
    )


def penalty_total() -> Column:
    return (
        F.col("dialogue_conflict") + F.col("duration_conflict") + F.col("forbidden_tag_conflict")
        + F.col("style_redundancy_penalty") + F.col("same_track_consecutive_penalty")
        + F.col("missing_data_penalty")
    )


def with_final_score(scored: DataFrame) -> DataFrame:
    """Add penalty_total and final_score; the two context penalties must be present."""
    return scored.withColumn("penalty_total", penalty_total()).withColumn(
        "final_score", V.clamp01(F.col("weighted_score") - F.col("penalty_total"))
    )


COMPONENTS = {
    "embedding": ["main_similarity", "tags_similarity", "ensemble_similarity", "hybrid_similarity",
                  "audio_similarity_aux", "embedding_score"],
    "semantic": ["emotion_match_score", "narrative_match_score", "weight_profile_match_score",
                 "dialogue_match_score", "semantic_score"],
    "targets": ["energy_match_score", "tempo_match_score", "rhythm_match_score",
                "intensity_shape_match_score", "sound_character_match_score", "targets_score"],
    "tag_selection": ["should_have_hit_rate", "must_not_conflict_rate", "tag_selection_score"],
    "penalties": ["dialogue_conflict", "duration_conflict", "forbidden_tag_conflict",
                  "style_redundancy_penalty", "same_track_consecutive_penalty",
                  "missing_data_penalty", "penalty_total"],
}


def _component(name: str) -> Column:
    return F.col("dialogue_score" if name == "dialogue_match_score" else name)


def explanation() -> Column:
    """Nested explanation of a match."""
    scores = [
        _component(name).alias(name)
        for group in ("embedding", "semantic", "targets", "tag_selection")
        for name in COMPONENTS[group]
    ]
    return F.struct(
        F.struct("scene_query_id", F.col("scene_theme_title_en").alias("theme_title_en")).alias("scene"),
        F.struct(
            "track_query_id",
            F.col("track_semantic_title_en").alias("semantic_title_en"),
            F.col("track_filename").alias("filename"),
        ).alias("track"),
        F.struct(*scores).alias("component_scores"),
        F.struct(
            *COMPONENTS["penalties"], "style_signature", "dialogue_safe_applied"
        ).alias("penalties"),
    )


def without_context(scored: DataFrame) -> DataFrame:
    """Final scores as if no scene came before."""
    return with_final_score(
        scored.withColumn("style_redundancy_penalty", F.lit(0.0)).withColumn(
            "same_track_consecutive_penalty", F.lit(0.0)
        )
    )


def score_breakdown(
    scenes: DataFrame, tracks: DataFrame, scene_id: int, track_id: int, config: MatchConfig
) -> DataFrame:
    """(grp, component, value) of one pair, recomputed without episode context.

    ``final_score`` is rebuilt from the group scores rounded to four places
    with the standard final weights. No rows when either id is unknown.
    """
    one_scene = scenes.filter(F.col("id") == scene_id)
    pair = one_scene.select(F.col("id").alias("scene_query_id"), F.lit(track_id).cast("long").alias("track_query_id"))
    return breakdown(
        score_pairs(pair, one_scene, tracks.filter(F.col("id") == track_id), config)
    ).drop("scene_query_id", "track_query_id")


def breakdown(scored: DataFrame) -> DataFrame:
    """Long table (scene_query_id, track_query_id, grp, component, value) of scored pairs."""
    full = without_context(scored)
    std = fv.SCORE_WEIGHTS["final"]
    four = lambda c: F.round(c, 4)
    rebuilt = V.clamp01(
        F.lit(std["embedding"]) * four("embedding_score") + F.lit(std["semantic"]) * four("semantic_score")
        + F.lit(std["targets"]) * four("targets_score")
        + F.lit(std["tag_selection"]) * four("tag_selection_score") - four("penalty_total")
    )
    cells = [
        F.struct(F.lit(group).alias("grp"), F.lit(name).alias("component"), _component(name).alias("value"))
        for group, names in COMPONENTS.items()
        for name in names
    ]
    cells.append(F.struct(F.lit("final").alias("grp"), F.lit("final_score").alias("component"), rebuilt.alias("value")))
    return full.select("scene_query_id", "track_query_id", F.inline(F.array(*cells)))
