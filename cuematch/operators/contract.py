"""The descriptive contract of a track, built from its selected tags.

Every step is an expression over the track's own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuematch import fixed_values as fv
from cuematch.functions.arrays import or_empty, quoted, string_lists, strings, top_distinct
from cuematch.functions.text import cut, title_case, words
from cuematch.functions.vectors import clamp01
from cuematch.operators.tags import bind, names_in, names_of, score_lookup, select_tags


def _score(lookup: Column, name) -> Column:
    key = F.lit(name) if isinstance(name, str) else name
    return F.coalesce(F.try_element_at(lookup, key), F.lit(0.0))


def _or_default(items: Column, default: list[str]) -> Column:
    return F.when(F.size(items) > 0, items).otherwise(strings(default))


def dialogue_safe_score(lookup: Column) -> Column:
    def total(coefficients: dict[str, float]) -> Column:
        out = None
        for name, c in coefficients.items():
            part = F.lit(c) * _score(lookup, name)
            out = part if out is None else out + part
        return out

    return clamp01(F.lit(fv.DIALOGUE_SAFE_BASE) + total(fv.DIALOGUE_SAFE) - total(fv.DIALOGUE_RISK))


def profile_candidates(lookup: Column, selected: Column, safe_score: Column) -> Column:
    """Up to three scene profiles whose hinted tags score best."""
    rows = [
        f"named_struct('no', {no}, 'name', {quoted(name)}, 'tags', array({', '.join(map(quoted, tags))}))"
        for no, (name, tags) in enumerate(fv.PROFILE_HINTS.items())
    ]
    hints = F.expr(f"array({', '.join(rows)})")

    def scored(p: Column) -> Column:
        base = F.aggregate(p["tags"], F.lit(0.0), lambda s, t: s + _score(lookup, t))
        bonus = F.when(p["name"] == "dialogue", F.lit(fv.PROFILE_DIALOGUE_SHARE) * safe_score).otherwise(0.0)
        hit = F.exists(p["tags"], lambda t: F.map_contains_key(lookup, t))
        return F.struct(
            (-(base + bonus)).alias("minus"), p["no"].alias("no"), p["name"].alias("name"), hit.alias("hit")
        )

    listed = F.array_sort(
        F.filter(F.transform(hints, scored), lambda p: p["hit"] & (-p["minus"] >= fv.PROFILE_MIN))
    )

    def pick(ps: Column) -> Column:
        best = -F.get(ps, F.lit(0))["minus"]
        near = F.filter(
            ps, lambda p: -p["minus"] >= F.greatest(F.lit(fv.PROFILE_MIN), best - F.lit(fv.PROFILE_WINDOW))
        )
        scene_tags = names_in(selected, "scene", 2)
        fallback = F.when(
            safe_score >= fv.DIALOGUE_STRONG_AT, strings(["dialogue", "transition"])
        ).otherwise(_or_default(scene_tags, ["dramatic_scene"]))
        return F.when(F.size(ps) > 0, F.slice(F.transform(near, lambda p: p["name"]), 1, 3)).otherwise(fallback)

    return bind(listed, pick)


def music_semantics(selected: Column, lookup: Column, safe_score: Column) -> Column:
    return F.struct(
        names_in(selected, "emotion", 4).alias("emotional_direction"),
        _or_default(names_in(selected, "narrative", 3), ["underscore"]).alias("narrative_function"),
        profile_candidates(lookup, selected, safe_score).alias("weight_profile_candidates"),
        F.round(safe_score, 6).alias("dialogue_safe_score"),
        (safe_score >= fv.DIALOGUE_FLAG_AT).alias("dialogue_safe"),
    )


def music_targets(selected: Column, analysis: Column | None = None) -> Column:
    """Best tag per category, else the audio hint, else a constant."""
    def hint(name: str) -> Column:
        return F.lit(None).cast("string") if analysis is None else analysis[name]

    def first_or(category: str, name: str, default: str) -> Column:
        best = F.get(names_in(selected, category, 1), F.lit(0))
        return F.coalesce(best, hint(name), F.lit(default))

    hinted = strings() if analysis is None else or_empty(analysis["sound_character_hints"])
    sound = names_in(selected, "sound_character", 4)
    sound = F.when(F.size(sound) > 0, sound).otherwise(_or_default(F.slice(hinted, 1, 2), ["atmospheric"]))

    def complete(s: Column) -> Column:
        room = ~F.array_contains(s, "atmospheric") & (F.size(s) < 4)
        return top_distinct(F.when(room, F.array_append(s, "atmospheric")).otherwise(s), 4)

    return F.struct(
        first_or("energy", "energy_target_hint", "medium").alias("energy_target"),
        first_or("tempo", "tempo_target_hint", "moderate").alias("tempo_target"),
        first_or("rhythm", "rhythm_target_hint", "steady").alias("rhythm_target"),
        first_or("intensity_shape", "intensity_shape_hint", "static").alias("intensity_shape_target"),
        bind(sound, complete).alias("sound_character_target"),
    )


def _contrary_of(name: Column) -> Column:
    return F.coalesce(F.try_element_at(string_lists(fv.CONTRARY_TAGS), name), strings())


def _banned(names: Column, value: Column) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("name"), value.alias("value")))


def must_not_tags(selected: Column, lookup: Column, semantics: Column, targets: Column) -> Column:
    """Up to six tags a track must not meet, by strength; ties in order of discovery.

    Four sources: tags contrary to the selected ones, loud tags for a track
    that is safe under dialogue, tags banned by its first two profiles, and
    tags contrary to its energy and tempo.
    """
    names = names_of(selected)
    contrary = F.flatten(
        F.transform(
            names, lambda n: _banned(_contrary_of(n), F.greatest(F.lit(fv.CONTRARY_MIN), _score(lookup, n)))
        )
    )
    safe = semantics["dialogue_safe_score"]
    nothing = F.array().cast("array<struct<name:string,value:double>>")
    loud = F.when(
        safe >= fv.DIALOGUE_STRONG_AT,
        _banned(strings(fv.LOUD_TAGS), F.lit(fv.LOUD_BASE) + F.lit(fv.LOUD_SHARE) * safe),
    ).otherwise(nothing)
    by_profile = F.flatten(
        F.transform(
            F.slice(semantics["weight_profile_candidates"], 1, 2),
            lambda p: _banned(
                F.coalesce(F.try_element_at(string_lists(fv.PROFILE_BANS), p), strings()), F.lit(fv.PROFILE_BAN_SCORE)
            ),
        )
    )
    by_target = F.flatten(
        F.transform(
            F.array(targets["energy_target"], targets["tempo_target"]),
            lambda t: _banned(_contrary_of(t), F.lit(fv.TARGET_BAN_SCORE)),
        )
    )
    everything = F.concat(contrary, loud, by_profile, by_target)

    def order(found: Column) -> Column:
        open_names = F.array_except(F.array_distinct(F.transform(found, lambda b: b["name"])), names)
        keyed = F.transform(
            open_names,
            lambda n, i: F.struct(
                (-F.array_max(
                    F.transform(F.filter(found, lambda b: b["name"] == n), lambda b: b["value"])
                )).alias("minus"),
                i.alias("place"),
                n.alias("name"),
            ),
        )
        return F.slice(F.transform(F.array_sort(keyed), lambda b: b["name"]), 1, 6)

    return bind(everything, order)


def confidence_profile(selected: Column) -> Column:
    """Mean, largest and smallest selected score; zeros when nothing is selected."""
    scores = F.transform(selected, lambda r: r["score"])
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x)
    some = F.size(selected) > 0
    return F.struct(
        F.when(some, total / F.size(selected)).otherwise(0.0).alias("mean_selected_tag_score"),
        F.coalesce(F.array_max(scores), F.lit(0.0)).alias("max_selected_tag_score"),
        F.coalesce(F.array_min(scores), F.lit(0.0)).alias("min_selected_tag_score"),
    )


def tag_selection(selected: Column, must_not: Column) -> Column:
    should = names_of(selected, 8)
    return F.struct(
        should.alias("should_have_tags"),
        F.slice(F.array_except(must_not, should), 1, 6).alias("must_not_tags"),
        confidence_profile(selected).alias("confidence_profile"),
    )


def _joined(items: Column, n: int) -> Column:
    return words(F.concat_ws(", ", F.slice(items, 1, n)))


def track_texts(selected: Column, semantics: Column, targets: Column) -> Column:
    emotions = _or_default(semantics["emotional_direction"], ["cinematic"])
    narrative = _or_default(semantics["narrative_function"], ["underscore"])
    sound = targets["sound_character_target"]
    sound = F.when(F.size(sound) > 0, _joined(sound, 2)).otherwise("atmospheric")
    title = F.concat(
        title_case(F.get(emotions, F.lit(0))), F.lit(" "), title_case(F.get(narrative, F.lit(0))), F.lit(" Cue")
    )
    description = F.concat(
        F.lit("Instrumental cue with "), _joined(emotions, 2), F.lit(" and "), _joined(narrative, 2),
        F.lit("; "), words(targets["energy_target"]), F.lit(" energy, "),
        words(targets["intensity_shape_target"]), F.lit(" shape, "), sound, F.lit(" character."),
    )
    summary = F.when(F.size(selected) > 0, _joined(names_of(selected), 6)).otherwise(
        "cinematic instrumental underscore"
    )
    return F.struct(
        cut(title, fv.PROMPT_MAX).alias("semantic_title_en"),
        cut(description, fv.TEXT_MAX).alias("description_en"),
        cut(summary, fv.TEXT_MAX).alias("tags_summary_en"),
    )


def track_prompts(texts: Column, semantics: Column, targets: Column, selection: Column) -> Column:
    def some(items: Column, n: int, default: str) -> Column:
        return F.when(F.size(items) > 0, _joined(items, n)).otherwise(default)

    prompts = {
        "semantic_scene_prompt": texts["description_en"],
        "music_for_scene_prompt": F.concat(F.lit("instrumental music for "), F.lower(texts["semantic_title_en"])),
        "emotion_prompt": some(semantics["emotional_direction"], 3, "cinematic"),
        "narrative_prompt": some(semantics["narrative_function"], 3, "underscore"),
        "sonic_prompt": some(targets["sound_character_target"], 3, "atmospheric"),
        "tag_prompt": some(selection["should_have_tags"], 6, "cinematic"),
        "concise_core_prompt": texts["tags_summary_en"],
    }
    return F.struct(*[cut(value, fv.PROMPT_MAX).alias(name) for name, value in prompts.items()])


def with_selection(tracks: DataFrame, scores_col: str = "tag_scores") -> DataFrame:
    """Add ``selected_tags``, ``tag_lookup`` and ``safe_score``."""
    return (
        tracks.withColumn("selected_tags", select_tags(F.col(scores_col)))
        .withColumn("tag_lookup", score_lookup(F.col("selected_tags")))
        .withColumn("safe_score", dialogue_safe_score(F.col("tag_lookup")))
    )


def track_contracts(
    tracks: DataFrame, scores_col: str = "tag_scores", analysis_col: str | None = "audio_analysis"
) -> DataFrame:
    """Replace tag scores by the full contract columns."""
    selected, lookup = F.col("selected_tags"), F.col("tag_lookup")
    semantics, targets = F.col("track_music_semantics"), F.col("track_music_targets")
    analysis = F.col(analysis_col) if analysis_col else None
    staged = (
        with_selection(tracks, scores_col)
        .withColumn("track_music_semantics", music_semantics(selected, lookup, F.col("safe_score")))
        .withColumn("track_music_targets", music_targets(selected, analysis))
        .withColumn("must_not", must_not_tags(selected, lookup, semantics, targets))
        .withColumn("track_tag_selection", tag_selection(selected, F.col("must_not")))
        .withColumn("texts", track_texts(selected, semantics, targets))
        .withColumn(
            "track_clap_prompt_ensemble",
            track_prompts(F.col("texts"), semantics, targets, F.col("track_tag_selection")),
        )
    )
    return staged.select(
        *[c for c in tracks.columns if c != scores_col],
        "texts.semantic_title_en", "texts.description_en", "texts.tags_summary_en",
        "track_music_semantics", "track_music_targets", "track_tag_selection",
        "track_clap_prompt_ensemble",
    )
