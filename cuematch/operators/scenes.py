"""Scene records: splitting texts, checking stored answers, assembling rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuematch import fixed_values as fv
from cuematch import schemas
from cuematch.functions.arrays import as_set, strings
from cuematch.functions.text import header_keyword, split_scenes, strip


def scenes_of(screenplays: DataFrame, header: str = fv.SCENE_HEADER) -> tuple[DataFrame, DataFrame]:
    """(scenes, rejects) of a (file_name, episode_nr, text) table.

    Scenes are numbered by their place, not by the printed number.
    """
    split = split_scenes(F.col("text"), header)
    # A text without scenes explodes to no rows, so the costly split is done
    # once; a filter on it would be pushed below and split again.
    good = screenplays.filter(F.col("episode_nr").isNotNull()).select(
        "file_name", "episode_nr", F.posexplode(split).alias("place", "scene_txt")
    )
    scenes = good.select("file_name", "episode_nr", (F.col("place") + 1).alias("scene_nr"), "scene_txt")
    keyword = header_keyword(header)
    reason = (
        F.when(F.col("episode_nr").isNull(), "no episode number in the file name")
        .when(F.coalesce("text", F.lit("")) == "", "empty text")
        .when(F.size(split) == 0, f'no scene headers found, expected keyword "{keyword}"')
    )
    rejects = screenplays.select("file_name", "episode_nr", reason.alias("reason")).filter(F.col("reason").isNotNull())
    return scenes, rejects


# --- stored answers ----------------------------------------------------------

def _empty(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def _text_issue(c: Column, label: str, longest: int | None = None) -> list[Column]:
    issues = [F.when(_empty(c), f"{label} is empty")]
    if longest:
        issues.append(F.when(F.char_length(c) > longest, f"{label} is longer than {longest}"))
    return issues


def _null_issue(c: Column, label: str) -> Column:
    return F.when(c.isNull(), f"{label} is missing")


def _odd_kind(value: Column, wanted: str) -> Column:
    """Whether a JSON value has another kind; a missing or null one has none."""
    kind = F.schema_of_variant(value)
    fits = kind.isin("VOID", "ARRAY<VOID>", wanted) if wanted.startswith("ARRAY") else kind.isin("VOID", wanted)
    return F.coalesce(~fits, F.lit(False))


def _at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", "variant")


_THEME_TEXTS = ["theme_title_pl", "theme_title_en", "description_en", "theme_txt"]


def theme_list_kinds(raw: Column) -> Column:
    """Issues of the kinds of values in a theme list, ``raw`` being a variant: a text must be a JSON string."""
    inner = F.flatten(F.transform(
        F.try_variant_get(raw, "$.themes", "array<variant>"),
        lambda t, i: F.array_compact(F.array(*[
            F.when(_odd_kind(_at(t, f), "STRING"), F.concat(F.lit("themes["), i.cast("string"), F.lit(f"].{f} is not a text")))
            for f in _THEME_TEXTS
        ])),
    ))
    reason = F.when(_odd_kind(_at(raw, "segmentation_reason"), "STRING"), "segmentation_reason is not a text")
    return F.concat(F.coalesce(inner, strings()), F.array_compact(F.array(reason)))


_GROUPS = {
    "scene_music_semantics": schemas.SCENE_SEMANTICS, "scene_music_targets": schemas.TARGETS,
    "scene_tag_selection": schemas.SCENE_TAG_SELECTION, "clap_prompt_ensemble": schemas.PROMPT_ENSEMBLE,
}


def theme_query_kinds(raw: Column, groups: dict[str, Column], answer: Column) -> Column:
    """Issues of the kinds of values in a theme query: texts, and lists of texts without a null.

    ``groups`` are the four inner objects of ``raw`` as maps, so each is walked once.
    """
    fields = [(g, f.name, f.dataType.typeName()) for g, schema in _GROUPS.items() for f in schema.fields]
    issues = [F.when(_odd_kind(_at(raw, "tags_summary_en"), "STRING"), "tags_summary_en is not a text")]
    issues += [F.when(_odd_kind(groups[g][name], "STRING"), f"{name} is not a text") for g, name, kind in fields if kind == "string"]
    for g, name, kind in fields:
        if kind == "array":
            holds_null = F.coalesce(F.exists(answer[g][name], lambda x: x.isNull()), F.lit(False))
            issues.append(F.when(_odd_kind(groups[g][name], "ARRAY<STRING>") | holds_null, f"{name} is not a list of texts"))
    return F.array_compact(F.array(*issues))


def theme_list_issues(answer: Column) -> Column:
    """Issues of a parsed theme list."""
    themes = answer["themes"]
    inner = F.flatten(
        F.transform(
            themes,
            lambda t, i: F.array_compact(
                F.array(
                    *[
                        F.when(
                            F.coalesce(strip(t[f]), F.lit("")) == "",
                            F.concat(F.lit("themes["), i.cast("string"), F.lit(f"].{f} is empty")),
                        )
                        for f in _THEME_TEXTS
                    ]
                )
            ),
        )
    )
    own = F.array_compact(
        F.array(
            F.when(answer.isNull(), "not an object"),
            F.when(answer.isNotNull() & (F.coalesce(F.size(themes), F.lit(0)) < 1), "themes is empty"),
            F.when(answer.isNotNull() & _empty(answer["segmentation_reason"]), "segmentation_reason is empty"),
        )
    )
    return F.concat(own, F.coalesce(inner, strings()))


def theme_query_issues(answer: Column) -> Column:
    """Issues of a parsed theme query."""
    sem, tgt = answer["scene_music_semantics"], answer["scene_music_targets"]
    sel, prompts = answer["scene_tag_selection"], answer["clap_prompt_ensemble"]
    issues: list[Column] = []
    issues += _text_issue(answer["tags_summary_en"], "tags_summary_en", fv.PROMPT_MAX)
    for name in ("emotional_direction", "narrative_function", "dialogue_safe_required"):
        issues.append(_null_issue(sem[name], name))
    issues += _text_issue(sem["weight_profile"], "weight_profile")
    for name in ("energy_target", "tempo_target", "rhythm_target", "intensity_shape_target"):
        issues += _text_issue(tgt[name], name)
    issues.append(_null_issue(tgt["sound_character_target"], "sound_character_target"))
    for name in ("should_have_tags", "must_not_tags"):
        issues.append(_null_issue(sel[name], name))
    for name in fv.ENSEMBLE_PROMPTS:
        issues += _text_issue(prompts[name], name, fv.PROMPT_MAX)
    both = F.sort_array(F.array_intersect(as_set(sel["should_have_tags"]), as_set(sel["must_not_tags"])))
    issues.append(F.when(F.size(both) > 0, F.concat(F.lit("overlapping tags: "), F.concat_ws(", ", both))))
    listed = F.array_compact(F.array(*issues))
    return F.when(answer.isNull(), strings(["not an object"])).otherwise(listed)


def _parsed(answers: DataFrame, json_col: str, schema) -> DataFrame:
    """Answers with ``parsed`` and ``_raw``: the text is parsed once by the schema and once as a variant.

    Both are columns of their own below the many expressions that read them;
    written into those, each would parse the text again.
    """
    return answers.withColumns({"parsed": F.from_json(json_col, schema), "_raw": F.try_parse_json(json_col)})


def check_theme_lists(answers: DataFrame, json_col: str = "answer") -> DataFrame:
    """Add ``parsed`` and ``issues`` to stored theme lists."""
    both = _parsed(answers, json_col, schemas.THEME_LIST)
    issues = F.concat(theme_list_issues(F.col("parsed")), theme_list_kinds(F.col("_raw")))
    return both.withColumn("issues", issues).drop("_raw")


def check_theme_queries(answers: DataFrame, json_col: str = "answer") -> DataFrame:
    """Add ``parsed`` and ``issues`` to stored theme queries."""
    both = _parsed(answers, json_col, schemas.THEME_QUERY)
    inner = {f"_{g}": F.try_variant_get("_raw", f"$.{g}", "map<string,variant>") for g in _GROUPS}
    kinds = theme_query_kinds(F.col("_raw"), {g: F.col(f"_{g}") for g in _GROUPS}, F.col("parsed"))
    issues = F.concat(theme_query_issues(F.col("parsed")), kinds)
    return both.withColumns(inner).withColumn("issues", issues).drop("_raw", *inner)


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.filter(F.size("issues") == 0), checked.filter(F.size("issues") > 0)


def _stripped(c: Column, schema) -> Column:
    """Struct with its text fields stripped."""
    return F.struct(
        *[
            (strip(c[f.name]) if f.dataType.typeName() == "string" else c[f.name]).alias(f.name)
            for f in schema.fields
        ]
    )


def themes_of(valid_lists: DataFrame) -> DataFrame:
    """One row per theme of valid theme lists; scenes and themes count from 1."""
    rows = valid_lists.filter((F.col("episode_nr") > 0) & (F.col("scene_nr") > 0)).select(
        "episode_nr", "scene_nr",
        strip(F.col("parsed.segmentation_reason")).alias("segmentation_reason"),
        F.posexplode("parsed.themes").alias("place", "theme"),
    )
    return rows.select(
        "episode_nr", "scene_nr", (F.col("place") + 1).alias("theme_nr"), "segmentation_reason",
        *[strip(F.col(f"theme.{f.name}")).alias(f.name) for f in schemas.THEME.fields],
    )


def assemble_records(valid_lists: DataFrame, valid_queries: DataFrame) -> DataFrame:
    """Scene records from valid theme lists and the query of each theme.

    ``valid_queries`` is keyed by (episode_nr, scene_nr, theme_nr).
    """
    q = F.col("parsed")
    queries = valid_queries.select(
        "episode_nr", "scene_nr", "theme_nr",
        strip(q["tags_summary_en"]).alias("tags_summary_en"),
        _stripped(q["scene_music_semantics"], schemas.SCENE_SEMANTICS).alias("scene_music_semantics"),
        _stripped(q["scene_music_targets"], schemas.TARGETS).alias("scene_music_targets"),
        q["scene_tag_selection"].alias("scene_tag_selection"),
        _stripped(q["clap_prompt_ensemble"], schemas.PROMPT_ENSEMBLE).alias("clap_prompt_ensemble"),
    )
    joined = themes_of(valid_lists).join(queries, ["episode_nr", "scene_nr", "theme_nr"])
    return joined.withColumn("id", F.xxhash64("episode_nr", "scene_nr", "theme_nr"))


def assembly_rejects(lists: DataFrame, queries: DataFrame) -> DataFrame:
    """What :func:`assemble_records` leaves out: (episode_nr, scene_nr, theme_nr, reason)."""
    keys = ["episode_nr", "scene_nr", "theme_nr"]
    good = F.coalesce((F.col("episode_nr") > 0) & (F.col("scene_nr") > 0), F.lit(False))
    themes, asked = themes_of(lists).select(keys), queries.select(keys)
    odd = lists.filter(~good).select("episode_nr", "scene_nr", F.lit(None).cast("int").alias("theme_nr"), F.lit("numbers must be positive").alias("reason"))
    alone = themes.join(asked, keys, "left_anti").withColumn("reason", F.lit("theme without a valid query"))
    lost = asked.join(themes, keys, "left_anti").withColumn("reason", F.lit("query without a theme"))
    return odd.unionByName(alone).unionByName(lost)


def answer_vocabulary() -> dict[str, list[str]]:
    """Allowed words per field of a scene answer."""
    words = {category: list(data["tags"]) for category, data in fv.TAXONOMY.items()}
    words["narrative"] = [fv.ANSWER_NARRATIVE_SWAP.get(w, w) for w in words["narrative"]]
    every = sorted({w for listed in words.values() for w in listed})
    return {
        "emotional_direction": words["emotion"],
        "narrative_function": words["narrative"],
        "weight_profile": words["scene"],
        "energy_target": words["energy"],
        "tempo_target": words["tempo"],
        "rhythm_target": words["rhythm"],
        "intensity_shape_target": words["intensity_shape"],
        "sound_character_target": words["sound_character"],
        "should_have_tags": every,
        "must_not_tags": every,
    }


def vocabulary_report(records: DataFrame, key: str) -> DataFrame:
    """Words outside the vocabulary: (key, field, word). Nothing is rejected."""
    places = {
        "emotional_direction": "scene_music_semantics", "narrative_function": "scene_music_semantics",
        "weight_profile": "scene_music_semantics", "energy_target": "scene_music_targets",
        "tempo_target": "scene_music_targets", "rhythm_target": "scene_music_targets",
        "intensity_shape_target": "scene_music_targets", "sound_character_target": "scene_music_targets",
        "should_have_tags": "scene_tag_selection", "must_not_tags": "scene_tag_selection",
    }
    single = {"weight_profile", "energy_target", "tempo_target", "rhythm_target", "intensity_shape_target"}
    cells = []
    for field, allowed in answer_vocabulary().items():
        value = F.col(f"{places[field]}.{field}")
        listed = F.array_compact(F.array(value)) if field in single else as_set(value)
        odd = F.array_except(listed, strings(allowed))
        cells.append(F.struct(F.lit(field).alias("field"), odd.alias("words")))
    rows = records.select(F.col(key), F.inline(F.array(*cells)))
    return rows.select(key, "field", F.explode("words").alias("word"))
