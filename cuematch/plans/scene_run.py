"""The scene side as one run: texts and stored answers in, one commit out."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuematch import fixed_values as fv
from cuematch.operators import embed, scenes
from cuematch.plans import versions
from cuematch.plans.storage import materialize
from cuematch.schemas import MATCHES, SCENES
from cuematch.sources.files import prepare_screenplays

SCENE_TABLE = versions.Table("scenes", ("episode_nr", "scene_nr", "theme_nr"), by=("episode_nr",))
MATCH_TABLE = versions.Table("matches", ("episode_nr", "scene_query_id", "track_query_id"), by=("episode_nr",))
REJECT_TABLE = versions.Table("rejects", ("episode_nr", "scene_nr", "theme_nr"), by=("episode_nr",))


def _rejects(rows: DataFrame, stage: str, reason: Column) -> DataFrame:
    kinds = {"file_name": "string", "episode_nr": "int", "scene_nr": "int", "theme_nr": "int"}
    own = [(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]
    return rows.select(*own, F.lit(stage).alias("stage"), reason.alias("reason"))


def _one_answer(answers: DataFrame, keys: list[str], places: DataFrame, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers that stand alone under their key and belong to a scene; the others as rejects; the keys of all.

    Only keys are counted and compared; the answers' texts stay where they are
    unless very many keys are bad.
    """
    listed = materialize(answers.select(*keys), "answer-keys")
    known = places.withColumn("known", F.lit(True))
    counted = listed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(known, ["episode_nr", "scene_nr"], "left")
    bad = materialize(counted.filter("known is null or n > 1"), "bad-answers")
    reason = F.when(F.col("known").isNull(), f"{kind} without a scene").otherwise(f"several answers for one {kind}")
    each = bad.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return answers.join(bad.select(*keys), keys, "left_anti"), _rejects(each, "answers", reason), listed


def build_scenes(
    screenplays: DataFrame, theme_lists: DataFrame, theme_queries: DataFrame,
    encoder: embed.Encoder | None = None, header: str = fv.SCENE_HEADER,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scene rows, rejects, episodes) of raw texts and stored answers.

    ``screenplays`` is (file_name, text); ``theme_lists`` (episode_nr, scene_nr,
    answer); ``theme_queries`` (episode_nr, scene_nr, theme_nr, answer). What
    cannot become a scene row is a reject (file_name, episode_nr, scene_nr,
    theme_nr, stage, reason) and stops nothing else: stage ``text`` for texts
    without a number, headers or content, or with a number that several files
    have; ``answers`` for missing, doubled, misplaced or faulty answers and themes
    without their query; ``vectors`` for texts that the encoder cannot take.
    ``episodes`` are those whose text was split.
    """
    place, full = ["episode_nr", "scene_nr"], ["episode_nr", "scene_nr", "theme_nr"]
    texts = prepare_screenplays(screenplays)
    shared = texts.filter(F.col("episode_nr").isNotNull()).groupBy("episode_nr").count().filter("count > 1").select("episode_nr")
    found, refused = scenes.scenes_of(texts.join(shared, "episode_nr", "left_anti"), header)
    found = materialize(found.select(*place), "split-scenes")
    told = [
        _rejects(refused, "text", F.col("reason")),
        _rejects(texts.join(shared, "episode_nr", "left_semi"), "text", F.lit("several files have this episode number")),
    ]
    lists, odd, listed = _one_answer(theme_lists, place, found, "theme list")
    told += [odd, _rejects(found.join(listed, place, "left_anti"), "answers", F.lit("scene without a theme list"))]
    queries, odd, _listed = _one_answer(theme_queries, full, found, "theme query")
    told.append(odd)
    checked = []
    for rows, keys, check in ((lists, place, scenes.check_theme_lists), (queries, full, scenes.check_theme_queries)):
        good, bad = scenes.split_valid(materialize(check(rows).select(*keys, "parsed", "issues"), "checked"))
        checked.append(good)
        told.append(_rejects(bad, "answers", F.concat_ws("; ", "issues")))
    told.append(_rejects(scenes.assembly_rejects(*checked), "answers", F.col("reason")))
    # the scene's own text is as long as the screenplay: it joins at the end
    records = scenes.assemble_records(*checked).drop("theme_txt")
    embedded = materialize(embed.scene_vectors(records, encoder, errors="encode_errors"), "encoded-scenes")
    texts_of = F.concat_ws("; ", F.transform("encode_errors", lambda e: F.concat_ws(": ", F.when(e["column"] != "", e["column"]), e["error"])))
    told.append(_rejects(embedded.filter(F.size("encode_errors") > 0), "vectors", texts_of))
    now = F.current_timestamp().cast("timestamp_ntz")
    whole = embedded.filter(F.size("encode_errors") == 0).withColumns({"created_at": now, "updated_at": now})
    whole = whole.join(scenes.themes_of(checked[0]).select(*full, "theme_txt"), full)
    rows = whole.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCENES.fields])
    return rows, functools.reduce(DataFrame.unionByName, told), found.select("episode_nr").distinct()


def import_scenes(
    screenplays: DataFrame, theme_lists: DataFrame, theme_queries: DataFrame, path: str,
    encoder: embed.Encoder | None = None, header: str = fv.SCENE_HEADER,
) -> int:
    """Run :func:`build_scenes` and swap its result into the store at ``path``; returns the version.

    One commit holds everything: the scenes of each split episode replace the
    stored ones, the matches of those episodes go with the scenes they belonged
    to, and the rejects of every episode of this run replace its old ones. Buckets
    without such an episode keep their files. Until the commit readers see the old
    state, and a run that fails leaves nothing behind that they could see.
    """
    spark = screenplays.sparkSession
    base = versions.current(spark, path)
    rows, rejects, episodes = build_scenes(screenplays, theme_lists, theme_queries, encoder, header)
    rejects, episodes = materialize(rejects, "scene-rejects"), materialize(episodes, "scene-episodes")
    told = episodes.unionByName(rejects.select("episode_nr")).distinct()
    return versions.commit(spark, path, [
        versions.replacing(spark, path, base, SCENE_TABLE, rows, episodes),
        versions.replacing(spark, path, base, REJECT_TABLE, rejects, told),
        versions.replacing(spark, path, base, MATCH_TABLE, spark.createDataFrame([], MATCHES), episodes),
    ], base)
