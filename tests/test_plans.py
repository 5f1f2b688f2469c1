import datetime
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import queries as q
from checks import standins as fx
from cuematch import fixed_values as fv
from cuematch.operators import contract, embed, ranking, scenes, signals, validate
from cuematch.plans import catalog, ingest, matching, persist, reports, scene_run, storage, versions, views
from cuematch.sources import decode, files, taxonomy


# --- sources -----------------------------------------------------------------

def test_audio_files(spark, tmp_path):
    for name in ["b.MP3", "a.wav", "._a.wav", "x.txt", "sub/c.flac"]:
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"12345")
    df = files.audio_files(spark, str(tmp_path))
    rows = df.collect()
    assert [r["filename"] for r in rows] == ["a.wav", "b.MP3", "c.flac"] and rows[0]["length"] == 5
    assert "content" not in df.columns


def test_screenplays_to_scenes(spark, tmp_path):
    (tmp_path / "ep 7.txt").write_text("x\r\nSCENA 1\r\n\r\nA   b\r\nSCENA 5: c\r\nd\r\n")
    (tmp_path / "nothing.txt").write_text("SCENA 1 x")
    (tmp_path / "ep+8.txt").write_text("plain text")
    good, bad = scenes.scenes_of(files.screenplays(spark, str(tmp_path)))
    rows = good.orderBy("scene_nr").collect()
    assert [(r["episode_nr"], r["scene_nr"], r["scene_txt"]) for r in rows] == [(7, 1, "SCENA 1\n\nA b"), (7, 2, "SCENA 5: c\nd")]
    reasons = {r["file_name"]: r["reason"] for r in bad.collect()}
    assert "episode number" in reasons["nothing.txt"] and "SCENA" in reasons["ep+8.txt"]


def test_decode_rows(spark):
    df = spark.createDataFrame([(1, '{"k": 5}', "[1,2]"), (2, None, None), (3, "[1]", ""), (4, "nope", "")], "id int, o string, v string")
    good, bad = decode.decode_rows(df, {"o": T.StructType([T.StructField("k", T.IntegerType())])}, ["v"])
    assert {r["id"]: (r["o"]["k"], r["v"]) for r in good.collect()} == {1: (5, [1.0, 2.0]), 2: (None, [])}
    assert {r["id"]: r["bad_columns"] for r in bad.collect()} == {3: ["o"], 4: ["o"]}
    assert spark.range(1).select(decode.encode(F.struct(F.lit(1).alias("a")))).first()[0] == '{"a":1}'


def test_signal_stats_over_chunk_seams(spark):
    values = [1.0, -1.0, -1.0, 0.0, 2.0, -2.0, 3.0]
    rows = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "signal_id string, pos long, value double")
    for chunk in (1, 2, 3, 100):
        r = signals.signal_stats(rows, chunk=chunk).first()
        assert r["n_samples"] == 7 and r["crossing_rate"] == pytest.approx(4 / 7)
        assert r["rms"] == pytest.approx((20 / 7) ** 0.5)


# --- validation --------------------------------------------------------------

def test_constraint_report_of_typed_rows(spark):
    sem = F.expr("named_struct('emotional_direction', array('a'), 'narrative_function', cast(null as array<string>), 'weight_profile', 'x', 'dialogue_safe_required', true)")
    df = spark.createDataFrame([(1, 1, 1, 1, None), (2, 1, 1, 1, "r")], "id int, episode_nr int, scene_nr int, theme_nr int, segmentation_reason string")
    df = df.withColumn("scene_music_semantics", sem).withColumn("embedding_main", F.array(F.lit(1.0)))
    rules = {(r["rule"], r["key"]) for r in validate.constraint_report(df, "scenes", "id", dim=2).collect()}
    assert ("segmentation_reason not null", "1") in rules and ("segmentation_reason not null", "2") not in rules
    assert ("scene_music_semantics required keys", "1") in rules and ("embedding_main has 2 numbers", "2") in rules
    assert ("unique (episode_nr, scene_nr, theme_nr)", "1/1/1") in rules


def test_match_keys(spark):
    df = spark.createDataFrame([(1, 1, 5, 1), (2, 1, 5, 2)], "id int, scene_query_id long, track_query_id long, rank_position int")
    rows = validate.constraint_report(df, "matches", "id").collect()
    assert [(r["rule"], r["key"]) for r in rows] == [("unique (scene_query_id, track_query_id)", "1/5")]


# --- catalog, views, reports -------------------------------------------------

def test_views_over_a_ranking(spark, sf):
    m = q.matches(spark, sf)
    s, t = fx.scenes(spark, sf), fx.tracks(spark, sf)
    n = m.count()
    assert views.match_debug(m, s, t).count() == n == views.match_compare(m, s, t).count()
    order = [tuple(r) for r in views.match_debug(m, s, t).select("episode_nr", "scene_nr", "theme_nr", "rank_position").collect()]
    assert order == sorted(order)
    assert views.match_top1(m, s, t).filter("rank_position <> 1").count() == 0
    lines = [tuple(r) for r in reports.report_order(m).select("episode_nr", "scene_nr", "theme_nr", "scene_theme_title_en", "rank_position").collect()]
    assert lines == sorted(lines)
    short = reports.short_report(m)
    assert short.columns == reports.SHORT_COLUMNS and short.count() == 3 * s.count()
    assert len(reports.full_report(m).columns) == 30
    assert sum(len(r["matches"]) for r in reports.grouped_report(m).collect()) == n
    assert validate.constraint_report(m, "matches", "id").count() == 0
    full = m.filter("rank_position = 1").select("match_explanation", "track_query_id").first()
    import json

    told = json.loads(full["match_explanation"])
    assert told["track"]["track_query_id"] == full["track_query_id"] and set(told) == {"scene", "track", "component_scores", "penalties"}
    assert catalog.matches_of_theme(m, 1, 1, 1).columns == catalog.THEME_MATCH_COLUMNS


def test_lookups_prune_and_push(spark, sf, tmp_path):
    path = str(tmp_path / "tracks")
    fx.tracks(spark, sf).write.parquet(path)
    plan = catalog.track_detail(spark.read.parquet(path), fx.TRACK_BASE + 3)._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert "EqualTo(id," in physical and "embedding_main" not in physical


def test_defaults_and_missing(spark, sf):
    m = q.matches(spark, sf).withColumn("final_score", F.lit(None).cast("double")).withColumn("style_signature", F.lit(None).cast("string"))
    row = catalog.matches_of_episode(m, 1).first()
    assert row["final_score"] == 0.0 and row["style_signature"] == ""
    s = fx.scenes(spark, sf)
    assert catalog.scene_by_place(s.drop("segmentation_reason"), 1, 1, 1).count() == 1
    assert not any(r["matched"] for r in catalog.episode_options(s, None, 3).collect())
    assert catalog.episode_options(s, None, 3).count() == 3
    nothing = spark.createDataFrame([], "id long")
    assert catalog.tracks_by_ids(fx.tracks(spark, sf), nothing).count() == 0


def test_field_lines_and_rounding(spark):
    df = spark.createDataFrame([(1, None, (["a", "b"], True))], "id int, theme_txt string, scene_music_semantics struct<e:array<string>,r:boolean>")
    rows = {r["field"]: r["value"] for r in reports.field_lines(df).collect()}
    assert rows == {"theme_txt": "-", "scene_music_semantics": "e: a, b\nr: True"}
    nested = spark.range(1).select(F.struct(F.array(F.lit(1.23456)).alias("x"), F.lit("s").alias("s")).alias("b"), F.create_map(F.lit("k"), F.lit(2.00049)).alias("m"))
    row = reports.round_floats(nested).first()
    assert row["b"]["x"] == [1.235] and row["m"] == {"k": 2.0}


def test_write_report(spark, sf, tmp_path):
    path = str(tmp_path / "r")
    short = reports.short_report(q.matches(spark, sf))
    reports.write_report(short, path)
    assert spark.read.option("header", "true").csv(path).count() == short.count()


# --- persistence -------------------------------------------------------------

OLD = "id long, filepath string, note string, created_at timestamp_ntz, updated_at timestamp_ntz"


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a", "old", None, None), (2, "b", "old", None, None)], OLD)
    new = spark.createDataFrame([(9, "b", "new"), (8, "c", "new")], "id long, filepath string, note string")
    once = persist.upsert_tracks(old, new)
    got = {r["filepath"]: (r["id"], r["note"], r["merge_action"], r["updated_at"] is not None) for r in once.collect()}
    assert got == {"a": (1, "old", "kept", False), "b": (2, "new", "updated", True), "c": (8, "new", "inserted", True)}
    twice = persist.upsert_tracks(once.drop("merge_action"), new)
    key = lambda df: sorted((r["id"], r["filepath"], r["note"]) for r in df.collect())
    assert key(once) == key(twice)


def test_episode_partitions_on_storage(spark, tmp_path):
    path = str(tmp_path / "m")
    make = lambda rows: spark.createDataFrame(rows, "episode_nr int, scene_query_id long, score double")
    persist.overwrite_episodes(make([(1, 1, 0.1), (2, 2, 0.2)]), path)
    persist.overwrite_episodes(make([(2, 3, 0.9)]), path)
    assert sorted((r["episode_nr"], r["score"]) for r in spark.read.parquet(path).collect()) == [(1, 0.1), (2, 0.9)]
    persist.overwrite_episodes(make([(1, 4, 0.5)]).limit(0), path, episodes=[1, 7])
    assert [(r["episode_nr"], r["score"]) for r in spark.read.parquet(path).collect()] == [(2, 0.9)]
    persist.overwrite_episodes(make([(1, 4, 0.5), (2, 9, 0.3), (3, 3, 0.3)]), path, episodes=[1])
    assert sorted((r["episode_nr"], r["score"]) for r in spark.read.parquet(path).collect()) == [(1, 0.5), (2, 0.9)]
    with pytest.raises(ValueError):
        persist.delete_episode(make([(1, 1, 0.1)]), 0)
    persist.write_snapshot(make([(1, 1, 0.1)]), str(tmp_path / "s"))
    with pytest.raises(Exception):
        persist.write_snapshot(make([(1, 1, 0.1)]), str(tmp_path / "s"))


def test_small_episode_is_one_file(spark, tmp_path):
    rows = spark.range(400).selectExpr("cast(id div 20 as int) episode_nr", "id scene_query_id", "double(id) score").repartition(8)
    persist.overwrite_episodes(rows, str(tmp_path / "m"))
    assert len(list((tmp_path / "m").glob("episode_nr=*/*.parquet"))) == 20
    assert spark.read.parquet(str(tmp_path / "m")).count() == 400


def test_rerun_episode_replaces_scenes(spark, sf):
    s = fx.scenes(spark, sf)
    fresh = s.filter("episode_nr = 2").limit(3).withColumn("theme_txt", F.lit("fresh"))
    after = persist.rerun_episode(s, fresh, 2)
    assert after.filter("episode_nr = 2").count() == 3 and after.filter("episode_nr <> 2").count() == s.filter("episode_nr <> 2").count()


def test_materialize_uses_the_shared_folder(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    folder = storage.work_dir(spark)
    if named:
        assert folder == named.rstrip("/")
    df = storage.materialize(spark.range(5), "numbers")
    assert df.count() == 5
    assert all(f"{storage.run_dir(spark).split(':')[-1]}/numbers-" in name for name in df.inputFiles())


# --- ingest ------------------------------------------------------------------

def test_import_run(spark):
    record = ("named_struct('rms', 0.2D, 'zero_crossing_rate', 0.05D, 'spectral_centroid', 100D, 'spectral_rolloff', 1D, 'energy_target_hint', 'high',"
              "'tempo_target_hint', 'fast', 'rhythm_target_hint', 'steady', 'intensity_shape_hint', 'static', 'sound_character_hints', array('clean'))")
    features = spark.createDataFrame(
        [("a.mp3", "l/a.mp3", 10.0, 90, "C", "ok", None, None), ("b.mp3", "l/b.mp3", 70.0, None, None, "ok", None, None),
         ("c.mp3", "l/c.mp3", None, None, None, "error", "IOError", "broken"), ("d.mp3", "l/d.mp3", 5.0, 80, "D", "ok", None, None)],
        "filename string, filepath string, duration_sec double, bpm int, musical_key string, status string, error_type string, error string",
    ).withColumn("audio_analysis", F.expr(record))
    segments = spark.createDataFrame([("l/a.mp3", [1.0] + [0.0] * 31), ("l/a.mp3", [0.0, 1.0] + [0.0] * 30), ("l/b.mp3", [0.5] * 32)], "filepath string, embedding array<float>")
    encoder = embed.hashing_encoder(32)
    tag_vecs = embed.tag_vectors(taxonomy.with_prompts(taxonomy.default_tags(spark)), encoder)
    from cuematch.schemas import TRACKS

    existing = spark.createDataFrame([], TRACKS)
    content, outcomes = ingest.import_tracks(features, segments, tag_vecs, existing, encoder)
    content = storage.materialize(content, "content")
    assert sorted(r["filepath"] for r in content.collect()) == ["l/a.mp3", "l/b.mp3"]
    first = content.filter("filename = 'a.mp3'").first()
    assert len(first["embedding_hybrid"]) == 32 and first["track_music_targets"]["energy_target"]
    report = ingest.ingest_report(outcomes).first()
    assert (report["inserted"], report["failed"], report["success_rate"]) == (2, 2, 0.5)
    assert report["errors"] == ["l/c.mp3 :: IOError :: broken", "l/d.mp3 :: NoSegments :: no segment vectors"]
    again, second = ingest.import_tracks(features, segments, tag_vecs, content.drop("merge_action"), encoder)
    report = ingest.ingest_report(second).first()
    assert (report["inserted"], report["updated"], report["skipped"]) == (0, 0, 2)
    assert again.count() == 2


def test_empty_ingest_report(spark):
    row = ingest.ingest_report(spark.createDataFrame([], "filepath string, status string, error_type string, error string")).first()
    assert row["success_rate"] == 0.0 and row["errors"] == []


# --- scene answers -----------------------------------------------------------

def test_bad_answers_are_rejected(spark):
    lists = spark.createDataFrame([(1, "{}"), (2, "not json"), (3, '{"themes": [], "segmentation_reason": "x"}'),
                                   (4, '{"themes": [{"theme_title_pl":"a","theme_title_en":"b","description_en":"c","theme_txt":"d"}], "segmentation_reason": " y "}')],
                                  "scene_nr int, answer string").withColumn("episode_nr", F.lit(1))
    good, bad = scenes.split_valid(scenes.check_theme_lists(lists))
    assert [r["scene_nr"] for r in good.collect()] == [4] and bad.count() == 3
    assert scenes.themes_of(good).first()["segmentation_reason"] == "y"
    queries = spark.createDataFrame([(1, "{}"), (2, "[]")], "scene_nr int, answer string")
    issues = {r["scene_nr"]: r["issues"] for r in scenes.check_theme_queries(queries).collect()}
    assert "tags_summary_en is empty" in issues[1] and "emotional_direction is missing" in issues[1]
    assert issues[2]


def test_answer_vocabulary():
    allowed = scenes.answer_vocabulary()
    assert "narrative_release" in allowed["narrative_function"] and "release" not in allowed["narrative_function"]
    assert "release" in allowed["intensity_shape_target"] and "release" in allowed["should_have_tags"]
    assert len(allowed["emotional_direction"]) == len(fv.TAXONOMY["emotion"]["tags"])


def test_published_versions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    make = lambda rows: spark.createDataFrame(rows, "id long, filepath string, note string, updated_at timestamp_ntz")
    persist.publish(make([(1, "a", "old", None), (2, "b", "old", None)]), path)
    first = datetime.datetime(2024, 1, 1)
    incoming = make([(7, "b", "later", first + datetime.timedelta(days=1)), (8, "b", "earlier", first), (9, "c", "none", None), (9, "c", "new", first)])
    once = persist.upsert_tracks(persist.published(spark, path), incoming)
    persist.publish(once.drop("merge_action"), path)
    got = sorted((r["id"], r["filepath"], r["note"]) for r in persist.published(spark, path).collect())
    assert got == [(1, "a", "old"), (2, "b", "later"), (9, "c", "new")]
    persist.drop_old_versions(spark, path)
    assert len(list((tmp_path / "t/versions").iterdir())) == 1
    assert persist.published(spark, path).count() == 3


def test_themes_without_a_query_are_rejects(spark):
    from cuematch import schemas
    from cuematch.operators import scenes

    theme = {f.name: "x" for f in schemas.THEME.fields if f.dataType.typeName() == "string"}
    lists = spark.createDataFrame(
        [(1, 1, {"segmentation_reason": "r", "themes": [theme, theme]}), (0, 5, {"segmentation_reason": "r", "themes": [theme]})],
        schemas.T.StructType([
            schemas.T.StructField("episode_nr", schemas.T.IntegerType()), schemas.T.StructField("scene_nr", schemas.T.IntegerType()),
            schemas.T.StructField("parsed", schemas.THEME_LIST),
        ]),
    )
    queries = spark.createDataFrame([(1, 1, 1), (4, 4, 4)], "episode_nr int, scene_nr int, theme_nr int")
    got = {tuple(r) for r in scenes.assembly_rejects(lists, queries).collect()}
    assert got == {
        (0, 5, None, "numbers must be positive"), (1, 1, 2, "theme without a valid query"), (4, 4, 4, "query without a theme"),
    }


def test_tables_of_a_run_are_cleared_and_a_cluster_needs_a_folder(spark, monkeypatch):
    from cuematch.plans import storage

    storage.materialize(spark.range(3), "kept-for-a-test").count()
    folder = storage.run_dir(spark).removeprefix("file:")
    assert os.path.isdir(folder)
    storage.delete(spark, f"{storage.run_dir(spark)}/not-there")

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        storage.work_dir(Session())


def test_kinds_of_stored_answers(spark):
    from cuematch.operators import scenes

    rows = [
        '{"themes":[{"theme_title_pl":1,"theme_title_en":"a","description_en":["x"],"theme_txt":"t"}],"segmentation_reason":true}',
        '{"themes":[{"theme_title_pl":"1","theme_title_en":"a","description_en":"d","theme_txt":"t"}],"segmentation_reason":"r"}',
        "no json",
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, answer string")
    got = {r["id"]: set(r["issues"]) for r in scenes.check_theme_lists(df).collect()}
    assert {"themes[0].theme_title_pl is not a text", "themes[0].description_en is not a text", "segmentation_reason is not a text"} <= got[0]
    assert got[1] == set() and got[2]


# --- versioned stores --------------------------------------------------------

TRACKS_IN_BUCKETS = versions.Table("tracks", ("filepath",), buckets=8)


def _stored(spark, path, rows):
    make = spark.createDataFrame(rows, "id long, filepath string, note string, updated_at timestamp_ntz")
    return versions.commit(spark, path, [versions.Change(TRACKS_IN_BUCKETS, make)], versions.current(spark, path))


def _new(spark, rows):
    return spark.createDataFrame(rows, "id long, filepath string, note string")


def test_merge_leaves_untouched_buckets_alone(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    first = _stored(spark, path, [(i, f"f{i}", "old", None) for i in range(100)])
    second = versions.merge(_new(spark, [(900, "f7", "new"), (901, "fresh", "new")]), path, "tracks")
    assert (first, second) == (0, 1)
    before, after = (versions.parts(spark, path, "tracks", v) for v in (0, 1))
    where = {r["filepath"]: r["b"] for r in _new(spark, [(0, "f7", ""), (0, "fresh", "")]).select("filepath", TRACKS_IN_BUCKETS.part().alias("b")).collect()}
    assert {k for k in after if after[k] != before.get(k)} == set(where.values())
    assert len(before) == 8 and sum(after[k] == before[k] for k in before) >= 6
    files = lambda version: {f for f in versions.read(spark, path, "tracks", version=version).inputFiles() if f.split("cuematch_part=")[1].split("/")[0] not in where.values()}
    assert files(0) == files(1) and files(0)
    got = {r["filepath"]: (r["id"], r["note"], r["updated_at"] is not None) for r in versions.read(spark, path, "tracks").collect()}
    assert len(got) == 101 and got["f7"] == (7, "new", True) and got["fresh"] == (901, "new", True) and got["f8"] == (8, "old", False)
    assert versions.read(spark, path, "tracks", version=0).filter("note = 'new'").isEmpty()
    versions.drop_old(spark, path)
    assert versions.versions(spark, path) == [1] and versions.read(spark, path, "tracks").count() == 101


def test_second_writer_of_a_version_fails(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    base = _stored(spark, path, [(1, "a", "old", None)])
    change = lambda note: [versions.Change(TRACKS_IN_BUCKETS, _new(spark, [(1, "a", note)]))]
    versions.commit(spark, path, change("one"), base)
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, change("two"), base)
    assert [r["note"] for r in versions.read(spark, path, "tracks").collect()] == ["one"]
    with pytest.raises(ValueError, match="outside"):
        versions.commit(spark, path, [versions.Change(TRACKS_IN_BUCKETS, _new(spark, [(1, "a", "x")]), [])], 1)


def test_emptied_and_empty_tables(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    _stored(spark, path, [])
    assert versions.read(spark, path, "tracks").collect() == [] and versions.parts(spark, path, "tracks") == {}
    versions.merge(_new(spark, [(1, "a", "n")]), path, "tracks")
    assert versions.read(spark, path, "tracks").count() == 1
    gone = _new(spark, [(1, "a", "")])
    base = versions.current(spark, path)
    versions.commit(spark, path, [versions.replacing(spark, path, base, TRACKS_IN_BUCKETS, gone.limit(0), gone)], base)
    assert versions.read(spark, path, "tracks").collect() == []


def _scene_inputs(spark, title="Good title"):
    plays = spark.createDataFrame(
        [("ep 7.txt", "SCENA 1\nfirst\nSCENA 2\nsecond"), ("ep 8.txt", "no header"), ("none.txt", "SCENA 1 x"), ("a9.txt", "SCENA 1 x"), ("b9.txt", "SCENA 1 y")],
        "file_name string, text string",
    )
    theme = lambda t: f'{{"themes": [{{"theme_title_pl":"a","theme_title_en":"{t}","description_en":"c","theme_txt":"d"}}], "segmentation_reason": " y "}}'
    lists = spark.createDataFrame([(7, 1, theme(title)), (7, 2, theme("Other"))], "episode_nr int, scene_nr int, answer string")
    answers = spark.range(1).select(q._query_json(F.lit("sum"), F.lit("dialogue"), F.array(F.lit("wide")))).first()[0]
    queries = spark.createDataFrame([(7, 1, 1, answers), (7, 2, 1, answers)], "episode_nr int, scene_nr int, theme_nr int, answer string")
    return plays, lists, queries


def test_scene_run_is_one_commit(spark, tmp_path):
    path = f"file://{tmp_path}/scenes"
    version = scene_run.import_scenes(*_scene_inputs(spark), path, embed.hashing_encoder(16))
    assert version == 0
    rows = versions.read(spark, path, "scenes").orderBy("scene_nr").collect()
    assert [(r["episode_nr"], r["scene_nr"], r["theme_title_en"], len(r["embedding_hybrid"])) for r in rows] == [(7, 1, "Good title", 16), (7, 2, "Other", 16)]
    told = sorted((r["file_name"], r["stage"], r["reason"].split(",")[0]) for r in versions.read(spark, path, "rejects").collect())
    assert told == [
        ("a9.txt", "text", "several files have this episode number"), ("b9.txt", "text", "several files have this episode number"),
        ("ep 8.txt", "text", "no scene headers found"), ("none.txt", "text", "no episode number in the file name"),
    ]
    matches = spark.createDataFrame([(7, 1, 5), (1, 2, 5)], "episode_nr int, scene_query_id long, track_query_id long")
    versions.commit(spark, path, [versions.Change(scene_run.MATCH_TABLE, matches)], 0)
    # a theme without its query is lost with its reason; the episode's matches go in the same commit
    plays, lists, queries = _scene_inputs(spark, "New title")
    assert scene_run.import_scenes(plays, lists, queries.filter("scene_nr = 1"), path, embed.hashing_encoder(16)) == 2
    assert [r["theme_title_en"] for r in versions.read(spark, path, "scenes").collect()] == ["New title"]
    assert sorted((r["scene_nr"], r["stage"]) for r in versions.read(spark, path, "rejects").filter("scene_nr is not null").collect()) == [(2, "answers")]
    assert [r["episode_nr"] for r in versions.read(spark, path, "matches").collect()] == [1]
    assert versions.read(spark, path, "scenes", version=1).count() == 2


def test_failed_scene_run_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/scenes"
    scene_run.import_scenes(*_scene_inputs(spark), path, embed.hashing_encoder(16))
    with pytest.raises(Exception, match="shape"):
        scene_run.import_scenes(*_scene_inputs(spark, "New"), path, lambda texts: [[1.0]])
    assert versions.versions(spark, path) == [0]
    assert sorted(r["theme_title_en"] for r in versions.read(spark, path, "scenes").collect()) == ["Good title", "Other"]
