"""One Spark query per operator, over the stand-in relations.

Doubles are rounded to 6 places (reports to 3), integers are long, arrays of
words are joined with ``|``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import standins as fx
from checks.oracle import HEADER
from cuematch import MatchConfig
from cuematch import fixed_values as fv
from cuematch.functions import arrays, hints, text
from cuematch.functions import vectors as V
from cuematch.operators import contract, embed, ranking, retrieval, scenes, scoring, signals, tags, validate
from cuematch.plans import catalog, ingest, matching, persist, reports, scene_run, versions, views
from cuematch.plans.storage import materialize, run_dir, spread
from cuematch.session import ship
from cuematch.sources import decode, files, taxonomy

CONFIG = MatchConfig()
Query = Callable[[SparkSession, str], DataFrame]
_made: dict[tuple[str, str, str], DataFrame] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(F.round(c.cast("double"), 12), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.concat_ws("|", c.cast("array<string>"))
        out.append(c.alias(f.name))
    return df.select(*out)


def _once(name: str, spark: SparkSession, sf: str, make: Callable[[], DataFrame], stored: bool = False) -> DataFrame:
    """A relation several queries start from, written once per application."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _made:
        _made[key] = make() if stored else materialize(make(), name)
    return _made[key]


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return _once(
        "scored", spark, sf,
        lambda: matching.stored_scores(fx.scenes(spark, sf), fx.tracks(spark, sf), CONFIG), stored=True,
    )


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    return _once("ranked", spark, sf, lambda: ranking.rank_episodes(scored(spark, sf), CONFIG))


def matches(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.to_matches(ranked(spark, sf))


def same_row(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the pairs (scene v, track v)."""
    s = fx.scenes(spark, sf)
    pairs = s.select(F.col("id").alias("scene_query_id"), (F.col("id") + fx.TRACK_BASE).alias("track_query_id"))
    return scoring.score_pairs(pairs, s, fx.tracks(spark, sf), CONFIG, pair_route="shuffle")


def long_vector(df: DataFrame, key: str, vec: Column, *extra: str) -> DataFrame:
    return df.select(key, *extra, F.posexplode(vec).alias("p", "value")).select(
        key, *extra, (F.col("p") + 1).alias("pos"), "value"
    )


def emb(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "embeddings").withColumn("id", F.col("vec_id"))


IDS = ["scene_query_id", "track_query_id"]
PLACE = ["episode_nr", "scene_nr", "theme_nr"]
COMPONENTS = ["main_similarity", "tags_similarity", "ensemble_similarity", "hybrid_similarity",
              "audio_similarity_aux", "embedding_score", "semantic_score", "targets_score",
              "tag_selection_score", "dialogue_score"]
STATIC = ["dialogue_conflict", "duration_conflict", "forbidden_tag_conflict", "missing_data_penalty"]
SIX = ["final_score", "embedding_score", "semantic_score", "targets_score", "tag_selection_score", "dialogue_score"]


# --- vectors -----------------------------------------------------------------

def q_cosine(spark, sf):
    s, t = fx.scenes(spark, sf), fx.tracks(spark, sf)
    pairs = s.select("id", F.col("embedding_hybrid").alias("s")).join(
        t.select((F.col("id") - fx.TRACK_BASE).alias("id"), F.col("embedding_hybrid").alias("t"), "embedding_audio"), "id"
    )
    return tidy(pairs.select(
        "id", V.cosine(F.col("s"), F.col("embedding_audio")).alias("similarity"),
        V.cosine(F.col("s"), F.col("t")).alias("hybrid_similarity"),
        V.cosine_distance(F.col("s"), F.col("t")).alias("distance"),
    ))


def q_l2_normalize(spark, sf):
    v = V.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3))
    return tidy(long_vector(emb(spark, sf), "id", v))


def _turned(i: int) -> Column:
    return F.slice(F.concat("embedding", "embedding"), 5 * i + 1, 64)


def q_ensemble_vector(spark, sf):
    return tidy(long_vector(emb(spark, sf), "id", embed.ensemble_vector([_turned(i) for i in range(7)])))


def q_tag_vector(spark, sf):
    return tidy(long_vector(emb(spark, sf), "id", embed.tag_vector([_turned(i) for i in range(3)])))


def q_hybrid_vector(spark, sf):
    v = embed.hybrid_vector(F.col("embedding_main"), F.col("embedding_tags"), F.col("embedding_clap_ensemble"))
    return tidy(long_vector(fx.scenes(spark, sf), "id", v))


def q_vector_decode(spark, sf):
    stored = emb(spark, sf).select("id", F.concat(F.lit("["), F.concat_ws(", ", F.col("embedding").cast("array<string>")), F.lit("]")).alias("txt"))
    return tidy(long_vector(stored, "id", V.decode_vector(F.col("txt"))))


def q_mean_pool(spark, sf):
    segments = emb(spark, sf).select(F.col("label").cast("string").alias("filepath"), "embedding")
    return tidy(long_vector(embed.mean_pool(segments, "filepath", "embedding"), "filepath", F.col("embedding"), "n_segments"))


# --- retrieval ---------------------------------------------------------------

def q_knn_hybrid(spark, sf):
    return tidy(retrieval.nearest(fx.scenes(spark, sf), fx.tracks(spark, sf), CONFIG.candidate_pool_hybrid))


def q_knn_cells(spark, sf):
    return tidy(retrieval.nearest(
        fx.scenes(spark, sf), fx.tracks(spark, sf), CONFIG.candidate_pool_hybrid, method="slices", limit_bytes=64 << 10
    ))


def q_knn_floors(spark, sf):
    """As knn_hybrid, with the walk over a sample that bounds what is shuffled."""
    return tidy(retrieval.nearest(fx.scenes(spark, sf), fx.tracks(spark, sf), CONFIG.candidate_pool_hybrid, floors=True))


def q_knn_ragged(spark, sf):
    """Items of unequal length: every third one lacks a quarter of its numbers."""
    v = F.col("vec_id")
    cut = F.when(v % 3 == 1, F.slice("embedding", 1, 48)).otherwise(F.col("embedding"))
    items = emb(spark, sf).select((v + fx.TRACK_BASE).alias("id"), cut.alias("embedding"))
    return tidy(retrieval.nearest(emb(spark, sf).select("id", "embedding"), items, 20, "embedding"))


def q_knn_ensemble(spark, sf):
    return tidy(retrieval.nearest(
        fx.scenes(spark, sf), fx.tracks(spark, sf), CONFIG.candidate_pool_ensemble, "embedding_clap_ensemble"
    ))


def q_candidate_union(spark, sf):
    return tidy(retrieval.candidates(fx.scenes(spark, sf), fx.tracks(spark, sf), CONFIG))


def q_nearest_tags(spark, sf):
    tag_vecs = embed.tag_vectors(taxonomy.with_prompts(taxonomy.default_tags(spark)), embed.hashing_encoder(64))
    return tidy(retrieval.nearest_of_few(
        emb(spark, sf), tag_vecs, 20, "embedding", "embedding", query_id="vec_id", item_id="tag_no"
    ))


# --- scores ------------------------------------------------------------------

def _pair_columns(*columns: str) -> Query:
    return lambda spark, sf: tidy(same_row(spark, sf).select(*IDS, *columns))


def q_style_signature(spark, sf):
    return fx.tracks(spark, sf).filter(V.is_filled(F.col("embedding_hybrid"))).select(
        F.col("id").alias("track_query_id"), scoring.style_signature().alias("style_signature")
    )


def q_score_breakdown(spark, sf):
    return tidy(scoring.breakdown(same_row(spark, sf)))


def q_static_scores(spark, sf):
    return tidy(scored(spark, sf).select(*PLACE, *IDS, *COMPONENTS, *STATIC, "style_signature", "weighted_score"))


def q_rank_preview(spark, sf):
    rows = ranking.rank_alone(scored(spark, sf), CONFIG.preview_top_n)
    return tidy(rows.select(*IDS, "rank_position", "final_score", "embedding_score", "penalty_total"))


def q_episode_ranking(spark, sf):
    return tidy(matching.rank_all(fx.scenes(spark, sf), fx.tracks(spark, sf), CONFIG).select(
        *PLACE, *IDS, "rank_position", "final_score", *COMPONENTS, *scoring.COMPONENTS["penalties"],
        "style_signature", "dialogue_safe_applied",
    ))


def q_episode_ranking_hashed(spark, sf):
    """The ranking with negative track ids, as hashes give them."""
    n = F.col("id") - fx.TRACK_BASE
    t = fx.tracks(spark, sf).withColumn("id", F.when(n % 2 == 1, -(n + 5)).otherwise(F.col("id")))
    pairs = matching.scored_candidates(fx.scenes(spark, sf), t, CONFIG)
    rows = ranking.rank_episodes(materialize(pairs, "scored-hashed"), CONFIG)
    return tidy(rows.select(*PLACE, *IDS, "rank_position", "final_score", "same_track_consecutive_penalty", "style_signature"))


def q_preview_rows(spark, sf):
    return tidy(ranking.preview_rows(ranked(spark, sf), CONFIG.preview_top_n))


# --- views and reports -------------------------------------------------------

def q_match_top1(spark, sf):
    rows = views.match_top1(matches(spark, sf), fx.scenes(spark, sf), fx.tracks(spark, sf))
    return tidy(rows.select(*PLACE, *IDS, "scene_theme_title_en", "scene_description_en", "track_semantic_title_en",
                            "track_filename", "rank_position", *SIX, "penalty_total", "style_signature"))


def q_match_debug(spark, sf):
    rows = views.match_debug(matches(spark, sf), fx.scenes(spark, sf), fx.tracks(spark, sf))
    return tidy(rows.select(*PLACE, *IDS, "rank_position", "scene_theme_title_en", "scene_description_en",
                            "track_semantic_title_en", "track_description_en", "track_tags_summary_en",
                            "final_score", "duration_sec", "bpm", "musical_key"))


def q_match_compare(spark, sf):
    rows = views.match_compare(matches(spark, sf), fx.scenes(spark, sf), fx.tracks(spark, sf))
    return tidy(rows.select(
        *PLACE, *IDS, "theme_title_en", "scene_tags_summary_en",
        F.col("scene_music_semantics.emotional_direction").alias("scene_emotions"),
        F.col("track_music_semantics.emotional_direction").alias("track_emotions"),
        F.col("scene_music_targets.energy_target").alias("scene_energy"),
        F.col("track_music_targets.energy_target").alias("track_energy"),
        F.col("scene_tag_selection.should_have_tags").alias("scene_tags"),
        F.col("track_tag_selection.should_have_tags").alias("track_tags"),
        "final_score",
    ))


def q_low_confidence_view(spark, sf):
    return tidy(views.low_confidence(matches(spark, sf)).select(*PLACE, *IDS, "rank_position", *SIX, "penalty_total"))


def q_low_confidence(spark, sf):
    rows = matching.low_confidence(matches(spark, sf), CONFIG.low_confidence_threshold)
    return tidy(rows.select(*IDS, "rank_position", "final_score"))


def q_run_summary(spark, sf):
    counters = matching.telemetry(fx.scenes(spark, sf), scored(spark, sf))
    return tidy(matching.run_summary(matches(spark, sf), counters))


def q_telemetry(spark, sf):
    found = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("scene_query_id"))
    return tidy(matching.telemetry(fx.scenes(spark, sf), found))


def q_report_order(spark, sf):
    return tidy(reports.report_order(matches(spark, sf)).select(*PLACE, *IDS, "scene_theme_title_en", "rank_position"))


def q_match_explanation(spark, sf):
    told = lambda path: F.get_json_object("match_explanation", path)
    return tidy(matches(spark, sf).select(
        *IDS, told("$.scene.theme_title_en").alias("theme_title_en"), told("$.track.filename").alias("filename"),
        told("$.component_scores.energy_match_score").cast("double").alias("energy_match_score"),
        told("$.component_scores.dialogue_match_score").cast("double").alias("dialogue_match_score"),
        told("$.penalties.penalty_total").cast("double").alias("penalty_total"),
        told("$.penalties.style_signature").alias("style_signature"),
        F.get_json_object("match_metadata", "$.track_query_id").cast("long").alias("metadata_track"),
    ))


def q_report_grouped(spark, sf):
    rows = reports.grouped_report(matches(spark, sf))
    return tidy(rows.select(*PLACE, "scene_theme_title_en", F.col("matches.track_query_id").alias("track_query_ids")))


# --- lookups -----------------------------------------------------------------

def q_theme_matches(spark, sf):
    return tidy(catalog.matches_of_theme(matches(spark, sf), 3, 2, 1).select(*IDS, "rank_position", "track_filename", "final_score"))


def q_episode_matches(spark, sf):
    return tidy(catalog.matches_of_episode(matches(spark, sf), 4).select(*PLACE, *IDS, "rank_position", "final_score", "style_signature"))


def q_episode_scenes(spark, sf):
    rows = catalog.scenes_of_episode(fx.scenes(spark, sf), 2)
    return tidy(rows.select("id", *PLACE, "theme_title_en", F.col("scene_music_semantics.emotional_direction").alias("emotions")))


def q_scene_by_place(spark, sf):
    return tidy(catalog.scene_by_place(fx.scenes(spark, sf), 2, 5, 2).select("id", *PLACE, "segmentation_reason", "theme_title_pl"))


def q_scene_by_id(spark, sf):
    return tidy(catalog.scene_by_id(fx.scenes(spark, sf), 77).select("id", *PLACE, "tags_summary_en"))


def q_track_detail(spark, sf):
    rows = catalog.track_detail(fx.tracks(spark, sf), fx.TRACK_BASE + 123)
    return tidy(rows.select("id", "filename", "filepath", "duration_sec", "bpm", "musical_key",
                            F.col("track_tag_selection.should_have_tags").alias("should_have")))


def q_track_inspection(spark, sf):
    rows = fx.tracks(spark, sf).withColumn(
        "audio_analysis", F.struct((F.col("duration_sec") / 1000).alias("rms"), (F.col("duration_sec") / 3000).alias("zero_crossing_rate"))
    ).withColumn("segmentation", F.struct(F.when(F.col("bpm").isNotNull(), "v1").alias("pipeline_version")))
    return tidy(catalog.with_inspection(rows).select("id", "filename", "rms_mean", "zcr_mean", "pipeline_version"))


def q_tracks_by_ids(spark, sf):
    ids = fx.table(spark, sf, "labels").select((F.col("doc_id") + fx.TRACK_BASE).alias("id"))
    return tidy(catalog.tracks_by_ids(fx.tracks(spark, sf), ids).select("id", "filename"))


def q_track_views(spark, sf):
    rows = views.track_contract_debug(views.track_debug(fx.tracks(spark, sf)))
    return tidy(rows.select("track_query_id", "filename", "filepath", "semantic_title_en",
                            F.col("track_music_targets.energy_target").alias("energy"),
                            F.col("track_tag_selection.must_not_tags").alias("must_not")))


def q_track_search(spark, sf):
    t = fx.tracks(spark, sf)
    found = {
        "contains": catalog.search_tracks(t, "10"),
        "prefix": catalog.search_tracks(t, "CUE_001", starts_with=True),
        "tags": catalog.search_tracks(t, tags=["calm", "dark"]),
        "both": catalog.search_tracks(t, "2_4", tags=["hope"]),
        "all": catalog.search_tracks(t),
    }
    out = None
    for mode, rows in found.items():
        rows = rows.select(F.lit(mode).alias("mode"), "*")
        out = rows if out is None else out.unionByName(rows)
    return tidy(out)


def q_distinct_lists(spark, sf):
    s = fx.scenes(spark, sf)
    a = catalog.episodes(s).select(F.lit("episode").alias("kind"), F.col("episode_nr").alias("nr"))
    b = catalog.scene_numbers(s, 2).select(F.lit("scene").alias("kind"), F.col("scene_nr").alias("nr"))
    c = catalog.theme_numbers(s, 2, 3).select(F.lit("theme").alias("kind"), F.col("theme_nr").alias("nr"))
    return tidy(a.unionByName(b).unionByName(c))


def q_episode_options(spark, sf):
    done = fx.table(spark, sf, "labels").select(F.col("doc_id").cast("int").alias("episode_nr"))
    return tidy(catalog.episode_options(fx.scenes(spark, sf), done))


def q_row_counts(spark, sf):
    s = fx.scenes(spark, sf)
    return tidy(catalog.row_counts({"scenes": s, "tracks": fx.table(spark, sf, "documents"), "matches": None}, s))


# --- validation --------------------------------------------------------------

def q_scene_issues(spark, sf):
    rows = fx.scenes(spark, sf).select("id", validate.scene_issues().alias("issues"))
    return tidy(rows.select("id", F.size("issues").alias("n_issues"), "issues"))


def q_track_issues(spark, sf):
    rows = fx.tracks(spark, sf).select("id", validate.track_issues().alias("issues"))
    return tidy(rows.select("id", F.size("issues").alias("n_issues"), "issues"))


def q_validation_report(spark, sf):
    return tidy(validate.validation_report(fx.scenes(spark, sf), fx.tracks(spark, sf)))


def q_episode_validation(spark, sf):
    return tidy(matching.episode_validation(fx.scenes(spark, sf), fx.tracks(spark, sf), 2))


def q_scene_vectors(spark, sf):
    """The four vectors of every scene, with the title that is never empty."""
    rows = fx.scenes(spark, sf).drop("embedding_main", "embedding_tags", "embedding_clap_ensemble", "embedding_hybrid")
    rows = embed.scene_vectors(rows.withColumn("theme_title_en", F.col("theme_title_pl")), embed.hashing_encoder(64))
    cells = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(f"embedding_{k}").alias("v")) for k in ("main", "tags", "clap_ensemble", "hybrid")
    ])
    long = rows.select("id", F.inline(cells)).select("id", "kind", F.posexplode("v").alias("pos", "value"))
    return tidy(long.filter(F.abs("value") > 1e-6))


def q_usable_tracks(spark, sf):
    return tidy(matching.usable_tracks(fx.tracks(spark, sf)).select("id"))


def q_constraint_report(spark, sf):
    m = F.col("doc_id") % 7
    raw = fx.table(spark, sf, "documents").select(
        "doc_id",
        F.concat_ws("/", "lang", "source").alias("filepath"),
        F.when(m == 0, '{"should_have_tags":[]}').when(m == 1, '{"should_have_tags":"x","must_not_tags":[]}')
        .when(m == 2, "[1]").otherwise('{"should_have_tags":[],"must_not_tags":[]}').alias("track_tag_selection"),
    )
    return tidy(validate.constraint_report(raw, "tracks", "doc_id"))


# --- tags and contract -------------------------------------------------------

def _selection(spark, sf) -> DataFrame:
    return contract.with_selection(spread(fx.tag_scores(spark, sf)))


def _contracts(spark, sf) -> DataFrame:
    return contract.track_contracts(spread(fx.tag_scores(spark, sf)), analysis_col=None)


def q_tag_select(spark, sf):
    rows = _selection(spark, sf).select("id", F.posexplode("selected_tags").alias("p", "t"))
    return tidy(rows.select("id", (F.col("p") + 1).alias("pos"), "t.category", "t.name", "t.score"))


def q_tag_lookup(spark, sf):
    return tidy(_selection(spark, sf).select("id", F.explode("tag_lookup").alias("name", "score")))


def q_dialogue_safe(spark, sf):
    return tidy(_selection(spark, sf).select(
        "id", F.col("safe_score").alias("dialogue_safe_score"), (F.col("safe_score") >= fv.DIALOGUE_FLAG_AT).alias("dialogue_safe")
    ))


def q_tags_by_category(spark, sf):
    cells = F.array(*[
        F.struct(F.lit(c).alias("category"), tags.names_in(F.col("selected_tags"), c, 2).alias("names"))
        for c in fv.TAXONOMY
    ])
    rows = _selection(spark, sf).select("id", F.inline(cells))
    return tidy(rows.filter(F.size("names") > 0))


def q_confidence_profile(spark, sf):
    c = F.col("track_tag_selection.confidence_profile")
    return tidy(_contracts(spark, sf).select(
        "id", c["mean_selected_tag_score"].alias("mean_score"), c["max_selected_tag_score"].alias("max_score"),
        c["min_selected_tag_score"].alias("min_score"),
    ))


def _selected_rows(spark, sf) -> DataFrame:
    return _selection(spark, sf).select(F.inline("selected_tags"))


def q_tag_vocab(spark, sf):
    return tidy(catalog.tag_vocabulary(_selected_rows(spark, sf)))


def q_tags_in_categories(spark, sf):
    return catalog.tags_in(_selected_rows(spark, sf), ["emotion", "atmosphere"])


def q_tag_prompts(spark, sf):
    """Prompts of every tag that any track has a score for, and the number of those tracks."""
    rows = fx.tag_scores(spark, sf).select(F.inline("tag_scores")).groupBy("tag_no", "category", "name").agg(F.count(F.lit(1)).alias("n_tracks"))
    return tidy(taxonomy.with_prompts(rows).select("tag_no", "prompts", "n_tracks"))


def q_taxonomy_rows(spark, sf):
    """Every document stands for a small taxonomy of two categories."""
    n = F.col("doc_id").cast("string")
    category = lambda label, *tag_names: F.struct(label.alias("category_pl"), F.map_from_arrays(
        F.array(*[F.concat(F.lit(t), n) for t in tag_names]), F.array(*[F.lit(t) for t in tag_names])).alias("tags"))
    made = fx.table(spark, sf, "documents").select(F.to_json(F.map_from_arrays(
        F.array(F.lit("first"), F.col("lang")),
        F.array(category(F.col("source"), "b", "a"), category(F.col("lang"), "z", "y", "x")),
    )).alias("value"))
    return tidy(taxonomy.flatten_tags(made))


def q_profile_candidates(spark, sf):
    return tidy(_contracts(spark, sf).select("id", F.col("track_music_semantics.weight_profile_candidates").alias("profiles")))


def q_track_semantics(spark, sf):
    return tidy(_contracts(spark, sf).select(
        "id", "track_music_semantics.emotional_direction", "track_music_semantics.narrative_function",
        F.col("track_music_semantics.weight_profile_candidates").alias("profiles"),
        "track_music_semantics.dialogue_safe_score", "track_music_semantics.dialogue_safe",
    ))


def q_track_targets(spark, sf):
    t = F.col("track_music_targets")
    return tidy(_contracts(spark, sf).select(
        "id", t["energy_target"].alias("energy"), t["tempo_target"].alias("tempo"), t["rhythm_target"].alias("rhythm"),
        t["intensity_shape_target"].alias("shape"), t["sound_character_target"].alias("sound"),
    ))


def q_must_not_tags(spark, sf):
    sel = _selection(spark, sf)
    selected, lookup = F.col("selected_tags"), F.col("tag_lookup")
    rows = sel.withColumn("sem", contract.music_semantics(selected, lookup, F.col("safe_score"))).withColumn(
        "tgt", contract.music_targets(selected)
    )
    return tidy(rows.select("id", contract.must_not_tags(selected, lookup, F.col("sem"), F.col("tgt")).alias("must_not_tags")))


def q_track_tag_selection(spark, sf):
    return tidy(_contracts(spark, sf).select("id", "track_tag_selection.should_have_tags", "track_tag_selection.must_not_tags"))


def q_track_texts(spark, sf):
    return tidy(_contracts(spark, sf).select("id", "semantic_title_en", "description_en", "tags_summary_en"))


def q_track_prompts(spark, sf):
    return tidy(_contracts(spark, sf).select("id", "track_clap_prompt_ensemble.*"))


# --- numbers -----------------------------------------------------------------

def q_audio_hints(spark, sf):
    e = fx.table(spark, sf, "events")
    bpm = F.when(F.col("event_type") != "error", (F.col("event_id") % 200).cast("int"))
    a = hints.audio_analysis(F.col("value") / 100, F.col("value") / 500, F.col("value") * 50, F.lit(0.0), bpm)
    rows = e.select("event_id", a.alias("a"))
    return tidy(rows.select(
        "event_id", F.col("a.energy_target_hint").alias("energy"), F.col("a.tempo_target_hint").alias("tempo"),
        F.col("a.rhythm_target_hint").alias("rhythm"), F.col("a.intensity_shape_hint").alias("shape"),
        F.col("a.sound_character_hints").alias("sound"),
    ))


def q_signal_stats(spark, sf):
    e = fx.table(spark, sf, "events").select("user_id", "event_id", "value")
    centre = e.groupBy("user_id").agg(F.avg("value").alias("mean"))
    rows = e.join(centre, "user_id").select(
        F.col("user_id").alias("signal_id"), F.col("event_id").alias("pos"), (F.col("value") - F.col("mean")).alias("value")
    )
    return tidy(signals.signal_stats(rows, chunk=1000))


def q_segment_ranges(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 20).alias("n"))
    rows = o.select("o_orderkey", F.posexplode(hints.segment_ranges(F.col("n"), 48000, 20, 5)).alias("segment_no", "r"))
    return tidy(rows.select("o_orderkey", "segment_no", "r.start_sec", "r.end_sec"))


def _folded_classes() -> Column:
    """Twelve sums over all numbers of a vector, by position modulo twelve."""
    kept = lambda c: F.filter("embedding", lambda _x, i: i % 12 == c)
    return F.array(*[
        F.round(F.aggregate(kept(c), F.lit(0.0), lambda a, x: a + x.cast("double")), 9) for c in range(12)
    ])


def q_pitch_class(spark, sf):
    return tidy(emb(spark, sf).select(
        "id", arrays.argmax_label(_folded_classes(), fv.PITCH_CLASSES).alias("musical_key")
    ))


# --- texts -------------------------------------------------------------------

def q_whitespace(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.normalize_whitespace(F.col("text")).alias("text"))


def q_episode_number(spark, sf):
    return tidy(fx.table(spark, sf, "pages").select("page_id", text.episode_number(F.col("url")).alias("episode_nr")))


def q_scene_split(spark, sf):
    raw = spread(fx.table(spark, sf, "documents").select("doc_id", "text")).select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), "text")
    found, _rejects = scenes.scenes_of(files.prepare_screenplays(raw), HEADER)
    return tidy(found.select("episode_nr", "scene_nr", "scene_txt"))


def q_scene_rejects(spark, sf):
    """Texts that give no scenes, with the reason and the word the headers should hold."""
    raw = spread(fx.table(spark, sf, "documents").select("doc_id", "text")).select(
        F.concat(F.lit("doc_"), F.when(F.col("doc_id") % 17 != 9, F.col("doc_id").cast("string")).otherwise("x"), F.lit(".txt")).alias("file_name"), "text"
    )
    _found, rejects = scenes.scenes_of(files.prepare_screenplays(raw), HEADER)
    return tidy(rejects.select("file_name", "episode_nr", "reason"))


def q_embed_texts(spark, sf):
    docs = spread(fx.table(spark, sf, "documents").select("doc_id", "text"))
    rows = embed.embed_texts(docs, {"text": "v"}, embed.hashing_encoder(64)).select("doc_id", F.posexplode("v").alias("bucket", "value"))
    return tidy(rows.filter(F.col("value") != 0))


# --- catalogs ----------------------------------------------------------------

def _old_tracks(spark, sf) -> DataFrame:
    n = F.col("doc_id")
    return fx.table(spark, sf, "documents").select(
        (n + 5000000).alias("id"), F.concat(F.lit("old_"), n.cast("string")).alias("filename"),
        F.concat(F.lit("lib/"), (n % 10).cast("string"), F.lit("/"), fx.track_filename(n)).alias("filepath"),
        F.col("n_chars").cast("double").alias("duration_sec"),
        F.concat(F.lit("Old "), n.cast("string")).alias("semantic_title_en"),
    )


def q_new_files(spark, sf):
    t, old = fx.tracks(spark, sf).select("filepath"), _old_tracks(spark, sf)
    a = ingest.already_indexed(t, old).withColumn("state", F.lit("indexed"))
    return a.unionByName(ingest.left_to_import(t, old).withColumn("state", F.lit("new")))


def q_scan_stats(spark, sf):
    return tidy(ingest.scan_stats(fx.tracks(spark, sf), _old_tracks(spark, sf)))


def q_ingest_report(spark, sf):
    kind = F.col("event_type")
    status = F.when(kind == "error", "error").when(kind == "click", "inserted").when(kind == "view", "updated").otherwise("skipped")
    outcomes = fx.table(spark, sf, "events").select(
        F.lpad(F.col("event_id").cast("string"), 9, "0").alias("filepath"), status.alias("status"),
        F.lit("IOError").alias("error_type"), F.lit("bad file").alias("error"),
    )
    return tidy(ingest.ingest_report(outcomes))


def q_audio_names(spark, sf):
    m = F.col("page_id") % 4
    end = F.when(m == 0, "/a.MP3").when(m == 1, "/._b.wav").when(m == 2, "/c.flac").otherwise("/d.txt")
    listing = fx.table(spark, sf, "pages").select(F.concat("url", end).alias("path"))
    return files.keep_audio(listing).select("path")


def _odd_texts(rows: DataFrame, v: Column) -> DataFrame:
    """Texts of a track: some descriptions empty, some summaries without a word, some prompts the encoder cannot read."""
    n = v.cast("string")
    prompt = lambda p: F.when((v % 31 == 11) & F.lit(p == "emotion_prompt"), F.concat(F.lit("boom "), n)).otherwise(
        F.concat(F.lit(f"{p} "), (F.floor(v / 10)).cast("string"))
    )
    return rows.withColumns({
        "semantic_title_en": F.concat(F.lit("Cue "), n),
        "description_en": F.when(v % 23 == 5, " ").otherwise(F.concat(F.lit("Track "), n)),
        "tags_summary_en": F.when(v % 29 == 7, "!!!").otherwise("Summary"),
        "track_clap_prompt_ensemble": F.struct(*[prompt(p).alias(p) for p in fv.ENSEMBLE_PROMPTS]),
    })


def _picky_encoder() -> embed.Encoder:
    """The word hashes, but a text with the word boom is refused."""
    encode = embed.hashing_encoder(64)

    def run(texts):
        bad = [t for t in texts if "boom" in t]
        if bad:
            raise ValueError(f"cannot read {bad[0]}")
        return encode(texts)

    return run


def q_track_vectors(spark, sf):
    """The vectors of every track, and what its texts lack."""
    rows = _odd_texts(fx.tracks(spark, sf).select("id"), F.col("id") - fx.TRACK_BASE)
    rows = materialize(embed.track_vectors(rows, _picky_encoder(), errors="errors"), "track-vectors")
    cells = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(f"embedding_{k}").alias("v")) for k in ("main", "tags", "clap_ensemble", "hybrid")
    ])
    long = rows.select("id", F.inline(cells)).select("id", "kind", F.posexplode("v").alias("pos", "value"))
    told = rows.select("id", F.inline("errors")).select("id", F.col("column").alias("kind"), "error_type", "error")
    return tidy(long.filter(F.abs("value") > 1e-6).unionByName(told, allowMissingColumns=True))


def q_import_run(spark, sf):
    """An import over every vector: known files, broken files, odd segments and odd texts among good ones."""
    v = F.col("vec_id")
    lib = fx.tracks(spark, sf).select((F.col("id") - fx.TRACK_BASE).alias("vec_id"), "filename", "filepath", "duration_sec", "bpm", "musical_key")
    bad = v % 10 == 9
    features = lib.withColumns({
        "status": F.when(bad, "error").otherwise("ok"), "error_type": F.when(bad, "IOError"), "error": F.when(bad, "bad file"),
    }).drop("vec_id")
    first = F.when(v % 37 == 8, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    second = F.when(v % 19 == 4, F.slice("embedding", 1, 48)).otherwise(first)
    segments = emb(spark, sf).filter(v % 17 != 3).join(lib.select("vec_id", "filepath"), "vec_id").select(
        "filepath", F.explode(F.array(first, second)).alias("embedding")
    )
    tag_vecs = embed.tag_vectors(taxonomy.with_prompts(taxonomy.default_tags(spark)), embed.hashing_encoder(64))
    number = F.substring("filename", 5, 5).cast("long")
    content, outcomes = ingest.import_tracks(
        features, segments, tag_vecs, _old_tracks(spark, sf), _picky_encoder(),
        describe=lambda rows: _odd_texts(rows.drop("tag_scores"), number),
    )
    return tidy(outcomes.join(content.select("filepath", F.col("semantic_title_en").alias("title")), "filepath", "left"))


def q_upsert_tracks(spark, sf):
    incoming = fx.tracks(spark, sf).select("id", "filename", "filepath", "duration_sec", "semantic_title_en")
    return tidy(persist.upsert_tracks(_old_tracks(spark, sf), incoming))


def q_upsert_published(spark, sf):
    """Two upserts into buckets on storage; of two incoming rows of a path the later one counts."""
    path = f"{run_dir(spark)}/published-{uuid.uuid4().hex}"
    stamp = lambda day: F.lit(f"2024-01-0{day}").cast("timestamp_ntz")
    old = _old_tracks(spark, sf).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    table = versions.Table("tracks", ("filepath",), buckets=16)
    versions.commit(spark, path, [versions.Change(table, old)], None)
    new = fx.tracks(spark, sf).select("id", "filename", "filepath", "duration_sec", "semantic_title_en")
    early = new.withColumn("semantic_title_en", F.lit("early")).withColumn("updated_at", stamp(1))
    both = new.withColumn("updated_at", stamp(2)).unionByName(early)
    for rows in (early, both):
        versions.merge(rows, path, "tracks")
    versions.drop_old(spark, path)
    out = versions.read(spark, path, "tracks").withColumn("stamped", F.col("updated_at").isNotNull())
    return tidy(out.drop("updated_at"))


def q_upsert_scenes(spark, sf):
    n = F.col("doc_id")
    old = fx.table(spark, sf, "documents").select(
        (n + 9000).alias("id"), F.expr("cast(doc_id div 40 + 1 as int)").alias("episode_nr"),
        F.expr("cast((doc_id % 40) div 2 + 1 as int)").alias("scene_nr"), F.expr("cast(doc_id % 2 + 1 as int)").alias("theme_nr"),
        F.concat(F.lit("Old "), n.cast("string")).alias("theme_title_en"),
    )
    incoming = fx.scenes(spark, sf).select("id", *PLACE, "theme_title_en")
    return tidy(persist.upsert_scenes(old, incoming))


def _match_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    old = fx.table(spark, sf, "documents").select(
        F.expr("cast(doc_id div 40 + 1 as int)").alias("episode_nr"), F.col("doc_id").alias("scene_query_id"),
        ((F.col("doc_id") * 7) % 500 + fx.TRACK_BASE).alias("track_query_id"), F.col("n_chars").cast("double").alias("final_score"),
    )
    new = emb(spark, sf).select(
        F.expr("cast(vec_id div 20 + 1 as int)").alias("episode_nr"), F.col("vec_id").alias("scene_query_id"),
        ((F.col("vec_id") * 7) % 500 + fx.TRACK_BASE).alias("track_query_id"), F.col("label").cast("double").alias("final_score"),
    )
    return old, new


def q_replace_episode(spark, sf):
    return tidy(persist.replace_episode(*_match_tables(spark, sf), 3))


def q_rerun_episode(spark, sf):
    old, new = _match_tables(spark, sf)
    return tidy(persist.rerun_episode(old, new.filter("episode_nr = 2"), 2))


def q_replace_empty(spark, sf):
    """On storage: episodes 2 and 4 are replaced, 4 by nothing."""
    old, new = _match_tables(spark, sf)
    path = f"{run_dir(spark)}/episodes-{uuid.uuid4().hex}"
    persist.overwrite_episodes(old, path)
    persist.overwrite_episodes(new.filter("episode_nr <> 4"), path, episodes=[2, 4])
    return tidy(spark.read.schema(old.schema).parquet(path).select(*old.columns))


def q_replace_episodes(spark, sf):
    return tidy(persist.replace_episodes(*_match_tables(spark, sf)))


def q_merge_matches(spark, sf):
    return tidy(persist.merge_matches(*_match_tables(spark, sf)))


def q_replace_scene(spark, sf):
    return tidy(persist.replace_scene(*_match_tables(spark, sf), 17))


def q_delete_episode(spark, sf):
    return tidy(persist.delete_episode(_match_tables(spark, sf)[0], 2))


def q_cascade_delete(spark, sf):
    _left, kept = persist.delete_scene_episode(
        fx.scenes(spark, sf), _match_tables(spark, sf)[0], fx.tracks(spark, sf), 2
    )
    return tidy(kept.select("episode_nr", *IDS, "final_score"))


# --- scene answers -----------------------------------------------------------

def _docs(spark, sf) -> DataFrame:
    return fx.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")


def q_answer_validation(spark, sf):
    title = F.when(F.col("lang") == "fr", "  ").otherwise("Temat")
    theme = F.struct(F.lit("T").alias("theme_title_pl"), title.alias("theme_title_en"), F.lit("d").alias("description_en"), F.lit("x").alias("theme_txt"))
    answers = _docs(spark, sf).select(
        F.col("doc_id").alias("scene_nr"),
        F.to_json(F.struct(F.array(theme).alias("themes"), F.lit("why").alias("segmentation_reason"))).alias("answer"),
    )
    return tidy(scenes.check_theme_lists(answers).select("scene_nr", "issues"))


def _query_json(summary: Column, profile: Column, must: Column) -> Column:
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    return F.to_json(F.struct(
        summary.alias("tags_summary_en"),
        F.struct(words("fear").alias("emotional_direction"), words("accent").alias("narrative_function"),
                 profile.alias("weight_profile"), F.lit(True).alias("dialogue_safe_required")).alias("scene_music_semantics"),
        F.struct(F.lit("low").alias("energy_target"), F.lit("slow").alias("tempo_target"), F.lit("free").alias("rhythm_target"),
                 F.lit("wave").alias("intensity_shape_target"), words("dense").alias("sound_character_target")).alias("scene_music_targets"),
        F.struct(words("calm", "dark").alias("should_have_tags"), must.alias("must_not_tags")).alias("scene_tag_selection"),
        F.struct(*[F.lit(p).alias(p) for p in fv.ENSEMBLE_PROMPTS]).alias("clap_prompt_ensemble"),
    ))


def q_query_validation(spark, sf):
    """Answers that sum up the documents' own texts, some of them at too great a length."""
    summary = F.substring("text", F.lit(1), F.when(F.col("n_chars") % 5 == 0, 140).otherwise(100))
    profile = F.when(F.col("lang") == "en", " \t").otherwise("dialogue")
    must = F.when(F.col("n_chars") % 3 == 0, F.array(F.lit("calm"))).otherwise(F.array(F.lit("wide")))
    answer = _query_json(summary, profile, must)
    answer = F.when(F.col("doc_id") % 7 == 3, F.replace(answer, F.lit('"low"'), F.lit("3"))).otherwise(answer)
    answer = F.when(F.col("doc_id") % 11 == 5, F.replace(answer, F.lit('["dense"]'), F.lit('["dense",null]'))).otherwise(answer)
    answers = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("scene_nr"), answer.alias("answer"))
    return tidy(scenes.check_theme_queries(answers).select("scene_nr", "issues"))


def _answers(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Checked theme lists and theme queries, two themes to a document."""
    docs = _docs(spark, sf).select(F.lit(1).alias("episode_nr"), (F.col("doc_id") + 1).cast("int").alias("scene_nr"), "doc_id")
    theme = lambda k: F.struct(
        F.lit("t").alias("theme_title_pl"),
        F.concat(F.lit(" T"), F.col("doc_id").cast("string"), F.lit(f"-{k} ")).alias("theme_title_en"),
        F.lit("d").alias("description_en"), F.lit("x").alias("theme_txt"),
    )
    lists = scenes.check_theme_lists(docs.withColumn(
        "answer", F.to_json(F.struct(F.array(theme(1), theme(2)).alias("themes"), F.lit(" why ").alias("segmentation_reason")))
    ))
    wide = F.array(F.lit("wide"))
    queries = scenes.check_theme_queries(docs.withColumn("theme_nr", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
        "answer", _query_json(F.concat(F.lit("sum "), F.col("doc_id").cast("string")), F.lit("dialogue"), wide)
    ))
    return scenes.split_valid(lists)[0], scenes.split_valid(queries)[0]


def q_scene_import(spark, sf):
    """Texts of all documents with their stored answers into a store that holds scenes and matches."""
    path = f"{run_dir(spark)}/scenes-{uuid.uuid4().hex}"
    old, _new = _match_tables(spark, sf)
    kept = fx.scenes(spark, sf).select(*PLACE, "theme_title_en", "theme_txt")
    versions.commit(spark, path, [versions.Change(scene_run.SCENE_TABLE, kept), versions.Change(scene_run.MATCH_TABLE, old)], None)
    raw = spread(fx.table(spark, sf, "documents").select("doc_id", "text")).select(
        F.concat(F.lit("doc_"), F.when(F.col("doc_id") % 17 != 9, F.col("doc_id").cast("string")).otherwise("x"), F.lit(".txt")).alias("file_name"), "text"
    )
    split = scenes.scenes_of(files.prepare_screenplays(raw), HEADER)[0]
    found = _once("found", spark, sf, lambda: split.select("episode_nr", "scene_nr"))
    e, n = F.col("episode_nr"), F.col("scene_nr")
    theme = F.struct(
        F.lit("t").alias("theme_title_pl"), F.when(e % 11 == 5, " ").otherwise(F.concat(F.lit("T"), e.cast("string"))).alias("theme_title_en"),
        F.lit("d").alias("description_en"), F.col("scene_txt").alias("theme_txt"),
    )
    lists = split.filter(n % 7 != 3).select(
        "episode_nr", "scene_nr", F.to_json(F.struct(F.array(theme).alias("themes"), F.lit("why").alias("segmentation_reason"))).alias("answer")
    )
    stray = found.filter("scene_nr = 1").select("episode_nr", F.lit(100_000).alias("scene_nr"), F.lit("{}").alias("answer"))
    asked = found.filter(e % 5 != 2).select(
        "episode_nr", "scene_nr", F.lit(1).alias("theme_nr"),
        _query_json(F.when(e % 13 == 6, "!!!").otherwise(F.concat(F.lit("sum "), n.cast("string"))), F.lit("dialogue"), F.array(F.lit("wide"))).alias("answer"),
    )
    twice = asked.filter((e % 29 == 3) & (n == 2))
    scene_run.import_scenes(raw, lists.unionByName(stray), asked.unionByName(twice), path, embed.hashing_encoder(64), HEADER)
    none = F.lit(None)
    s = versions.read(spark, path, "scenes").select(
        F.lit("scene").alias("kind"), *PLACE, "theme_title_en", F.char_length("theme_txt").alias("n"), none.cast("string").alias("note")
    )
    r = versions.read(spark, path, "rejects").select(
        F.lit("reject").alias("kind"), *PLACE, F.col("stage").alias("theme_title_en"), none.cast("int").alias("n"), F.col("reason").alias("note")
    )
    m = versions.read(spark, path, "matches").select(
        F.lit("match").alias("kind"), "episode_nr", F.col("scene_query_id").alias("scene_nr"), none.cast("int").alias("theme_nr"),
        none.cast("string").alias("theme_title_en"), F.col("track_query_id").alias("n"), none.cast("string").alias("note"),
    )
    return tidy(s.unionByName(r).unionByName(m))


def q_assembly_rejects(spark, sf):
    """Themes whose query is lost, queries whose list is, and lists without a number."""
    lists, asked = _answers(spark, sf)
    lists = lists.filter("doc_id % 6 <> 4").withColumn("scene_nr", F.expr("if(doc_id % 6 = 5, -scene_nr, scene_nr)"))
    asked = asked.filter("not (doc_id % 5 = 2 and theme_nr = 2)")
    return tidy(scenes.assembly_rejects(lists, asked).select("scene_nr", "theme_nr", "reason"))


def q_assemble_records(spark, sf):
    rows = scenes.assemble_records(*_answers(spark, sf))
    return tidy(rows.select("scene_nr", "theme_nr", "segmentation_reason", "theme_title_en", "tags_summary_en"))


def q_vocab_check(spark, sf):
    return tidy(scenes.vocabulary_report(fx.scenes(spark, sf), "id"))


def q_field_lines(spark, sf):
    return tidy(reports.field_lines(fx.scenes(spark, sf)))


def q_round_floats(spark, sf):
    e = fx.table(spark, sf, "events").select(
        "event_id", (F.col("value") / 7).alias("direct"), F.struct(F.array(F.col("value") / 11).alias("xs")).alias("box")
    )
    return reports.round_floats(e).select("event_id", "direct", F.col("box.xs")[0].alias("nested"))


def q_json_decode(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", "props")
    good, _bad = decode.decode_rows(e, {"props": T.StructType([T.StructField("k", T.LongType())])})
    return tidy(good.select("event_id", "props.k"))


_ALL: dict[str, Query] = {
    name[2:]: value for name, value in list(globals().items()) if name.startswith("q_") and callable(value)
}
_ALL.update({
    "embedding_score": _pair_columns(*COMPONENTS[:6]),
    "set_overlap": _pair_columns("emotion_match_score", "narrative_match_score", "weight_profile_match_score", "dialogue_score"),
    "semantic_score": _pair_columns("semantic_score"),
    "ordinal_match": _pair_columns("energy_match_score", "tempo_match_score", "rhythm_match_score", "intensity_shape_match_score"),
    "jaccard": _pair_columns("sound_character_match_score"),
    "targets_score": _pair_columns("targets_score"),
    "tag_score": _pair_columns("should_have_hit_rate", "must_not_conflict_rate", "tag_selection_score"),
    "penalties_static": _pair_columns(*STATIC, "dialogue_safe_applied"),
    "episode_summary": lambda spark, sf: tidy(views.episode_summary(matches(spark, sf))),
    "style_redundancy": lambda spark, sf: tidy(views.style_redundancy(matches(spark, sf))),
    "report_full": lambda spark, sf: tidy(reports.full_report(matches(spark, sf))),
    "report_short": lambda spark, sf: tidy(reports.short_report(matches(spark, sf))),
})


def queries() -> dict[str, Query]:
    def shipped(make: Query) -> Query:
        return lambda spark, sf: make(ship(spark), sf)

    return {name: shipped(make) for name, make in _ALL.items()}
