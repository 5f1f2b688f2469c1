import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuematch import fixed_values as fv
from cuematch.operators import contract, embed, tags
from cuematch.sources import taxonomy

ROWS = taxonomy.tag_rows()
SCHEMA = f"id long, tag_scores {tags.SCORES}"


def track(spark, *scored):
    """A track row with the given (name or (category, name), score) pairs."""
    entries = []
    for key, score in scored:
        for no, category, name in ROWS:
            if key == name or key == (category, name):
                entries.append((no, category, name, score))
                break
        else:
            entries.append((999, *key, score))
    return spark.createDataFrame([(1, entries)], SCHEMA)


def selected(spark, *scored):
    rows = track(spark, *scored).select(F.inline(tags.select_tags(F.col("tag_scores")))).collect()
    return [r["name"] for r in rows]


def test_taxonomy(spark):
    df = taxonomy.default_tags(spark)
    rows = [(r["tag_no"], r["category"], r["name"]) for r in df.orderBy("tag_no").collect()]
    assert rows == ROWS and len(rows) == 122
    last = df.orderBy(F.col("tag_no").desc()).first()
    assert (last["name"], last["name_pl"], last["category_pl"]) == ("cinematic", "filmowy", "tagi specjalne")


def test_read_tags(spark, tmp_path):
    path = tmp_path / "tags.json"
    path.write_text('{"b": {"category_pl": "B", "tags": {"z": "zz", "a": "aa"}}, "a": {"category_pl": "A", "tags": {"m": "mm"}}}')
    rows = taxonomy.read_tags(spark, str(path)).orderBy("tag_no").collect()
    assert [tuple(r) for r in rows] == [(0, "b", "B", "z", "zz"), (1, "b", "B", "a", "aa"), (2, "a", "A", "m", "mm")]


def test_selection_properties(spark):
    """What must and must not be kept, over many random score lists."""
    rng = random.Random(5)
    data = []
    for i in range(120):
        listed = [(no, c, n, round(rng.choice([0.19, 0.2, 0.21, 0.22, 0.235, 0.25, 0.27, 0.3]) + rng.choice([0, 0, 0.001]), 4)) for no, c, n in ROWS]
        listed += [(500, "new", "one", 0.23), (501, "new", "two", 0.2)]
        rng.shuffle(listed)
        data.append((i, listed))
    alone = [(1000 * (1 + i) + j, [e for e in listed if e[1] == c]) for i, listed in data[:20] for j, c in enumerate(fv.CATEGORY_RULES)]
    got = {r["id"]: r["s"] for r in spark.createDataFrame(data + alone, SCHEMA).select("id", tags.select_tags(F.col("tag_scores")).alias("s")).collect()}
    for i, listed in data:
        scores = [e["score"] for e in got[i]]
        assert scores == sorted(scores, reverse=True)
        for category in {e[1] for e in listed}:
            most, threshold, _margin, required = fv.CATEGORY_RULES.get(category, fv.DEFAULT_RULE)
            own = [e["score"] for e in got[i] if e["category"] == category]
            best = max(e[3] for e in listed if e[1] == category)
            assert len(own) <= most
            assert not own or max(own) == best or min(own) >= threshold
            assert all(x >= threshold for x in own) or (own == [best] and required and best >= threshold - fv.FALLBACK_SLACK)
            assert own or best < threshold + fv.SURE_BONUS
            assert own or not required or best < threshold - fv.FALLBACK_SLACK
        if i < 20:  # a category is judged alone
            for j, category in enumerate(fv.CATEGORY_RULES):
                assert [e["name"] for e in got[1000 * (1 + i) + j]] == [e["name"] for e in got[i] if e["category"] == category]


def test_selection_edges(spark):
    assert selected(spark, ("fear", 0.26), ("joy", 0.25)) == []                    # margin too small, not required
    assert selected(spark, ("fear", 0.2901), ("joy", 0.2899)) == ["fear", "joy"]   # high without a margin; the last has one
    assert selected(spark, ("low", 0.216), ("high", 0.2155)) == ["low"]            # required
    assert selected(spark, ("low", 0.1951), ("high", 0.1)) == ["low"]              # fallback
    assert selected(spark, ("low", 0.1949)) == []
    assert selected(spark) == []


def test_lookup_keeps_the_lower_score(spark):
    df = contract.with_selection(track(spark, (("sound_character", "intimate"), 0.4), (("atmosphere", "intimate"), 0.3)))
    assert df.first()["tag_lookup"] == {"intimate": 0.3}


def test_pack_scores(spark):
    rows = spark.createDataFrame([(1, 2, "emotion", "fear", 0.3), (1, 0, "emotion", "tension", 0.5)], "id long, tag_no int, category string, name string, score double")
    packed = tags.pack_scores(rows, "id").select(F.inline(tags.select_tags(F.col("tag_scores")))).collect()
    assert [r["name"] for r in packed] == ["tension", "fear"]


def test_contract_of_a_quiet_track(spark):
    row = contract.track_contracts(
        track(spark, ("dialogue_safe", 0.5), ("restrained", 0.4), ("underscore", 0.3), ("low", 0.3), ("sparse", 0.3), ("calm", 0.4)), analysis_col=None
    ).first()
    sem = row["track_music_semantics"]
    safe = 0.5 + 0.45 * 0.5 + 0.28 * 0.4 + 0.22 * 0.3 + 0.14 * 0.3 + 0.18 * 0.3
    assert sem["dialogue_safe_score"] == round(min(1.0, safe), 6) and sem["dialogue_safe"]
    assert sem["weight_profile_candidates"] == ["dialogue"]
    assert sem["narrative_function"] == ["underscore"] and sem["emotional_direction"] == ["calm"]
    tgt = row["track_music_targets"]
    assert (tgt["energy_target"], tgt["tempo_target"], tgt["rhythm_target"]) == ("low", "moderate", "steady")
    assert tgt["sound_character_target"] == ["sparse", "atmospheric"]
    sel = row["track_tag_selection"]
    assert sel["must_not_tags"][:5] == ["hits", "impacts", "very_high", "climax_peak", "trailer_music"] and len(sel["must_not_tags"]) == 6
    assert sel["confidence_profile"]["min_selected_tag_score"] == pytest.approx(0.3)
    assert row["semantic_title_en"] == "Calm Underscore Cue"
    assert row["description_en"] == "Instrumental cue with calm and underscore; low energy, static shape, sparse, atmospheric character."
    assert row["track_clap_prompt_ensemble"]["music_for_scene_prompt"] == "instrumental music for calm underscore cue"


def test_contract_of_an_untagged_track_uses_hints(spark):
    analysis = F.expr("named_struct('energy_target_hint','high','tempo_target_hint','fast','rhythm_target_hint','driving',"
                      "'intensity_shape_hint','pulsating','sound_character_hints',array('clean','wide'))")
    row = contract.track_contracts(track(spark).withColumn("audio_analysis", analysis)).first()
    assert row["track_music_semantics"]["weight_profile_candidates"] == ["dramatic_scene"]
    assert row["track_music_targets"]["sound_character_target"] == ["clean", "wide", "atmospheric"]
    assert row["track_music_targets"]["energy_target"] == "high"
    assert row["track_tag_selection"]["must_not_tags"] == ["very_low", "dialogue_safe", "very_slow"]
    assert tuple(row["track_tag_selection"]["confidence_profile"]) == (0.0, 0.0, 0.0)
    assert row["tags_summary_en"] == "cinematic instrumental underscore"
    assert row["semantic_title_en"] == "Cinematic Underscore Cue"


def test_scene_tags_as_profile_fallback(spark):
    df = contract.with_selection(track(spark, ("conversation", 0.3)))
    lookup = F.create_map().cast("map<string,double>")
    row = df.select(contract.profile_candidates(lookup, F.col("selected_tags"), F.lit(0.5)).alias("p"),
                    contract.profile_candidates(lookup, F.col("selected_tags"), F.lit(0.62)).alias("q")).first()
    assert row["p"] == ["conversation"] and row["q"] == ["dialogue", "transition"]


def test_vector_packages(spark):
    record = spark.createDataFrame([(1, " Title ", "words here", "some tags", tuple(f"p {i} text" for i in range(7)))],
        "id long, theme_title_en string, description_en string, tags_summary_en string, clap_prompt_ensemble struct<" +
        ",".join(f"{n}:string" for n in fv.ENSEMBLE_PROMPTS) + ">")
    row = embed.scene_vectors(record, embed.hashing_encoder(16)).first()
    import numpy as np

    enc = embed.hashing_encoder(16)
    unit = lambda v: v / np.linalg.norm(v)
    main, tag = unit(enc(["Title. words here"])[0]), unit(enc(["some tags"])[0])
    ens = unit(sum(w * unit(enc([f"p {i} text"])[0]) for i, w in enumerate(fv.ENSEMBLE_PROMPTS.values())))
    hybrid = unit(0.45 * main + 0.20 * tag + 0.35 * ens)
    assert row["embedding_main"] == pytest.approx(main.tolist(), abs=1e-6)
    assert row["embedding_hybrid"] == pytest.approx(hybrid.tolist(), abs=1e-6)
    assert len(row["embedding_clap_ensemble"]) == 16
    with pytest.raises(Exception, match="is empty"):
        embed.embed_texts(spark.createDataFrame([("  ",)], "t string"), {"t": "v"}).collect()


def test_mean_pool_and_tag_scores(spark):
    segments = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [0.0, 5.0])], "filepath string, embedding array<float>")
    pooled = {r["filepath"]: r["embedding"] for r in embed.mean_pool(segments, "filepath", "embedding").collect()}
    assert pooled["a"] == pytest.approx([0.5 ** 0.5] * 2) and pooled["b"] == [0.0, 1.0]
    vecs = embed.tag_vectors(taxonomy.with_prompts(taxonomy.default_tags(spark)), embed.hashing_encoder(8))
    tracks = spark.createDataFrame([(4, [1.0] + [0.0] * 7)], "id long, embedding_audio array<float>")
    scores = embed.score_tags(tracks, vecs).first()["tag_scores"]
    want = {r["tag_no"]: r["embedding"][0] for r in vecs.collect()}
    assert len(scores) == 122 and all(s["score"] == pytest.approx(want[s["tag_no"]], abs=1e-6) for s in scores)


def test_contracts_need_no_shuffle(spark, sf):
    from checks import standins as fx

    plan = contract.track_contracts(fx.tag_scores(spark, sf), analysis_col=None)._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1]


def test_mean_pool_combines_before_the_shuffle(spark):
    segments = spark.createDataFrame([("a", [1.0, 0.0])], "filepath string, embedding array<float>")
    plan = embed.mean_pool(segments, "filepath", "embedding")._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("ObjectHashAggregate") == 2


@pytest.mark.parametrize("text", ["напряжение в темноте", "ένταση στο σκοτάδι", "黑暗中的紧张", "napięcie rośnie"])
def test_encoder_reads_any_script(text):
    encode = embed.hashing_encoder(64)
    row = encode([text])[0]
    assert row.sum() == len(text.split()) and (encode([text.upper()])[0] == row).all()


def test_encoder_errors(spark):
    rows = spark.createDataFrame([(1, "words"), (2, "!!! ...")], "id long, text string")
    with pytest.raises(Exception, match="no usable vector"):
        embed.embed_texts(rows, {"text": "v"}).collect()
    with pytest.raises(Exception, match="shape"):
        embed.embed_texts(rows.limit(1), {"text": "v"}, lambda texts: np.ones((len(texts) + 1, 4))).collect()


def test_encoder_gets_bounded_texts(spark):
    """However many long texts an Arrow batch holds; the vectors tell what came at once."""
    def encode(texts):
        return np.tile([float(sum(map(len, texts))), 1.0], (len(texts), 1))

    sizes = [1 << 20] * 9 + [6 << 20, 0, 5]
    rows = spark.createDataFrame([(i, "x" * n + f" {i}") for i, n in enumerate(sizes)], "id long, text string").coalesce(1)
    found = embed.embed_texts(rows, {"text": "v"}, encode).select("id", "v").collect()
    assert len(found) == len(sizes)
    for r in found:
        assert r["v"][0] / r["v"][1] <= max((4 << 20) * 1.001, sizes[r["id"]] + 10)


def test_no_text_travels_with_its_vector(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, "c")], "id long, text string").write.parquet(f"{tmp_path}/rows")
    rows = embed.embed_texts(spark.read.parquet(f"{tmp_path}/rows"), {"text": "v"}, embed.hashing_encoder(4)).select("id", "v")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join LeftOuter")]
    assert "text#" not in above


def test_tag_scores_in_slices(spark):
    vecs = embed.tag_vectors(taxonomy.with_prompts(taxonomy.default_tags(spark)), embed.hashing_encoder(8))
    tracks = spark.createDataFrame([(1, [float(i) for i in range(8)]), (2, [1.0] * 8), (3, [1.0])], "id long, embedding_audio array<float>")
    whole, sliced = (
        {r["id"]: [(t["tag_no"], round(t["score"], 12)) for t in r["tag_scores"]] for r in embed.score_tags(tracks, vecs, limit_bytes=n).collect()}
        for n in (64 << 20, 2000)
    )
    assert whole == sliced and len(whole[1]) == 122


def test_tags_of_another_length_score_zero(spark):
    """One longer tag, in whatever slice, takes nothing from the others."""
    tags = spark.createDataFrame(
        [(0, "c", "a", [1.0, 0.0]), (1, "c", "b", [0.0, 2.0]), (2, "c", "long", [1.0, 1.0, 1.0, 1.0]), (3, "c", "none", None)],
        "tag_no int, category string, name string, embedding array<float>",
    )
    tracks = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0, 0.0, 2.0]), (4, None)], "id long, embedding_audio array<float>")
    want = {1: [1, 0, 0, 0], 2: [0, 1, 0, 0], 3: [0, 0, 0.5, 0], 4: [0, 0, 0, 0]}
    for limit in (64 << 20, 60):
        got = {r["id"]: [t["score"] for t in r["tag_scores"]] for r in embed.score_tags(tracks, tags, limit_bytes=limit).collect()}
        assert got == want


def test_each_distinct_text_is_encoded_once(spark, tmp_path):
    encode, folder = embed.hashing_encoder(8), str(tmp_path)

    def counting(texts):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return encode(texts)

    rows = spark.createDataFrame([(i, f"title {i % 3}", "same" if i % 2 else f"title {i % 5}") for i in range(60)], "id long, a string, b string").repartition(7)
    out = embed.embed_rows(rows, {"a": "va", "b": "vb"}, counting)
    got = {r["id"]: (r["va"], r["vb"], r["encode_errors"]) for r in out.collect()}
    out.count()
    seen = [t for f in tmp_path.iterdir() for t in f.read_text().split("\n")]
    assert sorted(seen) == sorted({f"title {i}" for i in range(5)} | {"same"})
    unit = lambda t: (encode([t])[0] / np.linalg.norm(encode([t])[0])).tolist()
    assert len(got) == 60
    for i, (va, vb, errors) in got.items():
        assert va == pytest.approx(unit(f"title {i % 3}")) and vb == pytest.approx(unit("same" if i % 2 else f"title {i % 5}")) and errors == []


def test_a_bad_text_is_a_row_and_stops_nothing(spark):
    encode = embed.hashing_encoder(8)

    def picky(texts):
        if any("boom" in t for t in texts):
            raise KeyError("boom")
        return encode(texts)

    rows = spark.createDataFrame([(1, "fine"), (2, " "), (3, "a boom"), (4, "!!"), (5, None), (6, "fine")], "id long, t string")
    got = {r["id"]: (r["v"] is not None, [(e["column"], e["error_type"]) for e in r["encode_errors"]]) for r in embed.embed_rows(rows, {"t": "v"}, picky).collect()}
    assert got == {1: (True, []), 2: (False, [("t", "EmptyText")]), 3: (False, [("t", "KeyError")]), 4: (False, [("t", "NoVector")]),
                   5: (False, [("t", "EmptyText")]), 6: (True, [])}
    plan = embed.embed_rows(rows, {"t": "v"}, picky)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan  # the rows meet the stored vectors; only the narrow table of texts went through Python
