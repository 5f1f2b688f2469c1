import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuematch import fixed_values as fv
from cuematch.functions import arrays, hints, text
from cuematch.functions import vectors as V


def one(spark, column, **values):
    """Value of a column over a single row."""
    row = spark.range(1).select(*[v.alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def vec(*numbers):
    return F.array(*[F.lit(float(n)) for n in numbers]).cast("array<float>")


def opt(numbers):
    return F.lit(None).cast("array<float>") if numbers is None else vec(*numbers)


def words(*items):
    return arrays.strings(list(items))


@pytest.mark.parametrize("a, b, want", [
    ([1, 0], [1, 0], 1.0),
    ([1, 0], [0, 2], 0.0),
    ([1, 0], [-3, 0], -1.0),
    ([0, 0], [1, 0], 0.0),
    ([1, 0], [1, 0, 0], 0.0),
    ([], [], 0.0),
    (None, [1, 0], 0.0),
])
def test_cosine(spark, a, b, want):
    a, b = opt(a), opt(b)
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)
    batch = V.cosine_batch(F.col("a"), F.col("b"), V.norm(F.col("a")), V.norm(F.col("b")))
    assert one(spark, batch, a=a, b=b) == pytest.approx(want)


def test_cosine_distance_of_null_is_null(spark):
    assert one(spark, V.cosine_distance(opt(None), vec(1))) is None
    assert one(spark, V.cosine_distance(vec(2), vec(1))) == pytest.approx(0.0)


def test_l2_normalize(spark):
    assert one(spark, V.l2_normalize(vec(3, 4))) == pytest.approx([0.6, 0.8])
    assert one(spark, V.l2_normalize(vec(0, 0))) == [0.0, 0.0]


def test_weighted_average(spark):
    got = one(spark, V.weighted_average([vec(1, 0), vec(0, 1)], [3.0, 1.0]))
    assert got == pytest.approx([3 / math.sqrt(10), 1 / math.sqrt(10)])
    for vectors, weights in [([], []), ([vec(1)], [1.0, 2.0]), ([vec(1)], [0.0])]:
        with pytest.raises(ValueError):
            V.weighted_average(vectors, weights)
    with pytest.raises(Exception, match="differ in length"):
        one(spark, V.weighted_average([vec(1, 0), vec(1)], [0.5, 0.5]))


@pytest.mark.parametrize("stored, want", [
    ("[0.5, -1,2e-3]", [0.5, -1.0, 0.002]), ("(1,,2)", [1.0, 2.0]), ("", []), (None, []), ("[]", []),
])
def test_decode_vector(spark, stored, want):
    assert one(spark, V.decode_vector(F.lit(stored).cast("string"))) == pytest.approx(want)


def test_shares_and_jaccard(spark):
    a, b, none = words("x", "y"), words("y", "z", "w"), words()
    assert one(spark, arrays.share_of_first(a, b)) == 0.5
    assert one(spark, arrays.share_of_first(none, b)) == 0.0
    assert one(spark, arrays.share_of_first(a, none)) == 0.0
    assert one(spark, arrays.jaccard(a, b)) == 0.25
    assert one(spark, arrays.jaccard(none, b)) == 0.0
    assert one(spark, arrays.as_set(F.lit(None).cast("array<string>"))) == []


@pytest.mark.parametrize("a, b, want", [
    ("low", "low", 1.0), ("very_low", "low", 0.75), ("very_low", "very_high", 0.0),
    ("low", "odd", 0.0), ("odd", "odd", 1.0), ("", "", 0.0), (None, "low", 0.0),
])
def test_scale_match(spark, a, b, want):
    col = arrays.scale_match(F.lit(a).cast("string"), F.lit(b), fv.ENERGY_SCALE, fv.ORDINAL_STEP)
    assert one(spark, col) == want


def test_long_scale_ends_at_zero_after_four_steps(spark):
    def match(a, b):
        return one(spark, arrays.scale_match(F.lit(a), F.lit(b), fv.INTENSITY_SCALE, 0.25))

    assert match("static", "peak") == 0.25
    assert match("static", "climax_peak") == 0.0
    assert match("static", "drop") == 0.0


def test_lists(spark):
    assert one(spark, arrays.top_distinct(words("b", "a", "b", "c", "d", "e"), 4)) == ["b", "a", "c", "d"]
    assert one(spark, arrays.argmax_label(vec(0, 5, 5), ["C", "D", "E"])) == "D"
    assert one(spark, words("it's", "a\\b")) == ["it's", "a\\b"]


def test_whitespace(spark):
    raw = "  a\t\tb\r\nc\rd\n\n\n\ne \n\x1f"
    assert one(spark, text.normalize_whitespace(F.lit(raw))) == "a b\nc\nd\n\ne"
    assert one(spark, text.strip(F.lit("  x 　"))) == "x"


@pytest.mark.parametrize("name, want", [
    ("Episode 12 v3.docx", 12), ("shows/s01/ep_0042.txt", 42), ("1234567.doc", 123456), ("none.txt", None), ("x.7", None),
])
def test_episode_number(spark, name, want):
    assert one(spark, text.episode_number(F.lit(name))) == want


def test_split_scenes(spark):
    raw = "prologue\nSCENA 3. INT\nfirst\n\n scena 9 - EXT\nsecond\nnot SCENA 5 here"
    got = one(spark, text.split_scenes(F.lit(raw)))
    assert got == ["SCENA 3. INT\nfirst", "scena 9 - EXT\nsecond\nnot SCENA 5 here"]
    assert one(spark, text.split_scenes(F.lit("no header"))) == []
    # white space after the number runs over the line end and takes in the next line
    assert one(spark, text.split_scenes(F.lit("SCENA 1\nSCENA 2\nx"))) == ["SCENA 1\nSCENA 2\nx"]
    assert one(spark, text.split_scenes(F.lit("SCENE 1 a\nSCENE 2 b"), r"^SCENE\s+\d+.*$")) == ["SCENE 1 a", "SCENE 2 b"]
    assert text.header_keyword(r"^\s*SCENA\s+(\d+)") == "SCENA"
    assert text.header_keyword("int") == "int"


def test_tag_prompts(spark):
    got = one(spark, text.tag_prompts(F.lit("sound_character"), F.lit("dialogue_safe")))
    assert got == [
        "cinematic instrumental music with dialogue safe",
        "music tagged as sound character: dialogue safe",
        "film underscore with dialogue safe",
    ]


@pytest.mark.parametrize("bpm, want", [
    (None, "moderate"), (54, "very_slow"), (55, "slow"), (79, "slow"), (80, "moderate"), (117, "moderate"),
    (118, "fast"), (144, "fast"), (145, "very_fast"),
])
def test_tempo(spark, bpm, want):
    assert one(spark, hints.tempo_hint(F.lit(bpm).cast("int"))) == want


def test_hints(spark):
    energy = lambda x: one(spark, hints.energy_hint(F.lit(x)))
    assert [energy(x) for x in (0.029, 0.03, 0.06, 0.11, 0.18)] == ["very_low", "low", "medium", "high", "very_high"]
    rhythm = lambda z, b: one(spark, hints.rhythm_hint(F.lit(z), F.lit(b).cast("int")))
    assert [rhythm(0.01, 120), rhythm(0.01, None), rhythm(0.05, 90), rhythm(0.1, 90), rhythm(0.2, 90)] == [
        "driving", "floating", "steady", "syncopated", "irregular"]
    shape = lambda r, z: one(spark, hints.intensity_hint(F.lit(r), F.lit(z)))
    assert [shape(0.15, 0.2), shape(0.1, 0.1), shape(0.09, 0.01), shape(0.01, 0.01)] == [
        "climax_peak", "pulsating", "gradual_build", "static"]
    sound = lambda c: one(spark, hints.sound_hints(F.lit(c)))
    assert [sound(10.0), sound(1600.0), sound(3200.0)] == [["intimate", "analog"], ["atmospheric", "textured"], ["clean", "wide"]]
    record = one(spark, hints.audio_analysis(F.lit(0.1), F.lit(0.05), F.lit(0.0), F.lit(0.0), F.lit(None).cast("int")))
    assert record["tempo_target_hint"] == "moderate" and record["energy_target_hint"] == "medium"


@pytest.mark.parametrize("n, count", [(10, 5), (200, 5), (201, 5), (999, 7), (2003, 1), (12345, 4)])
def test_segment_ranges(spark, n, count):
    rate, seconds = 10, 20
    got = [tuple(r) for r in one(spark, hints.segment_ranges(F.lit(n), rate, seconds, count))]
    if n < rate * seconds:
        want = [(0.0, round(n / rate, 3))]
    elif count <= 1:
        want = [(0.0, float(seconds))]
    else:
        starts = np.linspace(0, n - rate * seconds, count, dtype=int).tolist()
        want = [(round(s / rate, 3), round((s + rate * seconds) / rate, 3)) for s in starts]
    assert got == want


def test_title_case_is_that_of_strings(spark):
    from cuematch.functions import text

    names = ["lo-fi_beats", "80s_synth", "rock'n'roll", "DARK_moody", "a", "", "élan_vital", "x2y", "one__two"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, n string").select("id", text.title_case(F.col("n")).alias("t")).collect()
    assert {r["id"]: r["t"] for r in rows} == {i: n.replace("_", " ").title() for i, n in enumerate(names)}
