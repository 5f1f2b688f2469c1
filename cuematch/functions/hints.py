"""Hints read off the numbers of an audio signal, and segment ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuematch import fixed_values as fv
from cuematch.functions.arrays import strings


def _below(value: Column, bounds, above: str) -> Column:
    out = None
    for bound, word in bounds:
        out = F.when(value < bound, word) if out is None else out.when(value < bound, word)
    return out.otherwise(above)


def tempo_hint(bpm: Column) -> Column:
    return F.when(bpm.isNull(), "moderate").otherwise(_below(bpm, fv.TEMPO_BOUNDS, "very_fast"))


def energy_hint(rms: Column) -> Column:
    return _below(rms, fv.ENERGY_BOUNDS, "very_high")


def rhythm_hint(crossing_rate: Column, bpm: Column) -> Column:
    return F.when(bpm >= fv.DRIVING_BPM, "driving").otherwise(
        _below(crossing_rate, fv.RHYTHM_BOUNDS, "irregular")
    )


def intensity_hint(rms: Column, crossing_rate: Column) -> Column:
    return (
        F.when(rms > fv.PEAK_RMS, "climax_peak")
        .when(crossing_rate > fv.PULSE_CROSSINGS, "pulsating")
        .when(rms > fv.BUILD_RMS, "gradual_build")
        .otherwise("static")
    )


def sound_hints(centroid: Column) -> Column:
    (low, dark), (mid, soft) = fv.SOUND_BOUNDS
    return (
        F.when(centroid < low, strings(dark))
        .when(centroid < mid, strings(soft))
        .otherwise(strings(fv.SOUND_ABOVE))
    )


def audio_analysis(
    rms: Column, crossing_rate: Column, centroid: Column, rolloff: Column, bpm: Column
) -> Column:
    """The analysis record of a track."""
    return F.struct(
        rms.cast("double").alias("rms"),
        crossing_rate.cast("double").alias("zero_crossing_rate"),
        centroid.cast("double").alias("spectral_centroid"),
        rolloff.cast("double").alias("spectral_rolloff"),
        energy_hint(rms).alias("energy_target_hint"),
        tempo_hint(bpm).alias("tempo_target_hint"),
        rhythm_hint(crossing_rate, bpm).alias("rhythm_target_hint"),
        intensity_hint(rms, crossing_rate).alias("intensity_shape_hint"),
        sound_hints(centroid).alias("sound_character_hints"),
    )


def segment_ranges(n_samples: Column, sample_rate: int, seconds: int, count: int) -> Column:
    """Up to ``count`` equally spaced ranges of ``seconds`` over a signal.

    A signal shorter than one segment gives its whole length once.
    """
    length = seconds * sample_rate
    total = n_samples.cast("long")

    def span(start: Column, end: Column) -> Column:
        return F.struct(
            F.round(start / sample_rate, 3).alias("start_sec"),
            F.round(end / sample_rate, 3).alias("end_sec"),
        )

    whole = F.array(span(F.lit(0), total))
    if count <= 1:
        many = F.array(span(F.lit(0), F.lit(length)))
    else:
        room = total - length
        # The last start is the exact end of the room, free of rounding.
        starts = F.transform(
            F.sequence(F.lit(0), F.lit(count - 1)),
            lambda i: F.when(i == count - 1, room).otherwise(F.floor(i * (room / (count - 1)))),
        )
        many = F.transform(starts, lambda start: span(start, start + length))
    return F.when(total < length, whole).otherwise(many)
