"""Numbers of a sampled signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def signal_stats(
    samples: DataFrame, signal: str = "signal_id", pos: str = "pos", value: str = "value", chunk: int = 1 << 20
) -> DataFrame:
    """(signal, n_samples, rms, crossing_rate) per signal.

    The crossing rate is the number of sign changes between neighbours over
    the number of samples; zero counts as positive. A long signal is cut into
    chunks of positions that are walked in parallel; the few chunk ends are
    joined up afterwards, so one huge signal is not one task.
    """
    cut = samples.select(
        F.col(signal).alias("signal"), F.col(pos).alias("pos"), F.col(value).cast("double").alias("x"),
        F.floor(F.col(pos) / chunk).alias("chunk"),
    )
    within = Window.partitionBy("signal", "chunk").orderBy("pos")
    negative = F.col("x") < 0
    walked = cut.withColumn("change", F.when(negative != F.lag(negative).over(within), 1).otherwise(0))
    chunks = walked.groupBy("signal", "chunk").agg(
        F.count("*").alias("n"),
        F.sum(F.col("x") * F.col("x")).alias("squares"),
        F.sum("change").alias("changes"),
        F.min_by(negative, "pos").alias("first_negative"),
        F.max_by(negative, "pos").alias("last_negative"),
    )
    across = Window.partitionBy("signal").orderBy("chunk")
    seams = chunks.withColumn(
        "seam", F.when(F.col("first_negative") != F.lag("last_negative").over(across), 1).otherwise(0)
    )
    return seams.groupBy("signal").agg(
        F.sum("n").alias("n_samples"),
        F.sqrt(F.sum("squares") / F.sum("n")).alias("rms"),
        (F.sum(F.col("changes") + F.col("seam")) / F.sum("n")).alias("crossing_rate"),
    ).withColumnRenamed("signal", signal)
