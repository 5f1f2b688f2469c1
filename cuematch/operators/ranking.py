"""Ranking of scored pairs, alone or in the order of an episode.

Two penalties of a pair depend on the winners of earlier scenes of the
episode: how often its style has won, and whether the same track won the scene
just before. Only the winners carry state, so the episode ranking has three
steps:

1. In parallel, keep of every (scene, style) the few rows that can win under
   any history (``contenders``).
2. Fold the contenders in scene order. Sorted partitions stream through
   ``mapInArrow``; memory holds one scene and a counter per style, never an
   episode. It emits one row per scene: the uses of its styles so far and
   the previous winner.
3. In parallel, join that context to all candidates and rank them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuematch import fixed_values as fv
from cuematch.config import MatchConfig
from cuematch.operators import scoring
from cuematch.plans.storage import materialize

_SEND = 2_000_000  # last kept scores, 16 bytes each
_EDGE = 1e-9  # wider than the rounding of a handful of additions near 1


def rank_order() -> list[Column]:
    return [
        F.col("final_score").desc(), F.col("embedding_score").desc(),
        F.col("semantic_score").desc(), F.col("targets_score").desc(),
        F.col("hybrid_similarity").desc(), F.col("track_query_id").asc(),
    ]


def rank_within_scene(scored: DataFrame) -> DataFrame:
    """Add rank_position 1..n per scene; final_score must be present."""
    order = Window.partitionBy("scene_query_id").orderBy(*rank_order())
    return scored.withColumn("rank_position", F.row_number().over(order))


def rank_alone(scored: DataFrame, top_n: int) -> DataFrame:
    """Top rows per scene with no episode history."""
    return rank_within_scene(scoring.without_context(scored)).filter(F.col("rank_position") <= top_n)


def contenders(scored: DataFrame) -> DataFrame:
    """Rows that can win their scene under some history.

    Within one (scene, style) the style penalty is the same for all rows and
    the same-track penalty strikes at most one, so the winner is among the two
    best by unclamped score, with room for rounding, or, where the score is
    clamped to a bound, the two best by the later sort keys.
    """
    static = (
        F.col("weighted_score")
        - (F.col("dialogue_conflict") + F.col("duration_conflict") + F.col("forbidden_tag_conflict")
           + F.col("missing_data_penalty"))
    )
    style = Window.partitionBy("scene_query_id", "style_signature")
    later = rank_order()[1:]
    narrow = scored.select(
        "episode_nr", "scene_nr", "theme_nr", "scene_query_id", "track_query_id", "style_signature",
        "weighted_score",
        (F.col("dialogue_conflict") + F.col("duration_conflict") + F.col("forbidden_tag_conflict")).alias("before"),
        F.col("missing_data_penalty").alias("after"),
        "embedding_score", "semantic_score", "targets_score", "hybrid_similarity",
        static.alias("static_score"),
    )
    return (
        narrow.withColumn("by_score", F.row_number().over(style.orderBy(F.col("static_score").desc(), *later)))
        .withColumn("second", F.min(F.when(F.col("by_score") <= 2, F.col("static_score"))).over(style))
        .withColumn("by_later", F.row_number().over(style.orderBy(*later)))
        .filter((F.col("static_score") >= F.col("second") - _EDGE) | (F.col("by_later") <= 2))
        .drop("by_score", "second", "by_later", "static_score")
    )


_CONTEXT = "scene_query_id long, styles array<string>, uses array<int>, previous_track_id long"
_FOLD_COLUMNS = [
    "episode_nr", "scene_query_id", "track_query_id", "style_signature", "weighted_score",
    "before", "after", "embedding_score", "semantic_score", "targets_score", "hybrid_similarity",
]


def _fold(style_limit: int):
    """Walk contenders sorted by episode and scene; emit the context of each scene."""
    free = max(0, style_limit - 1)

    def winner(scene: dict[str, np.ndarray], uses: np.ndarray, previous: int | None) -> int:
        style = fv.STYLE_STEP * np.maximum(0, uses - free)
        repeated = np.zeros(len(uses), bool) if previous is None else scene["track_query_id"] == previous
        same = np.where(repeated, fv.SAME_TRACK_PENALTY, 0.0)
        total = scene["before"] + style + same + scene["after"]
        final = np.clip(scene["weighted_score"] - total, 0.0, 1.0)
        order = np.lexsort((
            scene["track_query_id"], -scene["hybrid_similarity"], -scene["targets_score"],
            -scene["semantic_score"], -scene["embedding_score"], -final,
        ))
        return int(order[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        episode, previous, used = None, None, {}
        out: list[tuple] = []
        rest: pa.Table | None = None

        def flush():
            ids, styles, uses, before = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(styles, pa.list_(pa.string())),
                 pa.array(uses, pa.list_(pa.int32())),
                 pa.array(before, pa.int64())],
                names=["scene_query_id", "styles", "uses", "previous_track_id"],
            )

        def scenes(table: pa.Table, last: bool):
            """Whole scenes of a table; the open one at its end is kept back."""
            nonlocal rest
            ids = np.asarray(table.column("scene_query_id"))
            starts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]])
            stop = len(starts) - 1 if last else len(starts) - 2
            columns = {
                name: np.asarray(table.column(name)) if name != "style_signature"
                else np.array(table.column(name).to_pylist(), dtype=object)
                for name in _FOLD_COLUMNS
            }
            for lo, hi in zip(starts[:stop], starts[1 : stop + 1]):
                yield {name: values[lo:hi] for name, values in columns.items()}
            rest = None if last else table.slice(int(starts[stop]))

        def step(scene):
            nonlocal episode, previous, used
            if scene["episode_nr"][0] != episode:
                episode, previous, used = scene["episode_nr"][0], None, {}
            styles = scene["style_signature"]
            uses = np.array([used.get(s, 0) for s in styles])
            scene_id = int(scene["scene_query_id"][0])
            met = list(dict.fromkeys(styles))
            out.append((scene_id, met, [used.get(s, 0) for s in met], previous))
            best = winner(scene, uses, previous)
            previous = int(scene["track_query_id"][best])
            used[styles[best]] = used.get(styles[best], 0) + 1

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            for scene in scenes(table, last=False):
                step(scene)
            if len(out) > 10_000:
                yield flush()
        if rest is not None and rest.num_rows:
            for scene in scenes(rest, last=True):
                step(scene)
        if out:
            yield flush()

    return run


def scene_context(scored: DataFrame, config: MatchConfig) -> DataFrame:
    """Per scene: uses so far of its styles, and the track that won the scene before."""
    ordered = (
        contenders(scored)
        .repartition("episode_nr")
        .sortWithinPartitions("episode_nr", "scene_nr", "theme_nr", "scene_query_id")
        .select(*_FOLD_COLUMNS)
    )
    return ordered.mapInArrow(_fold(config.style_duplicate_limit), _CONTEXT)


def rank_episodes(scored: DataFrame, config: MatchConfig) -> DataFrame:
    """Ranked matches of all episodes, each in (scene, theme) order.

    ``scored`` is read three times: for the contenders, for the score that a row must
    have to be kept in its scene, and, without the rows that cannot have it, for the
    final ranking. So only narrow rows are shuffled whole. Write it to a table first
    when it is costly (see plans/matching.py).
    """
    # Joined by scene alone, so the rankings below need no further shuffle.
    context = materialize(scene_context(scored, config).select(
        "scene_query_id", F.map_from_arrays("styles", "uses").alias("style_uses"), "previous_track_id"
    ), "context")
    limit = config.style_duplicate_limit
    uses = F.element_at("style_uses", F.col("style_signature"))

    def placed(rows: DataFrame) -> DataFrame:
        return scoring.with_final_score(
            rows.join(context, "scene_query_id")
            .withColumn("style_redundancy_penalty", scoring.style_penalty(uses, limit))
            .withColumn(
                "same_track_consecutive_penalty",
                F.when(F.col("track_query_id") == F.col("previous_track_id"), fv.SAME_TRACK_PENALTY).otherwise(0.0),
            )
            .drop("style_uses", "previous_track_id")
        )

    ranked = rank_within_scene(placed(_possible(scored, placed, config.rank_top_n)))
    return ranked.filter(F.col("rank_position") <= config.rank_top_n)


_STATIC = ["dialogue_conflict", "duration_conflict", "forbidden_tag_conflict", "missing_data_penalty"]


def _possible(scored: DataFrame, placed: Callable[[DataFrame], DataFrame], top_n: int) -> DataFrame:
    """Rows that can be among the ``top_n`` of their scene, and a few more.

    The two penalties of the context only lower a score, so a row whose score without
    them is below the last kept score of its scene is not kept. The last kept scores
    are a narrow table, one row per scene, sent to all tasks up to a bound.
    """
    narrow = scored.select("scene_query_id", "track_query_id", "style_signature", "weighted_score", *_STATIC)
    order = Window.partitionBy("scene_query_id").orderBy(F.col("final_score").desc())
    kept = placed(narrow).select("scene_query_id", "final_score").withColumn("n", F.row_number().over(order))
    last = kept.filter(F.col("n") <= top_n).groupBy("scene_query_id").agg(F.max_by("final_score", "n").alias("_last"))
    last = materialize(last, "last-kept")
    send = F.broadcast if last.count() <= _SEND else (lambda x: x)
    most = F.col("weighted_score") - sum((F.col(c) for c in _STATIC[1:]), F.col(_STATIC[0]))
    can = F.coalesce(F.col("_last") <= 0, F.lit(True)) | F.coalesce(most >= F.col("_last") - F.lit(_EDGE), F.lit(True))
    return scored.join(send(last), "scene_query_id").filter(can).drop("_last")


PREVIEW_COLUMNS = [
    "scene_query_id", "scene_nr", "theme_nr", "scene_theme_title_en", "track_query_id",
    "track_filename", "track_semantic_title_en", "rank_position", "final_score",
    "embedding_score", "semantic_score", "targets_score", "tag_selection_score", "penalty_total",
    "style_signature",
]


def preview_rows(ranked: DataFrame, top_n: int) -> DataFrame:
    return (
        ranked.filter(F.col("rank_position") <= top_n)
        .select(*PREVIEW_COLUMNS)
        .withColumnRenamed("scene_theme_title_en", "theme_title_en")
    )


def to_matches(ranked: DataFrame) -> DataFrame:
    """Rows of the match catalog."""
    from cuematch.schemas import MATCHES

    now = F.current_timestamp().cast("timestamp_ntz")
    full = (
        ranked.withColumn("id", F.xxhash64("scene_query_id", "track_query_id"))
        .withColumn("match_metadata", F.to_json(F.struct("scene_query_id", "track_query_id")))
        .withColumn("match_explanation", F.to_json(scoring.explanation()))
        .withColumn("created_at", now)
        .withColumn("updated_at", now)
    )
    return full.select(*[F.col(f.name).cast(f.dataType) for f in MATCHES.fields])
