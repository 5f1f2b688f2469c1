"""Keeping the catalogs current: merges, replacements, deletions.

The functions ending in rows (:func:`upsert`, :func:`replace_episode`, ...)
are plans: they return the new content of a table. :func:`write_snapshot` and
:func:`overwrite_episodes` put content on storage.
"""

from __future__ import annotations

from collections.abc import Sequence

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuematch.plans import storage


def _now() -> Column:
    return F.current_timestamp().cast("timestamp_ntz")


def last_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the last in ``order``; among equals the one with the largest hash of all columns.

    A missing value comes first in the order. Combined map-side.
    """
    by = F.struct(*[F.struct(F.col(c).isNotNull(), c) for c in order], F.xxhash64(*rows.columns))
    kept = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), by).alias("_last"))
    return kept.select("_last.*")


def upsert(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], keep: Sequence[str] = ("id", "created_at"),
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Content after merging ``incoming`` by key, with a ``merge_action`` column.

    Of several incoming rows of one key the last counts, in ``order`` (by
    default ``updated_at`` where there is one), see :func:`last_of_each`.

    Incoming rows replace all columns but ``keep``, which stay as first stored.
    ``merge_action`` is ``inserted``, ``updated`` or ``kept``. ``updated_at``
    is set on inserted and updated rows when the table has it. Stored keys must
    be unique. One full outer join: a single shuffle by key.
    """
    columns = list(existing.columns)
    if order is None:
        order = [c for c in ("updated_at",) if c in incoming.columns]
    incoming = last_of_each(incoming, keys, order)
    a = existing.withColumn("_has_a", F.lit(True)).alias("a")
    b = incoming.withColumn("_has_b", F.lit(True)).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    joined = a.join(b, on, "full_outer")
    fresh, stored = F.col("b._has_b").isNotNull(), F.col("a._has_a").isNotNull()
    out = []
    for name in columns:
        old = F.col(f"a.{name}")
        new = F.col(f"b.{name}") if name in incoming.columns else F.lit(None).cast(existing.schema[name].dataType)
        if name == "updated_at":
            value = F.when(fresh, _now()).otherwise(old)
        elif name in keep and name not in keys:
            first = F.coalesce(new, _now()) if name == "created_at" else new
            value = F.when(stored, old).otherwise(first)
        else:
            value = F.when(fresh, new).otherwise(old)
        out.append(value.alias(name))
    action = F.when(fresh & stored, "updated").when(fresh, "inserted").otherwise("kept")
    return joined.select(*out, action.alias("merge_action"))


def upsert_tracks(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(existing, incoming, ["filepath"])


def upsert_scenes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(existing, incoming, ["episode_nr", "scene_nr", "theme_nr"])


def _positive(episode_nr: int) -> int:
    if not isinstance(episode_nr, int) or isinstance(episode_nr, bool) or episode_nr <= 0:
        raise ValueError("episode_nr must be a positive integer")
    return episode_nr


def delete_episode(df: DataFrame, episode_nr: int) -> DataFrame:
    """Content without one episode."""
    return df.filter(~F.col("episode_nr").eqNullSafe(F.lit(_positive(episode_nr))))


def replace_episode(matches: DataFrame, ranked: DataFrame, episode_nr: int) -> DataFrame:
    """Content with the matches of one episode replaced; ``ranked`` may be empty."""
    return delete_episode(matches, episode_nr).unionByName(
        ranked.filter(F.col("episode_nr") == episode_nr), allowMissingColumns=True
    )


def replace_episodes(matches: DataFrame, ranked: DataFrame) -> DataFrame:
    """Content with every episode that occurs in ``ranked`` replaced."""
    touched = ranked.select("episode_nr").distinct()
    return matches.join(touched, "episode_nr", "left_anti").select(*matches.columns).unionByName(
        ranked, allowMissingColumns=True
    )


def merge_matches(matches: DataFrame, ranked: DataFrame) -> DataFrame:
    """Upsert by (scene, track) without removing other rows."""
    return upsert(matches, ranked, ["scene_query_id", "track_query_id"])


def replace_scene(matches: DataFrame, ranked: DataFrame, scene_id: int) -> DataFrame:
    """Content with the rows of one scene replaced.

    Old ranks of the scene go, so (scene, rank) stays unique. ``created_at`` of
    pairs that stay is kept.
    """
    mine = F.col("scene_query_id") == scene_id
    old = matches.filter(mine)
    merged = upsert(old, ranked.filter(mine), ["scene_query_id", "track_query_id"])
    fresh = merged.filter(F.col("merge_action") != "kept").drop("merge_action")
    return matches.filter(~mine).unionByName(fresh)


def cascade(matches: DataFrame, scenes: DataFrame, tracks: DataFrame) -> DataFrame:
    """Matches whose scene and track both still exist."""
    s = scenes.select(F.col("id").alias("scene_query_id"))
    t = tracks.select(F.col("id").alias("track_query_id"))
    return matches.join(s, "scene_query_id", "left_semi").join(t, "track_query_id", "left_semi")


def delete_scene_episode(
    scenes: DataFrame, matches: DataFrame, tracks: DataFrame, episode_nr: int
) -> tuple[DataFrame, DataFrame]:
    """(scenes, matches) after an episode's scenes are deleted, with their matches."""
    left = delete_episode(scenes, episode_nr)
    return left, cascade(matches, left, tracks)


def rerun_episode(scenes: DataFrame, records: DataFrame, episode_nr: int) -> DataFrame:
    """Scene content with one episode's rows deleted and written anew, in one step."""
    return replace_episode(scenes, records, episode_nr).select(*scenes.columns)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Write content to a folder of its own; never the folder it was read from."""
    df.write.mode("errorifexists").parquet(path)


def publish(df: DataFrame, path: str) -> str:
    """Write content as a new version of the table at ``path`` and make it the current one.

    A version is a folder of its own; the pointer file beside it is replaced
    last, so readers see the old version or the new one, whole. Returns the
    version's name. The content may be read from the version it replaces.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    write_snapshot(df, f"{path}/versions/{version}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}/current-{version}")
    fs = target.getFileSystem(conf)
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fresh, target, options)
    return version


def published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of the table at ``path``."""
    version = spark.read.text(f"{path}/current").first()["value"]
    return spark.read.parquet(f"{path}/versions/{version}")


def drop_old_versions(spark: SparkSession, path: str) -> None:
    """Delete all versions but the current one; no reader may still use them."""
    version = spark.read.text(f"{path}/current").first()["value"]
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    for status in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder):
        if status.getPath().getName() != version:
            storage.delete(spark, status.getPath().toString())


def overwrite_episodes(matches: DataFrame, path: str, episodes: Sequence[int] | None = None) -> None:
    """Replace episode partitions on storage; others stay.

    Without ``episodes`` those that occur in ``matches`` are replaced. With it,
    exactly those are: only their rows are written, and a partition that gets no
    rows is removed. An episode is one file, or several where its rows are many: Spark
    splits large episodes and puts small ones together by their sizes.
    """
    spark = matches.sparkSession
    if episodes is not None:
        wanted = [_positive(e) for e in episodes]
        matches = matches.filter(F.col("episode_nr").isin(wanted))
        filled = {r[0] for r in matches.select("episode_nr").distinct().collect()}  # at most the given ones
    (
        matches.hint("rebalance", "episode_nr")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("episode_nr")
        .parquet(path)
    )
    for episode in [] if episodes is None else sorted(set(wanted) - filled):
        storage.delete(spark, f"{path}/episode_nr={episode}")
