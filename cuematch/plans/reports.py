"""Report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuematch.schemas import PENALTY_COLUMNS

FULL_COLUMNS = [
    "episode_nr", "scene_query_id", "scene_nr", "theme_nr", "rank_position",
    "scene_theme_title_en", "track_query_id", "track_semantic_title_en", "track_filename",
    "track_filepath", "final_score", "embedding_score", "semantic_score", "targets_score",
    "tag_selection_score", "dialogue_score", "main_similarity", "tags_similarity",
    "ensemble_similarity", "hybrid_similarity", "audio_similarity_aux", *PENALTY_COLUMNS,
    "style_signature", "dialogue_safe_applied",
]
SHORT_COLUMNS = [
    "episode_nr", "scene_nr", "theme_nr", "rank_position", "scene_theme_title_en",
    "track_filename", "track_semantic_title_en", "final_score",
]
RECORD_FIELDS = [
    "episode_nr", "scene_nr", "theme_nr", "segmentation_reason", "theme_title_pl",
    "theme_title_en", "description_en", "theme_txt", "tags_summary_en", "scene_music_semantics",
    "scene_music_targets", "scene_tag_selection", "clap_prompt_ensemble",
]


def _rounded(c: Column, kind: T.DataType, digits: int) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.round(c.cast("double"), digits)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _rounded(x, kind.elementType, digits))
    if isinstance(kind, T.StructType):
        inner = F.struct(*[_rounded(c[f.name], f.dataType, digits).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), inner)
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _k, x: _rounded(x, kind.valueType, digits))
    return c


def round_floats(df: DataFrame, digits: int = 3) -> DataFrame:
    """Round every floating number, at any depth."""
    return df.select(*[_rounded(F.col(f.name), f.dataType, digits).alias(f.name) for f in df.schema.fields])


def full_report(matches: DataFrame) -> DataFrame:
    return round_floats(matches.select(*FULL_COLUMNS))


def short_report(matches: DataFrame, top_n: int = 3) -> DataFrame:
    """First ``top_n`` matches of each scene theme, by rank."""
    order = Window.partitionBy("scene_query_id").orderBy("rank_position", "track_query_id")
    rows = matches.withColumn("row", F.row_number().over(order)).filter(F.col("row") <= top_n)
    return round_floats(rows.select(*SHORT_COLUMNS))


def report_order(matches: DataFrame) -> DataFrame:
    """Grouped by (episode, scene, theme, title), then rank."""
    return matches.orderBy(
        "episode_nr", "scene_nr", "theme_nr", F.coalesce("scene_theme_title_en", F.lit("")),
        "rank_position", "track_query_id",
    )


def grouped_report(matches: DataFrame) -> DataFrame:
    """One row per (episode, scene, theme, title) with its matches by rank.

    A group holds at most the matches kept per scene theme.
    """
    title = F.coalesce("scene_theme_title_en", F.lit(""))
    rows = matches.groupBy("episode_nr", "scene_nr", "theme_nr", title.alias("scene_theme_title_en")).agg(
        F.array_sort(
            F.collect_list(
                F.struct("rank_position", "track_query_id", "track_filename", "track_semantic_title_en", "final_score")
            )
        ).alias("matches")
    )
    return rows.orderBy("episode_nr", "scene_nr", "theme_nr", "scene_theme_title_en")


def _plain(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").when(~c, "False").otherwise("None")
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.concat_ws(", ", c.cast("array<string>")), F.lit("None"))
    return F.coalesce(c.cast("string"), F.lit("None"))


def field_text(c: Column, kind: T.DataType) -> Column:
    """Lines of a value: a struct gives ``key: a, b`` lines, a list one line per item, NULL ``-``."""
    if isinstance(kind, T.StructType):
        lines = [F.concat(F.lit(f"{f.name}: "), _plain(c[f.name], f.dataType)) for f in kind.fields]
        return F.when(c.isNull(), "-").otherwise(F.concat_ws("\n", *lines))
    if isinstance(kind, T.ArrayType):
        return F.when(c.isNull(), "-").otherwise(F.concat_ws("\n", c.cast("array<string>")))
    return F.coalesce(c.cast("string"), F.lit("-"))


def field_lines(records: DataFrame, key: str = "id") -> DataFrame:
    """(key, field_no, field, value) of scene records, in field order."""
    kinds = {f.name: f.dataType for f in records.schema.fields}
    cells = [
        F.struct(F.lit(no).alias("field_no"), F.lit(name).alias("field"), field_text(F.col(name), kinds[name]).alias("value"))
        for no, name in enumerate(RECORD_FIELDS, start=1)
        if name in kinds
    ]
    return records.select(key, F.inline(F.array(*cells)))


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a flat report as CSV with a header, or as Parquet."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.parquet(path)
