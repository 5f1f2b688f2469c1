"""The tag taxonomy as rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuematch import fixed_values as fv
from cuematch.functions.arrays import quoted
from cuematch.functions.text import tag_prompts

_KIND = "map<string, struct<category_pl: string, tags: map<string, string>>>"


def flatten_tags(documents: DataFrame, json_col: str = "value") -> DataFrame:
    """Taxonomy documents (JSON text) to (tag_no, category, category_pl, name, name_pl).

    ``tag_no`` counts tags from 0 in file order, within each document.
    """
    # The number of a tag is its place among all entries, found per document
    # without a window: earlier sizes are summed inside the row.
    whole = documents.select(
        F.transform(
            F.map_entries(F.from_json(json_col, _KIND)), lambda e: F.size(e["value"]["tags"])
        ).alias("sizes"),
        F.map_entries(F.from_json(json_col, _KIND)).alias("categories"),
    )
    exploded = whole.select("sizes", F.posexplode("categories").alias("category_no", "entry")).select(
        F.aggregate(F.slice("sizes", 1, F.col("category_no")), F.lit(0), lambda s, n: s + n).alias("before"),
        F.col("entry.key").alias("category"),
        F.col("entry.value.category_pl").alias("category_pl"),
        F.posexplode(F.map_entries("entry.value.tags")).alias("place", "tag"),
    )
    return exploded.select(
        (F.col("before") + F.col("place")).alias("tag_no"),
        "category",
        "category_pl",
        F.col("tag.key").alias("name"),
        F.col("tag.value").alias("name_pl"),
    )


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """Read a taxonomy file."""
    return flatten_tags(spark.read.text(path, wholetext=True))


def default_tags(spark: SparkSession) -> DataFrame:
    """The built-in taxonomy; its 122 rows are fixed, so it may be broadcast."""
    text = json.dumps(fv.TAXONOMY, ensure_ascii=False)
    return flatten_tags(spark.range(1).select(F.lit(text).alias("value")))


def with_prompts(tags: DataFrame) -> DataFrame:
    return tags.withColumn("prompts", tag_prompts(F.col("category"), F.col("name")))


def tag_rows() -> list[tuple[int, str, str]]:
    """(tag_no, category, name) of the built-in taxonomy."""
    out = []
    for category, data in fv.TAXONOMY.items():
        for name in data["tags"]:
            out.append((len(out), category, name))
    return out


def tag_list() -> Column:
    """The built-in taxonomy as an array literal of (tag_no, category, name)."""
    rows = [
        f"named_struct('tag_no', {no}, 'category', {quoted(category)}, 'name', {quoted(name)})"
        for no, category, name in tag_rows()
    ]
    return F.expr(f"array({', '.join(rows)})")
