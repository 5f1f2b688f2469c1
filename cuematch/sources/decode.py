"""Stored text forms of nested values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuematch.functions.vectors import decode_vector


def decode_object(text: Column, schema: T.StructType) -> Column:
    """JSON object text to a struct; NULL gives a struct of NULLs."""
    return F.from_json(F.coalesce(text, F.lit("{}")), schema)


def is_object(text: Column) -> Column:
    """NULL counts as an empty object; other text must parse and hold an object."""
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(parsed)
    return text.isNull() | F.coalesce(parsed.isNotNull() & F.startswith(kind, F.lit("OBJECT")), F.lit(False))


def encode(value: Column) -> Column:
    return F.to_json(value)


def decode_rows(
    df: DataFrame, objects: dict[str, T.StructType], vectors: list[str] = []
) -> tuple[DataFrame, DataFrame]:
    """Decode text columns of stored rows; returns (rows, rejects).

    A row with a column that holds no object goes to the rejects, with the
    names of those columns.
    """
    bad = F.array_compact(F.array(*[F.when(~is_object(F.col(c)), c) for c in objects]))
    marked = df.withColumn("bad_columns", bad)
    good = marked.filter(F.size("bad_columns") == 0).drop("bad_columns")
    for name, schema in objects.items():
        good = good.withColumn(name, decode_object(F.col(name), schema))
    for name in vectors:
        good = good.withColumn(name, decode_vector(F.col(name)))
    return good, marked.filter(F.size("bad_columns") > 0)
