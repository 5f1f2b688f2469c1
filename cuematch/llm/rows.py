"""Whole rows of any table as one value and one hash, whatever its columns are called or hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def unhashed(kind: DataType) -> bool:
    """Whether the type holds maps or variants, which Spark neither hashes nor sorts."""
    return any(x in kind.simpleString() for x in ("map<", "variant"))


def columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def row_hash(docs: DataFrame) -> Column:
    """Hash of all columns; columns with maps or variants count by their JSON text."""
    whole = {"ignoreNullFields": "false"}
    each = zip(columns(docs), docs.schema.fields, strict=True)
    return F.xxhash64(*[F.to_json(F.struct(c.alias("c")), whole) if unhashed(f.dataType) else c for c, f in each])


def packed(docs: DataFrame) -> DataFrame:
    """(row, doc): the hash of each row and all its columns in a struct, beside which any helper column is safe."""
    return docs.select(row_hash(docs).alias("row"), F.struct(*columns(docs)).alias("doc"))
