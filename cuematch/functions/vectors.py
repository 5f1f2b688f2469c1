"""Vector expressions over ARRAY columns. All arithmetic is in double."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

ZERO = 0.0


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def is_filled(v: Column) -> Column:
    """True for a vector that is neither NULL nor empty."""
    return F.coalesce(F.size(v) > 0, F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(ZERO), lambda s, x: s + x
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(ZERO), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine; 0 for a missing or empty vector, unequal lengths or a zero norm.

    Pass norms computed once per row when one vector meets many others.
    """
    na = norm(a) if norm_a is None else norm_a
    nb = norm(b) if norm_b is None else norm_b
    usable = is_filled(a) & is_filled(b) & (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return F.when(usable, dot(a, b) / (na * nb)).otherwise(F.lit(ZERO))


@F.arrow_udf(DoubleType())
def dot_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    """Dot products of two list columns, batch by batch."""
    la = np.asarray(a.value_lengths().fill_null(0), dtype=np.int64)
    lb = np.asarray(b.value_lengths().fill_null(0), dtype=np.int64)
    usable = (la == lb) & (la > 0)
    out = np.zeros(len(la))
    if usable.any():
        keep = pa.array(usable)
        x = np.asarray(a.filter(keep).flatten(), dtype=np.float64)
        y = np.asarray(b.filter(keep).flatten(), dtype=np.float64)
        starts = np.concatenate([[0], np.cumsum(la[usable])[:-1]])
        out[usable] = np.add.reduceat(x * y, starts)
    return pa.array(out)


def cosine_batch(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """:func:`cosine` with the products computed in Arrow batches.

    Array expressions run element by element in the JVM; for many pairs of
    long vectors the batch form is several times faster.
    """
    scale = norm_a * norm_b
    return F.when(scale > 0, dot_batch(a, b) / scale).otherwise(F.lit(ZERO))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; NULL when either vector is NULL."""
    return F.when(a.isNotNull() & b.isNotNull(), F.lit(1.0) - cosine(a, b))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    d = doubles(v)
    # The norm is bound once as an array element, so it is not recomputed per item.
    return F.flatten(
        F.transform(
            F.array(norm(d)),
            lambda n: F.when(n > 0, F.transform(d, lambda x: x / n)).otherwise(d),
        )
    )


def weighted_average(vectors: Sequence[Column], weights: Sequence[float], unit: bool = True) -> Column:
    """Sum of w*v over the weight total, made a unit vector unless ``unit`` is False.

    The row fails when vectors are missing or of unequal length.
    """
    if not vectors:
        raise ValueError("no vectors given")
    if len(vectors) != len(weights):
        raise ValueError(f"{len(vectors)} vectors but {len(weights)} weights")
    total = float(sum(weights))
    if total == 0.0:
        raise ValueError("weights sum to zero")
    first = vectors[0]
    same = F.lit(True)
    for other in vectors[1:]:
        same = same & F.coalesce(F.size(first) == F.size(other), F.lit(False))
    def add(total: Column, v: Column, w: float) -> Column:
        return F.zip_with(total, doubles(v), lambda s, x: s + x * F.lit(float(w)))

    scaled = F.transform(doubles(first), lambda x: x * F.lit(float(weights[0])))
    for v, w in zip(vectors[1:], weights[1:]):
        scaled = add(scaled, v, w)
    mean = F.transform(scaled, lambda x: x / F.lit(total))
    checked = F.when(is_filled(first) & same, mean).otherwise(
        F.raise_error(F.lit("vectors to average are missing or differ in length"))
    )
    return l2_normalize(checked) if unit else checked


def decode_vector(text: Column) -> Column:
    """``"[0.1, 0.2]"`` or ``"(0.1, 0.2)"`` to ARRAY<FLOAT>; NULL or blank gives []."""
    parts = F.split(F.regexp_replace(text, r"^[\s\[\(]+|[\s\]\)]+$", ""), ",")
    kept = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda x: x != "")
    return F.coalesce(kept.cast("array<float>"), F.array().cast("array<float>"))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(ZERO), F.least(F.lit(1.0), x))
