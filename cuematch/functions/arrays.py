"""Set measures over string arrays, and ordered-scale matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def strings(values: Sequence[str] = ()) -> Column:
    """ARRAY<STRING> literal, built in one call whatever its length."""
    if not values:
        return F.expr("cast(array() as array<string>)")
    return F.expr("array(" + ", ".join(map(quoted, values)) + ")")


def quoted(text: str) -> str:
    """SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def string_lists(table: dict[str, Sequence[str]]) -> Column:
    """MAP<STRING, ARRAY<STRING>> literal."""
    entries = [f"{quoted(k)}, array({', '.join(map(quoted, v))})" for k, v in table.items()]
    return F.expr(f"map({', '.join(entries)})")


def or_empty(c: Column) -> Column:
    """NULL array to an empty one."""
    return F.coalesce(c, strings())


def as_set(c: Column) -> Column:
    return F.array_distinct(or_empty(c))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def share_of_first(a: Column, b: Column) -> Column:
    """|A n B| / |A| of two sets; 0 when A is empty."""
    return F.when(F.size(a) > 0, shared(a, b) / F.size(a)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """|A n B| / |A u B| of two sets; 0 when either is empty."""
    both = (F.size(a) > 0) & (F.size(b) > 0)
    common = shared(a, b)
    return F.when(both, common / (F.size(a) + F.size(b) - common)).otherwise(F.lit(0.0))


def scale_match(a: Column, b: Column, scale: Sequence[str] | None, step: float) -> Column:
    """1 for equal words, less by ``step`` per place between them on the scale, else 0.

    The words must be stripped already; an empty word never matches.
    """
    filled = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    out = F.when(~filled, 0.0).when(a == b, 1.0)
    if scale:
        steps = strings(scale)
        pa, pb = F.array_position(steps, a), F.array_position(steps, b)
        near = F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(step) * F.abs(pa - pb))
        out = out.when((pa > 0) & (pb > 0), near)
    return out.otherwise(0.0)


def top_distinct(c: Column, n: int) -> Column:
    """First ``n`` distinct items in order."""
    return F.slice(F.array_distinct(c), 1, n)


def argmax_label(values: Column, labels: Sequence[str]) -> Column:
    """Label at the first position of the largest value."""
    return F.when(
        F.size(values) == len(labels),
        F.element_at(strings(labels), F.array_position(values, F.array_max(values)).cast("int")),
    )
