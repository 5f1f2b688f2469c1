"""Tag selection for a track.

A track's tag scores are one array in its row, at most one entry per tag of
the taxonomy. Every rule works inside that row, so tag work needs no shuffle
however many tracks there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuematch import fixed_values as fv
from cuematch.functions.arrays import quoted

SCORES = "array<struct<tag_no:int,category:string,name:string,score:double>>"


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; ``use`` returns any column."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _ranked(rows: Column) -> Column:
    """Rows by score descending, ties in taxonomy order."""
    keyed = F.transform(
        rows,
        lambda r: F.struct(
            (-r["score"]).alias("minus"), r["tag_no"].alias("tag_no"),
            r["category"].alias("category"), r["name"].alias("name"), r["score"].alias("score"),
        ),
    )
    return F.transform(
        F.array_sort(keyed),
        lambda r: F.struct(
            r["tag_no"].alias("tag_no"), r["category"].alias("category"),
            r["name"].alias("name"), r["score"].alias("score"),
        ),
    )


def _rule(values) -> str:
    top_k, threshold, margin, required = values
    return (
        f"named_struct('top_k', {top_k}, 'threshold', double({threshold!r}), "
        f"'margin', double({margin!r}), 'required', {required})"
    )


def rule_of(category: Column) -> Column:
    """Selection rule of a category; unknown categories get the default rule."""
    entries = [f"{quoted(name)}, {_rule(values)}" for name, values in fv.CATEGORY_RULES.items()]
    return F.coalesce(
        F.try_element_at(F.expr(f"map({', '.join(entries)})"), category), F.expr(_rule(fv.DEFAULT_RULE))
    )


def _keep(rows: Column, rule: Column) -> Column:
    def wanted(row: Column, i: Column) -> Column:
        following = F.coalesce(F.get(rows, i + 1)["score"], F.lit(-1.0))
        return (row["score"] >= rule["threshold"]) & (
            (row["score"] - following >= rule["margin"])
            | (i < rule["required"])
            | (row["score"] >= rule["threshold"] + F.lit(fv.SURE_BONUS))
        )

    kept = F.filter(F.slice(rows, 1, rule["top_k"]), wanted)
    best = F.slice(rows, 1, 1)
    near = (rule["required"] > 0) & (
        F.get(rows, F.lit(0))["score"] >= rule["threshold"] - F.lit(fv.FALLBACK_SLACK)
    )
    return bind(kept, lambda k: F.when((F.size(k) == 0) & F.coalesce(near, F.lit(False)), best).otherwise(k))


def select_tags(scores: Column) -> Column:
    """Selected tags of a track, by score descending.

    Within each category the best ``top_k`` are kept when they reach the
    threshold and also stand clear of the next, are required, or are high.
    """
    ordered = _ranked(scores)

    def per_category(rows: Column) -> Column:
        categories = F.array_distinct(F.transform(rows, lambda r: r["category"]))
        return F.flatten(
            F.transform(
                categories,
                lambda c: bind(
                    F.struct(
                        F.filter(rows, lambda r: r["category"] == c).alias("rows"),
                        rule_of(c).alias("rule"),
                    ),
                    lambda x: _keep(x["rows"], x["rule"]),
                ),
            )
        )

    return _ranked(bind(ordered, per_category))


def pack_scores(rows: DataFrame, key: str) -> DataFrame:
    """(key, tag_no, category, name, score) rows to one array per key.

    A key holds at most one row per tag of the taxonomy.
    """
    entry = F.struct(
        F.col("tag_no").cast("int").alias("tag_no"), "category", "name",
        F.col("score").cast("double").alias("score"),
    )
    return rows.groupBy(key).agg(F.collect_list(entry).alias("tag_scores"))


def score_lookup(selected: Column) -> Column:
    """MAP name -> score; a name selected in two categories keeps the lower score."""
    names = F.array_distinct(F.transform(selected, lambda r: r["name"]))
    return F.map_from_arrays(
        names,
        F.transform(
            names,
            lambda n: F.array_min(
                F.transform(F.filter(selected, lambda r: r["name"] == n), lambda r: r["score"])
            ),
        ),
    )


def names_of(selected: Column, n: int | None = None) -> Column:
    names = F.transform(selected, lambda r: r["name"])
    return names if n is None else F.slice(names, 1, n)


def names_in(selected: Column, category: str, n: int) -> Column:
    """Best ``n`` selected names of one category."""
    return names_of(F.filter(selected, lambda r: r["category"] == category), n)
