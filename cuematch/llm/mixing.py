"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each source has a target number of words; a unit (a document) should be copied
target / size of its source times. The whole part is certain. The rest, a
probability times the unit's words, is a mass. A group of units is folded in a
fixed order: the open unit meets the next one, mass moves from one to the other,
in a direction drawn so that the expectation stays, until one of the two is
empty or full. Then that unit is decided and the other one stays open. Each
group passes its open unit on, groups of open units are folded in the same way,
and so on up a tree until one is left per source, which is rounded to the nearer
side. Words move from unit to unit and never get lost, so a source misses its
target by at most half a unit.

Groups are hash buckets of about ``fan_in`` units, so a source of any size is
just more groups. Rows that are equal in all columns are one unit with a count.
Draws are hashes of the units, so a rerun gives the same result.

Nulls: a null text has size 0 and takes no words; a null source is a source of
its own, last in order; a null doc_id is kept. An empty table gives no rows.
Columns of the input may have any name and type: they travel inside one struct.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuematch.llm.rows import unhashed
from cuematch.plans.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """Per source: source_size, target; ``sizes`` has one row per source (source, source_size, ...).

    Weights repeat over the sources by code point, null last. Targets share all
    words; none exceeds ``most`` times its source, and what is above is shared
    again by weight. Sources in order of cap per weight become capped one after
    the other, so running sums find the cut.
    """
    everything = Window.partitionBy(F.lit(1))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    table = sizes.withColumn("_w", w).withColumn("_cap", cap)
    before = everything.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total, weight = F.sum("source_size").over(everything), F.sum("_w").over(everything)
    table = table.withColumn("_left", total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn(
        "_share", weight - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    table = table.withColumn("_full", F.col("_w") * F.col("_left") / F.col("_share") >= F.col("_cap"))
    left = total - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everything), F.lit(0.0))
    share = weight - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_w"))).over(everything), F.lit(0.0))
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * left / share)
    return table.withColumn("target", target).drop("_w", "_cap", "_left", "_share", "_full")


def _draw(a: Column, b: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(a, b, F.lit(seed)), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def _fold(units: Column, seed: int) -> Column:
    """One group folded: struct(open: struct(i, size, mass, key), done: array of struct(i, extra))."""
    start = F.struct(
        F.lit(-1).alias("i"), F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("mass"), F.lit(0).cast("long").alias("key"),
        F.array().cast("array<struct<i:int,extra:int>>").alias("done"),
    )

    def step(s: Column, b: Column) -> Column:
        total = s["mass"] + b["mass"]
        to_open, to_next = F.least(s["size"] - s["mass"], b["mass"]), F.least(s["mass"], b["size"] - b["mass"])
        give = _draw(s["key"], b["key"], seed) * (to_open + to_next) < to_next  # mass goes to the open unit
        full_open = s["size"] - s["mass"] <= b["mass"]
        empty_open = s["mass"] <= b["size"] - b["mass"]
        open_goes = F.when(give, full_open).otherwise(empty_open)
        decided = F.when(open_goes, s["i"]).otherwise(b["i"])
        extra = F.when(give, F.when(full_open, 1).otherwise(0)).otherwise(F.when(empty_open, 0).otherwise(1))
        mass = F.when(give, F.when(full_open, total - s["size"]).otherwise(total)).otherwise(
            F.when(empty_open, total).otherwise(total - b["size"])
        )
        first = s["i"] < 0
        pick = first | open_goes
        return F.struct(
            F.when(pick, b["i"]).otherwise(s["i"]).alias("i"),
            F.when(pick, b["size"]).otherwise(s["size"]).alias("size"),
            F.when(first, b["mass"]).otherwise(F.greatest(mass, F.lit(0.0))).alias("mass"),
            F.when(pick, b["key"]).otherwise(s["key"]).alias("key"),
            F.when(first, s["done"]).otherwise(
                F.concat(s["done"], F.array(F.struct(decided.alias("i"), extra.cast("int").alias("extra"))))
            ).alias("done"),
        )

    return F.aggregate(F.transform(units, lambda u, i: F.struct(i.alias("i"), u["size"], u["mass"], u["key"])), start, step)


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    most: float = 3.0,
    size: Column | None = None,
    fan_in: int = 32,
    seed: int = 7,
) -> DataFrame:
    """The rows of ``docs`` as struct ``row``, with size, source_size, target and copies (0 to ``most``).

    ``size`` is a row's weight in words, by default the words of ``text``;
    ``source`` names the source. Rows of size 0 get the whole part of the
    source's factor.
    """
    size = word_count(F.col("text")) if size is None else size
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), size.alias("size"), F.col("source").alias("source"))
    units = rows.groupBy("row", "size", "source").agg(F.count(F.lit(1)).alias("n"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    plan = materialize(targets(sizes, weights, most), "targets")
    wide = plan.agg(F.max(F.ceil(F.col("rows") / F.lit(fan_in)))).first()[0] or 1
    levels = 1 + max(0, math.ceil(math.log(max(int(wide), 1), fan_in) - 1e-9))

    plan = plan.select(F.col("source").alias("_s"), "source_size", "target", F.ceil(F.col("rows") / F.lit(fan_in)).alias("_groups"))
    joined = units.join(plan, units["source"].eqNullSafe(plan["_s"])).drop("_s")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("n")).otherwise(F.lit(0.0))
    whole = F.floor(F.col("_wanted") + F.lit(1e-12))
    maps = unhashed(docs.schema)
    key = F.xxhash64(F.to_json("row", {"ignoreNullFields": "false"}) if maps else "row", F.lit(seed))
    by_key = [lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)] if maps else []
    open_ = joined.withColumn("_wanted", wanted).select(
        "source", "size", F.struct("row", "source_size", "target", "n", whole.alias("base")).alias("unit"), key.alias("key"),
        F.when(F.col("size") > 0, F.greatest(F.col("_wanted") - whole, F.lit(0.0)) * F.col("size")).otherwise(F.lit(0.0)).alias("mass"),
        F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.col("_groups")).alias("group"),
    )
    decided = []
    for level in range(levels):
        folded = open_.groupBy("source", "group").agg(
            F.array_sort(F.collect_list(F.struct("key", "size", "mass", "unit")), *by_key).alias("units")
        )
        folded = folded.withColumn("fold", _fold(F.col("units"), seed + 2 + level))
        folded = materialize(folded, f"folded{level}")
        done = folded.select("units", F.explode("fold.done").alias("d"))
        decided.append(done.select(F.element_at("units", F.col("d.i") + 1).alias("u"), F.col("d.extra").alias("extra")))
        last = F.element_at("units", F.col("fold.i") + 1)
        open_ = folded.select(
            "source", F.col("fold.size").alias("size"), last["unit"].alias("unit"), F.col("fold.key").alias("key"),
            F.col("fold.mass").alias("mass"), F.floor(F.col("group") / F.lit(fan_in)).alias("group"),
        )
    nearer = (F.col("size") < F.col("mass") * 2).cast("int")
    decided.append(open_.select(F.struct("key", "size", "mass", "unit").alias("u"), nearer.alias("extra")))
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    out = out.select("u.size", "u.unit.*", "extra").withColumn("_total", F.col("base") + F.col("extra"))
    out = out.withColumn("_j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = F.floor(F.col("_total") / F.col("n")) + F.when(F.col("_j") <= F.pmod("_total", "n"), 1).otherwise(0)
    return out.select("row", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is copied."""
    taken = mix(docs, **options).where("copies > 0")
    return taken.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
