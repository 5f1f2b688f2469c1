"""Secrets in texts: wide candidate search, then a random forest that removes false findings.

Everything is DataFrame and SQL functions and Spark's own forest; no Python runs
on the executors.

Candidates are runs of credential characters with a digit (12 characters or
more) or a known prefix, runs behind an assignment (8 or more), and behind the
assignment of a name such as password every quoted value, and every other one up to
a blank or its last sign that is no closing mark, of any characters and length. The text between candidates
gives each one its neighbours on both sides, up to 60 characters.

Features: length, shares of digits, capitals and distinct characters, switches
between character classes, mean log probability of the character transitions
(two symbols at a time, learned from all neighbour texts), share covered by a
dictionary (the most frequent neighbour words), path and address marks around,
and neighbouring words: a name such as token or password in front, in reach, an
assignment, quotes.

Training. The forest learns from labelled findings: columns of ``candidates``
and ``secret`` (0 or 1). ``labelled`` makes such a table from findings that are
sure by form (known prefixes, named assignments of mixed strings; plain numbers,
addresses, path parts, numbers with separators); the names that a label rests on
are blanked in part of the rows, so that the forest weighs the value as well. At
most ``most`` different labelled values, chosen by hash, are used for the fit.

Nulls and edges: a null or empty text has no candidates. A null doc_id is kept.
Rows that repeat give their findings each. With only one label in the labelled
findings there is no forest, and the score is that of the rule (0.5 where it is
silent). An empty table gives no rows. Other columns are untouched.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuematch.llm.rows import packed, row_hash
from cuematch.plans.storage import materialize

_RUN = r"[A-Za-z0-9+/_\-]"
_KINDS = r"AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|npm_|pypi-|hf_|eyJ"
NAMES = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|bearer|credentials?"
_SCHEME = r"(?:(?:bearer|basic|token)\s{1,8})?"
_BEHIND_NAME = rf"""(?<=[\s"'=:>])(?<=(?i:(?:{NAMES})[A-Za-z_\-]{{0,24}}["']?\s{{0,8}}(?::=|=>|=|:)\s{{0,8}}{_SCHEME}["']?))"""
_VALUE = r"""(?:(?<=")[^"\r\n]+(?=")|(?<=')[^'\r\n]+(?=')|(?!(?i:bearer|basic|token)\s)[^\s"'=:>](?:\S*[^\s"',;.)\]}>])?)"""
CANDIDATE = rf"""{_BEHIND_NAME}{_VALUE}|(?<=[=:][ ]?["']?)(?!//){_RUN}{{8,}}|(?<!{_RUN})(?:(?=[A-Za-z+/_\-]*+[0-9]){_RUN}{{12,}}|(?:{_KINDS}){_RUN}{{12,}})"""
NAMED = rf"(?i)(?:{NAMES})[A-Za-z_\-]*[\"']?\s*(?:=|:|:=|=>)\s*{_SCHEME}[\"']?$"
PREFIXES = rf"^(?:{_KINDS}){_RUN}{{12,}}$"
_SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789"
_N = len(_SYMBOLS) + 1
MASK = "<secret>"
_SEND = 1_000_000
FEATURES = [
    "f_length", "f_digits", "f_capitals", "f_distinct", "f_switches", "f_transitions", "f_words", "f_hex",
    "f_path", "f_address", "f_named", "f_near", "f_assigned", "f_quoted",
]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of all columns), number, begin (characters before it), value, before, after of every candidate."""
    row = row_hash(docs)
    found = docs.select("doc_id", row.alias("row"), "text").where(F.col("text").rlike(CANDIDATE))
    found = found.select(
        "doc_id", "row", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("values"), F.split("text", CANDIDATE, -1).alias("gaps")
    )
    gap = F.col("gaps")
    wide = F.transform("values", lambda v, i: F.struct(
        v.alias("value"),
        F.substring(gap[i], F.greatest(F.length(gap[i]) - 59, F.lit(1)), F.lit(60)).alias("before"),
        F.substring(gap[i + 1], F.lit(1), F.lit(60)).alias("after"),
        (F.length(gap[i]) + F.lit(0)).alias("gap"),
    ))
    one = found.select("doc_id", "row", F.posexplode(_with_begin(wide)).alias("number", "c"))
    return one.select("doc_id", "row", "number", "c.begin", "c.value", "c.before", "c.after")


def _with_begin(wide: Column) -> Column:
    """Adds the running character offset to each candidate; blocks keep the running array short."""
    item_type = "struct<value:string,before:string,after:string,begin:long>"
    start = F.struct(
        F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{item_type}>").alias("block"), F.array().cast(f"array<array<{item_type}>>").alias("blocks")
    )

    def step(s: Column, c: Column) -> Column:
        begin = s["at"] + c["gap"]
        item = F.struct(c["value"].alias("value"), c["before"].alias("before"), c["after"].alias("after"), begin.alias("begin"))
        full = F.size(s["block"]) >= 64
        return F.struct(
            (begin + F.length(c["value"])).alias("at"),
            F.when(full, F.array(item)).otherwise(F.concat(s["block"], F.array(item))).alias("block"),
            F.when(full, F.concat(s["blocks"], F.array(s["block"]))).otherwise(s["blocks"]).alias("blocks"),
        )

    return F.aggregate(wide, start, step, lambda s: F.flatten(F.concat(s["blocks"], F.array(s["block"]))))


def _share(count: Column, value: Column) -> Column:
    return count / F.length(value)


def _code(text: Column, at: Column) -> Column:
    return F.instr(F.lit(_SYMBOLS), F.lower(F.substring(text, at, F.lit(1))))


def _pairs(text: Column) -> Column:
    """Codes of the text's transitions, 0 to n * n - 1; any other character is symbol 0."""
    at = F.sequence(F.lit(1), F.length(text) - 1)
    return F.when(F.length(text) < 2, F.array().cast("array<int>")).otherwise(
        F.transform(at, lambda i: _code(text, i) * F.lit(_N) + _code(text, i + 1))
    )


def transitions(found: DataFrame) -> list[float]:
    """log2 probability of each symbol after each other, over all neighbour texts; n * n numbers."""
    words = F.regexp_replace(F.concat_ws(" ", "before", "after"), r"[^\p{L}\p{N} ]", " ")
    counts = found.select(F.explode(_pairs(words)).alias("p")).groupBy("p").count().collect()  # at most n * n rows
    table = [1.0] * (_N * _N)
    for r in counts:
        table[r["p"]] += r["count"]
    return [math.log2(table[i] / sum(table[i // _N * _N : (i // _N + 1) * _N])) for i in range(_N * _N)]


def dictionary(found: DataFrame, most: int = 400) -> list[str]:
    """The most frequent neighbour words of four letters or more."""
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", "before", "after")), F.lit(r"\p{L}{4,}"), F.lit(0))
    top = found.select(F.explode(words).alias("w")).groupBy("w").count().orderBy(F.col("count").desc(), "w").limit(most)
    return [r["w"] for r in top.collect()]


def features(found: DataFrame, table: list[float], words: list[str]) -> DataFrame:
    """The candidates with the columns FEATURES."""
    v, before, after = F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    logs = F.array(*[F.lit(float(x)) for x in table])
    pairs = _pairs(v)
    mean = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.element_at(logs, p + 1)) / F.greatest(F.size(pairs), F.lit(1))
    known = F.length(v) - F.length(F.regexp_replace(F.lower(v), "|".join(words), "")) if words else F.lit(0)
    switches = F.regexp_count(v, F.lit("[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])"))
    flag = lambda c: c.cast("double")
    return found.withColumns({
        "f_length": F.log2(F.length(v)),
        "f_digits": _share(F.regexp_count(v, F.lit("[0-9]")), v),
        "f_capitals": _share(F.regexp_count(v, F.lit("[A-Z]")), v),
        "f_distinct": _share(F.size(F.array_distinct(F.split(F.substring(v, 1, 256), ""))), F.substring(v, 1, 256)),
        "f_switches": _share(switches, v),
        "f_transitions": mean,
        "f_words": _share(known, v),
        "f_hex": flag(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & v.rlike("[a-fA-F]")),
        "f_path": flag(v.contains("/") | before.rlike(r"[/\\]$") | after.rlike(r"^[/\\]")),
        "f_address": flag(before.rlike(r"[@.]$") | after.rlike(r"^[@.:][A-Za-z0-9]")),
        "f_named": flag(before.rlike(NAMED)),
        "f_near": flag(before.rlike(rf"(?i)(?<![A-Za-z])(?:{NAMES})(?![a-z])")),
        "f_assigned": flag(before.rlike(r"[=:]\s*[\"']?$")),
        "f_quoted": flag(before.rlike(r"[\"']$") & after.rlike(r"^[\"']")),
    })


def labelled(found: DataFrame) -> DataFrame:
    """Candidates that are sure by form, with ``secret`` 1 or 0; a third of the named ones without their name."""
    v, before, after = F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    mixed = v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.length(v) >= 6) & ~v.contains("/")
    prose = v.rlike(r"^\p{L}\p{Ll}*$") & before.rlike(r":\s*$") & after.rlike(r"^[,;.]?\s+\p{Ll}+[\s,.]") & ~before.rlike(r"(?i)(?:bearer|basic|token)\s+$")
    sure = v.rlike(PREFIXES) | (before.rlike(NAMED) & mixed)
    number = v.rlike(r"^[0-9+/_\-]+$")
    address = before.rlike(r"[@.]$") | after.rlike(r"^@[A-Za-z0-9]") | before.rlike(r"[/\\]$")
    plain = v.rlike(r"^[A-Za-z\-]+$") & ~before.rlike(NAMED)
    path = v.rlike(r"^[A-Za-z0-9_\-]*(?:/[a-z0-9_\-]*)+$") & ~before.rlike(NAMED)
    out = found.withColumn("secret", F.when(sure, 1).when(number | address | plain | path | prose, 0)).where("secret is not null")
    blank = before.rlike(NAMED) & (F.pmod(F.xxhash64("value", F.lit(5)), F.lit(3)) == 0)
    return out.withColumn("before", F.when(blank, F.regexp_replace("before", rf"(?i)(?:{NAMES})", "value")).otherwise(F.col("before")))


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def train(labels: DataFrame, table: list[float], words: list[str], most: int = 20_000, trees: int = 30, depth: int = 8, seed: int = 3) -> RandomForestClassificationModel | None:
    """A forest over at most ``most`` different labelled values; None if one of the labels is missing."""
    chosen = labels.dropDuplicates(["value"]).orderBy(F.xxhash64("value", F.lit(seed)), "value").limit(most)
    rows = materialize(_assembled(features(chosen, table, words)).select("features", F.col("secret").cast("double").alias("label")), "findings")
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=2, subsamplingRate=0.8, seed=seed)
    return forest.fit(rows)


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, most: int = 20_000) -> DataFrame:
    """Every candidate: doc_id, row, number, begin, value, score, secret (score at or above ``threshold``).

    ``findings``: labelled findings (value, before, after, secret); by default
    those of these documents that are sure by form.
    """
    found = materialize(candidates(docs), "candidates")
    table, words = transitions(found), dictionary(found)
    labels = labelled(found) if findings is None else findings
    model = train(labels.select("value", "before", "after", "secret"), table, words, most)
    if model is None:
        sure = labelled(found).select("row", "number", "secret").dropDuplicates(["row", "number"])
        rows = found.join(sure, ["row", "number"], "left")
        score = F.coalesce(F.col("secret").cast("double"), F.lit(0.5))
    else:
        rows = model.transform(_assembled(features(found, table, words)))
        score = vector_to_array("probability")[1]
    return rows.select("doc_id", "row", "number", "begin", "value", score.alias("score")).withColumn("secret", F.col("score") >= threshold)


def _masked(text: Column, value: Column) -> Column:
    """MASK for the value; a short one only where it is no part of a longer word."""
    alone = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), value, F.lit(r"\E(?![\p{L}\p{N}])"))
    short = (F.length(value) < 8) & ~value.contains("\\E")
    return F.when(short, F.regexp_replace(text, alone, F.lit(MASK))).otherwise(F.replace(text, value, F.lit(MASK)))


def redacted(docs: DataFrame, **options) -> DataFrame:
    """All documents, secrets replaced by MASK; ``n_chars``, where there is one, counts the new text."""
    secrets = scan(docs, **options).where("secret").groupBy("row").agg(F.collect_set("value").alias("values"))
    secrets = materialize(secrets, "secrets")
    send = F.broadcast if secrets.count() <= _SEND // 10 else (lambda x: x)
    longest = F.array_sort("values", lambda a, b: F.length(b) - F.length(a))
    clean = F.when(F.col("values").isNull(), F.col("doc.text")).otherwise(F.aggregate(longest, F.col("doc.text"), _masked))
    out = packed(docs).join(send(secrets), "row", "left").select("doc", "values", clean.alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed = F.when(F.col("values").isNull(), F.col("doc.n_chars")).otherwise(F.length("text"))
        new["n_chars"] = changed.cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
