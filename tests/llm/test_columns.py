"""Contents of a caller's columns, whatever they are called or hold, after the operators that return documents."""

import random

import pytest
from pyspark.sql import functions as F

from cuematch.llm import mixing, ngram_join, quality, secret_scan
from tests.llm import cases

OWN = ["row", "doc", "values", "keep", "text_a", "__row", "__values", "__keep", "a.b", "copies", "source_size"]


def marked(spark):
    """Documents whose other columns say which row they belong to; one with a secret, copies, repeated rows."""
    rng = random.Random(12)
    rows = [(i, cases.prose(rng, 30), "en", f"s{i % 2}", 0) for i in range(24)]
    rows += [(30, rows[3][1], "en", "s1", 0), (31, f"password = 'Zk8#qLw2vX9$' {cases.prose(rng, 30)}", "en", "s1", 0), (32, None, None, None, None), rows[7], rows[7]]
    docs = cases.table(spark, rows, clashing=False)
    mark = lambda c: F.concat(F.lit(c), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    docs = docs.withColumns({c: mark(c) for c in OWN})
    docs = docs.withColumn("map", F.create_map(F.lit("b"), "doc_id", F.lit("a"), F.lit(1).cast("long")))
    return docs.withColumn("deep", F.array(F.struct(F.col("map").alias("m"), F.lit(None).cast("map<string,int>").alias("none"))))


def of_each(rows) -> list[tuple]:
    out = []
    for r in rows:
        assert [r[c] for c in OWN] == [f"{c}/{r['doc_id']}" for c in OWN]
        assert r["map"] == {"a": 1, "b": r["doc_id"]} and r["deep"][0]["m"] == r["map"] and r["deep"][0]["none"] is None
        out.append((r["doc_id"], r["text"]))
    return cases.ordered(out)


@pytest.fixture(scope="module")
def docs(spark):
    return marked(spark)


def test_accepted(spark, docs):
    trusted = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    keep = [(r["doc_id"]) for r in quality.classify(docs, trusted).collect() if r["keep"]]
    out = quality.accepted(docs, trusted)
    assert out.columns == docs.columns and cases.ordered((i,) for i, _ in of_each(out.collect())) == cases.ordered((i,) for i in keep)


def test_deduplicated(docs):
    out = ngram_join.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(i for i, _ in of_each(out.collect())) == [*range(24), 31, 32]


def test_redacted(docs):
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = secret_scan.redacted(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    got = of_each(out.collect())
    assert len(got) == docs.count() and all(t == before[i] for i, t in got if i != 31)


def test_mixed(docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r["row"]["doc_id"]] = taken.get(r["row"]["doc_id"], 0) + r["copies"]
    got = of_each(out.collect())
    assert {i: sum(j == i for j, _ in got) for i in taken} == taken
