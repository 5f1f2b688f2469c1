import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuematch.llm import mixing, sharding
from tests.llm import cases


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation_and_its_inverse(n):
    numbers = np.arange(n)
    places = sharding.permuted(numbers, n, key=9)
    assert sorted(places) == list(range(n))
    assert (sharding.unpermuted(places, n, key=9) == numbers).all()
    assert n < 100 or (sharding.permuted(numbers, n, key=10) != places).mean() > 0.9


def test_shards_are_even_and_slots_gapless(spark):
    rows = cases.documents()
    docs = cases.table(spark, rows)
    out = sharding.feistel_shards(docs, 24).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    shards = defaultdict(list)
    for r in out:
        shards[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    sizes = [len(shards[i]) for i in range(24)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.feistel_shards(docs.repartition(7), 24).collect()
    key = lambda r: (r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"])
    assert cases.ordered(map(key, out)) == cases.ordered(map(key, again))
    assert sharding.feistel_shards(cases.table(spark, [])).collect() == []


def expected_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full: set = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3 * sizes[s] for s in full}
        full |= over


def test_mix_meets_its_targets(spark):
    rows = cases.documents() + [(5000, "lonely words here", "en", "a", 1), (5001, None, "en", "zero", 1)]
    docs = cases.table(spark, rows)
    out = mixing.mix(docs, fan_in=4).select("row.doc_id", "row.source", "row.text", "size", "source_size", "target", "copies").collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r[0], r[1]) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(cases.WORD.findall(r[1] or ""))
    want = expected_targets(dict(sizes))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        assert r["size"] == len(cases.WORD.findall(r["text"] or "")) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-9) and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in want)
    again = mixing.mix(docs.repartition(5), fan_in=4).select("row.doc_id", "row.source", "row.text", "size", "source_size", "target", "copies").collect()
    assert cases.ordered(again) == cases.ordered(out)
    mixed = mixing.mixed(docs, fan_in=4)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out)


def test_even_units_are_drawn_evenly(spark):
    rows = [(i, "w", "en", "s", 1) for i in range(400)] + [(1000 + i, "w", "en", "t", 1) for i in range(200)]
    taken = Counter()
    for seed in range(6):
        for r in mixing.mix(cases.table(spark, rows, clashing=False), seed=seed).where("copies > 0").select("row.doc_id").collect():
            taken[r["doc_id"]] += 1
    # source s is taken by half: over six seeds a unit is taken three times on average, rarely never or always
    counts = [taken[i] for i in range(400)]
    assert sum(counts) == 1200 and 0 < sum(c in (0, 6) for c in counts) < 60


def test_empty_and_sizeless_tables(spark):
    assert mixing.mix(cases.table(spark, [])).collect() == []
    out = mixing.mix(cases.table(spark, [(1, None, None, None, 0), (2, " ", None, "s", 0)])).select("row.doc_id", "target", "copies").collect()
    assert cases.ordered(out) == [(1, 0.0, 0), (2, 0.0, 0)]


def test_mix_runs_no_python(spark):
    docs = cases.table(spark, clashing=False)
    plan = mixing.mix(docs.withColumn("size", F.lit(3).cast("long")), size=F.col("size"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
