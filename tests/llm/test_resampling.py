import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from cuematch.llm import resampling
from tests.llm import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, n):
    words = WORD.findall((text or "").translate(cases.LOWER))
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)], len(words)


def wanted(rows, target, n, buckets, percent, least):
    def counts(texts):
        return Counter(zlib.crc32(r.encode()) % buckets for t in texts for r in runs(t, n)[0])

    s, t = counts(r[1] for r in rows), counts(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    out = []
    for r in rows:
        found, words = runs(r[1], n)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in found)
        u = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(found), words, weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296)))])
    able = sorted((x for x in out if x[2] >= least), key=lambda x: (-x[4], x[0] is not None, x[0] or 0, x[3]))
    drawn = {id(x): i + 1 for i, x in enumerate(able[: percent * len(able) // 100])}
    return [(*x, drawn.get(id(x))) for x in out]


@pytest.mark.parametrize("n,buckets,percent", [(1, 10_000, 10), (3, 50, 60)])
def test_equals_brute_force(spark, n, buckets, percent):
    rng = random.Random(1)
    odd = ["A1b2 \x00\x7f:;", "İstanbul É!x", " \xa0　 ", "a`b{c@d/e", "\U0001f600" * 30, "1 2 3 " * 9]
    rows = cases.documents(copies=10) + [(3000 + i, t, None, None, 1) for i, t in enumerate(odd)]
    target = [None, "", cases.prose(rng, 300), odd[1]]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(cases.table(spark, rows), bench, n, buckets, percent, 20).collect()
    # rows equal in id, score and weight differ in nothing that ranks them: they may change places
    assert cases.ordered(got) == cases.ordered(wanted(rows, target, n, buckets, percent, 20))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30), (2, None)], "doc_id long, text string")
    assert resampling.resample(none, none).collect() == []
    assert [r["rank"] for r in resampling.resample(some, none, percent=100).orderBy("doc_id").collect()] == [1, None]


def test_longer_runs_are_seeded_by_shorter_ones():
    found, words = resampling.features("Ab cd, EF".encode(), 3)
    assert words == 3
    assert found == Counter(map(zlib.crc32, [b"ab", b"cd", b"ef", b"ab cd", b"cd ef", b"ab cd ef"]))
