from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuematch.llm import prefix_forest, vector_dedup
from tests.llm import cases

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n: int = 260) -> list[tuple]:
    rng = np.random.default_rng(6)
    base = rng.normal(size=(n, 24))
    for i in range(60, 110):  # a tight group, and chains of a looser one
        base[i] = base[60] + rng.normal(0, 0.02, 24)
    for i in range(110, 140):
        base[i] = base[i - 1] + rng.normal(0, 0.27, 24)
    base[150:180] = base[150]
    base[180] = base[150] * 7.5
    rows = [(i, base[i].astype(np.float32).tolist(), i % 3) for i in range(n)]
    odd = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0], [1e30] * 24, [1e-30] * 24, [-0.0] * 24]
    rows += [(1000 + 100 * i, v, 0) for i, v in enumerate(odd)]
    rows += [(None, rows[150][1], 0), rows[5], rows[5], (None, rng.normal(size=24).tolist(), 1)]
    return rows


def valid(v) -> np.ndarray | None:
    if not v or None in v:
        return None
    x = np.array(v, np.float32).astype(float)
    return x if np.isfinite(x).all() and x.any() else None


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(c) for c in cases.CLASHING})


def test_links_and_components_equal_brute_force(spark):
    rows = vectors()
    good = [valid(r[1]) for r in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and good[i] is not None and good[j] is not None and len(good[i]) == len(good[j]):
                a, b = (x / np.abs(x).max() for x in (good[i], good[j]))
                link[i, j] = a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.95
    label = np.arange(n)
    for _ in range(n):
        for i in range(n):
            label[i] = min([label[i], *label[link[i]]])
    want = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        first = min(ids) if ids else None
        want.append((rows[i][0], int(link[i].sum()), first, first is None or rows[i][0] == first))
    out = vector_dedup.near_duplicates(table(spark, rows), recall=0.9999)
    assert cases.ordered(out.select("vec_id", "n_links", "component_id", "kept").collect()) == cases.ordered(want)


def test_collision_rates_are_as_planned():
    rng = np.random.default_rng(7)
    for cosine in (0.95, 0.0):
        x = rng.normal(size=(20_000, 16))
        x /= np.linalg.norm(x, axis=1)[:, None]
        y = rng.normal(size=x.shape)
        y -= (x * y).sum(1)[:, None] * x
        y = cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1)[:, None]
        same = (vector_dedup._hashed(x, 1, 1, 2.0, 3) == vector_dedup._hashed(y, 1, 1, 2.0, 3)).mean()
        rates = [(vector_dedup._hashed(x, 8, 1, 2.0, s) == vector_dedup._hashed(y, 8, 1, 2.0, s)).mean() for s in range(8)]
        assert np.mean([same, *rates]) == pytest.approx(vector_dedup.collision(np.sqrt(2 - 2 * cosine)), abs=0.03)


def brute_nearest(rows, k=10):
    cand = [(r[0], x) for r in rows if r[0] is not None and (x := valid(r[1])) is not None]
    out = {}
    for q, x in cand:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in cand if i != q and len(y) == len(x))
            out[q] = near[:k]
    return out


@pytest.mark.parametrize("slice_size", [8192, 1])
def test_full_share_is_exact_with_ties(spark, slice_size):
    rows = vectors()
    out = prefix_forest.nearest(table(spark, rows), F.pmod("vec_id", F.lit(100)) == 0, share=1.0, slice_size=slice_size).collect()
    got: dict = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = {q: near for q, near in brute_nearest(rows).items() if near}
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
    assert all(np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=1e-12) for q in got)


def test_recall_on_the_given_table(spark, sf):
    data = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [tuple(r) for r in data.select("vec_id", "embedding", "label").collect()]
    out = prefix_forest.nearest(data, F.pmod("vec_id", F.lit(100)) == 0, least=10).collect()
    want = brute_nearest(rows)
    hits = Counter(r["vec_id"] in {i for _, i in want[r["query_id"]]} for r in out)
    assert hits[True] >= 0.9 * sum(len(x) for x in want.values())


def test_empty_tables(spark):
    assert vector_dedup.near_duplicates(table(spark, [])).collect() == []
    assert prefix_forest.nearest(table(spark, []), F.lit(True)).collect() == []
    alone = table(spark, [(0, [1.0, 2.0], 1)])
    assert prefix_forest.nearest(alone, F.lit(True)).collect() == []


def test_any_number_of_vector_lengths(spark):
    rows = [(i, np.ones(1 + i % 1100).tolist(), 0) for i in range(1110)]
    got = prefix_forest.nearest(table(spark, rows), F.col("vec_id") < 1100).collect()
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in got) == [(i, i + 1100, 0.0) for i in range(10)]
