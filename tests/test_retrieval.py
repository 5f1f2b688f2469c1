import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuematch.operators import retrieval

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.ArrayType(T.FloatType()))])


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def brute(queries, items, k):
    out = {}
    for qid, q in queries:
        if not q:
            continue
        a = np.array(q, dtype=np.float32).astype(float)
        scored = []
        for iid, x in items:
            if x is None:
                scored.append((np.inf, iid))
                continue
            b = np.array(x, dtype=np.float32).astype(float)
            n = np.linalg.norm(a) * np.linalg.norm(b)
            scored.append((round(1 - (a @ b / n if n else 0.0), 9), iid))
        out[qid] = [iid for _d, iid in sorted(scored)[:k]]
    return out


def as_lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["item_id"])
    return out


def clustered(seed, n, dim=6, copies=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = []
    for i in range(n):
        if copies and i % 3 == 0:
            rows.append((i, [1.0] * dim))  # a third of all rows are one vector
        else:
            rows.append((i, [float(x) for x in centres[i % 5] + 0.1 * rng.normal(size=dim)]))
    return rows


@pytest.mark.parametrize("method", ["scan", "slices"])
@pytest.mark.parametrize("k,floors", [(1, False), (7, False), (60, False), (1, True), (7, True), (60, True)])
def test_exact_with_hot_copies_nulls_and_zeros(spark, method, k, floors):
    items = clustered(1, 150, copies=True) + [(900, None), (901, [0.0] * 6), (902, None)]
    queries = clustered(2, 20) + [(500, None), (501, []), (502, [0.0] * 6), (503, [1.0] * 6)]
    got = retrieval.nearest(frame(spark, queries), frame(spark, items), k, "v", method=method, limit_bytes=1200, floors=floors)
    assert as_lists(got) == brute(queries, items, k)


@pytest.mark.parametrize("method", ["scan", "slices"])
def test_more_wanted_than_there_are(spark, method):
    items = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (0, None)]
    queries = [(10, [1.0, 0.0])]
    got = retrieval.nearest(frame(spark, queries), frame(spark, items), 9, "v", method=method, limit_bytes=40)
    assert as_lists(got) == {10: [1, 3, 0, 2]}


@pytest.mark.parametrize("method", ["scan", "slices"])
def test_items_without_direction(spark, method):
    items = [(5, [0.0, 0.0]), (6, None), (2, [0.0, 0.0]), (1, None)]
    got = retrieval.nearest(frame(spark, [(10, [1.0, 0.0])]), frame(spark, items), 3, "v", method=method)
    assert as_lists(got) == {10: [2, 5, 1]}
    only_null = retrieval.nearest(frame(spark, [(10, [1.0, 0.0])]), frame(spark, [(7, None), (3, None)]), 3, "v", method=method)
    assert as_lists(only_null) == {10: [3, 7]}


def test_size_decides_the_method(spark, monkeypatch):
    called = []

    class Stop(Exception):
        pass

    def stop(name):
        def run(*_):
            called.append(name)
            raise Stop

        return run

    monkeypatch.setattr(retrieval, "_scan", stop("scan"))
    monkeypatch.setattr(retrieval, "_sliced_lists", stop("slices"))
    q = frame(spark, clustered(3, 10))
    for limit in (10 * 7 * 8, 10 * 7 * 8 - 1):
        with pytest.raises(Stop):
            retrieval.nearest(q, q, 2, "v", limit_bytes=limit)
    assert called == ["scan", "slices"]


@pytest.mark.parametrize("parts", [1, 5])
def test_vectors_of_unequal_length(spark, parts):
    """Only the rows that differ from a query in length lose their direction, wherever they stand."""
    items = [(0, [1.0]), *clustered(8, 30), (900, [2.0, 1.0]), (901, [])]
    queries = [(1, [0.5, 0.25]), *((100 + i, v) for i, v in clustered(9, 6)), (2, [3.0])]
    want = {}
    for qid, v in queries:
        same = [(i, x if x and len(x) == len(v) else [0.0] * len(v)) for i, x in items]
        want |= brute([(qid, v)], same, 8)
    for method in ("scan", "slices"):
        got = retrieval.nearest(frame(spark, queries, 1), frame(spark, items, parts), 8, "v", method=method, limit_bytes=200)
        assert as_lists(got) == want
    assert as_lists(retrieval.nearest_of_few(frame(spark, queries, 1), frame(spark, items, parts), 8, "v", "v")) == want


def test_many_copies_in_bounded_memory():
    """20,000 copies of one vector of 512 numbers: the task holds k of them for each query."""
    import tracemalloc

    rng = np.random.default_rng(4)
    copy = rng.normal(size=512)
    items = np.tile(copy, (20_000, 1))
    queries = np.concatenate((np.tile(copy, (128, 1)), rng.normal(size=(128, 512))))
    ids = rng.permutation(20_000)
    results = []
    for size in (20_000, 3_000):
        best = retrieval._Nearest(np.arange(256), queries, 30)
        tracemalloc.start()
        for i in range(0, 20_000, size):
            best.add(ids[i : i + size], items[i : i + size], np.zeros(len(items[i : i + size]), bool))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 1 << 30
        results.append(best.result().to_pydict())
    assert results[0] == results[1]
    assert sorted(set(results[0]["item_id"])) == list(range(30))


def test_floors_keep_far_rows_out_of_the_shuffle(spark, monkeypatch):
    """64 tasks, 100 wanted: without floors 64 x 100 rows a query are merged, with them fewer than 2 x 100."""
    items, queries, k = clustered(11, 12_800), clustered(12, 30), 100
    q, x = frame(spark, queries, 2), frame(spark, items, 64)
    sent = []
    merged = retrieval._merged
    monkeypatch.setattr(retrieval, "_merged", lambda found, ks: sent.append(found.count()) or merged(found, ks))
    got = {f: as_lists(retrieval.nearest(q, x, k, "v", floors=f)) for f in (False, True)}
    assert got[True] == got[False] == brute(queries, items, k)
    assert sent[0] == 64 * k * len(queries)
    assert sent[1] < 2 * k * len(queries)


def test_queries_beyond_their_near_bound_fall_back_on_the_sure_one(spark, monkeypatch):
    items, queries = clustered(13, 3000), clustered(14, 25)
    monkeypatch.setattr(retrieval, "_hoped", lambda k: 1)  # far too near for nearly all queries
    q, x = frame(spark, queries, 2), frame(spark, items, 9)
    assert as_lists(retrieval.nearest(q, x, 20, "v", floors=True)) == brute(queries, items, 20)


def test_slices_run_one_after_the_other(spark, monkeypatch):
    """A slice's vectors leave the driver and the tasks before the next slice is collected."""
    events, lists, walked = [], retrieval._lists, retrieval._walked

    def collected(*a):
        out = lists(*a)
        events.append(("collected", sum(len(x[1]) for x in out)))
        return out

    def sent(*a):
        rows, shared = walked(*a)
        monkeypatch.setattr(shared, "destroy", lambda *_: events.append(("destroyed", 0)))
        return rows, shared

    monkeypatch.setattr(retrieval, "_lists", collected)
    monkeypatch.setattr(retrieval, "_walked", sent)
    items, queries = clustered(15, 60), clustered(16, 40)
    got = retrieval.nearest(frame(spark, queries), frame(spark, items), 3, "v", method="slices", limit_bytes=1600)
    assert as_lists(got) == brute(queries, items, 3)
    assert [e for e, _ in events] == ["collected", "destroyed"] * (len(events) // 2) and len(events) >= 6
    assert max(n for _, n in events) < 40


def test_nearest_of_few(spark):
    items, queries = clustered(4, 12), clustered(5, 30)
    got = retrieval.nearest_of_few(frame(spark, queries), frame(spark, items), 4, "v", "v")
    assert as_lists(got) == brute(queries, items, 4)
    beyond = retrieval.nearest_of_few(frame(spark, queries), frame(spark, items), 4, "v", "v", limit_bytes=600)
    assert as_lists(beyond) == brute(queries, items, 4)


def test_union_keeps_order_and_drops_copies(spark):
    def ranked(rows):
        return spark.createDataFrame(
            [(1, item, 0.0, rank) for rank, item in enumerate(rows, 1)], "query_id long, item_id long, distance double, rank int"
        )

    a, b = ranked([5, 3, 9]), ranked([3, 7, 5, 8])
    for limit, want in [(10, [5, 3, 9, 7, 8]), (4, [5, 3, 9, 7]), (1, [5])]:
        rows = retrieval.union_candidates(a, b, limit).orderBy("place").collect()
        assert [r["item_id"] for r in rows] == want
        assert [r["place"] for r in rows] == list(range(1, len(want) + 1))
    with pytest.raises(ValueError):
        retrieval.union_candidates(a, b, 0)


def test_no_cross_join_in_the_plans(spark):
    q, x = frame(spark, clustered(6, 10)), frame(spark, clustered(7, 40))
    for method in ("scan", "slices"):
        plan = retrieval.nearest(q, x, 3, "v", method=method)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("floors", [False, True])
@pytest.mark.parametrize("k", [1, 7, 60])
def test_blocks_are_exact(spark, monkeypatch, k, floors):
    """Blocks of few queries and chunks of few items: copies, nulls, zeros, other lengths."""
    monkeypatch.setattr(retrieval, "_BLOCK_BYTES", 12_000 * k)
    monkeypatch.setattr(retrieval, "_QUERY_BLOCK", 4)
    monkeypatch.setattr(retrieval, "_CHUNK", 16)
    items = clustered(1, 150, copies=True) + [(900, None), (901, [0.0] * 6), (902, None), (903, [1.0])]
    queries = clustered(2, 20) + [(500, None), (501, []), (502, [0.0] * 6), (503, [1.0] * 6)]
    want = brute(queries, [(i, v if v is None or len(v) == 6 else [0.0] * 6) for i, v in items], k)
    got = retrieval.nearest(frame(spark, queries), frame(spark, items), k, "v", method="blocks", floors=floors)
    assert as_lists(got) == want
    rows = got.groupBy("query_id").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    assert all(r["r"] == list(range(1, min(k, len(items)) + 1)) for r in rows)


def test_blocks_count_queries_of_one_id_as_the_scan_does(spark):
    items, queries = clustered(21, 50), clustered(22, 6) + clustered(23, 6)
    got = [
        retrieval.nearest(frame(spark, queries), frame(spark, items), 9, "v", method=m).select(
            "query_id", "rank", "item_id", F.round("distance", 12)).orderBy("query_id", "rank").collect()
        for m in ("scan", "blocks")
    ]
    assert got[0] == got[1]


def test_running_results_and_many_slices_lead_to_blocks(spark, monkeypatch):
    """What a task holds grows with the queries times k, not with their vectors alone."""
    assert retrieval.route(2_000, 2_000 * 520, [150], 64 << 20) == "scan"
    assert retrieval.route(100_000, 100_000 * 520, [150], 64 << 20) == "blocks"
    assert retrieval.route(2_000, 2_000 * 520, [5], 512 << 10) == "slices"
    assert retrieval.route(100_000, 100_000 * 520, [150], 64 << 10) == "blocks"
    walks = []
    walked = retrieval._walked
    monkeypatch.setattr(retrieval, "_walked", lambda *a: walks.append(1) or walked(*a))
    items, queries = clustered(24, 60), clustered(25, 40)
    got = retrieval.nearest(frame(spark, queries), frame(spark, items), 3, "v", method="slices", limit_bytes=200)
    assert as_lists(got) == brute(queries, items, 3)
    assert len(walks) <= 8


def test_distances_of_columns_are_summed_in_element_order():
    rng = np.random.default_rng(9)
    q, x = rng.normal(size=(2, 50, 37))
    nq, nx = (np.sqrt((m * m).sum(axis=1)) for m in (q, x))
    nq[3] = 0.0
    found = retrieval._exact_distance(q.T, x.T, nq, nx)
    for i in range(50):
        dot = 0.0
        for a, b in zip(q[i], x[i]):
            dot += a * b
        assert found[i] == (1.0 - dot / (nq[i] * nx[i]) if nq[i] else 1.0)
    assert retrieval._exact_distance(np.zeros((0, 2)), np.zeros((0, 2)), np.ones(2), np.ones(2)).tolist() == [1.0, 1.0]
