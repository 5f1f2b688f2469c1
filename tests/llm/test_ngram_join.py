from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from cuematch.llm import ngram_join
from cuematch.llm.components import components
from tests.llm import cases


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3), (7, 7), (159, 160)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 161)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("send", [2_000_000, 0])
def test_components_equal_brute_force(spark, monkeypatch, send):
    monkeypatch.setattr(ngram_join, "_SEND", send)
    rows = cases.documents()
    out = ngram_join.jaccard_components(cases.table(spark, rows))
    got = cases.ordered((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect())
    assert got == cases.ordered(cases.jaccard_classes(rows))


def test_one_document_of_each_group_stays(spark):
    rows = cases.documents()
    docs = cases.table(spark, rows)
    kept = ngram_join.deduplicated(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    groups = {}
    for r, (_, n, c) in zip(rows, cases.jaccard_classes([(i, *r[1:]) for i, r in enumerate(rows)]), strict=True):
        if n:
            groups.setdefault(c, []).append(r)
    empty = [r for r in rows if not cases.shingle_set(r[1])]
    assert len(got) == len(groups) + len(empty)
    for group in groups.values():  # the smallest id stays; a null only where there is none
        ids = [r[0] for r in group if r[0] is not None]
        stays = min(ids) if ids else None
        assert sum((r[0], r[1]) in got for r in set(group) if r[0] == stays) == 1


def test_empty_table(spark):
    docs = cases.table(spark, [])
    assert ngram_join.jaccard_components(docs).collect() == []
    assert ngram_join.deduplicated(docs).collect() == []


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 5, 64, 700):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.append(a[: n - n // 7], rng.integers(0, 2**63, n // 7, dtype=np.uint64))
        size = np.array([n, n])
        codes, text = ngram_join.distinct(np.append(a, b), np.repeat([0, 1], n))
        x, y = ngram_join._sketches(codes, text, size)
        apart = np.bitwise_count(ngram_join._folded(x, len(x)) ^ ngram_join._folded(y, len(y))).sum()
        assert apart <= len(set(a) ^ set(b))
        assert np.bitwise_count(ngram_join._folded(x, 8) ^ ngram_join._folded(y, 8)).sum() <= len(set(a) ^ set(b))


def test_pairs_at_the_threshold_share_a_piece():
    """Sets that differ as much as allowed meet in one of the chosen codes, whatever their sizes."""
    rng = np.random.default_rng(2)
    t = Fraction(4, 5)
    run = ngram_join._signatures(5, t)
    for n in (5, 9, 40, 63, 64, 79, 80, 127, 128, 160, 500):
        words = [f"v{x}" for x in rng.integers(0, 10**9, n + 4)]
        more = words + [f"u{x}" for x in range(n // 4)]  # exactly t where 4 divides n
        a, b = " ".join(words), " ".join(more)
        sets = cases.shingle_set(a), cases.shingle_set(b)
        assert Fraction(len(sets[0] & sets[1]), len(sets[0] | sets[1])) >= t
        found = [set(), set()]
        for i, text in enumerate((a, b)):
            for batch in run(iter([pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])])):
                found[i] |= set(batch.column(0).to_pylist())
        assert found[0] & found[1], n


def test_long_runs_may_cross_batches():
    t = Fraction(4, 5)
    sig = np.repeat([1, 2, 3], [3, 200, 2])
    cls, n = np.arange(205), np.sort(np.random.default_rng(3).integers(100, 120, 205))
    whole = [pa.RecordBatch.from_arrays([pa.array(sig), pa.array(cls), pa.array(n, pa.int32())], names=["sig", "cls", "n"])]
    small = [whole[0].slice(i, 7) for i in range(0, 205, 7)]

    def pairs(batches):
        out, long = set(), set()
        for b in ngram_join._runs(t)(iter(batches)):
            for s, x, y in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                (long.add((s, x)) if y is None else out.add((x, y)))
        return out, long

    assert pairs(whole) == pairs(small)
    assert {(0, 1), (0, 2), (1, 2), (203, 204)} <= pairs(whole)[0] and len(pairs(whole)[1]) == 200


@pytest.mark.parametrize("block", [2_000, 7])
def test_what_long_runs_leave_over_equals_brute_force(spark, monkeypatch, block):
    """Over a hundred near copies around the threshold, and others that share a passage with them."""
    monkeypatch.setattr(ngram_join, "_BLOCK_SETS", block)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(70)]
    rows = []
    for i in range(160):
        words = list(base)
        for at in rng.choice(70, int(rng.integers(1, 4)), replace=False):
            words[at] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(words), "en", "s", 1))
    rows += [(1000 + i, " ".join([*base[:30], *(f"y{i % 30}v{j}" for j in range(40 + i % 3))]), "en", "s", 1) for i in range(90)]
    out = ngram_join.jaccard_components(cases.table(spark, rows)).collect()
    assert cases.ordered((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == cases.ordered(cases.jaccard_classes(rows))


def test_rounds_move_the_texts_of_offered_pairs_only(spark, monkeypatch):
    """A text whose set is in no pair of a round stays out of that round's join."""
    verify, seen = ngram_join._verify, []

    def watched(texts, pairs, k, t):
        seen.append(({r["cls"] for r in texts.select("cls").collect()}, {x for r in pairs.collect() for x in (r["a"], r["b"])}))
        return verify(texts, pairs, k, t)

    monkeypatch.setattr(ngram_join, "_verify", watched)
    rows = []
    for i in range(60):
        words = [f"w{j}" for j in range(70)]
        words[i % 7 * 9 : i % 7 * 9 + 1 + i % 4] = [f"x{i}"]
        rows.append((i, " ".join(words), "en", "s", 1))
    rows += [(1000 + i, " ".join([*(f"w{j}" for j in range(30)), *(f"y{i}v{j}" for j in range(40))]), "en", "s", 1) for i in range(40)]
    out = ngram_join.jaccard_components(cases.table(spark, rows)).collect()
    assert cases.ordered((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == cases.ordered(cases.jaccard_classes(rows))
    assert len(seen) > 1 and all(texts == paired for texts, paired in seen)


def test_components_offer_their_nearest_pairs_across_blocks():
    t = Fraction(4, 5)
    rng = np.random.default_rng(7)
    common = rng.integers(0, 2**63, 100, dtype=np.uint64)
    sets = [np.append(common[: 100 - i % 9], rng.integers(0, 2**63, i % 9, dtype=np.uint64)) for i in range(40)]
    codes, text = ngram_join.distinct(np.concatenate(sets), np.repeat(np.arange(40), 100))
    sketch = ngram_join._sketches(codes, text, np.full(40, 100), ngram_join._WIDE)
    block = np.arange(40) % 2

    def batch(rows, i, j):
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (np.full(len(rows), 1), np.full(len(rows), i), np.full(len(rows), j), block[rows], rows, np.full(len(rows), 100), rows // 2)]
            + [pa.array([sketch[r] for r in rows])],
            names=["sig", "i", "j", "block", "a", "n", "root", "sketch"],
        )

    groups = [(np.flatnonzero(block == 0), 0, 0), (np.arange(40), 0, 1), (np.flatnonzero(block == 1), 1, 1)]
    got = {}
    for best in (False, True):
        out = ngram_join._between(t, best)(iter([b.slice(x, 9) for g in groups for b in [batch(*g)] for x in range(0, b.num_rows, 9)]))
        got[best] = {(a, b) for r in out for a, b in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), strict=True)}
    linked = {(a, b) for a in range(40) for b in range(a + 1, 40) if a // 2 != b // 2 and len(set(sets[a]) & set(sets[b])) * 5 >= 4 * len(set(sets[a]) | set(sets[b]))}
    assert linked <= got[False] and got[True] <= got[False] and len(got[True]) <= 60
    assert {x // 2 for p in got[True] for x in p} == set(range(20))
