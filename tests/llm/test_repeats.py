import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cuematch.llm import bwt, repeats
from tests.llm import cases

L = repeats.LENGTH


def brute(texts: list[str | None]) -> list[tuple]:
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + L] for b in data for i in range(len(b) - L + 1))
    out = []
    for b in data:
        runs: list[list[int]] = []
        for i in range(len(b) - L + 1):
            if seen[b[i : i + L]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + L
                else:
                    runs.append([i, i + L])
        edges = [0, *(x for r in runs for x in r), len(b)]
        kept = b"".join(b[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
        out.append((len(b), tuple(map(tuple, runs)), hashlib.sha256(kept).hexdigest()))
    return out


def test_transform_finds_repeats():
    rng = random.Random(3)
    for alphabet, length in ((b"ab", 5), (b"abcdefgh", 12), (bytes(range(256)), 3), (b"a", 4)):
        strings = [bytes(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(20)]
        strings += [strings[3] + b"xy" + strings[4], strings[5][7:] * 2, b"", bytes(40)]
        seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = [[i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1] for s in strings]
        assert [x.tolist() for x in bwt.repeats(strings, length)] == want


def corpus() -> list[tuple]:
    rng = random.Random(9)
    rows = cases.documents(copies=12)
    passage = cases.prose(rng, 60)
    texts = ["ab" * 400, "x" * 199, "x" * 200, "x" * 450, passage[:200], f"é{passage}", passage[1:199], f"{cases.prose(rng, 40)}{passage[:230]}{cases.prose(rng, 40)}"]
    return rows + [(1000 + i, t, None, None, 0) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("send", "crowd"), [(4_000_000, 2000), (0, 2000), (4_000_000, 2)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, send, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rows = corpus()
    out = repeats.without_repeats(cases.table(spark, rows), send=send).collect()
    got = cases.ordered((r["doc_id"], r["n_bytes"], tuple((s["begin"], s["end"]) for s in r["spans"] or ()), hashlib.sha256(r["kept"]).hexdigest()) for r in out)
    assert got == cases.ordered((r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows]), strict=True))


def test_empty_table(spark):
    assert repeats.without_repeats(cases.table(spark, [])).collect() == []


def test_each_window_is_in_one_unit(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 3000)
    rng = random.Random(4)
    texts = [cases.prose(rng, 3000), "", "short", cases.prose(rng, 100)]
    found = {i: [] for i in range(len(texts))}
    for rows, data, starts, shift in repeats._pieces(pa.array(texts)):
        first, stop, _, _ = repeats._units(data, starts)
        place = np.searchsorted(starts, first, side="right") - 1
        for a, b, p in zip(first, stop, place, strict=True):
            found[int(rows[p])] += range(int(a + shift - starts[p]), int(b + shift - starts[p]) + 1)
    assert {i: sorted(x) for i, x in found.items()} == {i: list(range(max(len(t.encode()) - L + 1, 0))) for i, t in enumerate(texts)}


def test_order_of_wide_keys_is_that_of_narrow_ones():
    key = np.random.default_rng(1).integers(0, 50, 400)
    for bits in (6, 63):  # packed with the position, or sorted beside it
        order, ordered = bwt._by_key(key, bits)
        assert sorted(order.tolist()) == list(range(400)) and (key[order] == ordered).all() and (np.diff(ordered) >= 0).all()
