import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuematch.llm import merkle, sha
from tests.llm import cases


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: tuple, text="same") -> str:
    doc_id, own, lang, source, n_chars = row
    values = [doc_id, source, lang, n_chars, own if text == "same" else text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grown(nodes: list[str], arity: int) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + arity]) for i in range(0, len(last), arity)])
    return levels


def siblings(levels: list[list[str]], place: int, arity: int) -> list[tuple[int, list[str]]]:
    out = []
    for level in levels[:-1]:
        first = place - place % arity
        out.append((place % arity, level[first : first + arity]))
        place //= arity
    return out


def wanted(rows: list[tuple], arity: int) -> list[tuple]:
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = grown([leaf(r) for r in by[s]], arity)
    top = grown([trees[s][-1][0] for s in order], arity)
    out = []
    for at, s in enumerate(order):
        for i, r in enumerate(by[s]):
            way = siblings(trees[s], i, arity) + siblings(top, at, arity)
            text = r[1].replace("\n", "") if r[1] is not None else None
            node = leaf(r, text)
            for slot, run in way:
                node = h(*run[:slot], node, *run[slot + 1 :])
            proof = "".join(x for slot, run in way for k, x in enumerate(run) if k != slot)
            out.append((r[0], s, leaf(r), trees[s][-1][0], top[-1][0], proof, node))
    return out


def found(spark, rows, arity=3):
    docs = cases.table(spark, rows)
    changed = merkle.leaf(docs, changed={"text": F.replace("text", F.lit("\n"), F.lit(""))})
    return [tuple(r) for r in merkle.manifest(docs, replacement=changed, arity=arity).proofs().collect()]


@pytest.mark.parametrize("arity,levels", [(3, 7), (3, 2), (2, 1)])
def test_equals_hashlib(spark, monkeypatch, arity, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)  # low blocks: several steps on a small table
    rows = cases.documents(copies=10)[:70] + [(500, "x\ny\n", "en", "alone", 4), (501, "a\nb", None, "", 3), (502, "", "é", "ß", 0)]
    assert cases.ordered(found(spark, rows, arity)) == cases.ordered(wanted(rows, arity))


def test_one_row_and_none(spark):
    rows = [(7, "a\nb", "en", None, 3)]
    assert found(spark, rows) == wanted(rows, 3)
    assert found(spark, rows)[0][5] == ""
    assert found(spark, []) == []


def test_hot_source_is_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    rng = random.Random(2)
    rows = [(i, f"t{i}\n", "en", "hot" if rng.random() < 0.7 else f"s{rng.randrange(40)}", 2) for i in range(600)]
    docs = cases.table(spark, rows)
    made = merkle.manifest(docs)
    assert made.sources.steps[0].count() > 50
    assert max(len(x or []) for (x,) in made.sources.steps[0].select("levels").collect()) == 2
    assert cases.ordered(found(spark, rows)) == cases.ordered(wanted(rows, 3))


def test_kept_states_are_those_of_the_hash():
    rng = np.random.default_rng(0)
    nodes = rng.integers(0, 256, (9001, 32), dtype=np.uint8)
    slot = np.arange(9001) % 3
    run = merkle._runs(np.zeros(9001, int), slot)
    up, before = merkle._hashed_runs(nodes, run, slot, 3)
    assert up[-1].tobytes() == hashlib.sha256(nodes[-1].tobytes().hex().encode()).digest()
    resumed = sha.finish(sha.absorb(before[2:3], sha.hex_block(nodes[2:3])), [3])
    assert resumed.tobytes() == up[0].tobytes() == hashlib.sha256(b"".join(x.tobytes().hex().encode() for x in nodes[:3])).digest()
