"""Small tables with every awkward case, and brute-force answers."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
# column names that operators use themselves
CLASHING = ["row", "sig", "cls", "node", "root", "unit", "key", "uid", "size", "__row", "c0", "copies", "count"]


def prose(rng: random.Random, n: int) -> str:
    parts = ["ba", "Du", "ki", "lo", "mé", "na", "öp", "ra", "su", "ti"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


def documents(copies: int = 40) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars) with nulls, empty, short, long, repeated and near-equal texts."""
    rng = random.Random(5)
    texts = [None, "", " \t\n ", "one", "two words", "Two  WORDS", "a b c d", "a b c d e", "  x\x0bY ▁z   é \U0001f600\x00 "]
    texts += [prose(rng, n) for n in (6, 20, 63, 64, 65, 127, 128, 300, 700)]
    texts.append(prose(rng, 30_000))
    base = prose(rng, 150).split(" ")
    for i in range(copies):  # near copies, some linked only through others
        words = list(base)
        for _ in range(i % 9):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    passage = prose(rng, 70)
    texts += [f"{prose(rng, 200)} {passage} {prose(rng, 120)}" for _ in range(30)]
    texts += [texts[14]] * 5 + ["Ha " * 300, "ha ha " * 200]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s10", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, texts[13], "en", "s1", 3), (None, "nobody else", None, None, None), rows[15], rows[15], (15, prose(rng, 40), "en", "s1", 1)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows: list[tuple] | None = None, clashing: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(c) for c in CLASHING}) if clashing else df


def shingle_set(text: str | None, k: int = 5) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset({tuple(words)}) if len(words) < k else frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def jaccard_classes(rows: list[tuple], t: Fraction = Fraction(4, 5)) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of every row."""
    sets = [shingle_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in where[x])
        for x in s:
            where[x].append(i)
        for j, n in shared.items():
            if Fraction(n, len(s) + len(sets[j]) - n) >= t:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least: dict[int, int | None] = {}
    for i, r in enumerate(rows):
        known = [x for x in (least.get(find(i)), r[0]) if x is not None]
        least[find(i)] = min(known) if known else None
    return [(r[0], len(sets[i]), least[find(i)] if sets[i] else r[0]) for i, r in enumerate(rows)]


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))
