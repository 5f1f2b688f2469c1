"""Self-join of documents on the Jaccard similarity of their word shingles, by parity sketches.

A document is the set of its distinct k-word shingles. A parity sketch maps each
shingle to one bit and holds the parity of every bit, so two sketches differ in
at most as many bits as the sets differ in shingles. Sets with similarity t or
more differ in at most (1 - t) / (1 + t) of their sizes' sum.

Search. Per size band (powers of two by the smaller set; a set also enters the
band below if its partner may lie there) a very wide sketch is cut into pieces,
about 0.75 per shingle of the band's smallest set, and each piece is held as the
XOR of its shingles' hashes. By the pigeonhole principle a pair within d
differences agrees on all but d of the pieces that are not empty, so it shares
one among the d + 1 smallest piece codes of both. Those meet in a shuffle. Sets
of under 64 shingles have one shingle to a piece. (With fewer filled pieces than
d + 1 the argument would fail; for 64 shingles or more the filled pieces exceed
that by eight standard deviations.)

Runs. Sets that share a code come as one sorted run. Short runs give all their
pairs; long ones give each set's pair with the run's first set of fitting size
and with its neighbour. What a long run has left over is looked at again once
those links are known: pairs of different components are compared by wide sketches,
block against block, so no task holds a whole run. Round by round each component
offers its nearest pair, and joins where it holds; what then is still open is checked
pair by pair. So copies by the thousand do not become pairs, and no pair of different
components is left out.

Check. Pairs whose sketches (four to eight bits per shingle) differ too much are dropped;
the rest are verified on the whole texts. Documents with equal sets are one node
throughout. Sets and shingles are compared as 64-bit hashes.

Nulls and edges: a null or empty text, or one without words, has no shingles and
links with nothing. A text of fewer than k words is one shingle. Rows that
repeat are linked with each other; a null doc_id takes part, and is skipped when
the smallest doc_id is taken. An empty table gives no rows. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuematch.llm.components import components
from cuematch.llm.rows import packed, row_hash
from cuematch.llm.words import distinct, mixed, shingles, slices, text_bytes, trimmed, word_hashes
from cuematch.plans.storage import materialize

_SINGLE = 64  # below this size every shingle is a piece
_SHORT = 24  # runs up to here give all pairs
_HOT = 50_000  # rows of a run that are held at once
_SEND = 2_000_000  # keys that may be sent to all tasks
_WIDE = 16  # at most so many bits a shingle in the sketches of what long runs leave over
_FIRST_RUNS = 3  # runs of a set in the rounds of nearest pairs
_BLOCK_SETS, _BLOCK_SHINGLES = 2_000, 1_000_000  # of a block of a run, about
_U = np.uint64


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice of rows: first and last row, distinct shingle codes, their row within the slice."""
    data, offsets = text_bytes(texts)
    for a, b in slices(offsets):
        words, counts = word_hashes(data, offsets[a : b + 1])
        yield a, b, *distinct(*shingles(words, counts, k))


def _per_text(values: np.ndarray, text: np.ndarray, n: int, op) -> np.ndarray:
    out = np.zeros(n, values.dtype)
    if len(text):
        first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        out[text[first]] = op.reduceat(values, first)
    return out


def _class_ids(codes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 63-bit id of each set."""
    size = np.bincount(text, minlength=n)
    total = _per_text(mixed(codes ^ _U(0x5851F42D4C957F2D)), text, n, np.add)
    return size, (mixed(total + size.astype(np.uint64)) >> _U(1)).astype(np.int64)


def _bands(size: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(size, 1).astype(float))[1] - 1  # floor of log2


def _sketches(codes: np.ndarray, text: np.ndarray, size: np.ndarray, width: int = 8) -> list[bytes | None]:
    bits = np.maximum(64, width << _bands(size)).astype(np.int64)
    start = np.cumsum(bits) - bits
    at = start[text] + (codes & (bits[text] - 1).astype(np.uint64)).astype(np.int64)
    parity = np.bincount(at, minlength=int(bits.sum())).astype(np.uint8) & 1
    packed = np.packbits(parity, bitorder="little").tobytes()
    return [packed[s // 8 : (s + m) // 8] if n else None for s, m, n in zip(start, bits, size, strict=True)]


def _described(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, codes, text in _sets(batch.column(2), k):
                size, ids = _class_ids(codes, text, b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(size, pa.int64()),
                        pa.array(ids, mask=size == 0), pa.array(_sketches(codes, text, size), pa.binary()),
                    ],
                    names=["doc_id", "row", "n", "cls", "sketch"],
                )

    return run


def _pieces(codes, text, size, band, share: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """The smallest piece codes of each set in its band, and the set's row. share: d of a set over its size."""
    count = np.where(size < _SINGLE, 0, np.maximum(1, (3 << np.maximum(band, 2)) // 4)).astype(np.uint64)[text]
    piece = np.where(count > 0, ((codes >> _U(32)) * count) >> _U(32), codes)
    order = np.lexsort((piece, text))
    codes, piece, text = codes[order], piece[order], text[order]
    first = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (text[1:] != text[:-1]))) if len(text) else np.zeros(0, int)
    value = np.bitwise_xor.reduceat(codes, first) if len(first) else codes
    text = text[first]
    full = value != 0
    value = mixed(value + (piece[first] + _U(1)) * _U(0x9E3779B97F4A7C15) + band[text].astype(np.uint64) * _U(0xD1B54A32D192ED03))[full]
    text = text[full]
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    rank = np.arange(len(text)) - np.searchsorted(text, text)
    keep = rank <= (size * share.numerator // share.denominator)[text]
    return value[keep], text[keep]


def _signatures(k: int, t: Fraction):
    below = (1 - t) / (1 + t) * 2  # of the larger set's size
    within = (1 - t) / (1 + t) * (1 + 1 / t)  # of the smaller set's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b, codes, text in _sets(batch.column(0), k):
                size, ids = _class_ids(codes, text, b - a)
                new = np.zeros(b - a, bool)
                for i in np.flatnonzero(size):
                    if (x := int(ids[i])) not in seen:
                        new[i] = True
                        seen.add(x)
                if len(seen) > 500_000:
                    seen = set()
                band = _bands(size)
                low = new & (size >= 1) & (-(-size * t.numerator // t.denominator) < (1 << band)) & (band > 0)
                for rows, at, share in ((new, band, within), (low, band - 1, below)):
                    mine = rows[text]
                    # the band, and not the set, says how fine the pieces are
                    value, row = _pieces(codes[mine], text[mine], np.where(at < 6, np.minimum(size, _SINGLE - 1), np.maximum(size, _SINGLE)), at, share)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(value.view(np.int64)), pa.array(ids[row]), pa.array(size[row], pa.int32())], names=["sig", "cls", "n"]
                    )

    return run


def _fits(small: np.ndarray, large: np.ndarray, t: Fraction) -> np.ndarray:
    return small * t.denominator >= large * t.numerator


def _star(sig, cls, n, t: Fraction, hot: dict | None) -> tuple[list, dict]:
    """Pairs of a long run's rows with their leaders and neighbours; ``hot`` is where the run stood."""
    pairs, at = [], 0
    hot = hot or {"sig": sig[0], "lead": cls[0], "lead_n": n[0], "last": cls[0], "last_n": n[0]}
    before, before_n = np.append(hot["last"], cls[:-1]), np.append(hot["last_n"], n[:-1])
    good = (before != cls) & _fits(before_n.astype(np.int64), n.astype(np.int64), t)
    pairs.append((before[good], cls[good]))
    while at < len(cls):
        end = int(np.searchsorted(n, int(hot["lead_n"]) * t.denominator // t.numerator, side="right"))
        if end > at:
            part = cls[at:end]
            pairs.append((np.full((part != hot["lead"]).sum(), hot["lead"]), part[part != hot["lead"]]))
            at = end
        if at < len(cls):
            hot |= {"lead": cls[at], "lead_n": n[at]}
    return pairs, hot | {"last": cls[-1], "last_n": n[-1]}


def _runs(t: Fraction):
    """Rows (sig, cls, n) sorted by (sig, n, cls) to pairs (sig null, a, b) and members of long runs (sig, a, null, n)."""

    def out(pairs: list, long: list) -> Iterator[pa.RecordBatch]:
        if pairs:
            a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
            a, b = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) & (a != b) if len(a) else np.zeros(0, bool)
            a, b = a[new], b[new]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32())], names=["sig", "a", "b", "n"])
        for sig, cls, n in long:
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(cls), pa.nulls(len(cls), pa.int64()), pa.array(n)], names=["sig", "a", "b", "n"])

    def whole(sig, cls, n) -> tuple[list, list]:
        pairs, long = [], []
        first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, int)
        length = np.diff(np.append(first, len(sig)))
        many = np.repeat(length, length)
        for i in np.flatnonzero(length > _SHORT):
            s = slice(first[i], first[i] + length[i])
            pairs += _star(sig[s], cls[s], n[s], t, None)[0]
            long.append((sig[s], cls[s], n[s]))
        few = (many > 1) & (many <= _SHORT)
        sig, cls, n = sig[few], cls[few], n[few].astype(np.int64)
        for j in range(1, _SHORT):
            same = sig[j:] == sig[:-j] if len(sig) > j else np.zeros(0, bool)
            if not same.any():
                break
            good = same & _fits(n[:-j], n[j:], t)
            pairs.append((cls[:-j][good], cls[j:][good]))
        return pairs, long

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        held, hot = empty, None
        for batch in batches:
            rows = [np.concatenate((h, batch.column(i).to_numpy())) for i, h in enumerate(held)]
            held = empty
            if hot is not None:
                end = int(np.searchsorted(rows[0], hot["sig"], side="right"))
                if end:
                    part = [x[:end] for x in rows]
                    pairs, hot = _star(*part, t, hot)
                    yield from out(pairs, [part])
                    rows = [x[end:] for x in rows]
                if not len(rows[0]):
                    continue
                hot = None
            if not len(rows[0]):
                continue
            # one row for a set in a run: copies are one node
            new = np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
            rows = [x[new] for x in rows]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from out(*whole(*(x[:last] for x in rows)))
            held = [x[last:] for x in rows]
            if len(held[0]) > _HOT:
                pairs, hot = _star(*held, t, None)
                yield from out(pairs, [held])
                held = empty
        yield from out(*whole(*held))

    return run


def _folded(sketch: bytes, size: int) -> np.ndarray:
    bits = np.frombuffer(sketch, np.uint64)
    while len(bits) * 8 > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _most(n_a, n_b, t: Fraction):
    gap = (1 - t) / (1 + t)
    return (n_a + n_b) * gap.numerator // gap.denominator


def _near(t: Fraction):
    """Pairs whose sketches are near enough: columns a, b, n_a, n_b, s_a, s_b to a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b = (batch.column(i).to_numpy() for i in range(4))
            keep = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                size = min(len(x), len(y))
                keep[i] = np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum() <= _most(int(n_a[i]), int(n_b[i]), t)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return run


def _between(t: Fraction, best: bool):
    """Pairs of different components: columns sig, i, j, block, a, n, root, sketch, sorted by (sig, i, j, n), to a, b.

    A group (sig, i, j) holds the blocks i and j of one signature's sets; pairs lie across
    them, or within block i where j is i. With ``best`` each component gives its nearest
    pair of the group only, else every pair within the sketch bound is given.
    """

    def nearest(found: list) -> list:
        """Of (root, far, a, b) rows the least far one of each root."""
        root, far, a, b = (np.concatenate([f[i] for f in found]) for i in range(4))
        order = np.lexsort((b, a, far, root))
        root = root[order]
        first = order[np.append(True, root[1:] != root[:-1])]
        return [tuple(x[first] for x in (np.concatenate([f[i] for f in found]) for i in range(4)))]

    def pairs(rows: list) -> list:
        _, i_, j_, block, a, n, root, sketch = rows
        size = min(map(len, sketch))
        bits = np.stack([_folded(x, size) for x in sketch])
        end = np.searchsorted(n, n * t.denominator // t.numerator, side="right")
        across, found, held = i_[0] != j_[0], [], 0
        for i in range(len(a)):
            j = np.arange(i + 1, end[i])
            j = j[(root[j] != root[i]) & ((block[j] != block[i]) | (not across))]
            if not len(j):
                continue
            far = np.bitwise_count(bits[j] ^ bits[i]).sum(1).astype(np.int64)
            good = far <= _most(n[i], n[j], t)
            j, far = j[good], far[good] / (n[i] + n[j][good])
            found.append((np.full(len(j), root[i]), far, np.full(len(j), a[i]), a[j]))
            if best:
                found.append((root[j], far, np.full(len(j), a[i]), a[j]))
                held += 2 * len(j)
                if held > 500_000:
                    found, held = nearest(found), 0
        return nearest(found) if best and found and sum(len(f[0]) for f in found) else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        sent: set[tuple[int, int]] = set()  # a pair meets in many groups

        def done(rows: list, last: int) -> Iterator[pa.RecordBatch]:
            new = np.any([x[1:last] != x[: max(last - 1, 0)] for x in rows[:3]], axis=0) if last > 1 else np.zeros(0, bool)
            for part in np.split(np.arange(last), np.flatnonzero(new) + 1) if last else []:
                for _, _, a, b in pairs([x[part] for x in rows]):
                    fresh = [p for p in dict.fromkeys(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)) if p not in sent]
                    if fresh:
                        if len(sent) > 500_000:
                            sent.clear()
                        sent.update(fresh)
                        a, b = zip(*fresh, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(8)]
            held = new if held is None else [np.concatenate((h, x)) for h, x in zip(held, new, strict=True)]
            if not len(held[0]):
                continue
            same = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
            last = int(np.argmax(same))
            yield from done(held, last)
            held = [x[last:] for x in held]
        if held is not None:
            yield from done(held, len(held[0]))

    return run


def _verified(k: int, t: Fraction):
    """Pairs with similarity t or more: columns a, b, text_a, text_b to a, b, shared, union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                both, size = [], np.zeros(part.num_rows, np.int64)
                for side in (2, 3):
                    for a, b, codes, text in _sets(part.column(side), k):
                        both.append((codes, text + a))
                        size[a:b] += np.bincount(text, minlength=b - a)
                codes, text = (np.concatenate([x[i] for x in both]) for i in (0, 1))
                order = np.lexsort((codes, text))
                codes, text = codes[order], text[order]
                same = (codes[1:] == codes[:-1]) & (text[1:] == text[:-1])
                shared = np.bincount(text[1:][same], minlength=part.num_rows)
                union = size - shared
                good = pa.array((shared * t.denominator >= union * t.numerator) & (union > 0))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).filter(good), part.column(1).filter(good), pa.array(shared).filter(good), pa.array(union).filter(good)],
                    names=["a", "b", "shared", "union"],
                )

    return run


def _class_texts(k: int, width: int = 0):
    """text to cls, text, and with a ``width`` a sketch of width/2 to width bits a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, codes, text in _sets(batch.column(0), k):
                size, ids = _class_ids(codes, text, b - a)
                full = pa.array(size > 0)
                columns = {"cls": pa.array(ids), "text": batch.column(0).slice(a, b - a)}
                if width:
                    columns["sketch"] = pa.array(_sketches(codes, text, size, width), pa.binary())
                yield pa.RecordBatch.from_arrays([c.filter(full) for c in columns.values()], names=list(columns))

    return run


def _texts(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(cls, text) of the sets in a pair. Texts are read again, and only those are shuffled."""
    needed = materialize(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), "needed")
    send = F.broadcast if needed.count() <= _SEND else (lambda x: x)
    texts = docs.select("text").mapInArrow(trimmed(_class_texts(k)), "cls long, text string").join(send(needed), "cls", "left_semi")
    return texts.groupBy("cls").agg(F.first("text").alias("text"))


def _among(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``sets`` that a join with ``ids`` (cls) can meet. Beyond ``_SEND`` ids the join alone drops the others."""
    ids = materialize(ids.distinct(), "among")
    return sets.join(F.broadcast(ids), "cls", "left_semi") if ids.count() <= _SEND else sets


def _verify(texts: DataFrame, pairs: DataFrame, k: int, t: Fraction) -> DataFrame:
    """The pairs (a, b) that hold on whole texts."""
    second = pairs.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
    both = second.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(trimmed(_verified(k, t)), "a long, b long, shared long, `union` long")


def _open(long: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of long runs (sig, a, n, root) whose run holds more than one component."""
    rooted = long.join(roots, F.col("a") == F.col("node"), "left").select("sig", "a", "n", F.coalesce("root", "a").alias("root"))
    several = rooted.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"))
    several = several.where("x <> y").select("sig", F.ceil(F.greatest(F.col("members") / _BLOCK_SETS, F.col("total") / _BLOCK_SHINGLES)).alias("blocks"))
    return rooted.join(several, "sig")


def _between_components(left: DataFrame, wide: DataFrame, t: Fraction, best: bool) -> DataFrame:
    """(a, b) of different components that may be linked. A run is met block by block, each pair of blocks a group."""
    block = F.pmod(F.xxhash64("a"), F.col("blocks"))
    if best:  # copies mostly share their first runs; the last pass takes all runs
        left = left.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy("sig"))).where(F.col("k") <= _FIRST_RUNS).drop("k")
    rows = left.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "a", F.col("n").cast("long").alias("n"), "root")
    wide = _among(wide, left.select(F.col("a").alias("cls")))
    rows = rows.join(wide.select(F.col("cls").alias("a"), "sketch"), "a").select("sig", "i", "j", "block", "a", "n", "root", "sketch")
    rows = rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "n", "a")
    return materialize(rows.mapInArrow(trimmed(_between(t, best)), "a long, b long").distinct(), "between")


def _joined(docs: DataFrame, long: DataFrame, found: DataFrame, roots: DataFrame, k: int, t: Fraction) -> DataFrame:
    """(node, root) with the links that long runs have left over.

    In each round every component offers its nearest pair of each group, over the first
    open runs of its sets; those that hold on whole texts join components, so a group of
    n sets offers at most n pairs.
    When a round joins nothing, all pairs of different components within the bound of
    the wide sketches are checked: few, as such sketches count the differences almost
    exactly, and none is left out. Only the sketches of sets still open and the texts of
    offered pairs are shuffled.
    """
    left = materialize(_open(long, roots), "open")
    if left.isEmpty():
        return roots
    needed = materialize(left.select(F.col("a").alias("cls")).distinct(), "open-sets")
    send = F.broadcast if needed.count() <= _SEND else (lambda x: x)
    wide = docs.select("text").mapInArrow(trimmed(_class_texts(k, _WIDE)), "cls long, text string, sketch binary").join(send(needed), "cls", "left_semi")
    wide = materialize(wide.groupBy("cls").agg(F.first("text").alias("text"), F.first("sketch").alias("sketch")), "open-texts")
    best = True
    while True:
        pairs = _between_components(left, wide, t, best)
        paired = pairs.select(F.col("a").alias("cls")).union(pairs.select("b"))
        more = materialize(_verify(_among(wide, paired), pairs, k, t).select("a", "b"), "verified")
        if more.isEmpty():
            if not best:
                return roots
            best = False
            continue
        found = materialize(found.unionByName(more), "links")
        roots = materialize(components(found), "roots")
        if not best:
            return roots
        left = materialize(_open(long, roots), "open")


def shingle_classes(docs: DataFrame, k: int = 5) -> DataFrame:
    """One row per document: doc_id, row (hash of all its columns), n (set size), cls (id of its set, null if empty), sketch."""
    sent = docs.select(F.col("doc_id").cast("long"), row_hash(docs).alias("row"), "text")
    return sent.mapInArrow(trimmed(_described(k)), "doc_id long, row long, n long, cls long, sketch binary")


def links(docs: DataFrame, classes: DataFrame, k: int = 5, t: Fraction = Fraction(4, 5)) -> DataFrame:
    """(node, root) over the ids of shingle sets: the components of all links between different sets."""
    sigs = docs.select("text").mapInArrow(trimmed(_signatures(k, t)), "sig long, cls long, n int")
    runs = sigs.repartition("sig").sortWithinPartitions("sig", "n", "cls").mapInArrow(trimmed(_runs(t)), "sig long, a long, b long, n int")
    runs = materialize(runs, "runs")
    sets = materialize(classes.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sets")

    def side(c: str) -> DataFrame:
        return sets.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    pairs = runs.where("b is not null").select("a", "b").distinct()
    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    near = materialize(near.mapInArrow(trimmed(_near(t)), "a long, b long"), "near")
    found = materialize(_verify(_texts(docs, near, k), near, k, t).select("a", "b"), "verified")
    roots = materialize(components(found), "roots")
    long = materialize(runs.where("b is null").select("sig", "a", "n").distinct(), "long")
    return _joined(docs, long, found, roots, k, t)


def _placed(docs: DataFrame, k: int, threshold: float | Fraction) -> DataFrame:
    """doc_id, row, n_shingles, cls, root of every document."""
    t = Fraction(threshold).limit_denominator(1000)
    classes = materialize(shingle_classes(docs, k), "classes")
    roots = links(docs, classes, k, t)
    placed = classes.drop("sketch").join(roots, F.col("cls") == F.col("node"), "left")
    return placed.select("doc_id", "row", F.col("n").alias("n_shingles"), "cls", F.coalesce("root", "cls").alias("root"))


def jaccard_components(docs: DataFrame, k: int = 5, threshold: float | Fraction = Fraction(4, 5)) -> DataFrame:
    """One row per document: doc_id, n_shingles, cls, component_id (smallest doc_id reachable by links, itself included)."""
    placed = _placed(docs, k, threshold)
    smallest = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("first"))
    out = placed.join(smallest, "root", "left")
    return out.select("doc_id", "n_shingles", "cls", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("component_id"))


def deduplicated(docs: DataFrame, k: int = 5, threshold: float | Fraction = Fraction(4, 5)) -> DataFrame:
    """The documents with one row of each component, all columns kept.

    The row with the smallest doc_id stays (a null comes last; among equal ids
    the row's hash decides). Documents without words stay.
    """
    placed = materialize(_placed(docs, k, threshold).where("root is not null").select("doc_id", "row", "root"), "placed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("w")
    won = placed.groupBy("root").agg(first).select("root", F.col("w.row").alias("row"))
    lost = placed.join(won, ["root", "row"], "left_anti").select("row").distinct()
    again = placed.join(won, ["root", "row"], "left_semi").groupBy("row").count().where("count > 1").select("row")
    lost, again = materialize(lost, "lost"), materialize(again, "again")
    send = F.broadcast if lost.count() <= _SEND else (lambda x: x)
    kept = packed(docs).join(send(lost), "row", "left_anti")
    if again.isEmpty():
        return kept.select("doc.*")
    once = kept.join(again, "row", "left_semi").dropDuplicates(["row"])
    return kept.join(again, "row", "left_anti").unionByName(once).select("doc.*")
