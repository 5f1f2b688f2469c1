"""Removal of every byte covered by a string of ``LENGTH`` bytes that occurs twice in the corpus.

Units. Every window of LENGTH bytes has an anchor: its substring of GRAM bytes
with the smallest hash, the leftmost of equals. Neighbouring windows with one
anchor form a unit, about 85 windows, and each window lies in one unit. Equal
windows have equal anchors, so they meet in the group of their anchor.

Whole units. Units are counted by (anchor, content), in the task first and then
by a shuffle of two numbers per unit. A unit that occurs twice is repeated as a
whole; one that is alone with its anchor has no repeated window. Both are
settled without their bytes.

Compared units. Where an anchor has units of different content, one copy of
each content meets the others, and a Burrows-Wheeler transform over whole
anchor groups yields the repeated windows (``bwt``). Anchors with many contents
are divided by a second and third anchor of each window, so no group grows with
the corpus unless its contents are equal in all three.

Texts are read three times and shuffled only if the table of settled units is
too large to send; otherwise only numbers and compared contents move. Anchors,
units and contents are compared as 64-bit hashes, compared units byte by byte.

Nulls and edges: a null text is empty; texts below LENGTH bytes keep all bytes
and match nothing. Long texts are walked in overlapping pieces; a unit cut at a
seam is a unit of other content and gets compared. Rows that repeat are repeated
text like any other. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuematch.llm import bwt
from cuematch.llm.words import BYTE_CODES, SLICE_BYTES, mixed, powers, slices, text_bytes, trimmed
from cuematch.plans.storage import materialize

LENGTH = 200
GRAM = 32
PIECE = 3 << 20  # bytes of one text that are walked at once
BUCKET = 1 << 18  # bytes of one transform, whose arrays stay in the cache of a core
CROWD = 2000  # contents of one anchor before it is divided
_SEND = 4_000_000
_U = np.uint64
_LOW = _U((1 << 24) - 1)
_BASE = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))


@lru_cache(maxsize=1)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(n, _BASE), powers(n, _BACK)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 22, 1 << (n - 1).bit_length())
    up, down = _tables(size)
    return up[: n + 1], down[: n + 1]


def _window_min(values: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (w - span)], values[w - span :]) if w > span else values


def _anchors(grams: np.ndarray, seed: int) -> np.ndarray:
    """Place of each window's anchor."""
    code = mixed(grams + _U(seed * 0x5851F42D4C957F2D & (2**64 - 1)))
    packed = (code & ~_LOW) | np.arange(len(code), dtype=np.uint64)
    return (_window_min(packed, LENGTH - GRAM + 1) & _LOW).astype(np.int64)


def _units(data: np.ndarray, starts: np.ndarray, seeds: tuple[int, ...] = (0,)):
    """First and last window of each unit, anchor code and content code. ``starts``: n + 1 offsets of the texts."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[:n], out=total[1:])
    grams = (total[GRAM:] - total[: n - GRAM + 1]) * down[: n - GRAM + 1]
    windows = n - LENGTH + 1
    at = [_anchors(grams, s) for s in seeds]
    length = np.diff(starts)
    fits = np.repeat(starts[1:], length)[:windows] - np.arange(windows) >= LENGTH
    new = fits.copy()
    same = fits[:-1].copy()
    for p in at:
        same &= p[1:] == p[:-1]
    new[1:] &= ~same
    first = np.flatnonzero(new)
    stop = np.flatnonzero(fits & np.append(~fits[1:] | new[1:], True))
    key = np.zeros(len(first), np.uint64)
    place = np.zeros(len(first), np.uint64)
    for p in at:
        key = mixed(key + grams[p[first]])
        place = place * _U(1009) + (p[first] - first).astype(np.uint64)
    size = stop - first + LENGTH
    content = (total[first + size] - total[first]) * down[first]
    uid = mixed(mixed(content + key) + size.astype(np.uint64) * _U(0xD1B54A32D192ED03) + place)
    return first, stop, key, uid


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Rows, bytes, offsets and place within the text, for slices of texts or pieces of a long one."""
    data, offsets = text_bytes(texts)
    for a, b in slices(offsets, min(SLICE_BYTES, PIECE)):
        begin, end = int(offsets[a]), int(offsets[b])
        if end - begin <= PIECE:
            yield np.arange(a, b), data[begin:end], offsets[a : b + 1] - begin, 0
            continue
        for at in range(begin, end, PIECE):
            part = data[at : min(at + PIECE + LENGTH - 1, end)]
            yield np.array([a]), part, np.array([0, len(part)]), at - begin


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, uids = [], []
        for _rows, data, starts, _at in _pieces(batch.column(0)):
            _, _, key, uid = _units(data, starts)
            keys.append(key)
            uids.append(uid)
        if uids:
            uid, first, c = np.unique(np.concatenate(uids), return_index=True, return_counts=True)
            key = np.concatenate(keys)[first]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(uid.view(np.int64)), pa.array(c)], names=["key", "uid", "c"])


def _settled(docs: DataFrame) -> DataFrame:
    """(uid, whole, compare, crowd) of the units that occur twice or share their anchor."""
    parts = docs.select("text").mapInArrow(trimmed(_counted), "key long, uid long, c long")
    units = parts.repartition("key").groupBy("key", "uid").agg(F.sum("c").alias("c"))
    units = units.withColumn("u", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("c > 1 or u > 1")
    return units.select("uid", (F.col("c") > 1).alias("whole"), (F.col("u") > 1).alias("compare"), (F.col("u") > CROWD).alias("crowd"))


class _Table:
    """Settled units as sorted arrays: kind is 1 for whole, 2 for compare, 4 for crowd, summed; spans of compared ones."""

    def __init__(self, uid: np.ndarray, kind: np.ndarray, spans: list | None = None):
        order = np.argsort(uid)
        self.uid, self.kind = uid[order], kind[order]
        self.spans = [spans[i] for i in order] if spans is not None else None

    def places(self, uid: np.ndarray) -> np.ndarray:
        if not len(self.uid):
            return np.full(len(uid), -1)
        at = np.minimum(np.searchsorted(self.uid, uid), len(self.uid) - 1)
        return np.where(self.uid[at] == uid, at, -1)


_KIND = "cast(whole as int) + 2 * cast(compare as int) + 4 * cast(crowd as int)"
_UNIT = "array<struct<first:long,stop:long,key:long,uid:long,kind:int,spans:binary>>"


def _looked_up(texts: pa.Array, table: _Table, want: int) -> Iterator[tuple[int, int, int, int, int, int, bytes | None]]:
    """Row, first and last window, anchor code, unit, kind and spans of the units of a wanted kind."""
    for rows, data, starts, shift in _pieces(texts):
        first, stop, key, uid = _units(data, starts)
        at = table.places(uid)
        take = np.flatnonzero((at >= 0) & ((table.kind[np.maximum(at, 0)] & want) > 0)) if len(table.uid) else np.zeros(0, int)
        place = np.searchsorted(starts, first[take], side="right") - 1
        # empty texts share an offset: the unit belongs to the last of them
        base = shift - starts[place]
        for i, row, b in zip(take, rows[place], base, strict=True):
            j = at[i]
            spans = table.spans[j] if table.spans is not None else None
            yield int(row), int(first[i] + b), int(stop[i] + b), int(key[i]), int(uid[i]), int(table.kind[j]), spans


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, first, stop, key, uid) of every unit, for the shuffled way."""
    for batch in batches:
        row = batch.column(0).to_numpy()
        for rows, data, starts, shift in _pieces(batch.column(1)):
            first, stop, key, uid = _units(data, starts)
            place = np.searchsorted(starts, first, side="right") - 1
            base = shift - starts[place]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[rows[place]]), pa.array(first + base), pa.array(stop + base), pa.array(key.view(np.int64)), pa.array(uid.view(np.int64))],
                names=["row", "first", "stop", "key", "uid"],
            )


def _with_units(docs: DataFrame, table: DataFrame, kinds: int) -> DataFrame:
    """doc_id, text and the list of the document's units of a wanted kind, by joins. table: uid, kind, spans."""
    listed = docs.select("row", "text").mapInArrow(trimmed(_listed), "row long, first long, stop long, key long, uid long")
    found = listed.join(table.where(F.col("kind").bitwiseAND(kinds) > 0), "uid")
    lists = found.groupBy("row").agg(F.collect_set(F.struct("first", "stop", "key", "uid", "kind", "spans")).alias("units"))
    return docs.join(lists, "row", "left").select("doc_id", "text", F.col("units").cast(_UNIT))


def _units_of(batch: pa.RecordBatch, table: _Table | None, want: int) -> Iterator[tuple]:
    if table is not None:
        yield from _looked_up(batch.column(1), table, want)
        return
    for row, units in enumerate(batch.column(2).to_pylist()):
        for u in units or ():
            yield row, u["first"], u["stop"], u["key"] % 2**64, u["uid"] % 2**64, u["kind"], u["spans"]


def _contents(model):
    """(key, uid, at, content) of compared units, each content once per task; crowds divided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value if model is not None else None
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            held_row, held, out = -1, b"", []
            for row, first, stop, key, uid, kind, _ in _units_of(batch, table, 2):
                if uid in seen:
                    continue
                seen.add(uid)
                if row != held_row:
                    held_row, held = row, texts[row].as_py()
                content = held[first : stop + LENGTH]
                if not kind & 4:
                    out.append((key, uid, 0, content))
                    continue
                data = np.frombuffer(content, np.uint8)
                for a, b, k, _ in zip(*_units(data, np.array([0, len(data)]), (0, 1, 2)), strict=True):
                    out.append((int(k), uid, int(a), content[a : b + LENGTH]))
            if len(seen) > 1_000_000:
                seen = set()
            if out:
                key, uid, at, content = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(np.array(uid, np.uint64).view(np.int64)), pa.array(at, pa.int32()), pa.array(content, pa.binary())],
                    names=["key", "uid", "at", "content"],
                )

    return run


def _transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key to (uid, spans): runs of repeated windows within the unit, as pairs of 32-bit numbers."""

    def done(keys: list, uids: list, ats: list, contents: list) -> Iterator[pa.RecordBatch]:
        out = []
        for uid, at, starts in zip(uids, ats, bwt.repeats(contents, LENGTH), strict=True):
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) > 1)
                runs = np.stack((np.append(starts[0], starts[cut + 1]), np.append(starts[cut], starts[-1])), 1) + at
                out.append((uid, runs.astype("<i4").tobytes()))
        if out:
            uid, spans = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(spans, pa.binary())], names=["uid", "spans"])

    held: list[list] = [[], [], [], []]
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if size > BUCKET and row[0] != held[0][-1]:
                yield from done(*held)
                held, size = [[], [], [], []], 0
            for h, x in zip(held, row, strict=True):
                h.append(x)
            size += len(row[3]) + 1
    if held[0]:
        yield from done(*held)


def _merged(ranges: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"begin": a, "end": b})
    return out


def _cut(model):
    """doc_id, n_bytes, spans, kept of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value if model is not None else None
        for batch in batches:
            ranges: dict[int, list] = {}
            for row, first, stop, _key, _uid, kind, spans in _units_of(batch, table, 3):
                mine = ranges.setdefault(row, [])
                if kind & 1:
                    mine.append((first, stop + LENGTH))
                elif spans:
                    mine += [(first + int(a), first + int(b) + LENGTH) for a, b in np.frombuffer(spans, "<i4").reshape(-1, 2)]
            texts = batch.column(1).cast(pa.large_binary())
            for at in range(0, batch.num_rows, 500):
                part = range(at, min(at + 500, batch.num_rows))
                spans_, kept, size = [], [], []
                for row in part:
                    text = texts[row].as_py() or b""
                    runs = _merged(ranges.get(row, []))
                    edges = [0, *(x for r in runs for x in (r["begin"], r["end"])), len(text)]
                    spans_.append(runs)
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    size.append(len(text))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(size, pa.int64()), pa.array(spans_, _SPANS), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "spans", "kept"],
                )

    return run


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def without_repeats(docs: DataFrame, send: int = _SEND) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs of bytes, maximal), kept (the other bytes) of every document.

    ``send``: units that may be sent to all tasks; with more, units and texts meet by joins.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text")
    settled = materialize(_settled(docs), "settled")
    small = settled.count() <= send

    def table(df: DataFrame, spans: bool):
        got = df.selectExpr("uid", f"{_KIND} as kind", *(["spans"] if spans else [])).toArrow()
        own = got.column("spans").to_pylist() if spans else None
        return spark.sparkContext.broadcast(_Table(got.column("uid").to_numpy().view(np.uint64), got.column("kind").to_numpy(), own))

    narrow = docs.select("doc_id", "text")
    schema = "key long, uid long, at int, content binary"
    if small:
        contents = narrow.mapInArrow(trimmed(_contents(table(settled.where("compare"), False))), schema)
    else:
        kinds = settled.selectExpr("uid", f"{_KIND} as kind", "cast(null as binary) as spans")
        contents = _with_units(docs, kinds, 2).mapInArrow(trimmed(_contents(None)), schema)
    contents = contents.repartition("key").dropDuplicates(["key", "uid", "at"]).sortWithinPartitions("key")
    runs = contents.mapInArrow(trimmed(_transformed), "uid long, spans binary").groupBy("uid").agg(F.array_join(F.collect_list(F.hex("spans")), "").alias("h"))
    runs = materialize(runs.select("uid", F.unhex("h").alias("spans")), "spans")
    final = settled.join(runs, "uid", "left").where("whole or spans is not null")
    if small:
        return narrow.mapInArrow(trimmed(_cut(table(final, True))), "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")
    kinds = final.selectExpr("uid", f"{_KIND} as kind", "spans")
    return _with_units(docs, kinds, 3).mapInArrow(trimmed(_cut(None)), "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")
