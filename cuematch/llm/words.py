"""Words of whole texts as 64-bit numbers, for tasks that hold Arrow batches.

A word is a run of bytes other than space and U+0009 to U+000D; A-Z count as
a-z. Everything works on the UTF-8 bytes of many texts at once. Slices keep the
temporary arrays small, whatever the batch; a single longer text is a slice of
its own and is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATORS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
SLICE_BYTES = 2 << 20

_rng = np.random.default_rng(20240611)
_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_CODES = BYTE_CODES[_LOWER]
_STEP = np.uint64(0x9E3779B97F4A7C13)
_ORDER = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same function of batches; at its end freed memory goes back to the system.

    Workers are used again by later stages, beside an executor that has grown.
    """

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)

    return inner


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers spread over all 64 bits (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the n + 1 offsets of the texts; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def powers(n: int, base: np.uint64 = _STEP) -> np.ndarray:
    """base ** 0, 1, ... n - 1, modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and the number of words of each text.

    ``starts`` are the n + 1 offsets of the texts within ``data``.
    """
    inside = ~_IS_SEPARATOR[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = starts[(starts > 0) & (starts < len(data))]
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1, np.diff(np.searchsorted(begin, starts))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of the texts in order, as hashes, and the number of words of each text."""
    data = data[offsets[0] : offsets[-1]]
    begin, end, counts = word_bounds(data, offsets - offsets[0])
    if not len(begin):
        return np.zeros(0, np.uint64), counts
    length = end - begin
    edges = np.concatenate(([0], begin, [len(data)]))
    at = np.arange(len(data)) - np.repeat(edges[:-1], np.diff(edges))
    power = powers(int(max(at.max() + 1, 1)))
    value = _WORD_CODES[data] * power[at]
    value[_IS_SEPARATOR[data]] = 0
    return mixed(np.add.reduceat(value, begin) + length.astype(np.uint64) * _ORDER[63]), counts


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row, and each one's text; a text of fewer words gives all its words as one."""
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    left = counts[text] - order
    code = np.zeros(len(words), np.uint64)
    for j in range(k):
        n = len(words) - j
        if n > 0:
            code[:n] += np.where(left[:n] > j, words[j:] * _ORDER[j], np.uint64(0))
    whole = (left >= k) | (order == 0)
    code += np.minimum(left, k).astype(np.uint64) * _ORDER[62]
    return mixed(code[whole]), text[whole]


def distinct(codes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct codes, sorted within the text."""
    order = np.lexsort((codes, text))
    codes, text = codes[order], text[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (text[1:] != text[:-1])
    return codes[new], text[new]
