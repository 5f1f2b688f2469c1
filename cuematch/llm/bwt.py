"""Repeated strings of a set of byte strings, from a Burrows-Wheeler transform, in numpy.

Common prefixes of neighbouring suffixes are derived in order of increasing
length: breadth-first, the interval of a string w is extended backward to the
intervals of all cw through the last-to-first map, and the right end of a new
interval, seen first at length l, has common prefix l. Each end is set once, so
the work does not grow with the lengths. The expansion stops at the wanted
length; ends that are still open then have a longer common prefix.
"""

from __future__ import annotations

import numpy as np


def _by_key(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of their keys of so many bits, and the keys in that order.

    Numbers sort several times faster than positions by numbers: where both fit 63 bits
    they are sorted as one number.
    """
    low = len(key).bit_length()
    if bits + low > 63:
        order = np.argsort(key)
        return order, key[order]
    both = np.sort((key << low) | np.arange(len(key)))
    return both & ((1 << low) - 1), both >> low


def _sorted_suffixes(sym: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of their first ``depth`` symbols (or a few more), the text taken as a ring."""
    n = len(sym)
    code = np.cumsum(np.bincount(sym) > 0) - 1
    width = max(1, int(code[-1]).bit_length())
    code = code[sym]
    h = max(1, (63 - n.bit_length()) // width)
    bits, key = h * width, np.zeros(n, np.int64)
    for j in range(h):
        key = (key << width) | np.roll(code, -j)
    while True:
        order, key = _by_key(key, bits)
        run = np.append(False, key[1:] != key[:-1]).cumsum()
        if h >= depth or run[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = run
        width = int(run[-1]).bit_length()
        bits, key, h = 2 * width, (rank << width) | np.roll(rank, -h), 2 * h


def repeats(strings: list[bytes], length: int) -> list[np.ndarray]:
    """Per string, the starts of its substrings of ``length`` bytes that start anywhere else in the strings as well."""
    sizes = np.array([len(s) for s in strings], np.int64)
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
    begin = np.cumsum(sizes + 1) - sizes - 1
    data[begin + sizes] = 0
    n = len(data)
    order = _sorted_suffixes(data, length)
    last = data[order - 1]  # the transform; place 0 has the ring's last symbol before it
    by = np.argsort(last.astype(np.uint16), kind="stable")  # numbers of 16 bits are sorted by counting
    back, front = np.empty(n, np.int64), last[by]
    back[by] = np.arange(n)
    known = np.zeros(n + 1, bool)  # right ends whose common prefix is below the level
    known[[0, n]] = True
    lo, hi = np.zeros(1, np.int64), np.full(1, n - 1)
    for _level in range(length):
        size = hi - lo + 1
        parent = np.repeat(np.arange(len(lo)), size)
        at = np.arange(len(parent)) - np.repeat(np.cumsum(size) - size, size) + lo[parent]
        both = np.sort((back[at] << 32) | parent)
        to, parent = both >> 32, both & 0xFFFFFFFF
        symbol = front[to]
        edge = np.flatnonzero((parent[1:] != parent[:-1]) | (symbol[1:] != symbol[:-1]))
        first, end = np.append(0, edge + 1), np.append(edge, len(to) - 1)
        lo, hi = to[first], to[end]
        new = ~known[hi + 1]
        lo, hi = lo[new], hi[new]
        known[hi + 1] = True
        if not len(lo):
            break
    shared = np.flatnonzero(~known[:n])
    again = np.zeros(n, bool)
    again[order[shared]] = True
    again[order[shared - 1]] = True
    return [np.flatnonzero(again[b : b + max(s - length + 1, 0)]) for b, s in zip(begin, sizes, strict=True)]
