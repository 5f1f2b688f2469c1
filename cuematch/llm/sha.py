"""SHA-256 of many messages at once, with states that can be kept and resumed.

A message here is a row of 64-byte blocks, such as hex digests. A state is what
the hash has kept after whole blocks: eight 32-bit words.
"""

from __future__ import annotations

import numpy as np

CHUNK = 8192


def _primes(n: int) -> list[int]:
    found: list[int] = []
    x = 2
    while len(found) < n:
        if all(x % p for p in found):
            found.append(x)
        x += 1
    return found


def _root_bits(x: int, power: int) -> int:
    """The first 32 bits after the point of a root of x."""
    big, low, high = x << (32 * power), 0, 1 << 40
    while low < high - 1:
        mid = (low + high) // 2
        low, high = (mid, high) if mid**power <= big else (low, mid)
    return low & 0xFFFFFFFF


START = np.array([_root_bits(p, 2) for p in _primes(8)], np.uint32)
_ROUND = np.array([_root_bits(p, 3) for p in _primes(64)], np.uint32)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    words = list(block.T.astype(np.uint32))
    a, b, c, d, e, f, g, h = state.T.copy()
    for i in range(64):
        if i >= 16:
            x, y = words[i - 15], words[i - 2]
            s0 = _turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))
            s1 = _turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))
            words.append(words[i - 16] + s0 + words[i - 7] + s1)
        t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[i] + words[i]
        u = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        h, g, f, e, d, c, b, a = g, f, e, d + t, c, b, a, t + u
    return state + np.stack([a, b, c, d, e, f, g, h], axis=1)


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (n, 8) after one more block each, given as (n, 16) words."""
    parts = [_absorb(state[i : i + CHUNK], block[i : i + CHUNK]) for i in range(0, len(state), CHUNK)]
    return np.concatenate(parts) if parts else state


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 32) of messages of so many whole blocks."""
    last = np.zeros((len(state), 16), np.uint32)
    last[:, 0] = 0x80000000
    last[:, 15] = np.asarray(blocks) * 512
    return as_bytes(absorb(state, last))


def as_bytes(state: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(state.astype(">u4")).view(np.uint8).reshape(-1, 32)


def as_state(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data).view(">u4").reshape(-1, 8).astype(np.uint32)


def hex_text(digest: np.ndarray) -> np.ndarray:
    """(n, 64) characters of digests (n, 32)."""
    out = np.empty((len(digest), 64), np.uint8)
    out[:, 0::2], out[:, 1::2] = _HEX[digest >> 4], _HEX[digest & 15]
    return out


def hex_block(digest: np.ndarray) -> np.ndarray:
    """Digests (n, 32) as hex text, one block (n, 16) each."""
    return np.ascontiguousarray(hex_text(digest)).view(">u4").reshape(-1, 16).astype(np.uint32)
