"""Polynomial hashes of substrings of a byte array, in numpy."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
_powers: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n, kept for reuse."""
    have = _powers.get("p")
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 20)
        out = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            p[1:] = base
            out.append(np.multiply.accumulate(p))
        _powers["p"] = have = tuple(out)
    return have[0][:n + 1], have[1][:n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix(raw: np.ndarray, salt: int = 1) -> np.ndarray:
    """Prefix sums P with P[i] over the first i bytes."""
    p, _ = powers(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(salt)) * p[:-1], out=out[1:])
    return out


def substrings(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of each raw[start:end]; equal bytes give equal hashes wherever they are."""
    _, inverse = powers(len(pre) - 1)
    return mix((pre[end] - pre[start]) * inverse[start] + (end - start).astype(np.uint64))
