"""Vectorised Karp-Rabin hashing of words and word windows (numpy, modulo 2**64)."""

from __future__ import annotations

import numpy as np

_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LUT = np.zeros(256, np.uint8)
_LUT[ord("0") : ord("9") + 1] = np.arange(1, 11)
_LUT[ord("a") : ord("z") + 1] = np.arange(11, 37)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n; odd numbers have an inverse modulo 2**64."""
    key = int(base)
    if key not in _POWERS or len(_POWERS[key][0]) < n:
        n = max(n, 1 << 16)
        inverse = np.uint64(pow(key, -1, 1 << 64))
        with np.errstate(over="ignore"):
            up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x, np.uint64)]), dtype=np.uint64) for x in (base, inverse))
        _POWERS[key] = (up, down)
    up, down = _POWERS[key]
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def order(hashes: np.ndarray) -> np.ndarray:
    """The stable order of hashes (uint64): sorted as values with the position in the low bits, where the other bits tell all apart."""
    low = np.uint64((1 << len(hashes).bit_length()) - 1)
    keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    keys.sort()
    out = (keys & low).astype(np.int64)
    found = hashes[out]
    if ((found[1:] != found[:-1]) & ((found[1:] & ~low) == (found[:-1] & ~low))).any():
        return np.argsort(hashes, kind="stable")
    return out


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the folded texts in order, and where each text's words begin (len(texts) + 1 offsets)."""
    blob = np.frombuffer(b"\n".join([*texts, b""]), np.uint8) if texts else np.zeros(0, np.uint8)
    starts_of = np.cumsum([0, *(len(t) + 1 for t in texts)])
    codes = _LUT[blob]
    inside = np.concatenate([[False], codes > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[0::2], edges[1::2]
    up, down = _powers(_B1, len(codes) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * up[: len(codes)], dtype=np.uint64)])
        out = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return out, np.searchsorted(begin, starts_of)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(_B2, len(hashes) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])
        return mix((sums[k:] - sums[:-k]) * down[:n] + np.uint64(k))
