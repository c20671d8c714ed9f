"""Sets of hashed word shingles of whole texts, computed on bytes with numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np

WORDS = 5
CHUNK = 1 << 18  # bytes that are hashed at a time; a longer text is a chunk of its own

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_MULTIPLIER = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        _powers[:] = made
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(texts: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    word = _mix((sums[end] - sums[start]) * down[start])
    limits = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(start, limits)
    grams = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
    for j in range(WORDS):
        grams += word[j : j + len(grams)] * _MULTIPLIER[j]
    grams = _mix(grams)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        elif b > a:
            short = (word[a:b] * _MULTIPLIER[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(_mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: Iterable[str | None]) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its 5-word shingles; of all its words if fewer; empty without."""
    out: list[np.ndarray] = []
    waiting: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "replace")
        if waiting and size + len(raw) > CHUNK:
            out += _hashed(waiting)
            waiting, size = [], 0
        waiting.append(raw)
        size += len(raw) + 1
    return out + (_hashed(waiting) if waiting else [])


def set_key(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
