"""Word shingles of many texts at once, as 64-bit hashes, by numpy over the texts' bytes."""

from __future__ import annotations

import numpy as np

WORDS = 5

_rng = np.random.default_rng(20240229)
#: A random value a byte; A-Z have those of a-z.
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_PLACE = _rng.integers(0, 1 << 63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    """Powers of the base modulo 2**64, as many as the longest word met so far (of up to 2**16 bytes) needed."""
    global _powers
    if len(_powers) >= n:
        return _powers
    made = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(1 << n.bit_length(), _BASE, np.uint64)]))
    if n <= 1 << 16:
        _powers = made
    return made


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """For each text its distinct shingles, sorted: words are runs of anything but ASCII white space, lower-cased in A-Z.

    A text of fewer than five words has its whole sequence as one shingle; one without words has none.
    """
    data = [t.encode() for t in texts]
    raw = np.frombuffer(b"\n".join(data), np.uint8)
    if not len(raw):
        return [np.empty(0, np.uint64) for _ in texts]
    space = np.concatenate([[True], _SPACE[raw], [True]])
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    n = len(starts)
    if not n:
        return [np.empty(0, np.uint64) for _ in texts]
    sizes = ends - starts
    at = np.cumsum(sizes) - sizes
    place = np.arange(1, int(sizes.sum()) + 1)
    place -= np.repeat(at, sizes)
    values = _BYTE[raw[~space[1:-1]]]
    values *= _power(int(sizes.max()) + 1)[place]
    words = mix(np.add.reduceat(values, at))
    if n >= WORDS:
        rolled = words[: n - WORDS + 1] * _PLACE[0]
        for k in range(1, WORDS):
            rolled = rolled + words[k : n - WORDS + 1 + k] * _PLACE[k]
        rolled = mix(rolled)
    first = np.searchsorted(starts, np.cumsum([0, *(len(d) + 1 for d in data)]))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            few = np.append(words[a:b], np.uint64(b - a)) * np.append(_PLACE[: b - a], _PLACE[WORDS])
            out.append(mix(few.sum(keepdims=True, dtype=np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


class MinHash:
    """``size`` min-hash values of ``bits`` = 16 bits each; two sets agree in one with their Jaccard similarity."""

    def __init__(self, size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = size
        self.a = rng.integers(0, 1 << 31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, size, dtype=np.uint32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)[:, None]
        low = np.full(self.size, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 2048):
            low = np.minimum(low, (x[i : i + 2048] * self.a + self.b).min(axis=0))
        return (low & np.uint32(0xFFFF)).astype("<u2")
