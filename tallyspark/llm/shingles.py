"""Word shingles of many texts at once, as 64-bit hashes, with numpy.

Words are runs of bytes other than ASCII white space; the letters A to Z are lower-cased first. A word's hash is a
polynomial over its bytes, a shingle's hash a mix of its words' hashes in order, so no text is ever cut up in Python.
"""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTES = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_STEP = 1 << 16


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    out = np.ones(n, np.uint64)
    out[1:] = base & (1 << 64) - 1
    return np.multiply.accumulate(out)


_UP = powers(_BASE, _STEP)
_DOWN = powers(pow(_BASE, -1, 1 << 64), _STEP)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each of the words flat[begin:end], A to Z lower-cased."""
    sums = np.zeros(len(flat) + 1, np.uint64)
    if len(flat) <= _STEP:
        up, down = _UP[: len(flat)], _DOWN
    else:  # a word that crosses a multiple of _STEP still has one weight per place
        turns = -(-len(flat) // _STEP)
        big = powers(pow(_BASE, _STEP, 1 << 64), turns)
        up = (_UP[None, :] * big[:, None]).ravel()[: len(flat)]
        down = _DOWN
    np.cumsum(_BYTES[_LOWER[flat]] * up, out=sums[1:])
    value = sums[end] - sums[begin]
    if len(flat) > _STEP:
        back = powers(pow(pow(_BASE, _STEP, 1 << 64), -1, 1 << 64), -(-len(flat) // _STEP))
        value = value * back[begin // _STEP]
    return mix(value * down[begin % _STEP] + (end - begin).astype(np.uint64))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, and where each text's words start (one more entry at the end)."""
    flat = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(_BLANK[flat].view(np.int8), prepend=1))
    begin, end = edge[::2], edge[1::2]
    value = hashed(flat, begin, end)
    bounds = np.cumsum([0, *(len(x) + 1 for x in texts)])
    return value, np.searchsorted(begin, bounds)


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of `size` words, in order, and where each text's shingles start.

    A text of fewer words is one shingle as a whole; a text without words has none.
    """
    value, start = words(texts)
    count = np.diff(start)
    made = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    first = np.cumsum(made) - made
    at = np.repeat(start[:-1] - first, made) + np.arange(int(made.sum()))
    limit = np.repeat(start[1:], made)
    out = np.zeros(len(at), np.uint64)
    padded = np.append(value, np.zeros(size, np.uint64))
    for k in range(size):
        here = np.where(at + k < limit, padded[at + k], np.uint64(k + 1))
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + here)
    return out, np.append(first, len(at))


def distinct(hashes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes sorted, without repeats, and where they start."""
    owner = np.repeat(np.arange(len(start) - 1), np.diff(start))
    order = hashes.copy()
    for a, b in zip(start[:-1], start[1:], strict=True):
        order[a:b].sort()
    new = np.ones(len(order), bool)
    new[1:] = (order[1:] != order[:-1]) | (owner[1:] != owner[:-1])
    return order[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(start) - 1))])
