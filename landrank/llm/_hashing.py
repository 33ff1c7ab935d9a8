"""Rolling hashes over words and bytes, whole batches at a time in numpy.

A run of symbols x0..xn hashes to sum(x_i * R**i) mod 2**64, taken from one prefix sum: subtracting two sums and
multiplying by R**-start gives the same value wherever the run stands. Symbols go through a random table (bytes) or a
mixer (words) first, and results are mixed again, so any bits of them may be used.
"""

from __future__ import annotations

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 2**64))
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words of letters and digits: [0-9a-z] after lower-casing, and every byte of a non-ASCII character.
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = True
_ALNUM[128:] = True
#: Powers of a slice; those of later slices are these times one number a slice, so tables do not grow with texts.
_SLICE = 1 << 16


def _slice_powers(r: np.uint64) -> np.ndarray:
    steps = np.full(_SLICE, r, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_POWER, _INVERSE = _slice_powers(_R), _slice_powers(_R_INV)


def _slice_steps(r: np.uint64, n: int) -> np.ndarray:
    """r ** (_SLICE * i) for the slices that n symbols take."""
    steps = np.full(n // _SLICE + 1, pow(int(r), _SLICE, 2**64), np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _scaled(x: np.ndarray, powers: np.ndarray, r: np.uint64) -> np.ndarray:
    """x[i] * r**i, slice by slice."""
    out = np.empty(len(x), np.uint64)
    for i, step in zip(range(0, len(x), _SLICE), _slice_steps(r, len(x)), strict=False):
        part = x[i : i + _SLICE]
        np.multiply(part, powers[: len(part)], out=out[i : i + len(part)])
        if i:
            out[i : i + len(part)] *= step
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, a bijection on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums S with S[0] = 0 for span_hash."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(_scaled(symbols, _POWER, _R), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    value = (sums[end] - sums[start]) * _INVERSE[start & (_SLICE - 1)]
    if len(sums) > _SLICE:
        value *= _slice_steps(_R_INV, len(sums))[start // _SLICE]
    return mix(value)


def window_hash(symbols: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive symbols."""
    if len(symbols) < n:
        return np.zeros(0, np.uint64)
    sums = prefix(symbols)
    return mix(_scaled(sums[n:] - sums[: len(symbols) - n + 1], _INVERSE, _R_INV))


def byte_symbols(raw: np.ndarray) -> np.ndarray:
    return _BYTE[raw]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    if len(x) < w:
        return x[:0]
    have, m = 1, x
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < w:
        m = np.minimum(m[: len(x) - w + 1], m[w - have :])
    return m


def lower(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def word_spans(raw: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that belong to words."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = member[raw]
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


NOT_SPACE, ALNUM = ~_SPACE, _ALNUM
