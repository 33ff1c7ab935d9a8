"""Texts cut where no tokenizer of the library lets a token cross, so that what a tokenizer says of a part can be kept.

A cut stands before every space behind a character that is no white space. Byte-level pre-tokens hold a space only as
their first character, and no piece of the sentence-piece vocabulary has a space behind another character, so both treat
the parts alone as they do inside the text. Where the character before a space might be Unicode white space, no cut is
made: runs of white space stay whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ._hashing import byte_symbols, prefix, span_hash
from .vector_packing import _gather, _Store

#: ASCII white space, and the separators 1C-1F that some engines count in.
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Last bytes of Unicode white space in UTF-8, whose first bytes are C2, E1, E2 or E3.
_TAIL = np.zeros(256, bool)
_TAIL[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_HEAD = np.zeros(256, bool)
_HEAD[[0xE1, 0xE2, 0xE3]] = True
#: Parts and 32-bit numbers that a worker keeps; beyond either it starts again.
PARTS_KEPT = 600_000
NUMBERS_KEPT = 1 << 24


def white_end(raw: np.ndarray) -> np.ndarray:
    """Whether the character that ends at a byte is white space, or might be."""
    out = _WHITE[raw]
    tail = _TAIL[raw]
    out[1:] |= tail[1:] & (raw[:-1] == 0xC2)
    out[2:] |= tail[2:] & _HEAD[raw[:-2]]
    return out


def part_spans(raw: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the parts of the texts raw[where[i] : where[i + 1]]; an empty text has none."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.zeros(len(raw) + 1, bool)
    begins[1:-1] = (raw[1:] == 32) & ~white_end(raw)[:-1]
    begins[where] = True
    begins[-1] = False
    first = np.flatnonzero(begins)
    return first, np.append(first[1:], len(raw))


class PartCache:
    """Runs of 32-bit numbers by part, kept in one Python worker.

    learn(raw, first, last) gives a run, as little-endian bytes, for each part raw[first[i] : last[i]].
    """

    def __init__(self, learn: Callable[[np.ndarray, np.ndarray, np.ndarray], list[bytes]]):
        self.learn, self.store = learn, _Store()

    def runs(self, raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(flat, begin, size, part): the run of distinct part u is flat[begin[u] : begin[u] + size[u]]; part i is the distinct part[i]."""
        if len(self.store) > PARTS_KEPT or self.store.end > NUMBERS_KEPT:
            self.store = _Store()
        keys, at, part = np.unique(span_hash(prefix(byte_symbols(raw)), first, last), return_index=True, return_inverse=True)
        missed = np.flatnonzero(~self.store.find(keys)[0])
        if len(missed):
            self.store.add(keys[missed], self.learn(raw, first[at[missed]], last[at[missed]]))
        _, begin, size = self.store.find(keys)
        return self.store.flat, begin, size, part


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _gather(flat, begin, size)


class Joined:
    """Parts a tokenizer can take in one text: those that begin with a space and end in none. The rest go one by one."""

    def __init__(self, raw: np.ndarray, first: np.ndarray, last: np.ndarray):
        fits = (raw[first] == 32) & ~white_end(raw)[last - 1]
        self.together, self.alone = np.flatnonzero(fits), np.flatnonzero(~fits)
        self.raw, self.ends = gather(raw, first[self.together], (last - first)[self.together])


__all__ = ["Joined", "PartCache", "gather", "part_spans", "white_end"]
