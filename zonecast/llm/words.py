"""The words of many texts at once, as arrays, and their hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Powers that tell a word's bytes by their place; beyond 65,536 bytes they begin anew.
_POWERS = np.cumprod(np.full(1 << 16, _ODD, np.uint64), dtype=np.uint64)
_VALUES = np.cumsum(np.full(256, _MIX, np.uint64), dtype=np.uint64)
_VALUES = (_VALUES ^ _VALUES >> np.uint64(30)) * _ODD
_VALUES = _VALUES ^ _VALUES >> np.uint64(27)


def lower_bytes() -> np.ndarray:
    """Each byte, A-Z as a-z."""
    out = np.arange(256, dtype=np.uint8)
    out[0x41:0x5B] += 32
    return out


LOWER = lower_bytes()


@dataclass(frozen=True)
class Words:
    """The words of several texts: ``data`` holds their bytes without what lies between, ``cut`` the n + 1 offsets of words
    in it, ``first`` the n_texts + 1 offsets of texts in the words, ``start`` and ``stop`` where a word lies in the input."""
    data: np.ndarray
    cut: np.ndarray
    first: np.ndarray
    start: np.ndarray
    stop: np.ndarray

    def hashes(self) -> np.ndarray:
        """64 bits a word."""
        if not len(self.data):
            return np.zeros(0, np.uint64)
        place = np.arange(len(self.data), dtype=np.int32 if len(self.data) < 1 << 31 else np.int64)
        place -= np.repeat(self.cut[:-1].astype(place.dtype), np.diff(self.cut))
        h = _POWERS[place & 0xFFFF]
        del place
        h *= _VALUES[self.data]
        h = np.add.reduceat(h, self.cut[:-1])
        return (h ^ h >> np.uint64(29)) * _MIX


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """The words of the texts that ``offsets`` bounds in ``data``: runs of bytes b with ``inside[b]``, in lower case."""
    within = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(within & (edge[:-1] | ~np.concatenate([[False], within[:-1]])))
    stop = np.flatnonzero(within & (edge[1:] | ~np.concatenate([within[1:], [False]]))) + 1
    return Words(LOWER[data[within]], np.concatenate([[0], np.cumsum(stop - start)]), np.searchsorted(start, offsets), start, stop)
