"""Hashes of words and of runs of words, for whole batches of texts at a time.

A run's hash is a polynomial in an odd base modulo 2^64; a prefix sum and the inverse powers of the base give it for every start in
a few vector steps. Words are what the six ASCII white spaces leave.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASES = ((0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15), (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
"""For each of two independent hashes: the base over bytes and the base over words."""
SLICE = 1 << 18
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=16)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i below 2^bits."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(1 << bits, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for every pair."""
    forth, back = _powers(base, max(4, int(len(values)).bit_length()))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * forth[:len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts])


class Words:
    """The words of a batch of texts: ``doc`` gives each word's text, ``first`` each text's first word (and the end)."""

    def __init__(self, texts: list[bytes], hashes: int = 2) -> None:
        data = b"\n".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        parts: list[list[np.ndarray]] = [[] for _ in range(hashes)]
        places = []
        at = 0
        while at < len(data):
            stop = min(at + SLICE, len(data))
            while stop < len(data) and not _BLANK[data[stop]]:
                stop += 1
            raw = np.frombuffer(data, np.uint8, stop - at, at)
            word = np.concatenate([[False], ~_BLANK[raw], [False]])
            edge = np.flatnonzero(word[1:] != word[:-1])
            starts, ends = edge[::2], edge[1::2]
            values = raw.astype(np.uint64) + np.uint64(1)
            for k in range(hashes):
                parts[k].append(runs(values, starts, ends, BASES[k][0]))
            places.append(starts + at)
            at = stop
        self.hash = [np.concatenate(p) if p else np.zeros(0, np.uint64) for p in parts]
        start = np.concatenate(places) if places else np.zeros(0, np.int64)
        self.first = np.concatenate([np.searchsorted(start, begin), [len(start)]])
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.doc)

    def windows(self, size: int, which: int = 0) -> np.ndarray:
        """Hash of ``size`` words from each word on, as far as the batch has that many; see ``inside``."""
        n = max(len(self) - size + 1, 0)
        starts = np.arange(n)
        return runs(self.hash[which], starts, starts + size, BASES[which][1])

    def inside(self, size: int) -> np.ndarray:
        """Whether ``size`` words from each word on belong to one text."""
        n = max(len(self) - size + 1, 0)
        return self.doc[:n] == self.doc[len(self) - n:]


def slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` consecutive values."""
    have = 1
    out = values
    while have * 2 <= width:
        out = pick(out[:-have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    rest = width - have
    return (pick(out[:-rest], out[rest:]) if len(out) > rest else out[:0]) if rest else out
