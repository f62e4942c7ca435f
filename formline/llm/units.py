"""Texts cut into space-led units, so that each distinct unit is encoded once.

A boundary is a single space between two characters that are not white space; the space leads
the unit on its right.  No piece of a byte-level pre-tokeniser or of a word-boundary vocabulary
reaches over such a boundary, so the ids of a text are those of its units one after the other.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from formline.llm import ragged

#: Longer units are never looked up, always encoded.
LONGEST = 256
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[*range(0, 33), 127]] = True
#: Lead bytes with second bytes under which the white space beyond ASCII lies.
_LEADS = {0xC2: (0x85, 0xA0), 0xE1: (0x9A,), 0xE2: (0x80, 0x81), 0xE3: (0x80,)}


def _maybe_white(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first), dtype=bool)
    for lead, seconds in _LEADS.items():
        out |= (first == lead) & np.isin(second, seconds)
    return out


def cut(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the units of every text, in order."""
    n = len(data)
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[4:4 + n] = data
    at = np.flatnonzero(data == 32)
    left = padded[at + 3]
    ok = ~_WHITE[left] & ~_WHITE[padded[at + 5]]
    at = at[ok]
    two, three = (padded[at + 2], padded[at + 3]), (padded[at + 1], padded[at + 2])
    at = at[~(_maybe_white(*two) | _maybe_white(*three)
              | _maybe_white(padded[at + 5], padded[at + 6]))]
    full = offsets[1:] > offsets[:-1]
    mark = np.zeros(n, dtype=bool)
    mark[at] = True
    # A space that starts a text, or ends one, is no boundary of its own.
    mark[offsets[1:][full] - 1] = False
    mark[offsets[:-1][full]] = True
    starts = np.flatnonzero(mark)
    ends = np.append(starts[1:], n)
    return ragged.owner(offsets, starts), starts, ends


class Cache:
    """Ids of units by the hash of their bytes; forgotten as a whole when half full.

    The hashes stand in an open-addressing table: many are looked up at once, slot by slot.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]],
                 bits: int = 22):
        self.encode, self.bits = encode, bits
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.place = np.zeros(1 << self.bits, np.int32)
        self.start = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int32)
        self.ids = np.zeros(4096, np.int32)
        self.units = self.used = 0

    def _slot(self, hashes: np.ndarray, probe: int) -> np.ndarray:
        return ((hashes + np.uint64(probe)) & np.uint64((1 << self.bits) - 1)).view(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each unit, or -1."""
        slot = self._slot(hashes, 0)
        there = self.keys[slot]
        out = np.where(there == hashes, self.place[slot], -1).astype(np.int64)
        todo = np.flatnonzero((there != hashes) & (there != 0))
        probe = 1
        while len(todo):
            slot = self._slot(hashes[todo], probe)
            there = self.keys[slot]
            hit = there == hashes[todo]
            out[todo[hit]] = self.place[slot[hit]]
            todo = todo[~hit & (there != 0)]
            probe += 1
        return out

    def _put(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Enter units that are not there yet; all hashes differ."""
        todo, probe = np.arange(len(hashes)), 0
        while len(todo):
            slot = self._slot(hashes[todo], probe)
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[todo[free]]
            own = self.keys[slot] == hashes[todo]
            self.place[slot[own]] = numbers[todo[own]]
            todo = todo[~own]
            probe += 1

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        number = np.arange(self.units, self.units + len(sizes))
        while len(self.size) < self.units + len(sizes):
            self.start = np.resize(self.start, 2 * len(self.start))
            self.size = np.resize(self.size, 2 * len(self.size))
        while len(self.ids) < self.used + len(ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.start[number] = self.used + np.cumsum(sizes) - sizes
        self.size[number] = sizes
        self.ids[self.used:self.used + len(ids)] = ids
        self.units += len(sizes)
        self.used += len(ids)
        return number

    def texts(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of every text)."""
        rows = len(offsets) - 1
        row, starts, ends = cut(offsets, data)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        if 2 * (self.units + len(starts)) > 1 << self.bits:
            self.clear()
            while 2 * len(starts) > 1 << self.bits:  # one very long text
                self.bits += 1
                self.clear()
        hashes = ragged.Spans(data).hashes(starts, ends) | np.uint64(1)
        long = np.flatnonzero(ends - starts > LONGEST)
        hashes[long] = ragged.mix(hashes[long] ^ long.astype(np.uint64)) | np.uint64(1)
        number = self._find(hashes)
        number[long] = -1
        missing = np.flatnonzero(number < 0)
        if len(missing):
            distinct, first, inverse = np.unique(hashes[missing], return_index=True,
                                                 return_inverse=True)
            raw, first = data.tobytes(), missing[first]
            units = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(),
                                              strict=True)]
            added = self._add(*self.encode(units))
            number[missing] = added[inverse]
            short = ends[first] - starts[first] <= LONGEST
            self._put(distinct[short], added[short])
        sizes = self.size[number].astype(np.int64)
        return (self.ids[ragged.ranges(self.start[number], sizes)],
                np.bincount(row, sizes, rows).astype(np.int64))
