"""Ragged numpy arrays over the bytes of a text column, for use inside Arrow batches.

A batch is walked in chunks of whole rows with about ``CHUNK_BYTES`` bytes, so that memory
depends on the longest single text and not on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + CHUNK_BYTES // 4)
        for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 2**64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


class Spans:
    """64-bit hashes of any byte ranges of ``data``, equal for equal bytes."""

    def __init__(self, data: np.ndarray, numbers: np.ndarray = _BYTE):
        """``numbers`` of the 256 bytes; other ones give other, independent hashes."""
        up, self._down = _power(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(numbers[data] * up[:-1], out=self._sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(raw ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES
                ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of consecutive rows; NULL counts as an empty text."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(
        column.type) else np.int32
    rows = len(column)
    if not rows:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=kind)[column.offset:column.offset + rows + 1].astype(
        np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield (first, offsets[first:last + 1] - offsets[first],
               data[offsets[first]:offsets[last]])
        first = last


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a run never crosses a text's end."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(mask)
    before[0] = False
    before[1:] = mask[:-1]
    inner = offsets[:-1][offsets[:-1] < len(mask)]
    before[inner] = False
    after = np.empty_like(mask)
    after[-1] = False
    after[:-1] = mask[1:]
    after[inner[inner > 0] - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def owner(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Row of each range."""
    return np.searchsorted(offsets, starts, "right") - 1


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(start, start + length)``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - begin, lengths)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, lower-case letters and everything beyond ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def words(offsets: np.ndarray, data: np.ndarray
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of the words of lower-cased (A-Z) texts, in order."""
    low = LOWER[data]
    starts, ends = runs(WORD[low], offsets)
    return Spans(low).hashes(starts, ends), owner(offsets, starts), starts, ends


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
