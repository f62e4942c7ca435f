"""Hashed features of words: the word, its affixes and its byte n-grams."""

from __future__ import annotations

import numpy as np

from formline.llm import ragged

LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = LETTER[128:] = True


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z and the accented capitals of Latin-1, lower-cased byte for byte."""
    low = ragged.LOWER[data]
    if len(low) > 1:
        capital = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][capital] += 0x20
    return low


def distinct_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = LETTER):
    """Words of the texts: (spans, row, place of the word's type, types' starts, types' ends)."""
    starts, ends = ragged.runs(table[data], offsets)
    spans = ragged.Spans(data)
    _, first, place = np.unique(spans.hashes(starts, ends), return_index=True,
                                return_inverse=True)
    return spans, ragged.owner(offsets, starts), place, starts[first], ends[first]


def features(spans: ragged.Spans, starts: np.ndarray, ends: np.ndarray, bits: int,
             affixes: tuple[int, ...], grams: tuple[int, ...]
             ) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature number) pairs of the given words, without order."""
    sizes = ends - starts
    words, hashes = [np.arange(len(starts))], [spans.hashes(starts, ends) ^ np.uint64(1)]
    for n in affixes:
        long = np.flatnonzero(sizes >= n)
        words += [long, long]
        hashes += [spans.hashes(starts[long], starts[long] + n) ^ np.uint64(2 * n + 100),
                   spans.hashes(ends[long] - n, ends[long]) ^ np.uint64(2 * n + 101)]
    for n in grams:
        count = np.maximum(sizes - n + 1, 0)
        at = ragged.ranges(starts, count)
        words.append(np.repeat(np.arange(len(starts)), count))
        hashes.append(spans.hashes(at, at + n))
    number = ragged.mix(np.concatenate(hashes)) >> np.uint64(64 - bits)
    return np.concatenate(words), number.astype(np.int64)


def sums(words: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Sum of the rows of ``values`` per word."""
    return np.stack([np.bincount(words, values[:, k], count) for k in range(values.shape[1])],
                    axis=1)
