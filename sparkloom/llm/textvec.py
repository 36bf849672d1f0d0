"""Whole batches of UTF-8 text as numpy arrays: word spans and 64-bit word hashes without a Python step per word."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Odd multiplier of the rolling hash; its inverse modulo 2**64 shifts a span back to position 0.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

#: Bytes that part words: space, and tab to carriage return.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


BYTE_VALUE = _byte_values()


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, BASE, dtype=np.uint64)
    down = np.full(n, INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True within every row, and for each row the index of its first run (n + 1)."""
    if not len(inside):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offsets] = True
    left = np.ones(len(inside), dtype=bool)
    left[1:] = ~inside[:-1]
    right = np.ones(len(inside), dtype=bool)
    right[:-1] = ~inside[1:]
    starts = np.flatnonzero(inside & (left | edge[:-1]))
    ends = np.flatnonzero(inside & (right | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row, as ``spans`` gives them."""
    return spans(~SEPARATOR[data], offsets)


def totals(data: np.ndarray) -> np.ndarray:
    """Rolling sums that ``span_hash`` takes differences of."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(len(data) + 1)[0][: len(data)], out=total[1:])
    return total


def span_hash(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((total[ends] - total[starts]) * powers(len(total))[1][starts])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, A-Z taken as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return span_hash(totals(data), starts, ends)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of k consecutive words, sorted; fewer words make one shingle, none make none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    width = min(k, len(words))
    h = np.full(len(words) - width + 1, np.uint64(width * 0x2545F4914F6CDD1D & (2**64 - 1)))
    for i in range(width):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - width + 1 + i])
    return np.unique(h)
