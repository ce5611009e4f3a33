"""Word shingles of whole texts as 64-bit hashes, many texts at once.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased. All work is on the bytes of an Arrow string
column; texts are taken in slices of about SLICE bytes, a longer text alone in its slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


@lru_cache
def constants(n: int, seed: int, odd: bool = False) -> np.ndarray:
    """n 64-bit numbers from a fixed rule, read-only."""
    with np.errstate(over="ignore"):
        out = mix((np.arange(1, n + 1, dtype=_U) + _U(seed << 20)) * _U(0x9E3779B97F4A7C15))
    out = out | _U(1) if odd else out
    out.flags.writeable = False
    return out


_BASE = 0x9E3779B97F4A7C55
_powers: dict[str, np.ndarray] = {}


def _power_table(base: int, n: int, name: str) -> np.ndarray:
    """Powers of an odd base modulo 2^64, kept per process."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 2 * SLICE)
        out = np.ones(size, dtype=_U)
        done = 1
        while done < size:
            step = min(done, size - done)
            out[done : done + step] = out[:step] * _U(pow(base, done, 1 << 64))
            done += step
        _powers[name] = have = out
    return have[:n]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of consecutive rows; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        end = min(end, len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and the number of words before each row (one more entry than rows)."""
    return words_at(data, offsets)[:2]


def words_at(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As word_hashes, and where each word begins and ends in the bytes."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=_U), np.zeros(len(offsets), dtype=np.int64), none, none
    inside = ~_SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum((_LOWER[data].astype(_U) + _U(1)) * _power_table(_BASE, n, "up"), out=sums[1:])
        inverse = _power_table(pow(_BASE, -1, 1 << 64), n, "down")
        hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))
    return hashes, np.searchsorted(starts, offsets), starts, ends


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each row, sorted; a row of fewer words has the whole sequence as one."""
    factors = constants(width, 7, odd=True)
    with np.errstate(over="ignore"):
        every = np.zeros(max(0, len(words) - width + 1), dtype=_U)
        for k in range(width):
            every += words[k : k + len(every)] * factors[k]
        every = mix(every)
        for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(every[a : b - width + 1])
            elif b > a:
                yield mix(np.atleast_1d((words[a:b] * factors[: b - a]).sum(dtype=_U) + _U(b - a)))
            else:
                yield np.zeros(0, dtype=_U)


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row: its number of words and its set of shingle hashes."""
    for _, data, offsets in slices(column):
        words, counts = word_hashes(data, offsets)
        yield from zip(np.diff(counts).tolist(), shingle_hashes(words, counts, width), strict=True)


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit key of a whole set, from the sum of its mixed members and its size."""
    with np.errstate(over="ignore"):
        h = mix(np.atleast_1d(mix(s ^ _U(0xA5A5A5A55A5A5A5A)).sum(dtype=_U) + _U(len(s)) * _U(0x9E3779B97F4A7C15)))
    return int(h.view(np.int64)[0])
