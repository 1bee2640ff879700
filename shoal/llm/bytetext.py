"""Words and their 64-bit hashes, straight from Arrow string buffers.

A word's hash is a polynomial over its bytes modulo 2**64, taken for all words at once from one
running sum, then mixed with its length. Texts are taken in chunks of a bounded size, whole texts
each, so that the arrays of eight bytes per byte stay small.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in the ranges, ends included."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: ASCII letters and digits, and all bytes of characters from U+0080 on.
ALNUM = byte_table((48, 57), (65, 90), (97, 122), (128, 255))
#: Everything but ASCII white space.
NONSPACE = ~byte_table((32, 32), (9, 13))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64 over all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64; only tables of a usual chunk are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 8192), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values and the n + 1 offsets; nulls count as empty."""
    arr = arr.cast(pa.large_string() if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_large_string(arr.type) else b"")
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def spans(offsets: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most chunk bytes each, or of one longer text."""
    n, low = len(offsets) - 1, 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + chunk, "right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high
        low = high


class Words(NamedTuple):
    low: int  # first row
    high: int  # row after the last
    hash: np.ndarray  # of each word, in order
    first: np.ndarray  # row low + i has the words first[i] to first[i + 1]


def words(arr: pa.Array, table: np.ndarray, chunk: int = CHUNK) -> Iterator[Words]:
    """Hashes of the words, runs of bytes in table, of A-Z lower-cased texts."""
    data, offsets = buffers(arr)
    for low, high in spans(offsets, chunk):
        at = offsets[low : high + 1] - offsets[low]
        text = np.insert(data[offsets[low] : offsets[high]], at[:-1], 32)  # a space stands before each text
        begin = at[:-1] + np.arange(high - low)
        inside = np.zeros(len(text) + 2, np.int8)
        inside[1:-1] = table[text]
        inside[1 + begin] = 0
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        running = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((LOWER[text].astype(np.uint64) + np.uint64(1)) * powers(BASE, len(text)), out=running[1:])
        h = (running[ends] - running[starts]) * powers(INVERSE, len(text) + 1)[starts]
        h = mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))
        yield Words(low, high, h, np.append(np.searchsorted(starts, begin), len(starts)))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words at each place; the last n - 1 places have none."""
    m = max(0, len(h) - n + 1)
    g = np.zeros(m, np.uint64)
    for i in range(n):
        g = mix(g * np.uint64(BASE) + h[i : i + m])
    return g
