"""Vectorised word splitting and rolling hashes over Arrow text columns.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``, which is what
``bytes.split()`` gives.  UTF-8 never uses those byte values inside a longer
character, so splitting bytes and splitting characters agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy step works on; its arrays take about 40 times that.
SLICE_BYTES = 1_000_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Gaps that leave lines instead of words.
LINE_ENDS = np.zeros(256, dtype=bool)
LINE_ENDS[[10, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: 1 for ASCII letters, 2 for marks that never belong to one.
_GROUP = np.zeros(256, dtype=np.int8)
_GROUP[65:91] = _GROUP[97:123] = 1
_GROUP[list(b".,;:!?")] = 2


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: close inputs end up far apart."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words(NamedTuple):
    """Words of consecutive texts: their 64-bit hashes, byte ranges in ``data``, and where each text's words begin."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    data: np.ndarray


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null text counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes each; a longer text stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = b


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool, gaps: np.ndarray = _SPACE, at_marks: bool = False) -> Words:
    """Splits texts ``offsets[i]:offsets[i+1]`` of ``data`` at the bytes marked in ``gaps`` and hashes each word.

    With ``at_marks`` words are also cut between ASCII letters and the marks ``.,;:!?``.
    """
    base = offsets[0]
    part = data[base : offsets[-1]]
    if lower:
        part = _LOWER[part]
    ends_at = offsets - base
    n = len(part)
    inside = np.zeros(n + 2, dtype=np.int8)
    inside[1:-1] = ~gaps[part]
    # A text's end also ends its last word: starts and ends are told apart per text.
    step = np.diff(inside)
    start_flag, end_flag = step[:n] == 1, step[1:] == -1
    inner = ends_at[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    joined = inner[(inside[inner] == 1) & (inside[inner + 1] == 1)]
    if at_marks:
        group = _GROUP[part]
        joined = np.concatenate([joined, np.flatnonzero(group[1:] + group[:-1] == 3) + 1])
    start_flag[joined] = True
    end_flag[joined - 1] = True
    starts = np.flatnonzero(start_flag)
    ends = np.flatnonzero(end_flag) + 1
    power = _powers(_BASE, n)
    power *= _BYTE_VALUES[part]
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(power, out=total[1:])
    del power
    hashes = (total[ends] - total[starts]) * _powers(_INVERSE, n)[starts] if len(starts) else np.zeros(0, np.uint64)
    hashes = mix(hashes + (ends - starts).astype(np.uint64))
    return Words(hashes, starts, ends, np.searchsorted(starts, ends_at, side="left"), part)


def window_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every run of ``k`` words within one text, and where each text's runs begin.

    The running sum of ``hash * base**i`` gives each window's polynomial by one
    difference; multiplying by the inverse power makes it independent of its place.
    """
    h, off = words.hashes, words.offsets
    n = len(h)
    counts = np.maximum(np.diff(off) - (k - 1), 0)
    out_off = np.concatenate([[0], np.cumsum(counts)])
    if n < k or not out_off[-1]:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * _powers(_BASE, n), out=total[1:])
    every = (total[k:] - total[:-k]) * _powers(_INVERSE, n - k + 1)
    at = np.arange(out_off[-1]) + np.repeat(off[:-1] - out_off[:-1], counts)
    return mix(every[at] + _U(k)), out_off


def shingle_sets(words: Words, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's distinct ``k``-word shingles as sorted hashes, and their counts.

    A text with fewer than ``k`` words has its whole sequence as its one shingle;
    one without words has none.
    """
    windows, at = window_hashes(words, k)
    n_words = np.diff(words.offsets)
    sets: list[np.ndarray] = []
    short = (n_words > 0) & (n_words < k)
    for i, n in enumerate(n_words):
        if short[i]:
            one = np.zeros(1, np.uint64)
            for h in words.hashes[words.offsets[i] : words.offsets[i + 1]]:
                one = mix(one * _U(_BASE) + h)
            sets.append(mix(one + _U(n)))
            continue
        part = windows[at[i] : at[i + 1]]
        part.sort()
        sets.append(part[np.concatenate([[True], part[1:] != part[:-1]])] if len(part) > 1 else part)
    return sets, np.array([len(x) for x in sets], dtype=np.int64)
