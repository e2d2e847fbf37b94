"""Words and word shingles of UTF-8 texts as 64-bit hashes, whole Arrow batches at a time.

A word is a run without ASCII white space. Its hash is that of its bytes as a polynomial modulo 2^64,
taken from running sums, so that no word becomes a Python object; a finaliser spreads the bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_UINT = np.uint64
_POWERS = np.cumprod(np.r_[_UINT(1), np.full(2 * SEGMENT, _BASE, _UINT)])
_INVERSES = np.cumprod(np.r_[_UINT(1), np.full(2 * SEGMENT, pow(_BASE, -1, 1 << 64), _UINT)])
_PLACES = [pow(0xD1B54A32D192ED03, k + 1, 1 << 64) for k in range(64)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> _UINT(30)) * _UINT(0xBF58476D1CE4E5B9)
    h = (h ^ h >> _UINT(27)) * _UINT(0x94D049BB133111EB)
    return h ^ h >> _UINT(31)


def text_groups(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, where each text starts and the last ends) of runs of rows of about `most` bytes.

    A null is an empty text. A longer text is a run of its own.
    """
    if len(column) == 0:
        return
    whole = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"").cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and how many words the texts have up to each."""
    solid = ~SPACE[data]
    before, after = np.r_[False, solid[:-1]], np.r_[solid[1:], False]
    inner = starts[(starts > 0) & (starts < len(data))]
    before[inner] = False
    after[inner - 1] = False
    first, last = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return first, last, np.searchsorted(first, starts)


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    out, i = np.empty(len(first), _UINT), 0
    while i < len(first):
        base = first[i]
        j = int(np.searchsorted(first, base + SEGMENT))
        stop = min(int(last[j - 1]), int(base) + 2 * SEGMENT)
        sums = np.r_[_UINT(0), np.cumsum((data[base:stop].astype(_UINT) + _UINT(1)) * _POWERS[: stop - base])]
        begin = first[i:j] - base
        out[i:j] = (sums[np.minimum(last[i:j], stop) - base] - sums[begin]) * _INVERSES[begin]
        for k in i + np.flatnonzero(last[i:j] - first[i:j] > SEGMENT):
            out[k] = int.from_bytes(hashlib.blake2b(data[first[k] : last[k]].tobytes(), digest_size=8).digest(), "little")
        i = j
    return mix(out)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of the words from each on, for all places that have so many."""
    n = max(0, len(hashes) - length + 1)
    out = np.zeros(n, _UINT)
    for k in range(length):
        out += hashes[k : k + n] * _UINT(_PLACES[k])
    return mix(out)


def shingle_sets(data: np.ndarray, starts: np.ndarray, length: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a text of fewer words is one shingle."""
    first, last, upto = word_bounds(data, starts)
    hashes = word_hashes(data, first, last)
    runs, sets = windows(hashes, length), []
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        if b - a >= length:
            own = np.sort(runs[a : b - length + 1])
            sets.append(own[np.r_[True, own[1:] != own[:-1]]])
        else:
            sets.append(windows(hashes[a:b], b - a) ^ _UINT(b - a) if b > a else np.zeros(0, _UINT))
    return sets
