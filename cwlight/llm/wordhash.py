"""Words and word n-grams of many texts at once, as 64-bit hashes in numpy.

A word is a run of bytes other than space and 0x09-0x0D, as in
``[^\\x20\\x09-\\x0D]+``; in UTF-8 no other character holds such a byte.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
STEP = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(STEP, -1, 1 << 64)
    out = []
    for base in (STEP, inverse):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP**i and its inverse modulo 2**64 for i below at least ``n``."""
    return _powers(1 << max(10, int(n).bit_length()))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * ODD)


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last, row bounds) of the words of consecutive rows.

    Words of row r are bounds[r]:bounds[r + 1].  With ``plain``, ASCII signs
    part words as blanks do.
    """
    n = len(offsets) - 1
    if lower:
        raw = raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << np.uint8(5))
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    if plain:
        blank = ~((raw >= 128) | ((raw >= 48) & (raw <= 57)) | (((raw | 32) >= 97) & ((raw | 32) <= 122)))
    solid = np.concatenate([[False], ~blank, [False]])
    inner = offsets[1:-1]
    first = solid[1:-1] & ~solid[:-2]
    last = solid[1:-1] & ~solid[2:]
    inside = inner[(inner > 0) & (inner < len(raw))]
    first[inside] = ~blank[inside]
    last[inside - 1] = ~blank[inside - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, np.zeros(n + 1, np.int64)
    size = ends - starts
    at = np.flatnonzero(~blank)
    begin = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(begin, size)
    value = BYTE[raw[at]] * powers(int(size.max()))[0][place]
    return mix(np.add.reduceat(value, begin) + size.astype(np.uint64) * ODD), starts, ends, bounds


def stems(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: int) -> np.ndarray:
    """Hash of the first ``letters`` characters of each word of UTF-8 bytes; a shorter word is its own stem."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = np.minimum(ends - starts, 4 * letters)
    begin = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(begin - starts, size)
    byte = raw[at]
    lead = np.cumsum((byte & 0xC0) != 0x80)
    nth = lead - np.repeat(lead[begin], size)
    value = BYTE[byte] * powers(4 * letters)[0][at - np.repeat(starts, size)]
    value[nth >= letters] = 0
    return mix(np.add.reduceat(value, begin) ^ ODD)


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words, by its first word (rows not told apart)."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[: n - width + 1])
