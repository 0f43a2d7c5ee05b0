"""Counts over the bytes of whole texts, computed for many documents at once."""
from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = 0xD6E8FEB86659FD93
#: Lower-cased ASCII letters and bytes of other characters stay; all else is a blank.
LETTERS = np.array([c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], np.uint8)


def lines_of(starts: np.ndarray) -> np.ndarray:
    """Row number of every byte."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def gram_counts(data: np.ndarray, starts: np.ndarray, size: int, buckets: int) -> np.ndarray:
    """rows x buckets: hashed byte n-grams of ``size`` within a row; grams that are all blank don't count."""
    rows, n = len(starts) - 1, len(data) - size + 1
    out = np.zeros((rows, buckets), np.float32)
    if n <= 0:
        return out
    code = np.zeros(n, np.uint64)
    for i in range(size):
        code = (code << np.uint64(8)) | data[i:i + n]
    blank = np.uint64(int.from_bytes(b" " * size, "big"))
    slot = ((code * _MIX) >> np.uint64(64 - int(buckets).bit_length() + 1)).astype(np.int64)
    for r in range(rows):
        a, b = int(starts[r]), int(starts[r + 1]) - size + 1
        if b > a:
            own = slot[a:b][code[a:b] != blank]
            out[r] = np.bincount(own, minlength=buckets)
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every word (a run of bytes that are not blank, within a row): its row, 64-bit hash and length."""
    inside = data != 32
    edge = np.empty(len(data), bool)
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z
    edge[0], edge[1:] = inside[0], inside[1:] & ~inside[:-1]
    cut = starts[:-1][np.diff(starts) > 0]
    edge[cut] = inside[cut]
    first = np.flatnonzero(edge)
    stop = np.empty(len(data), bool)
    stop[-1], stop[:-1] = inside[-1], inside[:-1] & ~inside[1:]
    stop[cut[cut > 0] - 1] = inside[cut[cut > 0] - 1]
    last = np.flatnonzero(stop) + 1
    # polynomial hash of each word from one running sum; the power of an odd base can be divided out
    powers = _powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * powers[:len(data)])])
    h = (total[last] - total[first]) * _powers(len(data), True)[first]
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return np.searchsorted(starts, first, "right") - 1, h ^ (h >> np.uint64(32)), last - first


_CACHE: dict[bool, np.ndarray] = {}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    have = _CACHE.get(inverse)
    if have is None or len(have) < n:
        base = pow(_ODD, -1, 1 << 64) if inverse else _ODD
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _CACHE[inverse] = have = np.cumprod(have, dtype=np.uint64)
    return have
