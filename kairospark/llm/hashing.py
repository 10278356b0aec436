"""Hashes of words and of word windows over whole Arrow batches, in numpy.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

import numpy as np

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)
#: For an independent second hash.
OTHER_BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1001)) * _ODD)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, _SLICE + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


#: Bytes of letters and digits, and all above ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray = ~SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the index of its first word (one entry more than rows). solid: which bytes words are made of. No word crosses rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = solid[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, solid[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit polynomial hash of each word, from prefix sums over about a megabyte at a time. values: a random number for each byte; others give an independent hash."""
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + _SLICE, "right")))
        low, high = starts[k], ends[stop - 1]
        up, down = _powers(int(high - low) + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[data[low:high]] * up[: high - low], out=sums[1:])
        a, b = starts[k:stop] - low, ends[k:stop] - low
        out[k:stop] = (sums[b] - sums[a]) * down[a]
        k = stop
    return mix(out)


def windows(words: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """64-bit hash of each run of `size` neighbouring words, by doubling: log2(size) passes. Runs across rows are for the caller to leave out."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    factor = int(mix(np.array([seed], np.uint64) * _ODD)[0]) | 1
    part, width, have, total = mix(words + np.uint64(seed)), 1, 0, None
    left = size
    while left:
        if left & 1:
            if total is None:
                total, have = part, width
            else:
                n = min(len(total), len(part) - have)
                total = total[:n] + part[have : have + n] * np.uint64(pow(factor, have, 1 << 64))
                have += width
        left >>= 1
        if left:
            part = part[:-width] + part[width:] * np.uint64(pow(factor, width, 1 << 64))
            width *= 2
    return mix(total[: len(words) - size + 1])
