"""Hashes of many spans of one text at once.

A span (a word, a gap) is hashed eight bytes at a time, each step mixed before the next: no sum of letters that a
clever order could cancel. Runs of spans are told by a polynomial over their hashes in the field of 2^61 - 1 elements,
from prefix sums, so any run of a text costs one product. In a field of prime size, equal values of different runs are
a matter of chance whatever the runs look like, which modulo a power of two they are not.
"""

from __future__ import annotations

import hashlib

import numpy as np

PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
_LOW32, _LOW29 = np.uint64((1 << 32) - 1), np.uint64((1 << 29) - 1)
_LANE = 8
#: Longer spans are digested one by one.
LONG = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers in which every bit of the result depends on every bit of the number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every span of bytes, from its content and length alone."""
    lengths = ends - starts
    found = mixed(lengths.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & (1 << 64) - 1))
    if not len(starts):
        return found
    padded = np.zeros(len(data) + _LANE, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
    open_, at, left = np.arange(len(starts)), starts, lengths
    while True:
        short = (left > 0) & (lengths[open_] <= LONG)
        open_, at, left = open_[short], at[short], left[short]
        if not len(open_):
            break
        unused = np.uint64(8) * np.maximum(_LANE - left, 0).astype(np.uint64)
        found[open_] = mixed((found[open_] + ((lanes[at] << unused) >> unused)) * np.uint64(0xD6E8FEB86659FD93))
        at, left = at + _LANE, left - _LANE
    for i in np.flatnonzero(lengths > LONG):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, person=seed.to_bytes(4, "little")).digest()
        found[i] = np.frombuffer(digest, "<u8")[0]
    return found


def _folded(x: np.ndarray) -> np.ndarray:
    """Below 2^61 - 1, from any 64-bit number."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, of numbers below it, in halves of 32 bits."""
    ah, al, bh, bl = a >> np.uint64(32), a & _LOW32, b >> np.uint64(32), b & _LOW32
    middle = ah * bl + al * bh  # below 2^62
    # a*b = ah*bh * 2^64 + middle * 2^32 + al*bl, with 2^64 = 8 and 2^61 = 1.
    high = ah * bh * np.uint64(8) + (middle >> np.uint64(29)) + ((middle & _LOW29) << np.uint64(32))
    return _folded(_folded(high) + _folded(al * bl))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) in the field, remembered up to the longest text so far."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.array([1], np.uint64)
        while len(held) < max(n, 1 << 12):
            held = np.concatenate([held, times(held, np.full(len(held), pow(base, len(held), PRIME), np.uint64))])
        _POWERS[base] = held
    return held[:n]


class Runs:
    """Digests of runs of items, from the items' hashes."""

    def __init__(self, hashes: np.ndarray, base: int):
        self.base, n = base, len(hashes)
        terms = times(_folded(hashes), _powers(base, n))
        # Halves are added up apart: their sums stay below 2^64.
        high = np.cumsum(terms >> np.uint64(32), dtype=np.uint64)
        low = np.cumsum(terms & _LOW32, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        self.sums[1:] = _folded(times(_folded(high), np.full(n, 1 << 32, np.uint64)) + _folded(low))

    def of(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The digest of the items from ``first`` up to before ``after``, wherever they stand."""
        apart = _folded(self.sums[after] + (_P - self.sums[first]))
        back = _powers(pow(self.base, -1, PRIME), len(self.sums))
        return mixed(times(apart, back[first]))
