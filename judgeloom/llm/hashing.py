"""Vectorised hashes of byte ranges, words and windows.

A range is folded eight bytes at a time, each step through a multiplication and
a mixer that is one to one.  Windows of codes double in width, two halves at a
time through the same mixer.  Nothing here is a polynomial, so patterns that
cancel modulo a power of two (two letters in Thue-Morse order, say) don't.
Two families with their own seeds give 128 bits when both are used.
"""

from __future__ import annotations

import hashlib

import numpy as np

_SEEDS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Longer ranges are digested one by one.
LONG = 1024


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit value over all of its bits (one to one)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the pairs (a, b), in that order."""
    h = a * np.uint64(0x9FB21C651E98DF25)
    h += b
    return mix(h)


class Bytes:
    """A buffer whose ranges are hashed."""

    def __init__(self, buf: np.ndarray) -> None:
        self.buf = buf
        padded = np.zeros(len(buf) + 16, np.uint8)
        padded[: len(buf)] = buf
        #: The eight bytes from each place on; zeros follow the last byte.
        self.lanes = np.ndarray((len(buf) + 9,), "<u8", padded, strides=(1,))

    def ranges(self, starts: np.ndarray, lengths: np.ndarray, family: int = 0) -> np.ndarray:
        """Hashes of buf[start : start + length]."""
        h = mix(lengths.astype(np.uint64) + np.uint64(_SEEDS[family]))
        at, k = np.flatnonzero((lengths > 0) & (lengths <= LONG)), 0
        while len(at):
            lane = self.lanes[starts[at] + k] & _MASKS[np.minimum(lengths[at] - k, 8)]
            h[at] = joined(h[at], lane)
            k += 8
            at = at[lengths[at] > k]
        for i in np.flatnonzero(lengths > LONG).tolist():
            digest = hashlib.blake2b(self.buf[starts[i] : starts[i] + lengths[i]], digest_size=16).digest()
            h[i] = int.from_bytes(digest[8 * family : 8 * family + 8], "little")
        return h

    def every(self, width: int) -> np.ndarray:
        """Hashes of all ranges of one width, 16 at most, by their start."""
        n = max(0, len(self.buf) - width + 1)
        head = self.lanes[:n] & _MASKS[min(width, 8)]
        return mix(head) if width <= 8 else joined(head, self.lanes[width - 8 : width - 8 + n].copy())


def windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` codes, by their first."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, k = codes, 1
    while 2 * k <= width:
        h, k = joined(h[:-k], h[k:]), 2 * k
    return h if k == width else joined(h[:n], h[width - k : width - k + n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for every i that has a full window."""
    n = len(x)
    if n < width:
        return x[:0]
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])
