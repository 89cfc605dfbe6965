"""Hashes of all windows of a byte string, and content-chosen anchors among them."""

from __future__ import annotations

import numpy as np

#: Odd factors of two rolling hashes modulo 2**64; both together are taken as 128 bits.
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits; one-to-one."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse, at least n of each."""
    size = 1 << max(12, int(n).bit_length())
    if (which, size) not in _powers:
        f = int(FACTORS[which])
        g = pow(f, -1, 1 << 64)
        up, down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)))) for x in (f, g))
        _powers[which, size] = up, down
    return _powers[which, size]


class Rolling:
    """Hashes of any slices of one byte array, by prefix sums."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.up, self.down = _power(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        """A hash of each slice of ``size`` bytes."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:-size]) * self.down[: max(n, 0)]) if n > 0 else np.empty(0, np.uint64)

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def _slide(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Smallest or largest of each w neighbours; the length is len(x) - w + 1."""
    f, edge = (np.minimum, np.uint64(2**64 - 1)) if least else (np.maximum, np.uint64(0))
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, edge)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    ahead = f.accumulate(rows, axis=1).reshape(-1)
    behind = f.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return f(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the smallest of some w neighbouring ones; all positions of a tie.

    Any two equal runs of w hashes hold the same anchors at the same places.
    """
    if len(hashes) < w:
        return np.empty(0, np.int64)
    low = _slide(hashes, w, True)
    padded = np.concatenate((np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)))
    return np.nonzero(_slide(padded, w, False) == hashes)[0]


def runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    return edge[::2], edge[1::2]
