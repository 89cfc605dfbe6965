"""Directions that a bounded sample of unit vectors gathers around, to deal rows out by content."""

from __future__ import annotations

import numpy as np


def spherical_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to k unit vectors, by k-means on the sphere; a centre that loses all its rows starts anew at the row farthest off."""
    rng = np.random.default_rng(len(x))
    k = max(1, min(k, len(x)))
    if not len(x):
        return np.zeros((1, x.shape[1]), x.dtype)
    centres = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds):
        best, near = nearest_centres(x, centres, 1)
        own = best[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.bincount(own, minlength=k)
        empty = np.flatnonzero(size == 0)
        sums[empty] = x[np.argsort(near[:, 0], kind="stable")[: len(empty)]]
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres).astype(x.dtype)
    return centres


def nearest_centres(x: np.ndarray, centres: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest centres of each row, nearest first, and their cosines; in blocks."""
    n = min(n, len(centres))
    at, score = np.empty((len(x), n), np.int64), np.empty((len(x), n), x.dtype)
    for i in range(0, len(x), 4096):
        s = x[i : i + 4096] @ centres.T
        part = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.broadcast_to(np.arange(n), s.shape)
        order = np.argsort(-np.take_along_axis(s, part, 1), axis=1, kind="stable")
        at[i : i + 4096] = np.take_along_axis(part, order, 1)
        score[i : i + 4096] = np.take_along_axis(s, at[i : i + 4096], 1)
    return at, score
