"""Arithmetic of one tile: a block of query vectors against a block of donor vectors.

Small numpy helpers that run inside tasks. Spark decides which blocks meet (see ``neighbors``).
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

# Distances are compared after rounding to this many places, ties go to the lower donor key.
PLACES = 12


def prepare(x: np.ndarray, metric: str):
    """Vectors in the form the metric needs, once per block: (matrix, squared norm or flat flag)."""
    x = np.asarray(x, dtype=np.float64)
    if metric == "correlation":
        flat = x.max(axis=1) == x.min(axis=1)
        x = x - x.mean(axis=1, keepdims=True)
        n = np.einsum("ij,ij->i", x, x)
        n[flat] = 0.0
        return x, n
    if metric == "cosine":
        return x, np.einsum("ij,ij->i", x, x)
    return x, None


def _rows_at_a_time(columns: int) -> int:
    return max(1, (1 << 18) // max(columns, 1))


def distances(a, b, metric: str) -> np.ndarray:
    """Distance of every row of ``a`` to every row of ``b``, both as given by ``prepare``."""
    x, nx = a
    y, ny = b
    if metric in ("cosine", "correlation"):
        scale = np.sqrt(nx[:, None] * ny[None, :])
        with np.errstate(divide="ignore", invalid="ignore"):
            out = 1.0 - (x @ y.T) / scale
        out[scale == 0] = 1.0 if metric == "cosine" else np.inf
        return np.round(out, PLACES)
    out = np.zeros((len(x), len(y)))
    yt = np.ascontiguousarray(y.T)
    step = _rows_at_a_time(len(y))
    for lo in range(0, len(x), step):
        part = out[lo:lo + step]
        rows = x[lo:lo + step]
        for j in range(x.shape[1]):
            gap = np.subtract(rows[:, j, None], yt[j][None, :])
            if metric == "manhattan":
                part += np.abs(gap, out=gap)
            elif metric == "chebyshev":
                np.maximum(part, np.abs(gap, out=gap), out=part)
            else:
                part += np.multiply(gap, gap, out=gap)
    if metric in ("euclidean", "mahalanobis"):
        np.sqrt(out, out=out)
    return np.round(out, PLACES)


class Tile:
    """Distances between two prepared blocks, cheap first and exact where they matter.

    ``nearby`` marks the pairs that may be within reach, and few others. ``rough`` is within ``slack`` of the exact distance, for
    angles by one matrix product of unit vectors. ``exact`` gives the rounded distance of single pairs, ``dense`` that of whole rows.
    """

    def __init__(self, a, b, metric: str):
        self.a, self.b, self.metric = a, b, metric
        self.angular = metric in ("cosine", "correlation")
        # rounding moves a distance by half a unit, the product by much less
        self.slack = 0.5 * 10.0 ** -PLACES + 1e-15 * max(8, a[0].shape[1]) if self.angular else 0.0

    @cached_property
    def rough(self) -> np.ndarray:
        if not self.angular:
            return distances(self.a, self.b, self.metric)
        out = 1.0 - _unit(self.a) @ _unit(self.b).T
        if self.metric == "correlation":
            out[self.a[1] == 0] = np.inf
            out[:, self.b[1] == 0] = np.inf
        return out

    def nearby(self, reach: np.ndarray) -> np.ndarray:
        """A mask that holds for every pair whose distance is at most the reach of its row (-inf: none)."""
        x, y = self.a[0], self.b[0]
        if self.angular:
            return _near_by_angle(_unit(self.a), _unit(self.b), reach)
        found = None
        if self.metric == "manhattan":
            found = _near_by_sum(x, y, reach)
        elif self.metric == "chebyshev":
            found = _near_by_most(x, y, reach)
        else:
            found = _near_by_square(x, y, reach)
        return self.rough <= reach[:, None] if found is None else found

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for lo in range(0, len(i), 1 << 16):
            r, c = i[lo:lo + (1 << 16)], j[lo:lo + (1 << 16)]
            x, y = self.a[0][r], self.b[0][c]
            if not self.angular:
                out[lo:lo + (1 << 16)] = _of_pairs(x, y, self.metric)
                continue
            dot = np.einsum("ij,ij->i", x, y)
            scale = np.sqrt(self.a[1][r] * self.b[1][c])
            with np.errstate(divide="ignore", invalid="ignore"):
                d = 1.0 - dot / scale
            d[scale == 0] = 1.0 if self.metric == "cosine" else np.inf
            out[lo:lo + (1 << 16)] = np.round(d, PLACES)
        return out

    def dense(self, rows: np.ndarray) -> np.ndarray:
        if not self.angular:
            return self.rough[rows] if "rough" in self.__dict__ else distances((self.a[0][rows], None), self.b, self.metric)
        return distances((self.a[0][rows], self.a[1][rows]), self.b, self.metric)


def _of_pairs(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row of ``x`` to the same row of ``y``; entries are added up in the order of ``distances``, so both agree."""
    gap = np.ascontiguousarray((x - y).T)
    if metric == "manhattan":
        out = np.add.reduce(np.abs(gap, out=gap), axis=0)
    elif metric == "chebyshev":
        out = np.maximum.reduce(np.abs(gap, out=gap), axis=0)
    else:
        out = np.add.reduce(np.multiply(gap, gap, out=gap), axis=0)
    if metric in ("euclidean", "mahalanobis"):
        np.sqrt(out, out=out)
    return np.round(out, PLACES)


# ---------------------------------------------------------------- which pairs may be near
#
# Arithmetic of 32, 16 and 8 bits with its largest error taken off, so no near pair is missed; what is marked is computed exactly.

EPS = 2.0 ** -23  # twice the rounding of 32 bits
ROUNDING = 10.0 ** -PLACES
SPREAD = 4.0  # entries are cut off so many deviations from the mean, which makes no distance larger


def _down(x: np.ndarray) -> np.ndarray:
    """32-bit numbers at or below the given ones."""
    with np.errstate(over="ignore"):
        return np.nextafter(x.astype(np.float32), np.float32(-np.inf))[:, None]


def _near_by_angle(x: np.ndarray, y: np.ndarray, reach: np.ndarray) -> np.ndarray:
    error = (x.shape[1] + 8) * EPS + ROUNDING
    return x.astype(np.float32) @ y.astype(np.float32).T >= _down(1.0 - reach - error)


def _near_by_square(x: np.ndarray, y: np.ndarray, reach: np.ndarray) -> np.ndarray | None:
    """xy - yy / 2 >= (xx - reach^2) / 2, around the mean of ``y`` and in units of the longest vector."""
    center = y.mean(axis=0)
    x, y = x - center, y - center
    nx, ny = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    longest = max(nx.max(), ny.max())
    if not 1e-200 < longest < 1e200:
        return None
    unit = np.sqrt(longest)
    nx, ny = nx / longest, ny / longest
    product = (x / unit).astype(np.float32) @ (y / unit).astype(np.float32).T
    product -= (ny / 2).astype(np.float32)
    error = (x.shape[1] + 16) * EPS * (np.sqrt(nx * ny.max()) + nx + ny.max()) + 1e-30
    far = np.maximum(reach + ROUNDING, 0.0) / unit
    return product >= _down(np.where(np.isneginf(reach), np.inf, (nx - far * far) / 2 - error))


def _ranges(y: np.ndarray):
    """Low end and width of every entry, without what lies far out."""
    mean, sd = y.mean(axis=0), y.std(axis=0)
    lo, hi = np.maximum(y.min(axis=0), mean - SPREAD * sd), np.minimum(y.max(axis=0), mean + SPREAD * sd)
    return lo, np.maximum(hi - lo, 0.0)


def _levels(x: np.ndarray, lo: np.ndarray, width: np.ndarray, unit: float, kind) -> np.ndarray:
    return np.floor(np.clip(x - lo, 0.0, width) / unit).astype(kind)


def _near_by_sum(x: np.ndarray, y: np.ndarray, reach: np.ndarray) -> np.ndarray | None:
    """Sums of whole levels in 16 bits: |x - y| = 2 max(x, y) - x - y. An entry is at most one level off."""
    dim = x.shape[1]
    lo, width = _ranges(y)
    unit = width.sum() / (65535 - 2 * dim) if dim < 8192 else 0.0
    if not 1e-200 < unit < 1e200:
        return None
    qx, qy = _levels(x, lo, width, unit, np.uint16), _levels(y, lo, width, unit, np.uint16)
    most = np.clip(np.floor((reach + ROUNDING) / unit * (1 + 1e-9)) + dim + 1, -1, 1 << 18)
    left = np.where(np.isneginf(reach), -(1 << 19), most + qx.sum(axis=1)).astype(np.int32)
    right, yt = qy.sum(axis=1).astype(np.int32), np.ascontiguousarray(qy.T)
    out, step = np.empty((len(x), len(y)), dtype=bool), _rows_at_a_time(len(y))
    larger = np.empty((min(step, len(x)), len(y)), np.uint16)
    for at in range(0, len(x), step):
        rows = qx[at:at + step]
        total, one = np.zeros((len(rows), len(y)), np.uint16), larger[:len(rows)]
        for j in range(dim):
            np.add(total, np.maximum(rows[:, j, None], yt[j], out=one), out=total)
        out[at:at + step] = total <= (left[at:at + step, None] + right) >> 1
    return out


def _near_by_most(x: np.ndarray, y: np.ndarray, reach: np.ndarray) -> np.ndarray | None:
    """Levels in 8 bits: -t <= x - y <= t is one comparison of x + t - y, which wraps below 0, with 2 t."""
    lo, width = _ranges(y)
    unit = width.max() / 126
    if not 1e-200 < unit < 1e200:
        return None
    qx, qy = _levels(x, lo, width, unit, np.uint8), _levels(y, lo, width, unit, np.uint8)
    most = np.clip(np.floor((reach + ROUNDING) / unit * (1 + 1e-9)) + 1, 0, 127).astype(np.uint8)
    shifted, yt = qx + most[:, None], np.ascontiguousarray(qy.T)
    out, step = np.empty((len(x), len(y)), dtype=bool), _rows_at_a_time(len(y))
    gap = np.empty((min(step, len(x)), len(y)), np.uint8)
    for at in range(0, len(x), step):
        rows = shifted[at:at + step]
        largest, one = np.zeros((len(rows), len(y)), np.uint8), gap[:len(rows)]
        for j in range(x.shape[1]):
            np.maximum(largest, np.subtract(rows[:, j, None], yt[j], out=one), out=largest)
        out[at:at + step] = largest <= 2 * most[at:at + step, None]
    out[np.isneginf(reach)] = False
    return out


def _unit(block) -> np.ndarray:
    x, n = block
    return x / np.sqrt(np.where(n == 0, 1.0, n))[:, None]


def as_metric(d, metric: str):
    """The distance as a true metric, for the triangle inequality: chord length for angles."""
    return np.sqrt(np.maximum(2.0 * d, 0.0)) if metric in ("cosine", "correlation") else d


def closest(d: np.ndarray, keys: np.ndarray, k: int, bound: np.ndarray | None = None):
    """Indices (row, column) that hold the k smallest per row by (distance, key), ``keys`` ascending.

    With ``bound`` only columns at or below the row's bound count. A few more than k may be returned
    per row; the caller merges and ranks them.
    """
    if bound is not None:
        take = d <= bound[:, None]
        if np.count_nonzero(take) <= 4 * k * len(d):
            return np.nonzero(take)
    if d.shape[1] > k:
        limit = np.partition(d, k - 1, axis=1)[:, k - 1]
    else:
        limit = np.full(len(d), np.inf)
    if bound is not None:
        limit = np.minimum(limit, bound)
    take = d <= limit[:, None]
    crowded = np.flatnonzero(np.count_nonzero(take, axis=1) > k)
    if len(crowded):
        part = d[crowded]
        edge = limit[crowded, None]
        nearer = part < edge
        tied = part == edge
        free = k - np.count_nonzero(nearer, axis=1)[:, None]
        take[crowded] = nearer | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= free))
    return np.nonzero(take)
