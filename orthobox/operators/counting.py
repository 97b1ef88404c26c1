"""How many boxes each of many windows meets, counted without making the pairs.

A window misses a box if the box ends before it or starts after it on some axis. On two axes the misses are counted by
inclusion and exclusion: points under one bound, and points under two bounds at once, which a merge tree of sorted runs
answers for all windows together. On more axes every window meets every box, a bit each: for each bound of an axis a table
holds, by rank, the boxes under or over it, and a window ANDs one row of each table.
"""

from __future__ import annotations

import numpy as np

#: Boxes in the bitmaps at once, and windows that are ANDed together.
BITS, TOGETHER = 1024, 4096


def dominated(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each (a, b) the number of points (x, y) with x <= a and y <= b."""
    n = len(x)
    out = np.zeros(len(a), np.int64)
    if not n:
        return out
    upto = np.searchsorted(np.sort(x), a, side="right")
    under = np.searchsorted(np.sort(y), b, side="right")
    rank = np.empty(n, np.int64)
    rank[np.argsort(y, kind="stable")] = np.arange(n)
    rank = rank[np.argsort(x, kind="stable")]
    place = np.arange(n, dtype=np.int64)
    for level in range(n.bit_length()):
        # The first `upto` points by x are one run of 2**level points for each bit of their number.
        has = np.flatnonzero(upto >> level & 1)
        if len(has):
            runs = np.sort((place >> level) * (n + 1) + rank)
            run = (upto[has] >> (level + 1)) << 1
            out[has] += np.searchsorted(runs, run * (n + 1) + under[has]) - (run << level)
    return out


def _proper(lo: np.ndarray, hi: np.ndarray, qlo: np.ndarray, qhi: np.ndarray) -> np.ndarray:
    """The same counts where no box both ends before and starts after a window on one axis."""
    n, d = lo.shape
    out = np.full(len(qlo), n, np.int64)
    for i in range(d):
        out -= np.searchsorted(np.sort(hi[:, i]), qlo[:, i], side="right")
        out -= np.searchsorted(np.sort(-lo[:, i]), -qhi[:, i], side="right")
    if d == 2:
        sides = [[(hi[:, i], qlo[:, i]), (-lo[:, i], -qhi[:, i])] for i in range(2)]
        for x, a in sides[0]:
            for y, b in sides[1]:
                out += dominated(x, y, a, b)
    return out


def window_counts(lo: np.ndarray, hi: np.ndarray, qlo: np.ndarray, qhi: np.ndarray) -> np.ndarray:
    """For each window (qlo, qhi) the number of boxes (lo, hi) that share inside with it; one or two axes.

    Windows that are flat on an axis meet only boxes that are not. Windows or boxes with crossed corners are taken one by one.
    """
    out = np.zeros(len(qlo), np.int64)
    crossed = (lo > hi).any(1)
    for i in np.flatnonzero(crossed):
        out += ((hi[i] > qlo) & (lo[i] < qhi)).all(1)
    lo, hi = lo[~crossed], hi[~crossed]
    odd = (qlo > qhi).any(1)
    for j in np.flatnonzero(odd):
        out[j] += ((hi > qlo[j]) & (lo < qhi[j])).all(1).sum()
    flat = qlo == qhi
    for kind in np.unique(flat[~odd], axis=0):
        windows = np.flatnonzero(~odd & (flat == kind).all(1))
        boxes = (lo < hi)[:, kind].all(1)
        out[windows] += _proper(lo[boxes], hi[boxes], qlo[windows], qhi[windows])
    return out


def window_sums(lo: np.ndarray, hi: np.ndarray, qlo: np.ndarray, qhi: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each window the summed weights (whole numbers, 0 or more) of the boxes that share inside with it: a count for
    each bit of the weights."""
    out = np.zeros(len(qlo), np.int64)
    for bit in range(int(weights.max(initial=0)).bit_length()):
        has = (weights >> bit & 1).astype(bool)
        out += window_counts(lo[has], hi[has], qlo, qhi) << bit
    return out


def _summed(x: np.ndarray, y: np.ndarray, values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each (a, b) the sums of the values (row, point) of the points (x, y) with x <= a and y <= b, a row each."""
    n = len(x)
    out = np.zeros((len(values), len(a)), values.dtype)
    upto = np.searchsorted(np.sort(x), a, side="right")
    under = np.searchsorted(np.sort(y), b, side="right")
    rank = np.empty(n, np.int64)
    rank[np.argsort(y, kind="stable")] = np.arange(n)
    by_x = np.argsort(x, kind="stable")
    rank, values, place = rank[by_x], values[:, by_x], np.arange(n, dtype=np.int64)
    for level in range(n.bit_length()):  # runs as in dominated
        has = np.flatnonzero(upto >> level & 1)
        if len(has):
            runs = (place >> level) * (n + 1) + rank
            order = np.argsort(runs)
            run = (upto[has] >> (level + 1)) << 1
            to = np.searchsorted(runs[order], run * (n + 1) + under[has])
            for i, v in enumerate(values):
                before = np.concatenate([np.zeros(1, v.dtype), np.cumsum(v[order])])
                out[i, has] += before[to] - before[run << level]
    return out


def area_sums(lo: np.ndarray, hi: np.ndarray, qlo: np.ndarray, qhi: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each window on two axes the summed areas that it shares with the boxes, each times the box's weight; finite corners.

    What a box has below and left of (x, y) is the sum of +-(x - u)(y - v) over its corners (u, v) there; a window's share
    follows from its own four corners. Terms cancel, so they are added in extended precision, from the middle of the boxes.
    """
    proper, asked = (lo < hi).all(1), (qlo < qhi).all(1)
    out = np.zeros(len(qlo))
    if not proper.any() or not asked.any():
        return out
    lo, hi, w, at = lo[proper], hi[proper], weights[proper].astype(np.longdouble), np.flatnonzero(asked)
    middle = (lo.min(0) + hi.max(0)) / 2
    sides = ((lo, -1), (hi, 1))
    u, v, s = (np.concatenate(p) for p in zip(*[(f[:, 0], g[:, 1], w * (i * j)) for f, i in sides for g, j in sides]))
    du, dv = u.astype(np.longdouble) - middle[0], v.astype(np.longdouble) - middle[1]
    values, total = np.stack([s, s * du, s * dv, s * du * dv]), np.zeros(len(at), np.longdouble)
    for f, i in ((qlo, -1), (qhi, 1)):
        for g, j in ((qlo, -1), (qhi, 1)):
            x, y = f[at, 0], g[at, 1]
            n, of_u, of_v, of_both = _summed(u, v, values, x, y)
            dx, dy = x.astype(np.longdouble) - middle[0], y.astype(np.longdouble) - middle[1]
            total += i * j * (dx * dy * n - dx * of_v - dy * of_u + of_both)
    out[at] = np.maximum(total, 0)
    return out


def bitmap_sums(lo: np.ndarray, hi: np.ndarray, qlo: np.ndarray, qhi: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each window the summed weights (whole numbers, 0 or more; box, weight) of the boxes that share inside with it, on
    any number of axes: (weight, window)."""
    out = np.zeros((weights.shape[1], len(qlo)), np.int64)
    d = lo.shape[1]
    for first in range(0, len(lo), BITS):
        l, h, w = lo[first : first + BITS], hi[first : first + BITS], weights[first : first + BITS]
        n = len(l)
        ranks = np.arange(n + 1, dtype=np.int16)[:, None]
        place = np.empty(n, np.int16)

        def packed(rows: np.ndarray) -> np.ndarray:
            words = np.zeros((len(rows), -(-n // 64) * 8), np.uint8)
            words[:, : -(-n // 8)] = np.packbits(rows, axis=1)
            return words.view(np.uint64)

        tables = []
        for i in range(d):
            order = np.argsort(h[:, i], kind="stable")
            place[order] = ranks[:n, 0]
            over = packed(place >= ranks)  # by rank: the boxes that end after so many others
            ends = h[order, i]
            order = np.argsort(l[:, i], kind="stable")
            place[order] = ranks[:n, 0]
            tables.append((over, ends, packed(place < ranks), l[order, i]))
        sums = [(k, bit, packed((w[:, k] >> bit & 1).astype(bool)[None])) for k in range(w.shape[1]) for bit in range(int(w[:, k].max(initial=0)).bit_length())]
        for at in range(0, len(qlo), TOGETHER):
            own = slice(at, at + TOGETHER)
            met = None
            for i, (over, ends, under, starts) in enumerate(tables):
                after = over[np.searchsorted(ends, qlo[own, i], side="right")]
                met = after if met is None else np.bitwise_and(met, after, out=met)
                np.bitwise_and(met, under[np.searchsorted(starts, qhi[own, i], side="left")], out=met)
            for k, bit, has in sums:
                out[k, own] += np.bitwise_count(met & has).sum(1, dtype=np.int64) << bit
    return out
