"""Vantage-point partitioning of 64-bit fingerprints under Hamming distance.

A node has a vantage point v and a threshold t. Fingerprints with d <= t go left, those with d > t - reach go right;
by the triangle inequality every pair within reach then stands together in a child, so leaves can be searched alone.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def distance(x: np.ndarray, v) -> np.ndarray:
    return np.bitwise_count(x ^ v)


def choose(points: np.ndarray, reach: int, tries: int = 8) -> tuple[int, int, float] | None:
    """The vantage point and threshold, among some points spread over the given ones, with the least work below them.

    Work counts pairs, as a share of all pairs. None: no split saves a twentieth.
    """
    n, best = len(points), None
    for k in range(tries):
        v = points[(n * k) // tries]
        upto = np.cumsum(np.bincount(distance(points, v), minlength=65))
        right = n - np.r_[np.zeros(reach, dtype=np.int64), upto[: 65 - reach]]
        work = (upto.astype(float) ** 2 + right.astype(float) ** 2) / float(n) ** 2
        t = int(np.argmin(work))
        if best is None or work[t] < best[2]:
            best = int(v), t, float(work[t])
    return best if best and best[2] < 0.95 else None


def sides(points: np.ndarray, v: int, t: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    d = distance(points, U(v)).astype(np.int16)
    return d <= t, d > t - reach


def grow(sample: np.ndarray, reach: int, depth: int) -> tuple | None:
    """A tree of (v, t, left, right) over a sample; None is a leaf."""
    if depth <= 0 or len(sample) < 16 or (best := choose(sample, reach)) is None:
        return None
    left, right = sides(sample, *best[:2], reach)
    return best[0], best[1], grow(sample[left], reach, depth - 1), grow(sample[right], reach, depth - 1)


def route(tree: tuple | None, points: np.ndarray, reach: int):
    """Yields (leaf number, indices of the points that it has to see)."""
    stack = [(tree, np.arange(len(points)), 1)]
    while stack:
        node, at, number = stack.pop()
        if node is None:
            yield number, at
            continue
        left, right = sides(points[at], node[0], node[1], reach)
        stack += [(node[2], at[left], 2 * number), (node[3], at[right], 2 * number + 1)]


def _block_links(points: np.ndarray, reach: int, label: np.ndarray, at: np.ndarray, rows: int = 256, columns: int = 4096) -> None:
    """Compares all points of a block and joins labels, tile by tile (a tile stays in cache); at: their places in label."""
    for a in range(0, len(points), rows):
        found = []
        for b in range(a, len(points), columns):
            i, j = np.nonzero(distance(points[a : a + rows, None], points[None, b : b + columns]) <= reach)
            found.append((a + i, b + j))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = j > i
        i, j = at[i[keep]], at[j[keep]]
        if not len(i):
            continue
        while True:  # least label along links, until nothing moves
            low = np.minimum(label[i], label[j])
            if (low == label[i]).all() and (low == label[j]).all():
                break
            for ends in (i, j):
                roots = label[ends]
                np.minimum.at(label, roots, low)  # hook whole classes
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def links(points: np.ndarray, reach: int, small: int = 768) -> np.ndarray:
    """For each of the distinct, sorted points the least point that links within reach join it to."""
    label = np.arange(len(points))
    stack = [np.arange(len(points))]
    while stack:
        at = stack.pop()
        own = points[at]
        best = choose(own, reach) if len(at) > small else None
        if best is None:
            _block_links(own, reach, label, at)
            continue
        left, right = sides(own, *best[:2], reach)
        stack += [at[left], at[right]]
    while True:
        up = label[label]
        if (up == label).all():
            return points[label]
        label = up
