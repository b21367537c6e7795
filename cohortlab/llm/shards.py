"""A balanced partition of vectors into boxes, with an exact bound on which boxes a ball can reach.

Vectors are turned to the principal axes of a bounded sample; every cut is along
one axis at a median of the sample. Distances to cuts on different axes add up,
so a leaf is reached only if all cuts on its path together allow it, and after
that only if the box of what it really holds does.
"""

from __future__ import annotations

import math

import numpy as np


class Tree:
    """Node i sends turned vectors with ``x[axes[i]] <= cuts[i]`` to child 2i+1, others to 2i+2; the last level are the leaves."""

    def __init__(self, basis: np.ndarray, axes: np.ndarray, cuts: np.ndarray, depth: int) -> None:
        self.basis, self.axes, self.cuts, self.depth = basis, axes, cuts, depth

    @classmethod
    def fit(cls, sample: np.ndarray, leaves: int, least: int) -> "Tree":
        """At most ``leaves`` leaves (rounded up to a power of two) of at least about ``least`` sampled vectors."""
        dim = sample.shape[1]
        depth = max(0, math.ceil(math.log2(max(1, min(leaves, len(sample) // least)))))
        basis = np.linalg.eigh(np.cov(sample.T.astype(np.float64)).reshape(dim, dim))[1] if len(sample) > 1 else np.eye(dim)
        turned = sample.astype(np.float64) @ basis
        axes, cuts = np.zeros(2**depth - 1, dtype=np.int64), np.zeros(2**depth - 1)
        groups = [np.arange(len(sample))]
        for level in range(depth):
            following = []
            for i, group in enumerate(groups):
                axis, cut = _best_cut(turned[group])
                axes[2**level - 1 + i], cuts[2**level - 1 + i] = axis, cut
                left = turned[group, axis] <= cut
                following += [group[left], group[~left]]
            groups = following
        return cls(basis, axes, cuts, depth)

    def parts(self) -> tuple:
        return self.basis, self.axes, self.cuts, self.depth

    def turn(self, vectors: np.ndarray) -> np.ndarray:
        return vectors.astype(np.float64) @ self.basis

    def leaf(self, turned: np.ndarray) -> np.ndarray:
        node = np.zeros(len(turned), dtype=np.int64)
        rows = np.arange(len(turned))
        for _ in range(self.depth):
            node = 2 * node + 1 + (turned[rows, self.axes[node]] > self.cuts[node])
        return node - (2**self.depth - 1)

    def within(self, turned: np.ndarray, radius: np.ndarray, leaves: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf (from ``leaves[0]`` to below ``leaves[1]``) that may hold something within ``radius`` of a row, rows in order."""
        first, last = leaves or (0, 2**self.depth)
        rows, nodes = np.arange(len(turned)), np.zeros(len(turned), dtype=np.int64)
        off = np.zeros(turned.shape, dtype=np.float32)  # how far each row is outside the node on each axis
        limit = _limit(radius)
        for level in range(self.depth):
            axis = self.axes[nodes]
            span = 2 ** (self.depth - level - 1)  # leaves below a child
            gap = turned[rows, axis] - self.cuts[nodes]
            children, offs, whose = [], [], []
            for side, outside in ((1, np.maximum(gap, 0)), (2, np.maximum(-gap, 0))):
                far = off.copy()
                at = np.arange(len(rows))
                far[at, axis] = np.maximum(far[at, axis], outside)
                begin = (2 * nodes + side - (2 ** (level + 1) - 1)) * span
                near = ((far.astype(np.float64) ** 2).sum(1) <= limit[rows]) & (begin < last) & (begin + span > first)
                children.append(2 * nodes[near] + side)
                offs.append(far[near])
                whose.append(rows[near])
            nodes, off, rows = np.concatenate(children), np.concatenate(offs), np.concatenate(whose)
        order = np.lexsort((nodes, rows))
        return rows[order], nodes[order] - (2**self.depth - 1)


def _limit(radius: np.ndarray) -> np.ndarray:
    """Squared radius with room for rounding."""
    return (np.asarray(radius, dtype=np.float64) * (1 + 1e-6) + 1e-6) ** 2


def _best_cut(points: np.ndarray) -> tuple[int, float]:
    """The widest axis whose median leaves at least a quarter on either side, else the most even one."""
    if len(points) < 2:
        return 0, 0.0
    best, evenest = (0, float(np.median(points[:, 0]))), -1.0
    for axis in np.argsort(-points.var(0), kind="stable"):
        cut = float(np.median(points[:, axis]))
        share = (points[:, axis] <= cut).mean()
        even = min(share, 1 - share)
        if even > evenest:
            best, evenest = (int(axis), cut), even
        if even >= 0.25:
            break
    return best


def box(turned: np.ndarray) -> np.ndarray:
    """[2, dim]: the lowest and highest value on every axis, rounded outwards to single precision."""
    low, high = turned.min(0).astype(np.float32), turned.max(0).astype(np.float32)
    return np.stack([np.nextafter(low, np.float32(-np.inf)), np.nextafter(high, np.float32(np.inf))])


def reaches(turned: np.ndarray, rows: np.ndarray, boxes: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Whether the ball around ``turned[rows[i]]`` touches ``boxes[i]``."""
    points = turned[rows]
    gap = np.maximum(np.maximum(boxes[:, 0] - points, points - boxes[:, 1]), 0)
    return (gap * gap).sum(1) <= _limit(radius)[rows]
