"""Trees built by inserting one box after the other, for tiles that fit a task: the two classic sets of rules.

A strategy is three functions, so that others can be put in: choose(tree, node, box) names the child to descend into,
split(tree, rows) parts an overfull node's rows into two lists, and reinsert(tree, rows) names rows to insert again (or none).
Node boxes are kept tight after every change, so queries never miss rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Values this close, relative to each other, are ties.
TIE = 1e-5
#: The share of an overfull node's rows that the R* rules insert again.
AGAIN = 0.3


def _area(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Areas; where they are not finite, summed edges."""
    with np.errstate(over="ignore", invalid="ignore"):
        a = np.prod(hi - lo, axis=-1)
    return np.where(np.isfinite(a), a, np.sum(hi - lo, axis=-1))


def _least(values: np.ndarray) -> np.ndarray:
    """The positions that tie for the least value."""
    low = values.min()
    return np.flatnonzero(np.abs(values - low) <= TIE * np.maximum(np.abs(values), abs(low)))


@dataclass
class Node:
    leaf: bool
    rows: list = field(default_factory=list)  # of a leaf positions of boxes, else nodes
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None


@dataclass
class Tree:
    lo: np.ndarray
    hi: np.ndarray
    capacity: int
    choose: Callable
    split: Callable
    reinsert: Callable | None = None

    def __post_init__(self):
        self.least = -(-self.capacity // 2)
        self.root = Node(True)

    def corners(self, node: Node) -> tuple[np.ndarray, np.ndarray]:
        """The boxes of a node's rows."""
        if node.leaf:
            return self.lo[node.rows], self.hi[node.rows]
        return np.array([c.lo for c in node.rows]), np.array([c.hi for c in node.rows])

    def tighten(self, node: Node) -> None:
        lo, hi = self.corners(node)
        node.lo, node.hi = lo.min(0), hi.max(0)

    def insert(self, row, height: int = 0, tried: set[int] | None = None) -> None:
        """Puts a box (height 0: its position) or a node (whose parent is to stand at that height) into the tree."""
        tried = set() if tried is None else tried
        lo, hi = (self.lo[row], self.hi[row]) if height == 0 and not isinstance(row, Node) else (row.lo, row.hi)
        path, node = [], self.root
        for _ in range(self._height() - height):
            path.append(node)
            node = node.rows[self.choose(self, node, lo, hi)]
        path.append(node)
        node.rows.append(row)
        again: list = []
        while path:
            node = path.pop()
            if len(node.rows) > self.capacity:
                at = self._height() - len(path)
                if self.reinsert and path and at not in tried:
                    tried.add(at)
                    out = self.reinsert(self, node)
                    again = [(node.rows[i], at) for i in out]
                    node.rows = [x for i, x in enumerate(node.rows) if i not in set(out)]
                else:
                    one, two = self.split(self, node)
                    rows, node.rows = node.rows, [node.rows[i] for i in one]
                    other = Node(node.leaf, [rows[i] for i in two])
                    self.tighten(other)
                    if path:
                        path[-1].rows.append(other)
                    else:
                        self.tighten(node)
                        self.root = Node(False, [node, other])
                        node = self.root
            self.tighten(node)
        for x, at in again:
            self.insert(x, at, tried)

    def _height(self) -> int:
        h, node = 0, self.root
        while not node.leaf:
            h, node = h + 1, node.rows[0]
        return h

    def paths(self) -> Iterator[tuple[int, str]]:
        """The leaf path of each box."""
        todo = [(self.root, "")]
        while todo:
            node, path = todo.pop()
            if node.leaf:
                yield from ((i, path) for i in node.rows)
            else:
                todo += [(c, f"{path}.{i}") for i, c in enumerate(node.rows)]


def least_enlargement(tree: Tree, node: Node, lo: np.ndarray, hi: np.ndarray) -> int:
    """The child whose area grows least, ties to the smallest child, then the first."""
    clo, chi = tree.corners(node)
    area = _area(clo, chi)
    tied = _least(_area(np.minimum(clo, lo), np.maximum(chi, hi)) - area)
    return int(tied[np.argmin(area[tied])])


def least_overlap(tree: Tree, node: Node, lo: np.ndarray, hi: np.ndarray) -> int:
    """Above leaves the child whose overlap with its siblings grows least, ties by enlargement; elsewhere enlargement."""
    if not node.rows[0].leaf:
        return least_enlargement(tree, node, lo, hi)
    clo, chi = tree.corners(node)
    nlo, nhi = np.minimum(clo, lo), np.maximum(chi, hi)

    def shared(alo, ahi):
        edges = np.maximum(np.minimum(ahi[:, None], chi[None]) - np.maximum(alo[:, None], clo[None]), 0)
        areas = edges.prod(-1)
        np.fill_diagonal(areas, 0)
        return areas.sum(1)

    growth = shared(nlo, nhi) - shared(clo, chi)
    if not np.isfinite(growth).all():
        return least_enlargement(tree, node, lo, hi)
    tied = _least(growth)
    gain = _area(nlo, nhi) - _area(clo, chi)
    tied = tied[_least(gain[tied])]
    return int(tied[np.argmin(_area(clo, chi)[tied])])


def quadratic_split(tree: Tree, node: Node) -> tuple[list[int], list[int]]:
    """The two rows that waste most area start a group each; the rest join, the most decided first, the group they enlarge
    less, then the smaller, then the shorter one. While just one group is short of the least size, and the rest could fill
    it, that group takes all the rest."""
    lo, hi = tree.corners(node)
    area = _area(lo, hi)
    waste = _area(np.minimum(lo[:, None], lo), np.maximum(hi[:, None], hi)) - area[:, None] - area
    waste = np.where(np.abs(waste) < 1e6, np.round(waste, 9), waste)  # as pick_seeds does, so that copies tie
    waste[np.tril_indices(len(lo))] = -np.inf
    a, b = np.unravel_index(np.argmax(waste), waste.shape)
    groups = [[int(a)], [int(b)]]
    box = [[lo[a], hi[a]], [lo[b], hi[b]]]
    left = [i for i in range(len(lo)) if i not in (a, b)]
    while left:
        short = [g for g in (0, 1) if len(groups[g]) < tree.least <= len(groups[g]) + len(left)]
        if len(short) == 1:
            groups[short[0]] += left
            break
        sizes = [float(_area(*box[g])) for g in (0, 1)]
        gain = np.array([_area(np.minimum(lo[left], box[g][0]), np.maximum(hi[left], box[g][1])) - sizes[g] for g in (0, 1)])
        at = int(np.argmax(np.abs(gain[0] - gain[1])))
        tied = _least(gain[:, at])
        tied = tied if len(tied) == 1 else _least(np.array(sizes))
        g = int(min(tied.tolist(), key=lambda g: (len(groups[g]), g)))
        i = left.pop(at)
        groups[g].append(i)
        box[g] = [np.minimum(box[g][0], lo[i]), np.maximum(box[g][1], hi[i])]
    return groups[0], groups[1]


def axis_split(tree: Tree, node: Node) -> tuple[list[int], list[int]]:
    """The axis whose legal cuts have the least summed perimeter; on it the cut of least overlap, then least area."""
    lo, hi = tree.corners(node)
    n, best = len(lo), None
    for axis in range(lo.shape[1]):
        total, cuts = 0.0, []
        for edge in (lo, hi):
            order = np.argsort(edge[:, axis], kind="stable")
            alo, ahi = np.minimum.accumulate(lo[order]), np.maximum.accumulate(hi[order])
            blo, bhi = np.minimum.accumulate(lo[order][::-1])[::-1], np.maximum.accumulate(hi[order][::-1])[::-1]
            for first in range(tree.least, n - tree.least + 1):
                l1, h1, l2, h2 = alo[first - 1], ahi[first - 1], blo[first], bhi[first]
                total += 2 * float((h1 - l1).sum() + (h2 - l2).sum())
                cuts.append((float(np.maximum(np.minimum(h1, h2) - np.maximum(l1, l2), 0).prod()), float(_area(l1, h1) + _area(l2, h2)), order, first))
        if best is None or total < best[0]:
            best = (total, cuts)
    cuts = best[1]
    tied = _least(np.array([c[0] for c in cuts]))
    _, _, order, first = cuts[min(tied.tolist(), key=lambda i: (cuts[i][1], i))]
    return order[:first].tolist(), order[first:].tolist()


def nearest_rows(tree: Tree, node: Node) -> list[int]:
    """The AGAIN share of rows nearest to the node's centre, nearest first."""
    lo, hi = tree.corners(node)
    centre = (lo.min(0) + hi.max(0)) / 2
    return np.argsort((((lo + hi) / 2 - centre) ** 2).sum(1), kind="stable")[: int(np.ceil(AGAIN * len(lo)))].tolist()


STRATEGIES = {"guttman": (least_enlargement, quadratic_split, None), "rstar": (least_overlap, axis_split, nearest_rows)}


def build(lo: np.ndarray, hi: np.ndarray, capacity: int, strategy: str | tuple) -> Tree:
    """A tree over boxes, inserted in their order."""
    if capacity < 2:
        raise ValueError("capacity: 2 or more")
    tree = Tree(lo, hi, capacity, *(STRATEGIES[strategy] if isinstance(strategy, str) else strategy))
    for i in range(len(lo)):
        tree.insert(i)
    return tree


def local_paths(tiles: DataFrame, d: int, key: str, capacity: int, strategy: str) -> DataFrame:
    """The rows, their node_id (a tile, bounded in size) replaced by their leaf in the tile's own tree."""
    names = [f"{s}_{i}" for s in ("min", "max") for i in range(d)]
    schema = T.StructType([f if f.name != "node_id" else T.StructField("node_id", T.StringType()) for f in tiles.schema.fields])

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, kind="stable").reset_index(drop=True)
        x = rows[names].to_numpy(dtype=float)
        tree = build(x[:, :d], x[:, d:], capacity, strategy)
        own = dict(tree.paths())
        return rows.assign(node_id=[f"{t}{own[i]}" for i, t in enumerate(rows["node_id"])])[schema.names]

    return tiles.groupBy("node_id").applyInPandas(grow, schema)
