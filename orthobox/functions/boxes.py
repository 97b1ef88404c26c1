"""Boxes as pairs of column lists. Every method returns an expression, so Catalyst sees plain arithmetic and comparisons.

Two boxes intersect only if their insides share a point (touching does not count); a box contains the points of its edges.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relative and absolute tolerance of close_to.
RTOL, ATOL = 1e-5, 1e-8


def _sum(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _product(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a * b, terms)


def axes(df: DataFrame, prefix: str = "") -> int:
    """How many axes the table has: columns prefix + min_0, min_1, ... and as many max ones."""
    found = {side: {int(m[1]) for c in df.columns if (m := re.fullmatch(rf"{prefix}{side}_(\d+)", c))} for side in ("min", "max")}
    if not found["min"] or found["min"] != found["max"] or found["min"] != set(range(len(found["min"]))):
        raise ValueError(f"no box columns {prefix}min_0.., {prefix}max_0.. in {df.columns}")
    return len(found["min"])


@dataclass(frozen=True)
class Box:
    """lo and hi: the lower and upper corner, one column per axis."""

    lo: tuple[Column, ...]
    hi: tuple[Column, ...]

    def __post_init__(self):
        if len(self.lo) != len(self.hi) or not self.lo:
            raise ValueError("both corners need the same axes, at least one")

    @staticmethod
    def of(d: int, prefix: str = "") -> Box:
        """The box in columns prefix + min_0 .. max_{d-1}; prefix may name a table alias, as in "a."."""
        return Box(tuple(F.col(f"{prefix}min_{i}") for i in range(d)), tuple(F.col(f"{prefix}max_{i}") for i in range(d)))

    @staticmethod
    def at(lo: Sequence[float], hi: Sequence[float]) -> Box:
        return Box(tuple(F.lit(float(x)) for x in lo), tuple(F.lit(float(x)) for x in hi))

    @staticmethod
    def point(coords: Sequence[float | Column]) -> Box:
        p = tuple(c if isinstance(c, Column) else F.lit(float(c)) for c in coords)
        return Box(p, p)

    @staticmethod
    def arrays(lo: Column, hi: Column, d: int) -> Box:
        """Corners held in arrays, for many axes; unrolled, so that expressions stay in generated code."""
        return Box(tuple(F.element_at(lo, i + 1) for i in range(d)), tuple(F.element_at(hi, i + 1) for i in range(d)))

    @property
    def d(self) -> int:
        return len(self.lo)

    def _pairs(self, other: Box) -> list[tuple[Column, Column, Column, Column]]:
        if self.d != other.d:
            raise ValueError(f"{self.d} and {other.d} axes")
        return list(zip(self.lo, self.hi, other.lo, other.hi))

    def intersects(self, other: Box) -> Column:
        """Whether the insides share a point."""
        return reduce(and_, [(h > l2) & (l < h2) for l, h, l2, h2 in self._pairs(other)])

    def contains(self, coords: Sequence[float | Column]) -> Column:
        """Whether the point is inside or on an edge."""
        if len(coords) != self.d:
            raise ValueError(f"{len(coords)} coordinates for {self.d} axes")
        return reduce(and_, [(l <= p) & (h >= p) for l, h, p in zip(self.lo, self.hi, Box.point(coords).lo)])

    def touches(self, other: Box) -> Column:
        """Whether they share a point, edges included."""
        return reduce(and_, [(h >= l2) & (l <= h2) for l, h, l2, h2 in self._pairs(other)])

    def union(self, other: Box) -> Box:
        """The smallest box around both; a null corner (no box) leaves the other."""
        p = self._pairs(other)
        return Box(tuple(F.least(l, l2) for l, _, l2, _ in p), tuple(F.greatest(h, h2) for _, h, _, h2 in p))

    def overlap(self, other: Box) -> Box:
        """The shared box; its corners are crossed where there is none."""
        p = self._pairs(other)
        return Box(tuple(F.greatest(l, l2) for l, _, l2, _ in p), tuple(F.least(h, h2) for _, h, _, h2 in p))

    def intersection(self, other: Box) -> Column:
        """The shared box as a struct, null unless it has an inside."""
        shared = self.overlap(other)
        return F.when(shared.proper(), shared.struct())

    def proper(self) -> Column:
        return reduce(and_, [l < h for l, h in zip(self.lo, self.hi)])

    def intersection_area(self, other: Box) -> Column:
        return _product([F.greatest(F.lit(0.0), h - l) for l, h in zip(self.overlap(other).lo, self.overlap(other).hi)])

    def edges(self) -> list[Column]:
        return [h - l for l, h in zip(self.lo, self.hi)]

    def area(self) -> Column:
        return _product(self.edges())

    def log_area(self) -> Column:
        """The logarithm of the area, for so many axes that the product would overflow; null for no inside."""
        return _sum([F.when(e > 0, F.log(e)) for e in self.edges()])

    def perimeter(self) -> Column:
        """Twice the sum of the edges, in any number of axes."""
        return 2 * _sum(self.edges())

    def centroid(self) -> list[Column]:
        return [(l + h) / 2 for l, h in zip(self.lo, self.hi)]

    def min_dist_sq(self, coords: Sequence[float | Column]) -> Column:
        """Squared distance from a point to the box, 0 inside."""
        return _sum([F.pow(F.greatest(F.lit(0.0), l - p, p - h), 2) for l, h, p in zip(self.lo, self.hi, Box.point(coords).lo, strict=True)])

    def max_dist_sq(self, coords: Sequence[float | Column]) -> Column:
        """Squared distance from a point to the box's farthest corner."""
        return _sum([F.pow(F.greatest(F.abs(p - l), F.abs(p - h)), 2) for l, h, p in zip(self.lo, self.hi, Box.point(coords).lo, strict=True)])

    def centroid_distance(self, other: Box) -> Column:
        return F.sqrt(_sum([F.pow(a - b, 2) for a, b in zip(self.centroid(), other.centroid(), strict=True)]))

    def close_to(self, other: Box) -> Column:
        """Equality within tolerance, relative to the other box."""
        return reduce(and_, [F.abs(a - b) <= ATOL + RTOL * F.abs(b) for a, b in zip((*self.lo, *self.hi), (*other.lo, *other.hi), strict=True)])

    def enlargement(self, other: Box) -> Column:
        """How much area the box gains by taking in the other."""
        return self.union(other).area() - self.area()

    def struct(self) -> Column:
        return F.struct(*self.named())

    def named(self, prefix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}min_{i}") for i, c in enumerate(self.lo)] + [c.alias(f"{prefix}max_{i}") for i, c in enumerate(self.hi)]


def mbr(box: Box, prefix: str = "") -> list[Column]:
    """Aggregates: the smallest box around all rows' boxes; null over no rows."""
    return [F.min(c).alias(f"{prefix}min_{i}") for i, c in enumerate(box.lo)] + [F.max(c).alias(f"{prefix}max_{i}") for i, c in enumerate(box.hi)]


def located(box: Box, location: Box | Sequence[float]) -> Column:
    """The test of a location: a point, closed, if it is a list of numbers, else a box, open."""
    return box.intersects(location) if isinstance(location, Box) else box.contains(location)


def features(box: Box, extent: Box) -> list[Column]:
    """4 d + 1 numbers of a box within its set's extent: corners, sizes, volume and centre, scaled to the extent."""
    scale = [F.greatest(e, F.lit(1e-9)) for e in extent.edges()]
    lo = [(c - o) / s for c, o, s in zip(box.lo, extent.lo, scale)]
    hi = [(c - o) / s for c, o, s in zip(box.hi, extent.lo, scale)]
    size = [h - l for l, h in zip(lo, hi)]
    return [*lo, *hi, *size, _product(size), *[(l + h) / 2 for l, h in zip(lo, hi)]]
