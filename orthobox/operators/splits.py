"""The decisions of insertion-built trees, taken for many nodes at once by joins and windows.

Nodes are groups of boxes: a column `node` and unique ids within it. These are the same rules that operators/insertion.py
follows one insertion at a time.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from orthobox.functions.boxes import Box, axes
from orthobox.shared import few

#: Values this close, relative to each other, are ties.
TIE = 1e-5
#: Boxes that meet a node's children in one task, and their pairs that it looks at together.
TOGETHER, AT_ONCE = 65_536, 500_000


def pick_seeds(df: DataFrame, node: str = "node", key: str = "id") -> DataFrame:
    """node, a, b, waste: the two boxes that would waste most area in one box; the first pair by id of equals."""
    d = axes(df)
    a, b = Box.of(d, "a."), Box.of(d, "b.")
    pairs = df.alias("a").join(df.alias("b"), (F.col(f"a.{node}") == F.col(f"b.{node}")) & (F.col(f"a.{key}") < F.col(f"b.{key}")))
    waste = pairs.select(F.col(f"a.{node}").alias(node), F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), F.round(a.union(b).area() - a.area() - b.area(), 9).alias("waste"))
    best = waste.groupBy(node).agg(F.max(F.struct("waste", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))).alias("m"))
    return best.select(node, (-F.col("m.na")).alias("a"), (-F.col("m.nb")).alias("b"), F.col("m.waste").alias("waste"))


def _rounded(x: np.ndarray) -> np.ndarray:
    """To nine digits, halves away from zero."""
    scaled = x * 1e9
    whole = np.trunc(scaled)
    return (whole + np.sign(scaled) * (np.abs(scaled - whole) >= 0.5)) / 1e9


def choose_subtree(boxes: DataFrame, children: DataFrame, key: str = "id") -> DataFrame:
    """id, child, enlargement: for each box (with a column parent_id) the child of that node that it enlarges least.

    Ties, within TIE, go to the smallest child, then the first node_id. A node's children meet TOGETHER of its boxes in a task,
    which keeps one child a box: no pair is shuffled.
    """
    d = axes(boxes)
    names = [f"{s}_{i}" for s in ("min", "max") for i in range(d)]
    corners = [F.col(c).cast("double").alias(c) for c in names]
    shares = few(boxes.groupBy(F.col("parent_id").alias("n_")).agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("shares_")))
    new = boxes.join(shares, F.col("parent_id") == F.col("n_")).select(F.col("n_").alias("at_"), F.pmod(F.xxhash64(key), F.col("shares_")).cast("int").alias("share_"), key, *corners)
    old = children.join(shares, F.col("parent_id") == F.col("n_")).select(F.col("n_").alias("p_"), F.explode(F.sequence(F.lit(0), F.col("shares_") - 1)).alias("part_"), "node_id", *corners)
    schema = T.StructType([boxes.schema[key], T.StructField("child", T.StringType()), T.StructField("enlargement", T.DoubleType())])

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("node_id")
        b, c = ([f.column(n).to_numpy() for n in names] for f in (left, right))
        area = reduce(np.multiply, [c[d + i] - c[i] for i in range(d)])
        size, kept, best, least_of = _rounded(area), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        step = max(1, AT_ONCE // max(1, len(right)))
        for first in range(0, len(left) if len(right) else 0, step):
            own = slice(first, first + step)
            both = reduce(np.multiply, [np.fmax(c[d + i], b[d + i][own, None]) - np.fmin(c[i], b[i][own, None]) for i in range(d)])
            more = _rounded(both - area)  # of a child without a box there is none
            least = np.fmin.reduce(more, axis=1)[:, None]
            tied = more - least <= TIE * np.maximum(np.abs(more), np.abs(least))
            at = np.argmin(np.where(tied, size, np.inf), axis=1)
            some = np.flatnonzero(tied.any(1))
            kept.append(some + first)
            best.append(at[some])
            least_of.append(more[some, at[some]])
        kept, best = np.concatenate(kept), np.concatenate(best)
        return pa.Table.from_arrays([left.column(key).take(pa.array(kept)), right.column("node_id").take(pa.array(best)), pa.array(np.concatenate(least_of))], names=schema.names)

    return new.groupBy("at_", "share_").cogroup(old.groupBy("p_", "part_")).applyInArrow(choose, schema)


def split_candidates(df: DataFrame, least: int, node: str = "node", key: str = "id") -> DataFrame:
    """Every legal two-way split of every node: node, axis, side (0 by lower, 1 by upper edge), first (size of the first
    group), overlap, area, perimeter.

    Boxes are ordered by one edge of one axis, ties by id, and cut after `first` of them, each group having at least `least`.
    """
    d = axes(df)
    orders = F.array(*[F.struct(F.lit(i).alias("axis"), F.lit(s).alias("side"), F.col(f"{'max' if s else 'min'}_{i}").cast("double").alias("edge")) for i in range(d) for s in (0, 1)])
    rows = df.select(node, key, *Box.of(d).named(), F.explode(orders).alias("o")).select(node, key, *Box.of(d).named(), "o.axis", "o.side", "o.edge")
    w = Window.partitionBy(node, "axis", "side").orderBy("edge", key)
    # The rows after one are those before it in the mirrored order, where a frame grows by a row at a time.
    mirrored = Window.partitionBy(node, "axis", "side").orderBy(F.desc("edge"), F.desc(key))
    head, rest = w.rowsBetween(Window.unboundedPreceding, 0), mirrored.rowsBetween(Window.unboundedPreceding, -1)
    one = Box(tuple(F.min(f"min_{i}").over(head) for i in range(d)), tuple(F.max(f"max_{i}").over(head) for i in range(d)))
    two = Box(tuple(F.min(f"min_{i}").over(rest) for i in range(d)), tuple(F.max(f"max_{i}").over(rest) for i in range(d)))
    size = F.count(F.lit(1)).over(Window.partitionBy(node, "axis", "side"))
    wide = rows.select(node, "axis", "side", F.row_number().over(w).alias("first"), size.alias("size"), *one.named("a"), *two.named("b"))
    a, b = Box.of(d, "a"), Box.of(d, "b")
    legal = wide.filter(f"first >= {least} and size - first >= {least}")
    return legal.select(node, "axis", "side", "first", F.round(a.intersection_area(b), 9).alias("overlap"), F.round(a.area() + b.area(), 9).alias("area"), F.round(a.perimeter() + b.perimeter(), 9).alias("perimeter"))


def rstar_split(candidates: DataFrame, node: str = "node") -> DataFrame:
    """node, axis, side, first: the axis of least summed perimeter, on it the split of least overlap, then least area.

    Overlaps within TIE of the least are ties; equal axes go to the lower one, equal splits to the lower edge's.
    """
    sums = candidates.groupBy(node, "axis").agg(F.round(F.sum("perimeter"), 6).alias("total"))
    axis = sums.groupBy(node).agg(F.min(F.struct("total", "axis")).alias("m")).select(F.col(node).alias("_n"), F.col("m.axis").alias("_axis"))
    own = candidates.join(axis, (F.col(node) == F.col("_n")) & (F.col("axis") == F.col("_axis"))).drop("_n", "_axis")
    least = F.min("overlap").over(Window.partitionBy(node))
    tied = own.withColumn("least", least).filter(reduce(or_, [F.col("overlap") == F.col("least"), F.col("overlap") - F.col("least") <= TIE * F.col("overlap")]))
    best = tied.groupBy(node).agg(F.min(F.struct("area", "side", "first", "axis")).alias("m"))
    return best.select(node, F.col("m.axis").alias("axis"), F.col("m.side").alias("side"), F.col("m.first").alias("first"))
