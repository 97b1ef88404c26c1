"""Spatial indexes as two tables, built for all nodes of a level at once.

nodes: node_id (path from the root, "r", "r.0", "r.0.2"), parent_id, level, is_leaf, n_children, n_entries, min_i, max_i.
entries: node_id of the leaf, id, min_i, max_i and whatever else the input has.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthobox.functions.boxes import Box, axes, mbr
from orthobox.shared import few, settled, tile, with_rank


#: Rows of a node that a task parts down to its leaves alone; labelled nodes may be larger, as their cuts are often uneven.
WHOLE, WHOLE_LABELLED = 1 << 17, 1 << 18


@dataclass(frozen=True)
class SpatialIndex:
    nodes: DataFrame
    entries: DataFrame

    @property
    def leaves(self) -> DataFrame:
        return self.nodes.filter("is_leaf")

    def levels(self) -> DataFrame:
        """level, n_nodes, n_leaves; the root is level 0."""
        return self.nodes.groupBy("level").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.col("is_leaf").cast("long")).alias("n_leaves"))

    def by_leaf(self) -> DataFrame:
        """Entries clustered by leaf, so that a written file's statistics prune by box."""
        return self.entries.repartitionByRange("node_id").sortWithinPartitions("node_id")


def from_paths(entries: DataFrame) -> SpatialIndex:
    """The index whose leaves are the entries' node_id paths; every prefix of a path is a node, with the tight box."""
    d = axes(entries)
    leaves = entries.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_entries"), *mbr(Box.of(d)))
    parts = F.split("node_id", r"\.")
    up = leaves.select("*", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth")).withColumn("path", F.concat_ws(".", F.slice(F.split("node_id", r"\."), F.lit(1), F.col("depth"))))
    rolled = up.groupBy("path", "depth").agg(F.max(F.col("path") == F.col("node_id")).alias("is_leaf"), F.sum("n_entries").alias("n_entries"), *mbr(Box.of(d)))
    nodes = rolled.select(F.col("path").alias("node_id"), F.when(F.col("depth") > 1, F.regexp_replace("path", r"\.[^.]*$", "")).alias("parent_id"), (F.col("depth") - 1).alias("level"), "is_leaf", "n_entries", *[c for i in range(d) for c in (f"min_{i}", f"max_{i}")])
    nodes = settled(nodes)
    children = nodes.filter("parent_id is not null").groupBy(F.col("parent_id").alias("_p")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, F.col("node_id") == F.col("_p"), "left").drop("_p").withColumn("n_children", F.coalesce("n_children", "n_entries"))
    return SpatialIndex(nodes, entries)


def _sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


def _placed(df: DataFrame, by: Column | str, key: str, sizes: DataFrame | None = None) -> DataFrame:
    """The rows with n, their node's size, and place, from 0, in their node's order of `by`, such as a centre.

    With sizes (node_id, size) `by` names a column of whole numbers, unique in the table, and rows get `run` instead: which run
    of `size` rows of their node each is in, null in other nodes. Rows then stay where they lie; only the runs' ends are joined.
    """
    if sizes is not None:
        from orthobox.operators.packing import runs_by_rank

        ends = runs_by_rank(df.withColumnRenamed("node_id", "group"), sizes.withColumnRenamed("node_id", "group"), {0: by})
        ends = few(ends.groupBy(F.col("group").alias("_n")).agg(F.array_sort(F.collect_list("last")).alias("_ends")))
        run = F.when(F.col("_ends").isNotNull(), F.size(F.filter("_ends", lambda x: x < F.col(by))))
        return df.join(ends, F.col("node_id") == F.col("_n"), "left").withColumn("run", run).drop("_n", "_ends")
    ranked = with_rank(df.withColumn("_centre", by), [F.col("node_id"), F.col("_centre"), F.col(key)], "_rank")
    first = ranked.groupBy("node_id").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("n"))
    return ranked.join(few(first), "node_id").withColumn("place", F.col("_rank") - F.col("_first")).drop("_rank", "_first", "_centre")


def _root(n: int, power: int) -> int:
    """The least whole number whose power is n or more."""
    root = max(1, int(round(n ** (1 / power))) - 1)
    while root**power < n:
        root += 1
    return root


def build_str(df: DataFrame, capacity: int, fanout: int | None = None, levels: int | None = None, key: str = "id") -> SpatialIndex:
    """Sort-tile: on each level every node is cut into `fanout` tiles of equal count along the next axis.

    By default the fanout is the least that suffices for leaves of at most `capacity`, on as many levels as axes, or on more
    where it would otherwise exceed the capacity: no node has more children than that.
    """
    if capacity < 1:
        raise ValueError("capacity: 1 or more")
    d, n = axes(df), df.count()
    need = max(1, -(-n // capacity))
    given = levels is not None
    levels = levels or d
    if fanout is None:
        fanout = _root(need, levels)
        while fanout > max(2, capacity) and not given:
            levels += 1
            fanout = _root(need, levels)
    now = df.withColumn("node_id", F.lit("r"))
    for level in range(levels):
        placed = _placed(now, Box.of(d).centroid()[level % d], key)
        now = settled(placed.withColumn("node_id", F.concat("node_id", F.lit("."), tile(F.col("place"), F.col("n"), F.lit(fanout)).cast("string"))).drop("place", "n"))
    return from_paths(now)


def _parted(rows: pa.Table, d: int, capacity: int, k: int, key: str, label: Callable[[np.ndarray, np.ndarray], np.ndarray] | None, levels: int | None) -> pa.Table:
    """The rows of one node with the leaves that build_top_down parts it into as their node_id."""
    lo, hi = (np.column_stack([rows.column(f"{s}_{i}").cast(pa.float64()).to_numpy() for i in range(d)]) for s in ("min", "max"))
    centre = (lo + hi) / 2
    for i in range(d):  # Spark's order: nulls first
        centre[rows.column(f"min_{i}").is_null().to_numpy() | rows.column(f"max_{i}").is_null().to_numpy(), i] = -np.inf
    rank = np.empty(len(rows), np.int64)
    rank[pc.sort_indices(rows.column(key), null_placement="at_start").to_numpy()] = np.arange(len(rows))
    path = rows.column("node_id")[0].as_py()
    open_, names, of = [(np.arange(len(rows)), path)], [], np.empty(len(rows), np.int64)
    while open_:
        at, path = open_.pop()
        if len(at) <= capacity or path.count(".") == levels:
            of[at] = len(names)
            names.append(path)
            continue
        part = None if label is None else label(lo[at], hi[at])
        if part is None or part.min() == part.max():
            part = np.empty(len(at), np.int64)
            part[np.lexsort((rank[at], centre[at, path.count(".") % d]))] = np.arange(len(at)) // -(-len(at) // k)
        open_ += [(at[part == x], f"{path}.{x}") for x in np.unique(part).tolist()]
    return rows.set_column(rows.schema.get_field_index("node_id"), "node_id", pa.array(names, pa.string()).take(pa.array(of)))


def build_top_down(df: DataFrame, capacity: int, k: int, label: Callable[[DataFrame, int], DataFrame] | None = None, key: str = "id", whole: int | None = None, levels: int | None = None) -> SpatialIndex:
    """All nodes over capacity are parted into at most k children, level by level, until none is left.

    label(rows, level) adds an integer column `label` to rows (node_id, the box columns, key). Nodes whose rows all get one
    label, and all nodes if there is no label function, are cut into k runs of equal length along axis level mod d. Nodes of up
    to `whole` rows are parted down to their leaves by a task each; a label function has to have local(lo, hi) for that, the
    labels of one node's boxes. If it has assign(rows), whole rows with their label, no row is joined to its label, and only
    nodes of one label are ranked. Without a label function rows are ranked once on each axis and cut where they lie, as ranks
    say. With `levels` nodes on that level are leaves, whatever their size.
    """
    k = min(k, capacity)
    if k < 2:
        raise ValueError("k and capacity: 2 or more")
    local = getattr(label, "local", None)
    whole = (WHOLE if label is None else WHOLE_LABELLED) if whole is None else whole
    whole = max(capacity, whole if label is None or local else capacity)
    d = axes(df)
    if label is None:
        return from_paths(_cut_by_ranks(df, d, capacity, k, key, whole, levels))
    active, finished, level = df.withColumn("node_id", F.lit("r")), [], 0
    schema = active.schema

    def runs(rows: DataFrame) -> DataFrame:
        return _placed(rows, Box.of(d).centroid()[level % d], key).withColumn("label", F.floor(F.col("place") / F.ceil(F.col("n") / k)).cast("int")).drop("place", "n")

    while True:
        sizes = few(_sizes(active))
        sized = active.join(sizes, "node_id").select(*active.columns, "n")
        leaves, small = (F.col("n") <= capacity) | F.lit(level == levels), (F.col("n") > capacity) & (F.col("n") <= whole) & F.lit(level != levels)
        if not finished or sizes.filter(leaves).head(1):
            finished.append(settled(sized.filter(leaves).drop("n")))  # written once, whatever comes after
        if sizes.filter(small).head(1):
            finished.append(settled(sized.filter(small).drop("n").groupBy("node_id").applyInArrow(lambda rows: _parted(rows, d, capacity, k, key, local, levels), schema)))
        if level == levels or not sizes.filter(F.col("n") > whole).head(1):
            return from_paths(reduce(DataFrame.unionByName, finished))
        large = sized.filter(F.col("n") > whole).drop("n")
        parted = settled(_labelled(large, label, level, d, key))
        one = few(parted.groupBy("node_id").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).filter("_a = _b").select("node_id"))
        if one.head(1):
            parted = parted.join(one, "node_id", "left_anti").unionByName(runs(parted.join(one, "node_id", "left_semi").drop("label")))
        active = settled(parted.withColumn("node_id", F.concat("node_id", F.lit("."), F.col("label").cast("string"))).select(*schema.names))
        level += 1


def _cut_by_ranks(df: DataFrame, d: int, capacity: int, k: int, key: str, whole: int, levels: int | None) -> DataFrame:
    """The rows with the leaves, as node_id, that build_top_down parts them into without labels."""
    from orthobox.operators.packing import LAZY, ranked

    active, n, level = df.withColumn("node_id", F.lit("r")), df.count(), 0
    spark, schema, large, ranks = df.sparkSession, active.schema, {"r": n} if n > whole else {}, []
    if large:
        active, ranks = ranked(active, key)
    while large and level != levels:  # a node for `whole` rows at most
        sizes = spark.createDataFrame([(node, -(-m // k)) for node, m in large.items()], "node_id string, size long")
        placed = _placed(active, ranks[level % d], key, sizes)
        active = placed.withColumn("node_id", F.concat_ws(".", "node_id", F.col("run").cast("string"))).select(*schema.names, *ranks)
        cut = {f"{node}.{i}": min(size, m - i * size) for node, m in large.items() for size in [-(-m // k)] for i in range(-(-m // size))}
        large = {node: m for node, m in cut.items() if m > whole}
        level += 1
        if not level % LAZY:
            active = settled(active)
    rows = active.select(*schema.names)
    return settled(rows.groupBy("node_id").applyInArrow(lambda own: _parted(own, d, capacity, k, key, None, levels), schema) if not large else rows)


def _labelled(rows: DataFrame, label: Callable[[DataFrame, int], DataFrame], level: int, d: int, key: str) -> DataFrame:
    """The rows with the label that the function gives them."""
    if hasattr(label, "assign"):
        return label.assign(rows)
    named = label(rows.select("node_id", key, *Box.of(d).named()), level).select(F.col("node_id").alias("_n"), F.col(key).alias("_k"), "label")
    return rows.join(named, (F.col("node_id") == F.col("_n")) & (F.col(key) == F.col("_k"))).drop("_n", "_k")


def build_local(df: DataFrame, capacity: int, strategy: str, tile_rows: int = 4096, key: str = "id") -> SpatialIndex:
    """Trees by one-by-one insertion ("guttman" or "rstar"), one per spatial tile of at most tile_rows rows.

    The tiles are those of a sort-tile index with no more children a node than the capacity, which stands above the local trees.
    """
    from orthobox.operators.insertion import local_paths

    d, need = axes(df), max(1, -(-df.count() // tile_rows))
    levels = d
    while _root(need, levels) > max(2, capacity):
        levels += 1
    tiles = build_str(df, tile_rows, levels=levels, key=key).entries
    return from_paths(settled(local_paths(tiles, d, key, capacity, strategy)))


def violations(index: SpatialIndex, capacity: int | None = None, key: str = "id") -> dict[str, int]:
    """How often the rules of an index are broken; all zero for a sound one."""
    d = axes(index.nodes)
    child, parent = index.nodes.alias("c"), index.nodes.alias("p")
    both = child.join(parent, F.col("c.parent_id") == F.col("p.node_id"), "left")
    inside = None
    for i in range(d):
        term = (F.col(f"c.min_{i}") >= F.col(f"p.min_{i}")) & (F.col(f"c.max_{i}") <= F.col(f"p.max_{i}"))
        inside = term if inside is None else inside & term
    tight = index.entries.groupBy("node_id").agg(*mbr(Box.of(d), "t")).join(index.leaves, "node_id")
    loose = None
    for i in range(d):
        term = (F.col(f"tmin_{i}") != F.col(f"min_{i}")) | (F.col(f"tmax_{i}") != F.col(f"max_{i}"))
        loose = term if loose is None else loose | term
    return {
        "roots": abs(index.nodes.filter("parent_id is null").count() - 1),
        "entries_twice": index.entries.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").count(),
        "outside_parent": both.filter(F.col("c.parent_id").isNotNull() & (F.col("p.node_id").isNull() | ~inside)).count(),
        "loose_leaves": tight.filter(loose).count(),
        "children_over_capacity": index.nodes.filter(~F.col("is_leaf") & (F.col("n_children") > max(2, capacity))).count() if capacity else 0,
        "over_capacity": index.leaves.filter(F.col("n_entries") > capacity).count() if capacity else 0,
    }


