"""Batches inserted into an index that exists already, for all rows, leaves and nodes of a level at once.

A batch descends the node table together, each row into the child that it enlarges least. Leaves that overflow first give up a
share of their rows, which descend once more (R*), and are then split, as are nodes that get too many children, up to the
root. Node ids stay what they are but for split nodes, whose parts get new ones; so only leaves that took rows are rewritten.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orthobox.functions.boxes import Box, axes, mbr
from orthobox.operators.index import SpatialIndex
from orthobox.operators.packing import tiles
from orthobox.operators.splits import choose_subtree, rstar_split, split_candidates
from orthobox.shared import few, settled

#: The share of an overfull leaf's rows that are inserted again.
AGAIN = 0.3
#: Leaves with over so many times the capacity, as a large batch in a small index makes them, are cut as sort-tile does.
BULK = 8


@dataclass(frozen=True)
class Grown:
    """The index after a batch, the entries of leaves that were written anew, and the ids of leaves that are no longer."""

    index: SpatialIndex
    changed: DataFrame
    gone: DataFrame


def route(rows: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """The rows with node_id, the leaf that each comes to: at every node the child of least enlargement, ties to the
    smallest, then the first."""
    d = axes(nodes)
    slim = few(nodes.select("node_id", "parent_id", "is_leaf", *Box.of(d).named()))
    root = slim.filter("parent_id is null").select(F.col("node_id").alias("parent_id"), F.col("is_leaf").alias("stop_"))
    at = rows.drop("node_id").join(F.broadcast(root))  # one row
    done, at = at.filter("stop_").drop("stop_").withColumnRenamed("parent_id", "node_id"), at.filter("not stop_").drop("stop_")
    for _ in range(nodes.agg(F.max("level")).first()[0] or 0):
        at = settled(at)
        chosen = choose_subtree(at.select(key, "parent_id", *Box.of(d).named()), slim, key).select(F.col(key).alias("k_"), F.col("child").alias("c_"))
        leaf = slim.select(F.col("node_id").alias("c_"), F.col("is_leaf").alias("stop_"))
        at = at.drop("parent_id").join(chosen, F.col(key) == F.col("k_")).join(leaf, "c_").drop("k_").withColumnRenamed("c_", "parent_id")
        done = done.unionByName(at.filter("stop_").drop("stop_").withColumnRenamed("parent_id", "node_id"))
        at = at.filter("not stop_").drop("stop_")
    return done


def split_over(rows: DataFrame, capacity: int, key: str) -> DataFrame:
    """rows (group, key, box) with `part`: groups over capacity by the R* rules in two, and again, until none is over it; far
    too large ones as sort-tile would. `part` is the group for those that fit."""
    d, least = axes(rows), max(1, int(0.4 * capacity))
    now, done = rows.withColumn("part", F.col("group")), None
    sizes = few(now.groupBy("part").agg(F.count(F.lit(1)).alias("n_")))
    sized = settled(now.join(sizes, "part"))
    bulk = sized.filter(F.col("n_") > BULK * capacity).drop("n_")
    done = sized.filter(F.col("n_") <= capacity).drop("n_")
    now = sized.filter((F.col("n_") > capacity) & (F.col("n_") <= BULK * capacity)).drop("n_")
    if bulk.head(1):
        cut = tiles(bulk.drop("group").withColumnRenamed("part", "within_"), capacity, key, "within_")
        done = done.unionByName(cut.withColumn("part", F.translate("group", ".", "~")).drop("group").withColumnRenamed("within_", "group"))
    while now.head(1):
        now = settled(now)
        split = few(rstar_split(split_candidates(now, least, "part", key), "part"))
        met = now.join(split, "part")
        edges = F.array(*[F.array(F.col(f"min_{i}").cast("double"), F.col(f"max_{i}").cast("double")) for i in range(d)])
        edge = F.element_at(F.element_at(edges, F.col("axis") + 1), F.col("side") + 1)
        place = F.row_number().over(Window.partitionBy("part").orderBy("edge_", key))
        parted = met.withColumn("edge_", edge).withColumn("place_", place)
        parted = parted.withColumn("part", F.concat("part", F.when(F.col("place_") <= F.col("first"), "a").otherwise("b"))).drop("edge_", "place_", "axis", "side", "first")
        counted = settled(parted.withColumn("n_", F.count(F.lit(1)).over(Window.partitionBy("part"))))
        done = done.unionByName(counted.filter(F.col("n_") <= capacity).drop("n_"))
        now = counted.filter(F.col("n_") > capacity).drop("n_")
    return done


def again(rows: DataFrame, capacity: int, key: str = "id", node: str = "node_id") -> DataFrame:
    """The rows of nodes over capacity that are inserted again: of each the AGAIN share nearest to its centre, ties by key."""
    d, own = axes(rows), Window.partitionBy(node)
    sized = rows.withColumn("n_", F.count(F.lit(1)).over(own)).filter(F.col("n_") > capacity)
    around = Box(tuple(F.min(f"min_{i}").over(own) for i in range(d)), tuple(F.max(f"max_{i}").over(own) for i in range(d)))
    far = sum((F.pow(a - b, 2) for a, b in zip(Box.of(d).centroid(), around.centroid())), F.lit(0.0))
    placed = sized.withColumn("far_", F.round(far, 9)).withColumn("place_", F.row_number().over(own.orderBy("far_", key)))
    return placed.filter(F.col("place_") <= F.ceil(F.lit(AGAIN) * F.col("n_"))).drop("n_", "far_", "place_")


def _rolled(leaves: DataFrame, inner: DataFrame, d: int) -> DataFrame:
    """All nodes, from leaves (complete rows) and inner ones (node_id, parent_id, level): boxes and counts from the children."""
    columns = ["node_id", "parent_id", "level", "is_leaf", "n_children", "n_entries", *[f"{s}_{i}" for s in ("min", "max") for i in range(d)]]
    out = level = None
    for at in range((leaves.agg(F.max("level")).first()[0] or 0), -1, -1):
        own = leaves.filter(F.col("level") == at).select(*columns)
        if level is not None:
            summed = level.groupBy(F.col("parent_id").alias("p_")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_entries").alias("n_entries"), *mbr(Box.of(d)))
            own = own.unionByName(inner.filter(F.col("level") == at).withColumn("is_leaf", F.lit(False)).join(summed, F.col("node_id") == F.col("p_")).select(*columns))
        level = settled(own)
        out = level if out is None else out.unionByName(level)
    return out


def insert_batch(index: SpatialIndex, batch: DataFrame, capacity: int, key: str = "id", reinsert: bool = True) -> Grown:
    """The index with the batch's rows, which have the entries' columns (but node_id) and keys that are in it no more than once.

    Every leaf holds at most `capacity` entries and every node at most so many children, if they did before. An empty batch
    changes nothing; into an empty index the batch is packed as its first leaf, which then is split.
    """
    if capacity < 2:
        raise ValueError("capacity: 2 or more")
    d, columns = axes(batch), [c for c in index.entries.columns if c != "node_id"]
    nodes, batch = index.nodes, batch.select(*columns)
    if not batch.head(1):
        return Grown(index, index.entries.limit(0), nodes.select("node_id").limit(0))
    if not nodes.head(1):
        routed = settled(batch.withColumn("node_id", F.lit("r")))
        known = routed.limit(0)
        leaves_before = batch.sparkSession.createDataFrame([("r", None, 0)], "node_id string, parent_id string, level int")
        inner = leaves_before.limit(0)
    else:
        routed = settled(route(batch, nodes, key).select(*columns, "node_id"))
        known = index.entries.select(*columns, "node_id")
        leaves_before = nodes.filter("is_leaf").select("node_id", "parent_id", F.col("level").cast("int").alias("level"))
        inner = nodes.filter("not is_leaf").select("node_id", "parent_id", F.col("level").cast("int").alias("level"))

    def of_touched(routed: DataFrame) -> DataFrame:
        touched = few(routed.select("node_id").distinct())
        return settled(known.join(touched, "node_id", "left_semi").select(*columns, "node_id").unionByName(routed))

    rows = of_touched(routed)
    if reinsert and nodes.head(1):
        out = settled(again(rows, capacity, key).select(*columns, "node_id"))
        if out.head(1):
            left = settled(rows.join(out.select(F.col(key).alias("k_")), F.col(key) == F.col("k_"), "left_anti"))
            shrunk = left.groupBy(F.col("node_id").alias("l_")).agg(*mbr(Box.of(d), "x"))
            new = leaves_before.join(nodes.drop("parent_id", "level"), "node_id").join(shrunk, F.col("node_id") == F.col("l_"), "left")
            boxed = new.select("node_id", "parent_id", "level", "is_leaf", "n_children", "n_entries", *[F.coalesce(f"x{c}", c).alias(c) for c in (f"{s}_{i}" for s in ("min", "max") for i in range(d))])
            moved = settled(route(out.select(*columns), _rolled(boxed, inner, d), key).select(*columns, "node_id"))
            here = few(left.select("node_id").distinct())
            others = few(moved.select("node_id").distinct().join(here, "node_id", "left_anti"))
            rows = settled(left.unionByName(moved).unionByName(known.join(others, "node_id", "left_semi").select(*columns, "node_id")))

    parted = settled(split_over(rows.withColumnRenamed("node_id", "group"), capacity, key))
    changed = settled(parted.select(*columns, F.col("part").alias("node_id")))
    origin = parted.select("part", "group").distinct()
    gone = settled(origin.filter("part <> group").select(F.col("group").alias("node_id")).distinct())
    before = leaves_before.select(F.col("node_id").alias("group"), "parent_id", "level")
    boxes = changed.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_entries"), *mbr(Box.of(d)))
    written = boxes.join(origin.withColumnRenamed("part", "node_id"), "node_id").join(before, "group").drop("group")
    same = nodes.filter("is_leaf").join(few(rows.select("node_id").distinct()), "node_id", "left_anti").select("node_id", "n_entries", *Box.of(d).named(), "parent_id", F.col("level").cast("int").alias("level"))
    leaves = settled(same.unionByName(written.select(*same.columns)))
    leaves, inner = _split_nodes(leaves, settled(inner), capacity, d)
    leaves = leaves.withColumns({"is_leaf": F.lit(True), "n_children": F.col("n_entries")})
    nodes = settled(_rolled(leaves, inner, d))
    untouched = index.entries.select(*columns, "node_id").join(few(rows.select("node_id").distinct()), "node_id", "left_anti")
    return Grown(SpatialIndex(nodes, untouched.unionByName(changed)), changed, gone)


def _split_nodes(leaves: DataFrame, inner: DataFrame, capacity: int, d: int) -> tuple[DataFrame, DataFrame]:
    """Leaves and inner nodes after all nodes with over `capacity` children are split, level by level up to the root.

    A root that is split, or that was a leaf, gets a new level of nodes below it and keeps its id.
    """
    if leaves.filter("parent_id is null").limit(2).count() > 1:
        inner = leaves.limit(1).select(F.lit("r").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("level"))
        leaves = settled(leaves.withColumns({"parent_id": F.lit("r"), "level": F.lit(1)}))
    depth = leaves.agg(F.max("level")).first()[0] or 0
    at = depth
    while at > 0:
        marked = leaves.withColumns({"is_leaf": F.lit(True), "n_children": F.col("n_entries")})
        boxed = _rolled(marked, inner, d).filter(F.col("level") == at)
        over = boxed.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > capacity).select("parent_id")
        over = few(over)
        if over.head(1):
            rows = boxed.join(over, "parent_id").select(F.col("parent_id").alias("group"), "node_id", *Box.of(d).named())
            parted = settled(split_over(rows, capacity, "node_id").select("group", "part", F.col("node_id").alias("c_")))
            at_root = bool(parted.join(inner.filter("parent_id is null"), F.col("group") == F.col("node_id"), "left_semi").head(1))
            if at_root:  # the root's parts stand a level below it
                parted = settled(parted.withColumn("part", F.concat(F.lit(f"r{depth}"), F.col("part"))))
                leaves, inner = (x.withColumn("level", F.when(F.col("level") > 0, F.col("level") + 1).otherwise(F.col("level")).cast("int")) for x in (leaves, inner))
                depth += 1
            moved = few(parted.select("c_", "part"))
            leaves, inner = (settled(x.join(moved, F.col("node_id") == F.col("c_"), "left").withColumn("parent_id", F.coalesce("part", "parent_id")).drop("c_", "part")) for x in (leaves, inner))
            parts = parted.select("group", "part").distinct()
            old = inner.select(F.col("node_id").alias("group"), F.col("parent_id").alias("up_"), F.col("level").alias("l_"))
            fresh = parts.join(old, "group")
            if at_root:
                made = fresh.select(F.col("part").alias("node_id"), F.col("group").alias("parent_id"), F.lit(1).alias("level"))
                inner = settled(inner.unionByName(made))
                at += 1  # the parts are the root's children now, and few
            else:
                made = fresh.select(F.col("part").alias("node_id"), F.col("up_").alias("parent_id"), F.col("l_").alias("level"))
                inner = settled(inner.join(few(parts.select(F.col("group").alias("node_id")).distinct()), "node_id", "left_anti").unionByName(made))
        at -= 1
    return leaves, inner


def write_leaves(entries: DataFrame, path: str) -> None:
    """Entries as Parquet, a folder for each leaf; folders of leaves that are not among the entries stay untouched."""
    dealt = entries.withColumn("leaf", F.col("node_id")).repartition("leaf").drop("node_id")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("leaf").parquet(path)


def read_leaves(nodes: DataFrame, path: str) -> DataFrame:
    """The entries of an index's leaves, read from their folders only: those of leaves that are no longer are passed over."""
    stored = nodes.sparkSession.read.parquet(path)
    leaves = few(nodes.filter("is_leaf").select(F.col("node_id").alias("leaf")))
    return stored.withColumn("leaf", F.col("leaf").cast("string")).join(leaves, "leaf", "left_semi").withColumnRenamed("leaf", "node_id")
