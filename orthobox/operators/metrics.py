"""How good an index is, without regard to time: overlap, coverage, and the nodes that queries test and open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthobox.functions.boxes import Box, axes
from orthobox.operators.query import range_join_sums
from orthobox.shared import few, settled


def sibling_overlap(nodes: DataFrame) -> DataFrame:
    """overlap: the summed areas that each two children of a node share. Entries of leaves do not count."""
    d = axes(nodes)
    a, b = nodes.alias("a"), nodes.alias("b")
    pairs = a.join(b, (F.col("a.parent_id") == F.col("b.parent_id")) & (F.col("a.node_id") < F.col("b.node_id")))
    return pairs.agg(F.coalesce(F.sum(Box.of(d, "a.").intersection_area(Box.of(d, "b."))), F.lit(0.0)).alias("overlap"))


def coverage(nodes: DataFrame) -> DataFrame:
    """coverage: the summed areas of all nodes but the root."""
    return nodes.filter("parent_id is not null").agg(F.coalesce(F.sum(Box.of(axes(nodes)).area()), F.lit(0.0)).alias("coverage"))


def overlap_ratio(nodes: DataFrame) -> DataFrame:
    """overlap, coverage and their ratio, 0 where nothing is covered; it may exceed 1."""
    both = sibling_overlap(nodes).crossJoin(coverage(nodes))  # one row each
    return both.withColumn("overlap_ratio", F.when(F.col("coverage") > 0, F.col("overlap") / F.col("coverage")).otherwise(F.lit(0.0)))


def node_accesses(queries: DataFrame, nodes: DataFrame, qid: str = "qid") -> DataFrame:
    """For each query (qmin_i, qmax_i): nodes_tested and nodes_opened.

    The root is tested once; a node is opened if the query hits it, and then all its children are tested. Hit nodes and their
    children are counted without pairs and without a descent: a node around a hit child is hit itself.
    """
    if not nodes.head(1):
        return queries.select(qid, F.lit(0).cast("long").alias("nodes_tested"), F.lit(0).cast("long").alias("nodes_opened"))
    below = nodes.filter("parent_id is not null").groupBy(F.col("parent_id").alias("_p")).agg(F.count(F.lit(1)).alias("_below"))
    sized = nodes.select("node_id", *Box.of(axes(nodes)).named()).join(below, F.col("node_id") == F.col("_p"), "left").withColumns({"nodes_opened": F.lit(1), "nodes_tested": F.coalesce("_below", F.lit(0))})
    sums = range_join_sums(queries, settled(sized), ["nodes_tested", "nodes_opened"], qid)
    return sums.withColumn("nodes_tested", F.col("nodes_tested") + 1)


def knn_nodes(points: DataFrame, neighbours: DataFrame, nodes: DataFrame, k: int, qid: str = "qid") -> DataFrame:
    """For each point (qid, q_i) nodes_expanded: the nodes no farther than its k-th neighbour, which any search must open.

    neighbours: qid, dist_sq, rank, as knn_join gives them; of fewer than k neighbours the farthest counts.
    """
    d = axes(nodes)
    reach = neighbours.filter(F.col("rank") <= k).groupBy(F.col(qid).alias("_q")).agg(F.max("dist_sq").alias("_reach"))
    at = points.join(reach, F.col(qid) == F.col("_q")).select(F.col(qid).alias("_q"), "_reach", *[F.col(f"q_{i}") for i in range(d)])
    slim = few(nodes.select("node_id", "parent_id", "level", *Box.of(d).named()))
    near = Box.of(d).min_dist_sq([F.col(f"q_{i}") for i in range(d)]) <= F.col("_reach")
    depth = nodes.agg(F.max("level")).first()[0]
    coords = [f"q_{i}" for i in range(d)]
    root = slim.filter("parent_id is null").drop("parent_id", "level")
    open_ = at.join(F.broadcast(root)).filter(near).select("_q", "_reach", *coords, "node_id")  # one row
    every = open_.select("_q")
    for _ in range(depth or 0):
        open_ = open_.select("_q", "_reach", *coords, F.col("node_id").alias("_p")).join(slim, F.col("_p") == F.col("parent_id")).filter(near).select("_q", "_reach", *coords, "node_id")
        every = every.unionByName(open_.select("_q"))
    return every.groupBy(F.col("_q").alias(qid)).agg(F.count(F.lit(1)).alias("nodes_expanded"))


def tidy(df: DataFrame, dataset: str, strategy: str, capacity: int, workload: str, param: float) -> DataFrame:
    """A one-row metric frame as rows (dataset, strategy, m, workload, param, metric, value)."""
    names = df.columns
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
    return df.select(F.lit(dataset).alias("dataset"), F.lit(strategy).alias("strategy"), F.lit(capacity).alias("m"), F.lit(workload).alias("workload"), F.lit(float(param)).alias("param"), F.explode(pairs).alias("x")).select("dataset", "strategy", "m", "workload", "param", "x.metric", "x.value")


def comparison(results: DataFrame, metric: str, by: str = "param") -> DataFrame:
    """One row per strategy, one column per value of `by`: tidy rows of one metric turned into a table."""
    return results.filter(F.col("metric") == metric).groupBy("strategy").pivot(by).agg(F.first("value"))
