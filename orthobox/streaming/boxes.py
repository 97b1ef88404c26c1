"""Boxes that arrive over time: running extents, alerts by standing windows, and files added under an index."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthobox.functions.boxes import Box, axes, mbr
from orthobox.operators.growing import insert_batch
from orthobox.operators.index import SpatialIndex, build_str
from orthobox.shared import settled


def running_mbr(stream: DataFrame, group: str) -> DataFrame:
    """The smallest box around each group's rows so far: a streaming aggregate of bounded state, one row per group."""
    return stream.groupBy(group).agg(*mbr(Box.of(axes(stream))))


def windowed_mbr(stream: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """The same per window of time; rows over `late` behind the newest are dropped and finished windows leave the state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window")).agg(F.count(F.lit(1)).alias("n"), *mbr(Box.of(axes(stream))))


def standing_queries(stream: DataFrame, queries: DataFrame, qid: str = "qid", key: str = "id", most: int = 10_000) -> DataFrame:
    """Pairs (qid, id) of arriving boxes and a fixed table of at most `most` query boxes, which goes to every task.

    For more of them run a range join on each batch, as with foreachBatch.
    """
    d = axes(stream)
    if queries.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} standing queries")
    return stream.join(F.broadcast(queries), Box.of(d, "q").intersects(Box.of(d))).select(qid, key)


def indexed(path: str, capacity: int, key: str = "id") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps an index under path: each batch is inserted, and only leaves that it changes are
    written, into a folder of the batch; leaves name the batch that wrote them. A repeated batch replaces its own folders."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = read_indexed(spark, path, batch.columns, number)
        grown = insert_batch(before, settled(batch), capacity, key)
        changed = grown.changed.select(F.col("node_id").alias("changed_")).distinct()
        known = before.nodes if "written" in before.nodes.columns else before.nodes.withColumn("written", F.lit(None).cast("long"))
        own = F.when(F.col("changed_").isNotNull(), F.lit(number)).otherwise(F.col("written")).cast("long")
        nodes = grown.index.nodes.drop("written").join(known.select(F.col("node_id").alias("old_"), "written"), F.col("node_id") == F.col("old_"), "left")
        nodes = nodes.join(changed, F.col("node_id") == F.col("changed_"), "left").withColumn("written", own).drop("old_", "changed_")
        grown.changed.write.mode("overwrite").parquet(f"{path}/leaves/batch={number}")
        nodes.write.mode("overwrite").parquet(f"{path}/nodes/batch={number}")

    return write


def read_indexed(spark: SparkSession, path: str, columns: Sequence[str] | None = None, before: int | None = None) -> SpatialIndex:
    """The index that a stream keeps under path, as of its last batch or of the last one before a number.

    columns: those of the rows (a whole number as key, and a box), for an index that has no batch yet.
    """
    try:
        every = spark.read.parquet(f"{path}/nodes")
        last = every.filter(F.lit(True) if before is None else F.col("batch") < before).agg(F.max("batch")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    if last is None:
        if columns is None:
            raise ValueError(f"no index under {path}")
        kinds = {c: "double" if re.fullmatch("(min|max)_[0-9]+", c) else "long" for c in columns}
        none = spark.createDataFrame([], ", ".join(f"`{c}` {kind}" for c, kind in kinds.items()))
        return build_str(none, 2, key=next(c for c, kind in kinds.items() if kind == "long"))
    nodes = every.filter(F.col("batch") == last).drop("batch")
    current = nodes.filter("is_leaf").select(F.col("node_id").alias("n_"), F.col("written").alias("w_"))
    stored = spark.read.parquet(f"{path}/leaves")
    entries = stored.join(current, (F.col("node_id") == F.col("n_")) & (F.col("batch") == F.col("w_")), "left_semi").drop("batch")
    return SpatialIndex(nodes, entries)


def appended(path: str, rebuild: Callable[[DataFrame], None] | None = None, every: int = 10) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch becomes a folder of its own under path, so that a repeated batch replaces itself;
    after every so many batches rebuild gets all boxes so far."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if rebuild and (number + 1) % every == 0:
            rebuild(batch.sparkSession.read.parquet(path))

    return write
