"""Lineage cuts in the folder that the whole cluster shares, and exact global ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one, in local mode only."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = f"file://{tempfile.mkdtemp(prefix='checkpoints')}"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read from the shared folder from then on.

    They are written as Parquet. A checkpoint would inherit its plan's estimated size, which every join multiplies: in a loop
    the numbers get millions of digits and planning takes minutes. Partitioning and order are not kept.
    """
    path = new_folder(df.sparkSession, "settled")
    columns = [f"c{i}" for i in range(len(df.columns))]  # names that differ in case only are one to Parquet
    df.toDF(*columns).write.parquet(path)
    kinds = T.StructType([T.StructField(c, f.dataType) for c, f in zip(columns, df.schema.fields)])
    return df.sparkSession.read.schema(kinds).parquet(path).toDF(*df.columns)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def few(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """The same rows, settled and counted, to be broadcast if there are no more than the limit."""
    df = settled(df)
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def with_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """The rows with their place, from 0, in the whole table's order: a range partitioning and one count per partition.

    No task sees more than its own range. The order should end in a unique column.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settled(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    own = (1 << 33) - 1  # the bits of a row's number within its partition
    counts = placed.groupBy(F.shiftright("_at", 33).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")  # one row per partition
    ranked = placed.withColumn("_p", F.shiftright("_at", 33)).join(F.broadcast(before), "_p")
    return ranked.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(own))).drop("_at", "_p", "_before")


def tile(place: Column, n: Column, tiles: Column) -> Column:
    """Which of so many tiles, from 0, the row at a place (from 0) of n rows is in; the first ones are larger by one."""
    small, more = F.floor(n / tiles), n % tiles
    cut = more * (small + 1)
    return F.when(place < cut, F.floor(place / (small + 1))).otherwise(more + F.floor((place - cut) / F.greatest(small, F.lit(1)))).cast("int")
