"""Lineage cuts in the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one, in local mode only."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='checkpoints')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read from the shared folder from then on; for plans of a few steps. See stored()."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows, computed once, written to the shared folder as Parquet and read from there: for loops.

    A checkpoint inherits its plan's estimated size, which joins multiply until, after a few rounds of a loop, planning takes
    minutes; what is read here has its files' size. Partitioning and order are not kept.
    """
    path = new_folder(df.sparkSession, "stored")
    columns = [f"c{i}" for i in range(len(df.columns))]  # names that differ in case only are one to Parquet
    df.toDF(*columns).write.parquet(path)
    return df.sparkSession.read.schema(T.StructType([T.StructField(c, f.dataType) for c, f in zip(columns, df.schema.fields)])).parquet(path).toDF(*df.columns)


def join_dealt(rows: DataFrame, table: DataFrame, on: str, sizes: DataFrame, most: int) -> DataFrame:
    """rows joined with the table, which has one row per key. Keys with over `most` rows (sizes: the key, n) are dealt to
    several tasks, their row of the table to each; there are at most rows / most of them."""
    hot = stored(sizes.filter(F.col("n") > most).select(on, F.ceil(F.col("n") / most).cast("int").alias("shares_")))
    if not hot.head(1):
        return rows.join(table, on)
    share = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("shares_").cast("long")).cast("int"), F.lit(0))
    left = rows.join(F.broadcast(hot), on, "left").withColumn("share_", share).drop("shares_")
    right = table.join(F.broadcast(hot), on, "left").withColumn("share_", F.explode(F.sequence(F.lit(0), F.coalesce("shares_", F.lit(1)) - 1))).drop("shares_")
    return left.join(right, [on, "share_"]).drop("share_")


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of frames that are settled and no longer held: its cleaner waits for the driver's
    garbage collection, which a driver with little to do may put off until the disks are full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
