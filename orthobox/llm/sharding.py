"""Rendezvous sharding: each record goes to the shard that scores highest for its key.

A shard's score for a key is -weight / ln(u), u a hash of (key, shard) in (0, 1). A new shard only takes the records for
which it scores highest, so no record moves between old shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, of each key. Equal keys share a shard; null is a key like any other.

    A shard of weight 0 gets nothing. Equal scores go to the smaller shard number.
    """
    if not weights or min(weights) < 0 or not any(weights):
        raise ValueError("weights: at least one, none negative, not all zero")
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    hashed = F.xxhash64(text)

    def scored(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(hashed, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("shard"))

    live = [scored(i, w) for i, w in enumerate(weights) if w > 0]
    best = F.greatest(*live) if len(live) > 1 else live[0]
    return -best["shard"]


def shard_records(df: DataFrame, key: str, text: str, weights: Sequence[float], extra_weight: float = 1.0, chunks: int = 1024) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot and grown_shard.

    size is the text's UTF-8 bytes plus 8 (null text: 8), text_crc32 the unsigned CRC-32 of the same bytes (null: 0),
    slot numbers each shard's rows from 0 without gaps, grown_shard is the shard after one of extra_weight is added. Null
    keys share one shard. Other columns, whatever their names, are dropped; no input rows give no rows.

    Slots need no task that sees a whole shard: rows are dealt by (shard, chunk), a chunk being a hash of the row, and the
    rows before each chunk come from a table of counts with at most shards x chunks rows, which is what gets broadcast.

    A long text only counts by its size; its bytes stay where they are.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(key).alias("key"), (F.octet_length(content) + 8).cast("long").alias("size"), F.crc32(content).cast("long").alias("text_crc32"))
    rows = rows.withColumns({"shard": rendezvous(F.col("key"), weights), "grown_shard": rendezvous(F.col("key"), [*weights, extra_weight]), "chunk": F.pmod(F.xxhash64("key", "text_crc32", "size"), F.lit(chunks)).cast("int")})
    counts = rows.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "chunk").orderBy("key", "text_crc32", "size")
    placed = rows.withColumn("place", F.row_number().over(within)).join(F.broadcast(first), ["shard", "chunk"])
    return placed.select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard")
