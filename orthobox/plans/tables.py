"""The driver's tables as boxes and points, as DataFrames and as the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthobox.functions.boxes import Box, mbr


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box per order: quantities by prices in thousands of its lines."""
    price = F.col("l_extendedprice") / 1000
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(*mbr(Box((F.col("l_quantity"), price), (F.col("l_quantity"), price))))


ORDER_BOXES = """(select l_orderkey id, min(l_quantity) min_0, min(l_extendedprice / 1000) min_1, max(l_quantity) max_0,
  max(l_extendedprice / 1000) max_1 from lineitem group by l_orderkey)"""


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per order: price in thousands by days since 1995."""
    x, y = F.col("o_totalprice") / 1000, F.datediff("o_orderdate", F.lit("1995-01-01")).cast("double")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), *Box.point([x, y]).named(), F.col("o_custkey").alias("cust"))


ORDER_POINTS = """(select o_orderkey id, o_totalprice / 1000 min_0, cast(date_diff('day', timestamp '1995-01-01', o_orderdate) as double) min_1,
  o_totalprice / 1000 max_0, cast(date_diff('day', timestamp '1995-01-01', o_orderdate) as double) max_1, o_custkey cust from orders)"""


def part_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One window per part over the order points' range."""
    x, y = F.col("p_size") * 10.0, (F.col("p_retailprice") - 900) * 24
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), *Box((x - 3, y - 24), (x + 3, y + 24)).named("q"))


PART_WINDOWS = """(select p_partkey qid, p_size * 10.0 - 3 qmin_0, (p_retailprice - 900) * 24 - 24 qmin_1, p_size * 10.0 + 3 qmax_0,
  (p_retailprice - 900) * 24 + 24 qmax_1 from part)"""


def customer_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box per customer around the points of its orders."""
    return order_points(spark, sf_dir).groupBy(F.col("cust").alias("id")).agg(*mbr(Box.of(2)))


CUSTOMER_BOXES = f"(select cust id, min(min_0) min_0, min(min_1) min_1, max(max_0) max_0, max(max_1) max_1 from {ORDER_POINTS} group by cust)"


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per event: hours since 2024 by value."""
    return event_rows(table(spark, sf_dir, "events"))


def event_rows(events: DataFrame) -> DataFrame:
    """The same of events that come from elsewhere, as from a stream."""
    x = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3.6e9
    return events.select(F.col("event_id").alias("id"), *Box.point([x, F.col("value")]).named(), "user_id")


EVENT_POINTS = """(select event_id id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 3.6e9 min_0, value min_1,
  (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 3.6e9 max_0, value max_1, user_id from events)"""
