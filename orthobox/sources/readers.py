"""Box tables from files: CSV in four headers, raw point files, shapefiles, and tables of published results."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthobox.functions.boxes import Box, axes


def as_boxes(df: DataFrame, key: str | None = None) -> DataFrame:
    """The table with columns min_0.., max_0.. as doubles, in the order of their numbers, and its other columns.

    Accepted, in this order: min_<n> and max_<n> with as many numbers of either; x, y; min_x, min_y, max_x, max_y. Without
    a key column, id is added, unique but not gapless.
    """
    names = {c.strip().lower(): c for c in df.columns}
    numbered = {side: sorted(int(m[1]) for c in names if (m := re.fullmatch(rf"{side}_(\d+)", c))) for side in ("min", "max")}
    if numbered["min"] and len(numbered["min"]) == len(numbered["max"]):
        pairs = [(names[f"min_{a}"], names[f"max_{b}"]) for a, b in zip(numbered["min"], numbered["max"])]
    elif {"x", "y"} <= names.keys():
        pairs = [(names["x"],) * 2, (names["y"],) * 2]
    elif {"min_x", "min_y", "max_x", "max_y"} <= names.keys():
        pairs = [(names["min_x"], names["max_x"]), (names["min_y"], names["max_y"])]
    else:
        raise ValueError(f"no box columns in {df.columns}")
    used = {c for p in pairs for c in p}
    boxes = [F.col(f"`{a}`").cast("double").alias(f"min_{i}") for i, (a, _) in enumerate(pairs)] + [F.col(f"`{b}`").cast("double").alias(f"max_{i}") for i, (_, b) in enumerate(pairs)]
    out = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in used], *boxes)
    return out if key else out.withColumn("id", F.monotonically_increasing_id())


def check_boxes(df: DataFrame) -> DataFrame:
    """The same rows; reading a null, NaN or crossed corner raises an error that names the row."""
    box = Box.of(axes(df))
    bad = None
    for lo, hi in zip(box.lo, box.hi):
        term = lo.isNull() | hi.isNull() | F.isnan(lo) | F.isnan(hi) | (lo > hi)
        bad = term if bad is None else bad | term
    return df.filter(F.when(bad, F.raise_error(F.concat(F.lit("not a box: "), F.to_json(F.struct(*df.columns))))).otherwise(F.lit(True)).cast("boolean"))


def read_csv(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Boxes of a CSV file with one of the headers of as_boxes; lines that do not parse are skipped.

    Only the header is read to know the columns: all are read as numbers but the key.
    """
    header = spark.read.csv(path, header=True).columns
    schema = ", ".join(f"`{c}` {'string' if c == key else 'double'}" for c in header)
    return as_boxes(spark.read.csv(path, header=True, schema=schema, mode="DROPMALFORMED", ignoreLeadingWhiteSpace=True), key)


def prepare_points(df: DataFrame, n: int | None = None, seed: int = 42, key: str | None = None) -> DataFrame:
    """Longitude and latitude as points min_0, min_1, max_0, max_1: columns so named in any case, else the first two numeric.

    Rows without either are dropped; n of the rest are drawn by seed, all if n is None.
    """
    names = {c.strip().lower(): c for c in df.columns}
    if {"latitude", "longitude"} <= names.keys():
        lon, lat = names["longitude"], names["latitude"]
    else:
        numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint") or t.startswith("decimal")]
        numeric = [c for c in numeric if c != key]
        if len(numeric) < 2:
            raise ValueError("no latitude and longitude, and fewer than two numeric columns")
        lon, lat = numeric[:2]
    x, y = F.col(f"`{lon}`").cast("double"), F.col(f"`{lat}`").cast("double")
    points = df.select(*([key] if key else []), x.alias("min_0"), y.alias("min_1"), x.alias("max_0"), y.alias("max_1")).dropna(subset=["min_0", "min_1"])
    return points if n is None else points.orderBy(F.rand(seed)).limit(n)


def shape_boxes(content: bytes) -> Iterator[tuple[float, float, float, float]]:
    """The box of each record of a shapefile's main file, in its published layout; records without a place are skipped.

    After a header of 100 bytes, a record has its number and length in 16-bit words (big-endian) and its shape
    (little-endian): type, then x and y of a point, or four numbers of a box for lines, areas and point sets.
    """
    at = 100
    while at + 12 <= len(content):
        _, length = struct.unpack_from(">ii", content, at)
        (kind,) = struct.unpack_from("<i", content, at + 8)
        if kind % 10 == 1 and length >= 10:
            x, y = struct.unpack_from("<dd", content, at + 12)
            yield x, y, x, y
        elif kind % 10 in (3, 5, 8) and length >= 18:
            yield struct.unpack_from("<dddd", content, at + 12)
        at += 8 + 2 * length


def read_shapefiles(spark: SparkSession, path: str, n: int | None = None, seed: int = 42) -> DataFrame:
    """file, min_0, min_1, max_0, max_1 of every shape in the .shp files of a folder, in the files' own units; n by seed."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"]):
                rows = list(shape_boxes(bytes(content)))
                yield pd.DataFrame({"file": name, "min_0": [r[0] for r in rows], "min_1": [r[1] for r in rows], "max_0": [r[2] for r in rows], "max_1": [r[3] for r in rows]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").option("recursiveFileLookup", "true").load(path).select("path", "content")
    boxes = files.mapInPandas(parse, "file string, min_0 double, min_1 double, max_0 double, max_1 double")
    return boxes if n is None else boxes.orderBy(F.rand(seed)).limit(n)


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    """strategy, param, value of a JSON file {"baselines": {strategy: {width: value}}, ...}, as tidy metric rows."""
    text = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.baselines").alias("b"))
    by = text.select(F.explode(F.from_json("b", "map<string,map<string,double>>")).alias("strategy", "values"))
    return by.select("strategy", F.explode("values").alias("param", "value")).withColumn("param", F.col("param").cast("double")).withColumn("metric", F.lit("nodes_tested"))
