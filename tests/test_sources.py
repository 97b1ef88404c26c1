"""Headers, raw points, shapefiles, exports and streams."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from orthobox.functions.boxes import Box
from orthobox.operators import index, metrics
from orthobox.sources import readers, shapes, writers
from orthobox.streaming import boxes as streaming


def write(path, text):
    path.write_text(text)
    return f"file://{path}"


@pytest.mark.parametrize("header, row, expected", [
    ("min_0,min_1,max_0,max_1", "1,2,3,4", (1, 2, 3, 4)), ("min_0,max_0,min_1,max_1", "1,3,2,4", (1, 2, 3, 4)),
    ("x,y", "5,6", (5, 6, 5, 6)), ("min_x,min_y,max_x,max_y", "1,2,3,4", (1, 2, 3, 4)), ("min_10,min_2,max_10,max_2", "2,1,4,3", (1, 2, 3, 4)),
])
def test_csv_headers(spark, tmp_path, header, row, expected):
    got = readers.read_csv(spark, write(tmp_path / "a.csv", f"{header}\n{row}\nbad,x,y,z\n")).select("min_0", "min_1", "max_0", "max_1").collect()
    assert [tuple(r) for r in got] == [expected]


def test_unknown_header_and_bad_boxes(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read_csv(spark, write(tmp_path / "b.csv", "a,b\n1,2\n"))
    for row in ((2.0, 1.0), (None, 1.0), (float("nan"), 1.0)):
        df = spark.createDataFrame([row], "min_0 double, max_0 double")
        with pytest.raises(Exception, match="not a box"):
            readers.check_boxes(df).collect()


def test_points(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, None, 4.0)], "id long, Latitude double, ` longitude ` double")
    assert [tuple(r) for r in readers.prepare_points(df, key="id").collect()] == [(1, 3.0, 2.0, 3.0, 2.0)]
    other = spark.createDataFrame([("a", 2.0, 3.0)] * 9, "name string, a double, b double")
    assert readers.prepare_points(other, n=4).count() == 4
    with pytest.raises(ValueError):
        readers.prepare_points(other.select("name", "a"))


def test_shapefiles(spark, tmp_path):
    def record(n, body):
        return struct.pack(">ii", n, len(body) // 2) + body

    shapes = [struct.pack("<idd", 1, 5.0, 6.0), struct.pack("<i", 0), struct.pack("<idddd", 5, 1.0, 2.0, 3.0, 4.0) + struct.pack("<ii", 0, 0)]
    (tmp_path / "a.shp").write_bytes(bytes(100) + b"".join(record(i + 1, s) for i, s in enumerate(shapes)))
    (tmp_path / "a.dbf").write_bytes(b"no")
    got = readers.read_shapefiles(spark, f"file://{tmp_path}").select("min_0", "min_1", "max_0", "max_1").collect()
    assert sorted(map(tuple, got)) == [(1, 2, 3, 4), (5, 6, 5, 6)]


def test_baselines_and_comparison(spark, tmp_path):
    path = write(tmp_path / "b.json", json.dumps({"num_objects": 3, "baselines": {"a": {"100": 5.0, "200": 4.0}, "b": {"100": 1.5}}}, indent=1))
    rows = readers.read_baselines(spark, path)
    table = metrics.comparison(rows, "nodes_tested").orderBy("strategy").collect()
    assert [tuple(r) for r in table] == [("a", 5.0, 4.0), ("b", 1.5, None)]


def test_exports(spark, tmp_path):
    points = spark.range(40).select("id", *Box.point([F.col("id").cast("double"), F.col("id").cast("double")]).named())
    tree = index.build_str(points, 5)
    writers.save_index(tree, f"file://{tmp_path}/index")
    entries = spark.read.parquet(f"file://{tmp_path}/index/tree_entry")
    assert entries.count() == 40 and set(entries.columns) == {"tree_id", "parent_node_id", "data", "min_0", "min_1", "max_0", "max_1"}
    lines = [r["line"] for r in writers.diagram(tree).collect()]
    assert lines[0] == "digraph {" and lines[-1] == "}" and len(lines) == 2 * tree.nodes.count() + 1
    writers.write_csv(points, f"file://{tmp_path}/c")
    assert readers.read_csv(spark, f"file://{tmp_path}/c", "id").count() == 40
    assert any("GIST" in s for s in writers.create_tables_sql(srid=4326)) and writers.clear_tables_sql() and len(writers.drop_tables_sql()) == 3


def test_streams(spark, tmp_path):
    points = spark.range(30).select("id", (F.col("id") % 3).alias("g"), *Box.point([F.col("id").cast("double")]).named())
    points.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = streaming.running_mbr(stream, "g").writeStream.outputMode("complete").format("memory").queryName("run_mbr").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("run_mbr").collect())) == [(0, 0.0, 27.0), (1, 1.0, 28.0), (2, 2.0, 29.0)]
    windows = spark.createDataFrame([(1, 2.5, 5.5)], "qid long, qmin_0 double, qmax_0 double")
    seen = []
    write_batch = streaming.appended(f"file://{tmp_path}/all", lambda df: seen.append(df.count()), every=1)
    q = stream.writeStream.foreachBatch(write_batch).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen[-1] == 30
    hits = streaming.standing_queries(stream, windows).writeStream.outputMode("append").format("memory").queryName("hits").trigger(availableNow=True).start()
    hits.awaitTermination()
    assert sorted(r["id"] for r in spark.table("hits").collect()) == [3, 4, 5]


def test_one_shapefile_in_several_tasks(spark, tmp_path):
    r = random.Random(3)
    records, index, at = [], [], 100
    for i in range(500):
        x, y = r.uniform(-5, 5), r.uniform(-5, 5)
        shape = r.choice([struct.pack("<idd", 1, x, y), struct.pack("<i", 0), struct.pack("<idddd", 5, x, y, x + 1, y + 2) + bytes(r.randint(0, 60) * 2)])
        records.append(struct.pack(">ii", i + 1, len(shape) // 2) + shape)
        index.append(struct.pack(">ii", at // 2, len(shape) // 2))
        at += len(records[-1])
    (tmp_path / "a.shp").write_bytes(bytes(100) + b"".join(records))
    (tmp_path / "a.shx").write_bytes(bytes(100) + b"".join(index))
    (tmp_path / "b.shp").write_bytes(bytes(100) + b"".join(records[:7]))
    spark.dataSource.register(shapes.Shapes)
    whole = readers.read_shapefiles(spark, f"file://{tmp_path}").drop("file")
    some = spark.read.format("shapes").option("part_bytes", "2000").load(f"file://{tmp_path}")
    assert some.rdd.getNumPartitions() > 5
    assert sorted(map(tuple, some.drop("file").collect())) == sorted(map(tuple, whole.collect()))
    inside = spark.read.format("shapes").option("part_bytes", "2000").option("window", "0,0,2,2").load(f"file://{tmp_path}").drop("file")
    assert sorted(map(tuple, inside.collect())) == sorted(map(tuple, whole.filter(Box.of(2).intersects(Box.at((0, 0), (2, 2)))).collect()))


def test_an_index_kept_by_a_stream(spark, tmp_path):
    """Files that arrive one by one, a batch that is repeated, and the answers and rules of a whole build."""
    r, path = random.Random(4), f"file://{tmp_path}/index"
    rows = [(i, x, y, x + i % 3, y + i % 2) for i in range(80) for x, y in [(float(r.randint(0, 40)), float(r.randint(0, 40)))]]
    schema = "id long, min_0 double, min_1 double, max_0 double, max_1 double"
    keep = streaming.indexed(path, 8)
    batches = [spark.createDataFrame(rows[a:b], schema) for a, b in ((0, 60), (60, 80))]
    for n, batch in enumerate(batches):
        keep(batch, n)
    keep(batches[1], 1)
    tree = streaming.read_indexed(spark, path)
    assert not any(index.violations(tree, 8).values())
    assert sorted(map(tuple, tree.entries.select("id", "min_0", "min_1", "max_0", "max_1").collect())) == rows
    assert streaming.read_indexed(spark, path, before=1).entries.count() == 60
