"""Packed indexes bound every level; batches keep the rules, the rows and the answers, and leave other leaves' files alone."""

import os
import random

import pytest
from pyspark.sql import functions as F

from orthobox.functions.boxes import Box
from orthobox.operators import growing, index, packing, query

BOXES = "id long, min_0 double, min_1 double, max_0 double, max_1 double"


def boxes(spark, seed, n, first=0, side=30):
    r = random.Random(seed)
    rows = [(first + i, float(r.randint(0, side)), float(r.randint(0, side))) for i in range(n)]
    return spark.createDataFrame([(i, x, y, x + i % 3, y + i % 2) for i, x, y in rows], BOXES)


@pytest.mark.parametrize("grouping", [packing.tiles, packing.curve, packing.extremes])
def test_packed_to_a_root(spark, grouping):
    rows = boxes(spark, 1, 400)
    tree = packing.build_packed(rows, 5, grouping)
    assert not any(index.violations(tree, 5).values())
    assert tree.nodes.agg(F.max("level")).first()[0] >= 3 and tree.entries.count() == 400
    box = Box.at([5, 5], [12, 20])
    assert {r["id"] for r in query.indexed_range_query(tree.nodes, tree.entries, box).collect()} == {r["id"] for r in rows.filter(Box.of(2).intersects(box)).collect()}


def test_packed_edges(spark):
    none = packing.build_packed(boxes(spark, 1, 3).limit(0), 4)
    assert none.nodes.count() == 0 and none.entries.count() == 0
    same = spark.range(60).select("id", *[F.lit(1.0).alias(c) for c in ("min_0", "min_1", "max_0", "max_1")])
    for tree in (packing.build_packed(same, 4, packing.curve), packing.build_greedy(same, 4)):
        assert not any(index.violations(tree, 4).values()) and tree.entries.count() == 60


def test_greedy_is_bounded(spark):
    tree = packing.build_greedy(boxes(spark, 2, 120), 6)
    assert not any(index.violations(tree, 6).values()) and tree.entries.count() == 120


def test_str_bounds_inner_nodes(spark):
    tree = index.build_str(boxes(spark, 3, 2000), 4)
    assert tree.nodes.agg(F.max(F.when(~F.col("is_leaf"), F.col("n_children")))).first()[0] <= 4
    assert not any(index.violations(tree, 4).values())


def hilbert(cells, bits):
    """The place on the curve by walking down the cells, two axes."""
    x, y = cells
    key, s = 0, 1 << (bits - 1)
    while s:
        right, up = int(bool(x & s)), int(bool(y & s))
        key += s * s * ((3 * right) ^ up)
        if not up:
            if right:
                x, y = (1 << bits) - 1 - x, (1 << bits) - 1 - y
            x, y = y, x
        s //= 2
    return key


@pytest.mark.parametrize("d", [2, 3])
def test_hilbert_curve(spark, d):
    n, bits = (16, 4) if d == 2 else (8, 3)
    cells = spark.range(n**d).select("id", *[F.floor(F.col("id") / n**i % n).cast("double").alias(f"{s}_{i}") for s in ("min", "max") for i in range(d)])
    keyed = cells.withColumn("k", packing.hilbert_key(Box.of(d), Box.at([0] * d, [n] * d), bits)).orderBy("k").collect()
    assert [r["k"] for r in keyed] == list(range(n**d))
    assert all(sum(abs(a[f"min_{i}"] - b[f"min_{i}"]) for i in range(d)) == 1 for a, b in zip(keyed, keyed[1:]))
    if d == 2:
        assert all(hilbert((int(r["min_0"]), int(r["min_1"])), bits) == r["k"] for r in keyed)


def test_priority_leaves_hold_extremes(spark):
    rows = {r["id"]: r for r in packing.extremes(boxes(spark, 4, 200), 10).collect()}
    assert len(rows) == 200
    first = sorted((r["min_0"], i) for i, r in rows.items())[:10]
    assert {rows[i]["group"] for _, i in first} == {"p.a0"}


@pytest.mark.parametrize("n, capacity, whole", [(150, 4, 40), (25, 5, 1), (3, 5, 1)])
def test_large_sets_are_parted_as_small_ones(spark, n, capacity, whole):
    rows = boxes(spark, 8, n, side=90)
    one, two = ({r["id"]: r["group"] for r in packing.extremes(rows, capacity, whole=w).collect()} for w in (whole, 10**6))
    assert one == two and len(one) == n
    trees = [packing.build_greedy(rows, capacity, whole=w) for w in (whole, 10**6)]
    one, two = ({r["id"]: r["node_id"] for r in t.entries.collect()} for t in trees)
    assert one == two and len(one) == n
    assert not any(index.violations(trees[0], capacity).values())


def test_packing_writes_rows_a_few_times(spark, monkeypatch):
    written, settled = [], packing.settled

    def counted(df):
        out = settled(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(packing, "settled", counted)
    rows = boxes(spark, 8, 600)
    assert len({r["group"] for r in packing.extremes(rows, 4).collect()}) > 100 and sum(written) <= 3 * 600
    written.clear()
    assert packing.build_greedy(rows, 4).entries.count() == 600 and sum(written) <= 3 * 600


def test_batches(spark, tmp_path):
    capacity, path = 8, str(tmp_path / "leaves")
    tree, every = index.build_str(boxes(spark, 5, 90), capacity), boxes(spark, 5, 90)
    growing.write_leaves(tree.entries, path)
    for n, batch in enumerate((boxes(spark, 6, 30, 1000, 8), boxes(spark, 7, 1, 2000))):
        before = {f: os.stat(f"{path}/{f}").st_mtime_ns for f in os.listdir(path) if f.startswith("leaf=")}
        grown = growing.insert_batch(tree, batch, capacity, reinsert=n < 1)
        growing.write_leaves(grown.changed, path)
        tree, every = grown.index, every.unionByName(batch)
        broken = index.violations(tree, capacity)
        assert not any(broken.values()), (n, broken)
        stored = {(r["id"], r["node_id"]) for r in growing.read_leaves(tree.nodes, path).collect()}
        assert stored == {(r["id"], r["node_id"]) for r in tree.entries.collect()}
        assert {i for i, _ in stored} == {r["id"] for r in every.collect()} and len(stored) == every.count()
        written = {f"leaf={r['node_id']}" for r in grown.changed.select("node_id").distinct().collect()}
        assert all(os.stat(f"{path}/{f}").st_mtime_ns == t for f, t in before.items() if f not in written)
        if n == 1:
            assert len(written) <= 4
    box = Box.at([3, 3], [9, 9])
    assert {r["id"] for r in query.indexed_range_query(tree.nodes, tree.entries, box).collect()} == {r["id"] for r in every.filter(Box.of(2).intersects(box)).collect()}


def test_batches_into_nothing(spark):
    empty = index.build_str(boxes(spark, 1, 3).limit(0), 4)
    assert growing.insert_batch(empty, boxes(spark, 1, 3).limit(0), 4).index.entries.count() == 0
    tree = growing.insert_batch(empty, boxes(spark, 9, 100), 4).index
    assert not any(index.violations(tree, 4).values()) and tree.entries.count() == 100


def test_walk(spark):
    tree = packing.build_packed(boxes(spark, 1, 200), 6)
    seen = query.walk(tree.nodes, {"depth": F.lit(0), "way": F.col("node_id")}, {"depth": F.col("up_depth") + 1, "way": F.concat("up_way", F.lit(">"), F.col("node_id"))}, F.col("depth") < 3).collect()
    assert {r["node_id"] for r in seen} == {r["node_id"] for r in tree.nodes.filter("level < 3").collect()}
    assert all(r["way"].split(">")[-1] == r["node_id"] and len(r["way"].split(">")) == r["level"] + 1 for r in seen)


@pytest.mark.parametrize("whole", [1, 10**6])
def test_priority_leaves_of_a_few_rounds_are_their_sql(spark, whole):
    """Sets that the last round leaves over the capacity are a group each."""
    import duckdb

    from orthobox.plans import packed

    rows = boxes(spark, 8, 150, side=90)
    known = rows.toPandas()  # noqa: F841 (read by the SQL)
    expected = set(duckdb.sql(packed.priority_sql("known", 3, 2)).fetchall())
    got = {(r["id"], r["group"]) for r in packing.extremes(rows, 3, whole=whole, rounds=2).collect()}
    assert got == expected and len({g for _, g in got}) < 150 / 3
