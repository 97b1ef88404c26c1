"""Every build keeps an index's rules and gives the answers of the plain predicate."""

import random

import pytest
from pyspark.sql import functions as F

from orthobox.functions.boxes import Box
from orthobox.operators import index, metrics, network, query, workload


@pytest.fixture(scope="module")
def points(spark):
    r = random.Random(1)
    rows = [(i, float(r.randint(0, 30)), float(r.randint(0, 30))) for i in range(600)]
    return spark.createDataFrame([(i, x, y, x + i % 3, y + i % 2) for i, x, y in rows], "id long, min_0 double, min_1 double, max_0 double, max_1 double").cache()


def builds(points):
    yield "str", index.build_str(points, 20), 20
    yield "top_down", index.build_top_down(points, 20, 3), 20
    yield "guttman", index.build_local(points, 8, "guttman", tile_rows=200), 8
    yield "rstar", index.build_local(points, 8, "rstar", tile_rows=200), 8
    net = network.Network(9, 8, (3,), seed=3)
    yield "learned", index.build_top_down(points, 20, 3, network.labeller(net, 2, 3)), 20


def test_builds(points):
    box = Box.at([5, 5], [12, 20])
    expected = {r["id"] for r in points.filter(Box.of(2).intersects(box)).collect()}
    windows = workload.random_ranges(points, 5)
    for name, tree, capacity in builds(points):
        broken = index.violations(tree, capacity)
        assert not any(broken.values()), (name, broken)
        assert tree.entries.count() == 600, name
        assert {r["id"] for r in query.indexed_range_query(tree.nodes, tree.entries, box).collect()} == expected, name
        access = metrics.node_accesses(windows, tree.nodes).collect()
        assert all(1 <= r["nodes_opened"] <= r["nodes_tested"] or r["nodes_opened"] == 0 for r in access), name


def test_identical_boxes(spark):
    same = spark.range(50).select("id", *[F.lit(1.0).alias(c) for c in ("min_0", "min_1", "max_0", "max_1")])
    for tree in (index.build_top_down(same, 4, 3), index.build_local(same, 4, "guttman"), index.build_local(same, 4, "rstar")):
        assert not any(index.violations(tree, 4).values())


def test_empty_and_small(spark, points):
    none = points.limit(0)
    tree = index.build_top_down(none, 4, 2)
    assert tree.nodes.count() == 0 and query.indexed_range_query(tree.nodes, tree.entries, Box.at([0, 0], [9, 9])).count() == 0
    assert index.build_str(none, 4).entries.count() == 0
    one = index.build_top_down(points.limit(3), 4, 2)
    assert one.nodes.collect()[0]["is_leaf"] and one.nodes.count() == 1


def test_knn_join_is_brute_force(spark, points):
    tree = index.build_str(points, 10)
    q = workload.random_points(points, 20)
    got = {}
    for r in query.knn_join(q, tree.nodes, tree.entries, 5).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    rows = points.collect()
    for p in q.collect():
        dist = sorted((sum(max(0, r[f"min_{i}"] - p[f"q_{i}"], p[f"q_{i}"] - r[f"max_{i}"]) ** 2 for i in (0, 1)), r["id"]) for r in rows)
        assert [i for _, i in sorted(got[p["qid"]])] == [i for _, i in dist[:5]]
    far = query.knn_join(q, tree.nodes, tree.entries, 1000)
    assert far.count() == 20 * 600


def test_overlap_by_hand(spark):
    nodes = spark.createDataFrame([("r", None, 0.0, 0.0, 3.0, 3.0), ("r.0", "r", 0.0, 0.0, 2.0, 2.0), ("r.1", "r", 1.0, 1.0, 3.0, 3.0)], "node_id string, parent_id string, min_0 double, min_1 double, max_0 double, max_1 double")
    assert tuple(metrics.overlap_ratio(nodes).first()) == (1.0, 8.0, 0.125)


def test_search_prunes_subtrees(points):
    tree = index.build_str(points, 20)
    assert query.search_nodes(tree.nodes, F.col("level") != 1).count() == 0
    assert query.search(tree.nodes, tree.entries, None, F.col("id") < 7).count() == 7
    walk = [r["node_id"] for r in query.traverse(tree.nodes).orderBy("visit").collect()]
    assert walk[0] == "r" and all(p.rpartition(".")[0] in walk[:i] for i, p in enumerate(walk) if p != "r")


def test_workloads_stay_in_place(points):
    e = workload.extent(points)
    for df in (workload.relative_windows(points, 50, 0.5), workload.fixed_windows(points, 50, 500.0), workload.random_ranges(points, 50, 0.001, 0.01, clip=True)):
        assert df.filter((F.col("qmin_0") < e["min_0"]) | (F.col("qmax_1") > e["max_1"]) | (F.col("qmin_0") > F.col("qmax_0"))).count() == 0
    assert workload.random_ranges(points, 9).collect() == workload.random_ranges(points, 9).collect()


def test_counts_are_brute_force():
    import numpy as np

    from orthobox.operators.counting import window_counts

    r = np.random.default_rng(0)
    for d in (1, 2):
        for i in range(200):
            n, m = r.integers(0, 40, 2)
            lo, qlo = r.integers(0, 8, (n, d)).astype(float), r.integers(0, 8, (m, d)).astype(float)
            hi, qhi = lo + r.integers(-(i % 3 == 0), 5, (n, d)), qlo + r.integers(-(i % 5 == 0), 4, (m, d))
            assert (window_counts(lo, hi, qlo, qhi) == ((hi[None] > qlo[:, None]) & (lo[None] < qhi[:, None])).all(2).sum(1)).all()


def test_hot_cells_lose_no_pair(spark, points, monkeypatch):
    """Boxes that nearly all lie in one cell, more pairs there than a task takes, on two and on five axes."""
    windows = workload.random_ranges(points, 40, 0.3, 0.9)
    want = sorted((q["qid"], p["id"]) for q in windows.collect() for p in points.collect() if p["max_0"] > q["qmin_0"] and p["min_0"] < q["qmax_0"] and p["max_1"] > q["qmin_1"] and p["min_1"] < q["qmax_1"])
    tree = index.build_str(points, 20)
    for pairs in (1000, 10**9):
        monkeypatch.setattr(query, "CELL_PAIRS", pairs)
        assert sorted(map(tuple, query.range_join(windows, points).collect())) == want
    monkeypatch.setattr(query, "COUNTED", 3)
    counted = {r["qid"]: r["n_results"] for r in query.range_join_counts(windows, points).collect()}
    assert sorted(map(tuple, query.indexed_range_join(windows, tree.nodes, tree.entries).collect())) == want
    assert counted == {q["qid"]: sum(a == q["qid"] for a, _ in want) for q in windows.collect()}
    many = spark.range(300).select("id", *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10)).cast("double").alias(c) for i in range(5) for c in (f"min_{i}", f"max_{i}")])
    around = many.select(F.col("id").alias("qid"), *[(F.col(f"{s}_{i}") + x).alias(f"q{s}_{i}") for i in range(5) for s, x in (("min", -4.5), ("max", 4.5))])
    a, b = around.collect(), many.collect()
    want = sorted((q["qid"], p["id"]) for q in a for p in b if all(p[f"max_{i}"] > q[f"qmin_{i}"] and p[f"min_{i}"] < q[f"qmax_{i}"] for i in range(5)))
    assert sorted(map(tuple, query.range_join(around, many).collect())) == want


def test_two_levels_are_the_sql_of_many_rows(spark):
    """More rows than the cube of the capacity, for which build_str by itself takes a third level."""
    import duckdb

    from orthobox.plans import catalogue

    r = random.Random(5)
    rows = [(i, float(r.randint(0, 9)), float(r.randint(0, 9))) for i in range(60)]
    boxes = spark.createDataFrame([(i, x, y, x + 1, y + 1) for i, x, y in rows], "id long, min_0 double, min_1 double, max_0 double, max_1 double")
    known = boxes.toPandas()  # noqa: F841 (read by the SQL)
    expected = set(duckdb.sql(f"{catalogue.str_sql('known', 2)} select id, node_id from e").fetchall())
    assert {(x["id"], x["node_id"]) for x in catalogue.two_levels(boxes, 2).entries.collect()} == expected


def test_quadratic_split_takes_the_seeds_of_pick_seeds(spark):
    """Wastes that differ by less than 1e-9 are ties for both rules."""
    import numpy as np

    from orthobox.operators import splits
    from orthobox.operators.insertion import Node, Tree, least_enlargement, quadratic_split

    x = [(0.0, 0.0), (0.1 + 0.2, 0.7), (0.3, 0.7), (0.0, 0.0), (0.3, 0.7 + 1e-16)]
    lo = np.array([*x, (0.3 + 1e-13, 0.7)])
    tree = Tree(lo, lo, max(2, len(lo) - 1), least_enlargement, quadratic_split)
    one, two = quadratic_split(tree, Node(True, list(range(len(lo)))))
    boxes = spark.createDataFrame([("n", i, float(a), float(b), float(a), float(b)) for i, (a, b) in enumerate(lo)], "node string, id long, min_0 double, min_1 double, max_0 double, max_1 double")
    seeds = splits.pick_seeds(boxes).first()
    assert {one[0], two[0]} == {seeds["a"], seeds["b"]}


def test_top_down_parts_bounded_nodes_alone(spark, monkeypatch):
    """The leaves are the same whether Spark parts every level or a task parts a node down to its leaves."""
    rows = [(i, float(i * 7919 % 101), float(i * 104729 % 37)) for i in range(700)]
    df = spark.createDataFrame([(i, x, x, y, y) for i, x, y in rows], "id long, min_0 double, max_0 double, min_1 double, max_1 double")
    net = network.Network(9, 8, (3,))
    calls, own = [], index._placed
    monkeypatch.setattr(index, "_placed", lambda *a: calls.append(1) or own(*a))
    for label in (None, network.labeller(net, 2, 3)):
        made = []
        for whole in (1, 300, 10_000):
            calls.clear()
            entries = index.build_top_down(df, 20, 3, label, whole=whole).entries
            made.append((sorted((r["id"], r["node_id"]) for r in entries.collect()), len(calls)))
        assert made[0][0] == made[1][0] == made[2][0]
        assert made[0][1] > made[1][1] > made[2][1] == 0


@pytest.mark.parametrize("whole", [1, 10**6])
def test_top_down_to_a_few_levels_is_its_sql(spark, whole):
    """Nodes on the last level are leaves, whatever their size."""
    import duckdb

    from orthobox.plans import catalogue
    from orthobox.plans.tables import ORDER_POINTS

    rows = [(i, float(i * 7919 % 101), float(i * 104729 % 37)) for i in range(300)]
    df = spark.createDataFrame([(i, x, x, y, y) for i, x, y in rows], "id long, min_0 double, max_0 double, min_1 double, max_1 double")
    known = df.toPandas()  # noqa: F841 (read by the SQL)
    expected = set(duckdb.sql(catalogue.top_down_sql(3, 8, 2).replace(ORDER_POINTS, "known")).fetchall())
    got = {(r["id"], r["node_id"]) for r in index.build_top_down(df, 8, 2, whole=whole, levels=3).entries.collect()}
    assert got == expected and len({n for _, n in got}) == 8


def test_top_down_writes_rows_a_few_times(spark, monkeypatch):
    from orthobox import shared
    from orthobox.operators import packing

    written, settled = [], shared.settled

    def counted(df):
        out = settled(df)
        written.append(out.count())
        return out

    for module in (shared, index, packing):
        monkeypatch.setattr(module, "settled", counted)
    df = spark.range(640).select("id", *Box.point([(F.col("id") * 7919 % 641).cast("double"), (F.col("id") * 31 % 641).cast("double")]).named())
    assert index.build_top_down(df, 10, 2, whole=10).entries.count() == 640 and sum(written) <= 6 * 640
