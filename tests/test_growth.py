"""Queries that were too slow or too large on bigger tables: the same answers, without deep plans or pairs."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthobox.functions.boxes import Box
from orthobox.operators import index, metrics, query
from orthobox.operators.counting import bitmap_sums


def _frame(spark, lo, hi, key="id", prefix=""):
    d = lo.shape[1]
    names = [key, *[f"{prefix}{s}_{i}" for s in ("min", "max") for i in range(d)]]
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(np.hstack([lo, hi]).tolist())], ", ".join([f"{key} long", *[f"{c} double" for c in names[1:]]]))


def _hits(lo, hi, qlo, qhi):
    return ((hi[None] > qlo[:, None]) & (lo[None] < qhi[:, None])).all(2)


@pytest.mark.parametrize("n, m, d", [(0, 5, 3), (1, 1, 3), (1025, 300, 4), (130, 4100, 3)])
def test_bitmap_sums_equal_brute_force(n, m, d):
    r = np.random.default_rng(n)
    lo, qlo = r.integers(0, 9, (n, d)).astype(float), r.integers(0, 9, (m, d)).astype(float)
    hi, qhi, w = lo + r.integers(0, 4, (n, d)), qlo + r.integers(-1, 5, (m, d)), r.integers(0, 6, (n, 2))
    assert (bitmap_sums(lo, hi, qlo, qhi, w) == (_hits(lo, hi, qlo, qhi) @ w).T).all()


def test_counts_on_many_axes_make_no_pairs(spark):
    r = np.random.default_rng(3)
    lo, qlo = r.integers(0, 9, (1500, 4)).astype(float), r.integers(0, 9, (60, 4)).astype(float)
    hi, qhi = lo + r.integers(0, 4, lo.shape), qlo + r.integers(0, 9, qlo.shape)
    windows = _frame(spark, qlo, qhi, "qid", "q").unionByName(spark.sql("select 60L qid, " + ", ".join(f"cast(null as double) q{s}_{i}" for s in ("min", "max") for i in range(4))))
    counts = query.range_join_counts(windows, _frame(spark, lo, hi))
    assert "Join" not in counts._jdf.queryExecution().analyzed().toString().replace("Join LeftOuter", "")
    got = {x["qid"]: x["n_results"] for x in counts.collect()}
    assert got == {**dict(enumerate(_hits(lo, hi, qlo, qhi).sum(1).tolist())), 60: 0}


def test_deep_trees_are_searched_in_one_join(spark):
    """A chain of 60 nodes: a plan with a join a level took minutes to be made."""
    n = 60
    x = np.arange(n, dtype=float)[:, None] * np.ones((1, 3))
    entries = _frame(spark, x, x + 0.5).withColumn("node_id", F.concat(F.lit("r"), F.repeat(F.lit(".1"), F.col("id").cast("int")), F.lit(".0")))
    tree = index.from_paths(entries)
    qlo, qhi = np.array([[3.1] * 3, [-5.0] * 3, [70.0] * 3]), np.array([[6.2] * 3, [99.0] * 3, [80.0] * 3])
    windows = _frame(spark, qlo, qhi, "qid", "q")
    start = time.perf_counter()
    pairs = {tuple(p) for p in query.indexed_range_join(windows, tree.nodes, tree.entries).collect()}
    access = {a["qid"]: (a["nodes_tested"], a["nodes_opened"]) for a in metrics.node_accesses(windows, tree.nodes).collect()}
    assert time.perf_counter() - start < 60
    assert pairs == {(0, 3), (0, 4), (0, 5), (0, 6), *((1, i) for i in range(n))}
    nodes = [n.asDict() for n in tree.nodes.collect()]
    for q in range(3):
        opened = [n for n in nodes if all(n[f"max_{i}"] > qlo[q, i] and n[f"min_{i}"] < qhi[q, i] for i in range(3))]
        assert access[q] == (1 + sum(n["n_children"] for n in opened if not n["is_leaf"]), len(opened))


def test_large_learned_nodes_are_labelled_without_joins_or_ranks(spark, monkeypatch):
    """Only nodes of one label are ranked; the tree is that of nodes parted in tasks."""
    from orthobox.operators import network

    x = np.random.default_rng(5).random((400, 2))
    net = next(n for n in (network.Network(9, 8, (3,), seed=s) for s in range(99)) if len(set(network.labeller(n, 2, 3).local(x, x).tolist())) > 1)
    points, label, ranked, placed = _frame(spark, x, x), network.labeller(net, 2, 3), [], index._placed
    monkeypatch.setattr(index, "_placed", lambda rows, *of: ranked.extend(r["node_id"] for r in rows.select("node_id").distinct().collect()) or placed(rows, *of))
    leaves = {r["id"]: r["node_id"] for r in index.build_top_down(points, 150, 3, label, whole=150).entries.collect()}
    assert "r" not in ranked, "a node of several labels was ranked"
    assert leaves == {r["id"]: r["node_id"] for r in index.build_top_down(points, 150, 3, label).entries.collect()}


def test_knn_join_deals_points_of_one_leaf_and_keeps_k(spark, monkeypatch):
    """Many points at one leaf, equal points, equal entries (ties by id)."""
    monkeypatch.setattr(query, "TOGETHER", 3)
    r = np.random.default_rng(7)
    x, q = r.integers(0, 6, (40, 2)).astype(float), np.vstack([r.integers(50, 60, (9, 2)), r.integers(0, 6, (3, 2)), [[55, 55], [55, 55]]]).astype(float)
    tree = index.build_str(_frame(spark, x, x), 8)
    at = spark.createDataFrame([(i, *p) for i, p in enumerate(q.tolist())], "qid long, q_0 double, q_1 double")
    got = sorted((n["qid"], n["rank"], n["id"], n["dist_sq"]) for n in query.knn_join(at, tree.nodes, tree.entries, 3).collect())
    dist = ((q[:, None] - x[None]) ** 2).sum(2)
    assert got == [(i, k + 1, int(j), dist[i, j]) for i in range(len(q)) for k, j in enumerate(np.argsort(dist[i], kind="stable")[:3])]


def test_subtrees_are_chosen_without_pairs(spark, monkeypatch):
    """Several shares of one node's boxes, ties within 1e-5 and equal children; no window over all pairs."""
    from orthobox.operators import splits

    r = np.random.default_rng(3)
    lo, b = r.integers(0, 9, (12, 2)).astype(float), r.integers(0, 12, (50, 2)).astype(float)
    lo[7], hi = lo[2], lo + np.array([2.0, 1.0])
    children = _frame(spark, lo, hi).select(F.concat(F.lit("r."), F.col("id").cast("string")).alias("node_id"), F.lit("r").alias("parent_id"), "min_0", "min_1", "max_0", "max_1")
    for name, value in (("TOGETHER", 7), ("AT_ONCE", 30), ("Window", None)):
        monkeypatch.setattr(splits, name, value, raising=False)
    got = {x["id"]: (x["child"], x["enlargement"]) for x in splits.choose_subtree(_frame(spark, b, b).withColumn("parent_id", F.lit("r")), children).collect()}
    for i, p in enumerate(b):
        more = [float(np.prod(np.maximum(h, p) - np.minimum(l, p)) - np.prod(h - l)) for l, h in zip(lo, hi)]
        tied = [j for j in range(12) if more[j] - min(more) <= 1e-5 * max(abs(more[j]), abs(min(more)))]
        best = min(tied, key=lambda j: (2.0, f"r.{j}"))
        assert got[i] == (f"r.{best}", more[best])


def test_areas_are_summed_without_pairs(spark, monkeypatch):
    """Runs of windows, weights, flat and crossed boxes and windows, and those without corners."""
    monkeypatch.setattr(query, "COUNTED", 9)
    monkeypatch.setattr(query, "AT_ONCE", 11)
    monkeypatch.setattr(query, "range_join", None)
    r = np.random.default_rng(11)
    lo, qlo = r.integers(0, 40, (50, 2)) / 4, r.integers(0, 40, (30, 2)) / 4
    hi, qhi = lo + r.integers(-1, 9, (50, 2)) / 2, qlo + r.integers(-1, 9, (30, 2)) / 2
    boxes = _frame(spark, lo, hi).withColumn("n", F.col("id") % 4)
    windows = _frame(spark, qlo, qhi, "qid", "q").unionByName(spark.createDataFrame([(99, None, 1.0, 5.0, 5.0)], "qid long, qmin_0 double, qmin_1 double, qmax_0 double, qmax_1 double"))
    got = {x["qid"]: (x["n"], round(x["area"], 9)) for x in query.range_join_sums(windows, boxes, ["n"], area="area").collect()}
    w, met = np.arange(50) % 4, _hits(lo, hi, qlo, qhi)
    for i in range(30):
        shared = np.maximum(0, np.minimum(hi, qhi[i]) - np.maximum(lo, qlo[i])).prod(1)
        assert got[i] == (int((w * met[i]).sum()), round(float((w * shared).sum()), 9)), i
    assert got[99] == (0, 0.0)


def test_overlaps_reach_beyond_a_leaf(spark):
    """Every pair of the table counts, whichever leaves its boxes are in; pairs within leaves only were counted before."""
    import __spark_entry__ as entry
    import duckdb

    r = np.random.default_rng(13)
    lo = r.integers(0, 20, (150, 2)).astype(float)
    hi = lo + r.integers(0, 5, (150, 2))
    got = {x["id"]: (x["n_links"], round(x["area"], 9)) for x in query.self_overlaps(_frame(spark, lo, hi)).collect()}
    met = _hits(lo, hi, lo, hi) & ~np.eye(150, dtype=bool)
    shared = np.maximum(0, np.minimum(hi[:, None], hi[None]) - np.maximum(lo[:, None], lo[None])).prod(2)
    assert got == {i: (int(met[i].sum()), round(float(shared[i][met[i]].sum()), 9)) for i in range(150)}
    con = duckdb.connect()
    con.sql("create view lineitem as select * from '/root/testdata/sf0.001/lineitem.parquet'")
    links = con.sql(f"select sum(n_links) from ({entry.oracle_sql()['self_overlap_pairs']})").fetchall()[0][0]
    assert entry.queries()["self_overlap_pairs"](spark, "/root/testdata/sf0.001").agg(F.sum("n_links")).first()[0] == links
