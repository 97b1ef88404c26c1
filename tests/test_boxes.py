"""Hand cases of the box rules, and queries against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from orthobox.functions.boxes import Box, axes, features, located, mbr
from orthobox.operators import query


def boxes(spark, rows, d=2):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, " + ", ".join(f"{s}_{i} double" for s in ("min", "max") for i in range(d)))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_touching_is_not_intersecting(spark):
    a, b = Box.at([0, 0], [1, 1]), Box.at([1, 0], [2, 1])
    assert one(spark, a.intersects(b)) is False
    assert one(spark, a.touches(b)) is True
    assert one(spark, a.intersection(b)) is None
    assert one(spark, a.intersection_area(b)) == 0
    assert one(spark, located(a, [1, 0.5])) is True
    assert one(spark, located(a, Box.point([1, 0.5]))) is False
    assert one(spark, located(a, Box.point([0.5, 0.5]))) is True


def test_measures(spark):
    flat, cube = Box.at([0, 0], [0, 5]), Box.at([0, 0, 0], [1, 2, 3])
    assert one(spark, flat.area()) == 0
    assert one(spark, flat.log_area()) is None
    assert one(spark, flat.intersects(Box.at([-1, 1], [1, 2]))) is True
    assert one(spark, cube.perimeter()) == 12
    assert one(spark, cube.area()) == 6
    assert one(spark, cube.min_dist_sq([2, 2, 5])) == 5
    assert one(spark, cube.max_dist_sq([0, 0, 0])) == 14
    assert one(spark, Box.at([1.0], [2.0]).close_to(Box.at([1.000001], [2.0]))) is True
    assert one(spark, Box.at([0, 0], [1, 1]).enlargement(Box.at([1, 1], [2, 2]))) == 3
    assert one(spark, Box.at([0], [2]).centroid_distance(Box.at([3], [5]))) == 3


def test_axes_must_agree():
    with pytest.raises(ValueError):
        Box.at([0], [1, 2])


@pytest.mark.parametrize("make", [lambda: Box.at([0], [1]).intersects(Box.at([0, 0], [1, 1])), lambda: Box.at([0], [1]).contains([1, 2])])
def test_axes_of_both_must_agree(spark, make):
    with pytest.raises(ValueError):
        make()


def test_mbr_and_features(spark):
    df = boxes(spark, [(0, 0, 2, 2), (1, 1, 3, 4)])
    assert tuple(df.agg(*mbr(Box.of(2))).first()) == (0, 0, 3, 4)
    assert tuple(df.limit(0).agg(*mbr(Box.of(2))).first()) == (None,) * 4
    f = df.filter("id = 1").select(*features(Box.of(2), Box.at([0, 0], [3, 4]))).first()
    assert [round(x, 6) for x in f] == [round(x, 6) for x in (1 / 3, 1 / 4, 1, 1, 2 / 3, 3 / 4, 0.5, 2 / 3, 5 / 8)]


def test_knn_bounds(spark):
    df = boxes(spark, [(0, 0, 0, 0), (1, 0, 1, 0), (-1, 0, -1, 0)])
    assert [r["id"] for r in query.knn(df, [0, 0], 10).collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        query.knn(df, [0, 0], 0)
    assert query.knn(df.limit(0), [0, 0], 3).count() == 0


@pytest.mark.parametrize("d", [1, 2, 3])
def test_range_join_is_brute_force(spark, d):
    r = random.Random(d)

    def make(n, wide):
        out = []
        for _ in range(n):
            lo = [r.randint(0, 40) for _ in range(d)]
            out.append((*lo, *[x + r.choice([0, 1, 3, wide]) for x in lo]))
        return out

    data, windows = make(150, 30), make(60, 60) + [(-9,) * d + (99,) * d, (200,) * d + (201,) * d]
    b = boxes(spark, data, d)
    q = boxes(spark, windows, d).toDF("qid", *[f"q{s}_{i}" for s in ("min", "max") for i in range(d)])
    expected = {(i, j) for (i, w), (j, x) in itertools.product(enumerate(windows), enumerate(data)) if all(x[d + k] > w[k] and x[k] < w[d + k] for k in range(d))}
    got = [(x["qid"], x["id"]) for x in query.range_join(q, b).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    counts = {x["qid"]: x["n_results"] for x in query.range_join_counts(q, b).collect()}
    assert counts == {i: sum(a == i for a, _ in expected) for i in range(len(windows))}
    assert {x["qid"] for x in query.range_join(q, b, how="anti").collect()} == {i for i in range(len(windows))} - {a for a, _ in expected}
    assert query.range_join(q, b.limit(0)).count() == 0


def test_axes_are_read_from_names(spark):
    assert axes(boxes(spark, [(0, 0, 1, 1)])) == 2
    with pytest.raises(ValueError):
        axes(spark.range(1))


def test_sibling_pairs(spark):
    df = boxes(spark, [(0, 0, 2, 2), (1, 1, 3, 3), (9, 9, 10, 10)]).withColumn("g", F.lit(1))
    assert [tuple(r) for r in query.sibling_pairs(df, "g").collect()] == [(1, 0, 1, 1.0)]


def test_counts_in_runs_of_windows(spark, monkeypatch):
    """More different windows than are counted at once, equal ones, and windows without corners: no pair is made."""
    import random

    from pyspark.sql import functions as F

    from orthobox.operators import query

    r = random.Random(3)
    windows = [(i, *(float(r.randint(0, 9)) for _ in range(2))) for i in range(40)]
    windows = [(i, x, y, x + 2, y + 1) for i, x, y in windows] + [(100, 1.0, 1.0, 5.0, 5.0), (101, 1.0, 1.0, 5.0, 5.0), (102, None, 1.0, 5.0, 5.0)]
    q = spark.createDataFrame(windows, "qid long, qmin_0 double, qmin_1 double, qmax_0 double, qmax_1 double")
    boxes = [(i, float(r.randint(0, 9)), float(r.randint(0, 9)), i % 7) for i in range(60)]
    b = spark.createDataFrame([(i, x, y, x + 1, y + 2, w) for i, x, y, w in boxes], "id long, min_0 double, min_1 double, max_0 double, max_1 double, w long")
    monkeypatch.setattr(query, "COUNTED", 7)
    monkeypatch.setattr(query, "range_join", None)
    got = {x["qid"]: x["n_results"] for x in query.range_join_counts(q, b).collect()}
    sums = {x["qid"]: x["w"] for x in query.range_join_sums(q, b, ["w"]).collect()}
    for i, x, y, x2, y2 in windows:
        met = [w for _, a, c, w in boxes if x is not None and a + 1 > x and a < x2 and c + 2 > y and c < y2]
        assert got[i] == len(met) and sums[i] == sum(met), i
    assert query.range_join_sums(q, b.limit(0), ["w"]).agg(F.sum("w")).first()[0] == 0
