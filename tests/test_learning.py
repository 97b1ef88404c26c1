"""Optimal trees against enumeration, probabilities against counting, gradients against differences."""

import itertools

import numpy as np
import pytest

from orthobox.operators import dp, insertion, network


def enumerate_cost(lo: np.ndarray, hi: np.ndarray, capacity: int, **objective) -> float:
    """The same least cost by trying every partition at every level: for checking small sets."""

    def parts(items: list[int]) :
        if not items:
            yield []
            return
        for rest in parts(items[1:]):
            yield [[items[0]], *rest]
            for i in range(len(rest)):
                yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]

    def best(items: list[int]) -> float:
        if len(items) <= capacity:
            return 0.0
        out = np.inf
        for groups in parts(items):
            if 2 <= len(groups) <= capacity:
                w = dp.weights(lo, hi, np.array([lo[g].min(0) for g in groups]), np.array([hi[g].max(0) for g in groups]), **objective)
                out = min(out, float(w.sum()) + sum(best(g) for g in groups))
        return out

    return best(list(range(len(lo))))


def some(n, d=2, seed=0):
    r = np.random.default_rng(seed)
    lo = r.integers(0, 8, (n, d)).astype(float)
    return lo, lo + r.integers(0, 4, (n, d))


@pytest.mark.parametrize("n, capacity", [(4, 2), (5, 2), (6, 3), (7, 3), (7, 4)])
@pytest.mark.parametrize("objective", ["range", "mix", "volume"])
def test_program_is_enumeration(n, capacity, objective):
    lo, hi = some(n, seed=n)
    cost, tree = dp.optimal_tree(lo, hi, capacity, objective=objective)
    assert cost == pytest.approx(enumerate_cost(lo, hi, capacity, objective=objective))
    assert sorted(dp.paths(tree)) == list(range(n))


def test_probability_counts_the_workload():
    lo, hi = some(5, seed=2)
    sides = [[(a, b) for a, b in itertools.combinations(np.unique(np.concatenate([lo[:, k], hi[:, k]])), 2)] for k in (0, 1)]
    every = list(itertools.product(*sides))
    hit = [np.mean([all(lo[i, k] <= q[k][1] and hi[i, k] >= q[k][0] for k in (0, 1)) for q in every]) for i in range(5)]
    assert np.allclose(dp.range_weights(lo, hi, lo, hi), hit)
    line = np.array([[0.0], [1.0], [2.0], [3.0]])
    assert dp.range_weights(line, line, np.array([[0.0]]), np.array([[0.0]]))[0] == pytest.approx(0.5)
    same = np.ones((3, 2))
    assert dp.range_weights(same, same, same, same).tolist() == [0, 0, 0]


def test_limits_and_labels():
    lo, hi = some(3)
    assert dp.partition_labels(lo[:1], hi[:1], 3) is None
    assert dp.partition_labels(lo, hi, 3) == [0, 0, 0]
    with pytest.raises(ValueError):
        dp.optimal_tree(*some(13), 3)
    assert dp.canonical(np.array([[5.0], [1.0], [3.0]]), [7, 2, 7]) == [1, 0, 1]
    h = dp.ultrametric([[0, 1], [[2], [3]]])
    assert h[0, 1] == 0 and h[0, 2] == 0 and h[2, 3] == 1 and (h == h.T).all()


def test_gradient():
    net = network.Network(9, 5, (3, 2), seed=1)
    lo, hi = some(6, seed=4)
    x, y = network.features(lo, hi), np.array([0, 1, 2, 0, 1, 2])
    _, g = net.gradient(x, y, 3, momentum=0)
    r = np.random.default_rng(0)
    for name, got in g.items():
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in got.shape)
            old = net.w[name][at]
            values = []
            for step in (1e-6, -1e-6):
                net.w[name][at] = old + step
                values.append(net.gradient(x, y, 3, momentum=0)[0])
            net.w[name][at] = old
            assert (values[0] - values[1]) / 2e-6 == pytest.approx(got[at], abs=1e-5), name


def test_network_round_trip_and_heads():
    net = network.Network(9, 5, (3, 2), seed=1)
    lo, hi = some(6, seed=4)
    back = network.Network.load(net.save())
    assert np.allclose(net.forward(lo, hi, 2), back.forward(lo, hi, 2)) and net.forward(lo, hi).shape == (6, 3)
    assert np.allclose(net.forward(lo * 3 + 5, hi * 3 + 5), net.forward(lo, hi))
    with pytest.raises(ValueError):
        net.forward(lo, hi, 4)


def test_training_learns(spark):
    from orthobox.shared import settled, with_rank
    from pyspark.sql import functions as F

    r = np.random.default_rng(5)
    rows = [(i, *map(float, p), *map(float, p)) for i, p in enumerate(r.random((200, 2)))]
    df = spark.createDataFrame(rows, "id long, min_0 double, min_1 double, max_0 double, max_1 double")
    samples = settled(network.training_samples(with_rank(df, [F.col("id")]), 200, 30, groups=3))
    assert samples.groupBy("sample_id").count().filter("count between 6 and 8").count() == 30
    table = samples.toPandas()
    net, raw = network.train(samples, 3, hidden=16, epochs=25, rate=5e-3), network.Network(9, 16, (3,), 42)

    def loss(n):
        return np.mean([n.gradient(network.features(x[["min_0", "min_1"]].to_numpy(), x[["max_0", "max_1"]].to_numpy()), x["label"].to_numpy(), momentum=0)[0] for _, x in table.groupby("sample_id")])

    assert loss(net) < loss(raw) - 0.1


@pytest.mark.parametrize("strategy", ["guttman", "rstar"])
def test_insertion_keeps_nodes_tight(strategy):
    r = np.random.default_rng(2)
    lo = r.random((300, 3))
    hi = lo + r.random((300, 3)) / 10
    tree = insertion.build(lo, hi, 6, strategy)
    seen, depths, todo = [], set(), [(tree.root, 0)]
    while todo:
        node, depth = todo.pop()
        a, b = tree.corners(node)
        assert len(node.rows) <= 6 and (node.lo == a.min(0)).all() and (node.hi == b.max(0)).all()
        assert node is tree.root or len(node.rows) >= (3 if strategy == "guttman" else 1)
        if node.leaf:
            seen += node.rows
            depths.add(depth)
        else:
            todo += [(c, depth + 1) for c in node.rows]
    assert sorted(seen) == list(range(300)) and len(depths) == 1


def test_subsets_of_many_sets_are_weighed_at_once():
    """Sets of one size share each step, and weigh what they weigh alone, equal coordinates and flat axes included."""
    import numpy as np

    from orthobox.operators import dp

    r = np.random.default_rng(4)
    lo = r.integers(0, 4, (20, 5, 2)).astype(float)
    lo[3, :, 1] = 2.0
    hi = lo + r.integers(0, 3, (20, 5, 2))
    hi[3, :, 1] = 2.0
    got = dp._weights_by_subset(lo, hi)
    for i in range(20):
        for s in range(1, 32):
            own = [k for k in range(5) if s >> k & 1]
            alone = dp.range_weights(lo[i], hi[i], lo[i, own].min(0)[None], hi[i, own].max(0)[None])[0]
            assert got[i, s] == alone, (i, s)


def test_groups_are_shuffled_once(spark):
    """Neither a group's sample points nor its coordinates are shuffled, only its rows."""
    from orthobox.operators import dp

    rows = spark.createDataFrame([(i // 4, i, float(i % 5), float(i % 3), i % 5 + 1.0, i % 3 + 2.0) for i in range(40)], "node long, id long, min_0 double, min_1 double, max_0 double, max_1 double")
    for df in (dp.knn_weight(rows, 2, 10), dp.hit_probability(rows)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
        assert df.count() == 40
