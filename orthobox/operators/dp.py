"""Hit probabilities over all boxes that a set's coordinates span, and exact optimal trees of small sets.

A set's workload is every box whose corners are two different coordinates per axis. A group of its boxes is hit (edges
included) with probability prod_d K_d / T_d: T_d pairs of coordinates on axis d, K_d of them reaching the group's box. A
tree costs the sum of its groups' weights; sets of at most `capacity` boxes are leaves and cost nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from orthobox.functions.boxes import Box, axes, mbr
from orthobox.operators.workload import uniform

#: Sets above this size are refused: the program takes 3 ** n steps.
MOST = 12
#: Subsets of sets of one size that are weighed together, about.
AT_ONCE = 1 << 18


def _coordinates(df: DataFrame, group: str) -> DataFrame:
    d = axes(df)
    pairs = F.array(*[F.struct(F.lit(i).alias("axis"), F.col(f"{s}_{i}").cast("double").alias("v")) for i in range(d) for s in ("min", "max")])
    return df.select(group, F.explode(pairs).alias("c")).select(group, "c.axis", "c.v").distinct()


def query_set(df: DataFrame, group: str = "node") -> DataFrame:
    """Every workload box of every group: group, min_i, max_i. Groups should be small: the sizes multiply over the axes."""
    d = axes(df)
    c = _coordinates(df, group)
    out = None
    for i in range(d):
        own = c.filter(F.col("axis") == i)
        low, high = own.select(F.col(group).alias("_g"), F.col("v").alias(f"min_{i}")), own.select(F.col(group).alias("_h"), F.col("v").alias(f"max_{i}"))
        pairs = low.join(high, (F.col("_g") == F.col("_h")) & (F.col(f"min_{i}") < F.col(f"max_{i}"))).select(F.col("_g").alias(group), f"min_{i}", f"max_{i}")
        out = pairs if out is None else out.join(pairs, group)
    return out.select(group, *Box.of(d).named())


def hit_probability(df: DataFrame, group: str = "node", key: str = "id") -> DataFrame:
    """group, id, probability: how likely a workload box of the group reaches the row's box; 0 on an axis of one coordinate."""
    d = axes(df)
    corners = F.array(*[F.struct(F.lit(i).alias("axis"), F.lit(s).alias("side"), F.col(f"{s}_{i}").cast("double").alias("v")) for i in range(d) for s in ("min", "max")])
    own = Window.partitionBy(group, "axis")  # a group's coordinates are ranked, not joined; one shuffle serves all that follows
    ranked = df.select(group, key, *Box.of(d).named()).repartition(group).select(group, key, F.explode(corners).alias("c")).select(group, key, "c.*").withColumn("at", F.dense_rank().over(own.orderBy("v")).cast("long"))
    placed = ranked.withColumn("p", F.max("at").over(own)).groupBy(group, key, "axis").agg(F.first("p").alias("p"), F.max(F.when(F.col("side") == "min", F.col("at"))).alias("lo"), F.max(F.when(F.col("side") == "max", F.col("at"))).alias("hi"))
    counted = placed.withColumns({"l": F.col("lo") - 1, "r": F.col("p") - F.col("hi")})
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    share = F.when(F.col("p") > 1, 1 - (pairs("l") + pairs("r")) / pairs("p")).otherwise(F.lit(0.0))
    return counted.groupBy(group, key).agg(F.product(share).alias("probability"))


def sample_points(df: DataFrame, samples: int, seed: int = 42, group: str = "node") -> DataFrame:
    """group, sample, q_i: so many uniform points in the extent of every group's rows."""
    d = axes(df)
    at = df.groupBy(group).agg(*mbr(Box.of(d)))
    return _sampled(at, d, samples, seed, group).select(group, "sample", *[f"q_{i}" for i in range(d)])


def _sampled(at: DataFrame, d: int, samples: int, seed: int, group: str) -> DataFrame:
    """Each group's row, with its extent, once for each sample point: sample, q_i."""
    at = at.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    at = at.withColumn("of_", F.concat_ws("/", F.col(group).cast("string"), F.col("sample").cast("string")))
    return at.withColumns({f"q_{i}": F.col(f"min_{i}") + uniform(seed, f"sample{i}", "of_") * (F.col(f"max_{i}") - F.col(f"min_{i}")) for i in range(d)})


def knn_weight(df: DataFrame, k: int = 1, samples: int = 100, seed: int = 42, group: str = "node", key: str = "id") -> DataFrame:
    """group, id, weight: the share of the group's sample points from which the row's box is no farther than the k-th nearest
    (the farthest, if there are fewer). Groups should be small: a group's rows are gathered once, and its points meet them where
    they are, so that only the rows are shuffled."""
    d = axes(df)
    listed = df.groupBy(group).agg(F.collect_list(F.struct(F.col(key).alias("k"), *Box.of(d).named())).alias("rows_"), *mbr(Box.of(d)))
    points = _sampled(listed, d, samples, seed, group)

    def far(r: Column) -> Column:
        box = Box(tuple(r[f"min_{i}"] for i in range(d)), tuple(r[f"max_{i}"] for i in range(d)))
        return F.struct(r["k"].alias("k"), box.min_dist_sq([F.col(f"q_{i}") for i in range(d)]).alias("far"))

    met = points.select(group, F.transform("rows_", far).alias("met_"))
    reach = F.element_at(F.sort_array(F.col("met_.far")), F.least(F.lit(k), F.size("met_")))
    each = met.withColumn("reach_", reach).select(group, "reach_", F.explode("met_").alias("m_"))
    return each.groupBy(group, F.col("m_.k").alias(key)).agg(F.avg((F.col("m_.far") <= F.col("reach_") + 1e-9).cast("int")).alias("weight"))


def range_weights(lo: np.ndarray, hi: np.ndarray, mlo: np.ndarray, mhi: np.ndarray) -> np.ndarray:
    """The hit probability of boxes mlo, mhi (group, d) under the workload of the set lo, hi (n, d)."""
    out = np.ones(len(mlo))
    for a in range(lo.shape[1]):
        v = np.unique(np.concatenate([lo[:, a], hi[:, a]]))
        p = len(v)
        if p < 2:
            return np.zeros(len(mlo))
        left, right = np.searchsorted(v, mlo[:, a], "left"), p - np.searchsorted(v, mhi[:, a], "right")
        out *= 1 - (left * (left - 1) + right * (right - 1)) / (p * (p - 1))
    return out


def knn_weights(lo: np.ndarray, hi: np.ndarray, mlo: np.ndarray, mhi: np.ndarray, k: int, samples: int, seed: int) -> np.ndarray:
    """The share of random points of the set's extent whose k-th neighbour (the farthest, if there are fewer) is no nearer
    than the boxes mlo, mhi."""
    points = np.random.default_rng(seed).uniform(lo.min(0), hi.max(0), (samples, lo.shape[1]))

    def dist(l, h):
        return (np.maximum(0, np.maximum(l[None] - points[:, None], points[:, None] - h[None])) ** 2).sum(-1)

    bound = np.sort(dist(lo, hi), axis=1)[:, min(k, len(lo)) - 1]
    return (dist(mlo, mhi) <= bound[:, None] + 1e-9).mean(0)


def weights(lo: np.ndarray, hi: np.ndarray, mlo: np.ndarray, mhi: np.ndarray, objective: str = "range", alpha: float = 0.5, k: int = 1, samples: int = 100, seed: int = 42) -> np.ndarray:
    """What a group with box mlo, mhi costs: objective range, knn, mix (alpha of range, the rest knn) or volume."""
    if objective == "volume":
        return np.prod(mhi - mlo, axis=1)
    out = np.zeros(len(mlo))
    if objective in ("range", "mix"):
        out += (alpha if objective == "mix" else 1.0) * range_weights(lo, hi, mlo, mhi)
    if objective in ("knn", "mix"):
        out += (1 - alpha if objective == "mix" else 1.0) * knn_weights(lo, hi, mlo, mhi, k, samples, seed)
    if objective not in ("range", "knn", "mix"):
        raise ValueError(objective)
    return out


@lru_cache(maxsize=64)
def _subsets(n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each set of n members, as a bit mask, its subsets that hold its lowest member, itself last; and all sizes."""
    out = [np.zeros(0, np.int64)]
    for s in range(1, 1 << n):
        low = s & -s
        subs = [0]
        while subs[-1] != s ^ low:
            subs.append((subs[-1] - (s ^ low)) & (s ^ low))
        out.append(np.array(subs, np.int64) | low)
    return out, np.bitwise_count(np.arange(1 << n)).astype(np.int64)


def _program(cost: np.ndarray, n: int, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of weights by subset: the least cost below each subset, into how many groups it is best parted, and the
    group with its lowest member for each number of groups.

    part[:, j, s] is the least cost of parting s into j groups, each paying its weight and its own tree: the group with the
    lowest member of s is chosen, the rest is part[:, j - 1].
    """
    subsets, size = _subsets(n)
    tree = np.zeros_like(cost)
    part = np.full((len(cost), capacity + 1, 1 << n), np.inf)
    part[:, 0, 0] = 0.0
    chosen = np.zeros((len(cost), capacity + 1, 1 << n), np.int32)
    groups = np.zeros(cost.shape, np.int32)
    for s in range(1, 1 << n):
        proper = subsets[s][:-1]
        own = cost[:, proper] + tree[:, proper]
        for j in range(2, min(capacity, size[s]) + 1):
            total = own + part[:, j - 1, s ^ proper]
            at = total.argmin(1)
            part[:, j, s], chosen[:, j, s] = np.take_along_axis(total, at[:, None], 1)[:, 0], proper[at]
        if size[s] > capacity:
            groups[:, s] = 2 + part[:, 2:, s].argmin(1)
            tree[:, s] = part[:, 2:, s].min(1)
        part[:, 1, s], chosen[:, 1, s] = cost[:, s] + tree[:, s], s
    return tree, groups, chosen


def _weights_by_subset(lo: np.ndarray, hi: np.ndarray, **objective) -> np.ndarray:
    """For sets lo, hi (set, n, d) the weights of their subsets (set, 2 ** n); those of range for all sets at once."""
    n = lo.shape[1]
    member = (np.arange(1 << n)[:, None] >> np.arange(n) & 1).astype(bool)
    mlo = np.where(member[1:, :, None], lo[:, None], np.inf).min(2)
    mhi = np.where(member[1:, :, None], hi[:, None], -np.inf).max(2)
    if objective.get("objective", "range") == "range":
        out = np.ones(mlo.shape[:2])
        for a in range(lo.shape[2]):
            v = np.sort(np.concatenate([lo[:, :, a], hi[:, :, a]], axis=1), axis=1)
            new = np.concatenate([np.ones((len(v), 1), bool), v[:, 1:] != v[:, :-1]], axis=1)[:, None]
            p = new.sum(2)
            left, right = ((v[:, None] < mlo[:, :, None, a]) & new).sum(2), ((v[:, None] > mhi[:, :, None, a]) & new).sum(2)
            out *= np.where(p > 1, 1 - (left * (left - 1) + right * (right - 1)) / np.maximum(p * (p - 1), 1), 0.0)
    else:
        out = np.array([weights(*x, **objective) for x in zip(lo, hi, mlo, mhi)])
    return np.concatenate([np.zeros((len(lo), 1)), out], axis=1)


def optimal_trees(sets: Sequence[tuple[np.ndarray, np.ndarray]], capacity: int, **objective) -> list[tuple[float, list]]:
    """For each set (lo, hi), all of one size, the least cost of a tree and the tree: a list of positions is a leaf, a list
    of lists an inner node. Sets share every step of the program."""
    if capacity < 2:
        raise ValueError("capacity: 2 or more")
    n = len(sets[0][0]) if sets else 0
    if n > MOST:
        raise ValueError(f"{n} boxes; at most {MOST}")
    if n <= capacity:
        return [(0.0, list(range(n)))] * len(sets)
    tree, groups, chosen = _program(_weights_by_subset(*(np.stack([np.asarray(s[i], float) for s in sets]) for i in (0, 1)), **objective), n, capacity)

    def grown(i: int, s: int) -> list:
        if int(s).bit_count() <= capacity:
            return [k for k in range(n) if s >> k & 1]
        out, j, left = [], int(groups[i, s]), s
        while j:
            g = int(chosen[i, j, left])
            out.append(grown(i, g))
            left, j = left ^ g, j - 1
        return out

    full = (1 << n) - 1
    return [(float(tree[i, full]), grown(i, full)) for i in range(len(sets))]


def optimal_tree(lo: np.ndarray, hi: np.ndarray, capacity: int, **objective) -> tuple[float, list]:
    """The least cost of a tree over one set's boxes, and the tree."""
    return optimal_trees([(lo, hi)], capacity, **objective)[0]


def paths(tree: list) -> dict[int, tuple[int, ...]]:
    """Where each position is in a tree: the numbers of the children on the way to its leaf."""
    if not tree or not isinstance(tree[0], list):
        return {i: () for i in tree}
    return {i: (c, *rest) for c, child in enumerate(tree) for i, rest in paths(child).items()}


def canonical(lo: np.ndarray, labels: Sequence[int]) -> list[int]:
    """Labels renumbered by the order of their groups' lower corners, axis by axis."""
    corner: dict[int, tuple] = {}
    for k, x in zip(labels, np.asarray(lo).tolist()):
        corner[int(k)] = tuple(map(min, corner[int(k)], x)) if int(k) in corner else tuple(x)
    order = {k: i for i, k in enumerate(sorted(corner, key=lambda k: (corner[k], k)))}
    return [order[int(x)] for x in labels]


def partition_labels(lo: np.ndarray, hi: np.ndarray, max_groups: int, **objective) -> list[int] | None:
    """Which child of the optimal tree's root each box is in: None for under two boxes, all 0 for at most max_groups."""
    if len(lo) < 2:
        return None
    _, tree = optimal_tree(lo, hi, max_groups, **objective)
    return [paths(tree)[i][0] if paths(tree)[i] else 0 for i in range(len(lo))]


def ultrametric(tree: list) -> np.ndarray:
    """For each two boxes the depth of the lowest node above both; 0 within one leaf and for a box itself."""
    at = paths(tree)
    out = np.zeros((len(at), len(at)), dtype=np.int64)
    for i in at:
        for j in at:
            if at[i] != at[j]:
                out[i, j] = next((k for k, (x, y) in enumerate(zip(at[i], at[j])) if x != y), min(len(at[i]), len(at[j])))
    return out


def solve_groups(df: DataFrame, capacity: int, group: str = "node", key: str = "id", **objective) -> DataFrame:
    """Each group's optimal tree: group, id, label (canonical), path in the tree, and the group's cost and size.

    Groups of over MOST boxes are refused. Rows are taken by key, so the outcome does not depend on their order.
    """
    d = axes(df)
    names = [f"{s}_{i}" for s in ("min", "max") for i in range(d)]
    schema = T.StructType([df.schema[group], df.schema[key], T.StructField("label", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("cost", T.DoubleType()), T.StructField("n", T.IntegerType())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            sizes = f.column("n").to_numpy()
            if not len(sizes):
                continue
            boxes, ends = f.column("boxes").flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * d), np.cumsum(sizes)
            labels, where, costs = np.zeros(len(boxes), np.int32), [""] * len(boxes), np.zeros(len(sizes))
            for n in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == n)
                for some in np.array_split(at, max(1, -(-len(at) // max(16, AT_ONCE >> n)))):
                    x = boxes[(ends[some] - n)[:, None] + np.arange(n)]
                    for i, own, (cost, tree) in zip(some.tolist(), x, optimal_trees([(b[:, :d], b[:, d:]) for b in x], capacity, **objective)):
                        first, last, at_ = ends[i] - n, ends[i], paths(tree)
                        costs[i] = cost
                        where[first:last] = [".".join(map(str, at_[j])) for j in range(n)]
                        labels[first:last] = canonical(own[:, :d], [at_[j][0] if at_[j] else 0 for j in range(n)])
            each = np.repeat(np.arange(len(sizes)), sizes)
            columns = [f.column(group).take(pa.array(each)), f.column("keys").flatten(), pa.array(labels), pa.array(where, pa.string()), pa.array(costs[each]), pa.array(sizes[each].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = F.struct(F.col(key).alias("k"), F.array(*[F.col(c).cast("double") for c in names]).alias("b"))
    size = F.count(F.lit(1)).cast("int")
    # Counted before any group is gathered, with sums by task.
    large = df.groupBy(group).agg(size.alias("n")).filter(F.col("n") > MOST).head(1)
    if large:
        raise ValueError(f"a group of over {MOST} boxes: {large[0][group]}")
    listed = df.groupBy(group).agg(size.alias("n"), F.collect_list(rows).alias("rows"))
    by_key = listed.withColumn("rows", F.array_sort("rows", lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)))
    return by_key.select(group, "n", F.transform("rows", lambda r: r["k"]).alias("keys"), F.transform("rows", lambda r: r["b"]).alias("boxes")).mapInArrow(solve, schema)


def ultrametric_pairs(solved: DataFrame, group: str = "node", key: str = "id") -> DataFrame:
    """group, a, b, depth of each two boxes' lowest common node, from solve_groups' paths."""
    a = solved.select(F.col(group).alias("_g"), F.col(key).alias("a"), F.split("path", r"\.").alias("p"))
    b = solved.select(F.col(group).alias("_h"), F.col(key).alias("b"), F.split("path", r"\.").alias("q"))
    met = a.join(b, (F.col("_g") == F.col("_h")) & (F.col("a") < F.col("b")))
    differ = F.transform(F.arrays_zip("p", "q"), lambda x: ~x["p"].eqNullSafe(x["q"]))
    first = F.array_position(differ, True)
    return met.select(F.col("_g").alias(group), "a", "b", F.when(first > 0, first - 1).otherwise(0).cast("int").alias("depth"))
