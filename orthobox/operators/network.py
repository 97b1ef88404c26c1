"""A network that parts a set of boxes into at most K groups, trained in numpy on optimal trees, and its use in a build.

A box's features pass two dense layers, the set is summed up by the largest value of each unit, and two more layers turn a
box's units and the set's into K logits. Batch normalisation follows the first layer of either pair.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthobox.functions.boxes import Box, axes, mbr
from orthobox.operators import dp
from orthobox.shared import few

_EPS = 1e-5
#: Boxes whose units are computed together.
TOGETHER = 1 << 14


def features(lo: np.ndarray, hi: np.ndarray, extent: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """4 d + 1 features per box, scaled to the set's extent: corners, sizes, volume, centre."""
    base, top = extent if extent is not None else (lo.min(0), hi.max(0))
    scale = np.maximum(top - base, 1e-9)
    a, b = (lo - base) / scale, (hi - base) / scale
    return np.hstack([a, b, b - a, np.prod(b - a, axis=1, keepdims=True), (a + b) / 2])


class Network:
    """Weights by name, one head per number of groups. train() keeps running means for normalisation in forward()."""

    def __init__(self, inputs: int, hidden: int = 64, groups: Sequence[int] = (3,), seed: int = 0, dropout: float = 0.1):
        r = np.random.default_rng(seed)
        self.config = {"input_dim": inputs, "hidden_dim": hidden, "groups": list(groups), "dropout": dropout}

        def dense(i: int, o: int) -> np.ndarray:
            return r.uniform(-1, 1, (i + 1, o)) / np.sqrt(i)

        self.w = {"in1": dense(inputs, hidden), "in2": dense(hidden, hidden), "g1": np.ones(hidden), "b1": np.zeros(hidden)}
        for k in groups:
            self.w |= {f"{k}.out1": dense(2 * hidden, hidden), f"{k}.g": np.ones(hidden), f"{k}.b": np.zeros(hidden), f"{k}.out2": dense(hidden, k)}
        self.running = {n: (np.zeros(hidden), np.ones(hidden)) for n in ("1", *map(str, groups))}

    def _head(self, k: int | None) -> int:
        k = self.config["groups"][0] if k is None else k
        if k not in self.config["groups"]:
            raise ValueError(f"no head for {k} groups")
        return k

    def _normal(self, x: np.ndarray, name: str, g: str, b: str) -> np.ndarray:
        mean, var = self.running[name]
        return (x - mean) / np.sqrt(var + _EPS) * self.w[g] + self.w[b]

    def units(self, x: np.ndarray) -> np.ndarray:
        """The units of each box, before they are pooled."""
        h = self._normal(np.maximum(x @ self.w["in1"][:-1] + self.w["in1"][-1], 0), "1", "g1", "b1")
        return np.maximum(h @ self.w["in2"][:-1] + self.w["in2"][-1], 0)

    def decide(self, units: np.ndarray, pooled: np.ndarray, k: int | None = None) -> np.ndarray:
        """The logits of boxes whose set has the pooled units."""
        k = self._head(k)
        w = self.w[f"{k}.out1"]
        h = self._normal(np.maximum(np.hstack([units, pooled]) @ w[:-1] + w[-1], 0), str(k), f"{k}.g", f"{k}.b")
        return h @ self.w[f"{k}.out2"][:-1] + self.w[f"{k}.out2"][-1]

    def forward(self, lo: np.ndarray, hi: np.ndarray, k: int | None = None) -> np.ndarray:
        u = self.units(features(lo, hi))
        return self.decide(u, np.broadcast_to(u.max(0), u.shape), k)

    def gradient(self, x: np.ndarray, labels: np.ndarray, k: int | None = None, rng: np.random.Generator | None = None, momentum: float = 0.1) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of one set, normalised by its own means, and the gradient by every weight."""
        k = self._head(k)
        n, g = len(x), {}

        def normal(a, name, scale, shift):
            mean, var = a.mean(0), a.var(0)
            if momentum:
                m, v = self.running[name]
                self.running[name] = (m + momentum * (mean - m), v + momentum * (var * n / max(1, n - 1) - v))
            inv = 1 / np.sqrt(var + _EPS)
            return (a - mean) * inv, inv, (a - mean) * inv * self.w[scale] + self.w[shift]

        def back(d, z, inv, scale, shift):
            g[scale], g[shift] = (d * z).sum(0), d.sum(0)
            d = d * self.w[scale]
            return inv * (d - d.mean(0) - z * (d * z).mean(0))

        def dense(name, a):
            return a @ self.w[name][:-1] + self.w[name][-1]

        def dense_back(name, a, d):
            g[name] = np.vstack([a.T @ d, d.sum(0)])
            return d @ self.w[name][:-1].T

        a1 = np.maximum(dense("in1", x), 0)
        z1, i1, h1 = normal(a1, "1", "g1", "b1")
        u = np.maximum(dense("in2", h1), 0)
        top = u.argmax(0)
        both = np.hstack([u, np.broadcast_to(u.max(0), u.shape)])
        a2 = np.maximum(dense(f"{k}.out1", both), 0)
        z2, i2, h2 = normal(a2, str(k), f"{k}.g", f"{k}.b")
        keep = np.ones_like(h2) if rng is None else (rng.random(h2.shape) >= self.config["dropout"]) / (1 - self.config["dropout"])
        h2 = h2 * keep
        logits = dense(f"{k}.out2", h2)
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss = float(-np.log(np.maximum(p[np.arange(n), labels], 1e-30)).mean())
        d = p
        d[np.arange(n), labels] -= 1
        d = dense_back(f"{k}.out2", h2, d / n) * keep
        d = dense_back(f"{k}.out1", both, back(d, z2, i2, f"{k}.g", f"{k}.b") * (a2 > 0))
        hidden = u.shape[1]
        du, pooled = d[:, :hidden].copy(), d[:, hidden:].sum(0)
        du[top, np.arange(hidden)] += pooled
        d = dense_back("in2", h1, du * (u > 0))
        dense_back("in1", x, back(d, z1, i1, "g1", "b1") * (a1 > 0))
        return loss, g

    def save(self) -> str:
        """The network as JSON text."""
        return json.dumps({"config": self.config, "weights": {n: w.tolist() for n, w in self.w.items()}, "running": {n: [m.tolist(), v.tolist()] for n, (m, v) in self.running.items()}})

    @staticmethod
    def load(text: str) -> Network:
        d = json.loads(text)
        net = Network(d["config"]["input_dim"], d["config"]["hidden_dim"], d["config"]["groups"], dropout=d["config"]["dropout"])
        net.w = {n: np.array(w) for n, w in d["weights"].items()}
        net.running = {n: (np.array(m), np.array(v)) for n, (m, v) in d["running"].items()}
        return net


def augment(df: DataFrame, scale: float, flips: Sequence[bool]) -> DataFrame:
    """Both corners multiplied by one scale; on flipped axes the box is mirrored at 0."""
    out = {}
    for i, flip in enumerate(flips):
        lo, hi = F.col(f"min_{i}") * F.lit(float(scale)), F.col(f"max_{i}") * F.lit(float(scale))
        out |= {f"min_{i}": -hi, f"max_{i}": -lo} if flip else {f"min_{i}": lo, f"max_{i}": hi}
    return df.withColumns(out)


def canonical_labels(df: DataFrame, sample: str = "sample_id", key: str = "id") -> DataFrame:
    """sample, id, label: labels renumbered from 0 by the order of their groups' lower corners."""
    from pyspark.sql.window import Window

    d = axes(df)
    corner = df.groupBy(sample, "label").agg(*[F.min(f"min_{i}").alias(f"c{i}") for i in range(d)])
    ranked = corner.select(F.col(sample).alias("_s"), F.col("label").alias("_l"), (F.row_number().over(Window.partitionBy(sample).orderBy(*[f"c{i}" for i in range(d)], "label")) - 1).alias("new"))
    return df.join(ranked, (F.col(sample) == F.col("_s")) & (F.col("label") == F.col("_l"))).select(sample, key, F.col("new").alias("label"))


def sample_windows(ranked: DataFrame, starts: DataFrame) -> DataFrame:
    """The rows of each sample: those of rank start to start + size - 1. starts: sample_id, start, size."""
    wanted = starts.select("sample_id", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("rank"))
    return ranked.join(wanted, "rank")


def training_samples(ranked: DataFrame, n_rows: int, samples: int, least: int = 6, most: int = 8, groups: int = 3, seed: int = 42, scale: tuple[float, float] = (0.8, 1.2), flip: float = 0.5, key: str = "id", **objective) -> DataFrame:
    """Rows (sample_id, id, label, min_i, max_i) of augmented windows of the table with their optimal, canonical labels.

    ranked has the rows' rank, as with_rank gives it. Sizes, places and augmentation depend on the seed and the sample only.
    """
    d, spark = axes(ranked), ranked.sparkSession
    pick = lambda name: (F.xxhash64("sample_id", F.lit(f"{seed}/{name}")).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)))
    starts = spark.range(samples).withColumnRenamed("id", "sample_id").withColumn("size", F.least(F.lit(n_rows), (F.lit(least) + F.floor(pick("size") * (most - least + 1)))).cast("long"))
    starts = starts.withColumn("start", F.floor(pick("start") * (F.lit(n_rows) - F.col("size") + 1)).cast("long"))
    rows = sample_windows(ranked, starts).withColumn("_scale", F.lit(scale[0]) + pick("scale") * (scale[1] - scale[0]))
    out = {}
    for i in range(d):
        lo, hi, flipped = F.col(f"min_{i}") * F.col("_scale"), F.col(f"max_{i}") * F.col("_scale"), pick(f"flip{i}") < flip
        out |= {f"min_{i}": F.when(flipped, -hi).otherwise(lo), f"max_{i}": F.when(flipped, -lo).otherwise(hi)}
    rows = rows.withColumns(out).select("sample_id", key, *Box.of(d).named())
    solved = dp.solve_groups(rows, groups, "sample_id", key, **objective).select("sample_id", key, "label")
    return rows.join(solved, ["sample_id", key])


def train(samples: DataFrame, groups: int, hidden: int = 64, epochs: int = 15, rate: float = 1e-3, batch: int = 32, seed: int = 42, key: str = "id") -> Network:
    """A network fitted to samples by Adam; a step sums the gradients of `batch` sets. The samples, a number that the caller
    chose, are collected."""
    d = axes(samples)
    names = [f"{s}_{i}" for s in ("min", "max") for i in range(d)]
    table = samples.select("sample_id", key, "label", *names).toPandas().sort_values(["sample_id", key])
    sets = []
    for _, rows in table.groupby("sample_id"):
        x = rows[names].to_numpy(dtype=float)
        if len(x) > 1:
            sets.append((features(x[:, :d], x[:, d:]), rows["label"].to_numpy()))
    net, r = Network(4 * d + 1, hidden, (groups,), seed), np.random.default_rng(seed)
    m, v = ({n: np.zeros_like(w) for n, w in net.w.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = r.permutation(len(sets))
        for at in range(0, len(order), batch):
            step += 1
            total = {n: np.zeros_like(w) for n, w in net.w.items()}
            for i in order[at : at + batch]:
                for n, g in net.gradient(*sets[i], rng=r)[1].items():
                    total[n] += g
            for n, g in total.items():
                m[n] += 0.1 * (g - m[n])
                v[n] += 0.001 * (g * g - v[n])
                net.w[n] -= rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
    return net


def labeller(net: Network, d: int, k: int, key: str = "id") -> Callable[[DataFrame, int], DataFrame]:
    """The label function of a top-down build: each row's most likely group among the first k, for all nodes at once.

    Per level: extents by node, the units' maxima by batch and node, and decisions by row; units, computed twice, are not shuffled.
    """
    hidden = net.config["hidden_dim"]
    names = [f"{s}_{i}" for s in ("min", "max") for i in range(d)]
    extents = [f"x{c}" for c in names]

    def assign(rows: DataFrame) -> DataFrame:
        own = T.StructType([rows.schema["node_id"], T.StructField("units", T.ArrayType(T.FloatType()))])
        kept, out = rows.columns, T.StructType([*rows.schema.fields, T.StructField("label", T.IntegerType())])

        def table(f: pa.RecordBatch, of: Sequence[str]) -> np.ndarray:
            return np.column_stack([f.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in of])

        def units(f: pa.RecordBatch) -> np.ndarray:
            x, e = table(f, names), table(f, extents)
            return net.units(features(x[:, :d], x[:, d:], (e[:, :d], e[:, d:]))).astype(np.float32)

        def maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top: dict[str, np.ndarray] = {}
            for f in batches:
                if f.num_rows:
                    coded = f.column("node_id").dictionary_encode()
                    codes, u = coded.indices.to_numpy(), units(f)
                    for i, node in enumerate(coded.dictionary.to_pylist()):
                        most = u[codes == i].max(0)
                        top[node] = np.maximum(top[node], most) if node in top else most
            if top:
                yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.string()), pa.array([x.tolist() for x in top.values()], pa.list_(pa.float32()))], names=own.names)

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for f in batches:
                if f.num_rows:
                    pooled = f.column("pooled").flatten().to_numpy().reshape(-1, hidden).astype(float)
                    labels = net.decide(units(f).astype(float), pooled)[:, :k].argmax(1)
                    yield pa.RecordBatch.from_arrays([*[f.column(c) for c in kept], pa.array(labels.astype(np.int32))], names=out.names)

        extent = few(rows.groupBy(F.col("node_id").alias("_n")).agg(*mbr(Box.of(d), "x")))
        scaled = rows.join(extent, F.col("node_id") == F.col("_n")).drop("_n")
        pooled = scaled.select("node_id", *names, *extents).mapInArrow(maxima, own).groupBy(F.col("node_id").alias("_n")).agg(F.array(*[F.max(F.get("units", F.lit(i))) for i in range(hidden)]).alias("pooled"))
        return scaled.join(few(pooled), F.col("node_id") == F.col("_n")).drop("_n").mapInArrow(decide, out)

    def label(rows: DataFrame, level: int) -> DataFrame:
        return assign(rows).select("node_id", key, "label")

    label.assign = assign  # keeps all columns of the rows

    def local(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        extent = lo.min(0), hi.max(0)
        runs = [slice(i, i + TOGETHER) for i in range(0, len(lo), TOGETHER)]
        u = np.concatenate([net.units(features(lo[r], hi[r], extent)).astype(np.float32) for r in runs])
        top = u.max(0).astype(float)
        return np.concatenate([net.decide(u[r].astype(float), np.broadcast_to(top, u[r].shape))[:, :k].argmax(1) for r in runs])

    label.local = local  # of the boxes of one node, in a task
    return label
