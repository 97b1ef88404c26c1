"""Toxicity from confirmed examples and unlabelled text: non-negative positive-unlabelled learning.

The classifier is linear over the words of a text and their prefixes, each counted once. Its risk is
prior * E_p[loss(g)] + max(0, E_u[loss(-g)] - prior * E_p[loss(-g)]); where the second part falls below zero, a step
raises it instead. Features are those whose share among the toxic examples differs most from that among unlabelled text.

Training takes at most MAX_POSITIVE toxic training keys and MAX_UNLABELLED of all training keys as unlabelled text, those
of least key hash, and one row, that of least text, of each; the class prior is the toxic share of all labelled training rows
unless one is given. Scoring covers every row and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthobox.llm._rows import CHUNK_BYTES, LOWER, Tables, map_texts, mixed, pieces, prefix_hashes, raw, small_batches, span_hashes, text_bytes, words
from orthobox.llm._shared import settled

MAX_POSITIVE = 3000
MAX_UNLABELLED = 9000
MAX_FEATURES = 1024
PREFIXES = (4, 5, 6)
LEAST_DOCUMENTS = 3
LEAST_Z = 4.0

#: Bytes that make up words: letters of ASCII and everything beyond.
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(texts: pa.Array, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's words and of the words' prefixes, not yet without repeats, and each one's text."""
    data, offsets = raw(texts)
    data = LOWER[data]
    prefix = prefix_hashes(data, tables)
    starts, ends, row = words(np.where(_LETTERS[data], data, np.uint8(0x20)), offsets)
    out, rows = [span_hashes(data, prefix, starts, ends, tables)], [row]
    for k in PREFIXES:
        long = ends - starts > k
        out.append(mixed(span_hashes(data, prefix, starts[long], starts[long] + k, tables) + np.uint64(k)))
        rows.append(row[long])
    return np.concatenate(out), np.concatenate(rows)


@dataclass(frozen=True)
class Model:
    """hashes are sorted; score = 1 / (1 + exp(-(bias + sum of the weights of the hashes in a text)))."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array, tables: Tables) -> np.ndarray:
        h, row = features(texts, tables)
        total = np.full(len(texts), self.bias)
        if len(self.hashes) and len(h):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            once = np.unique(row[hit] * len(self.hashes) + at[hit])
            total += np.bincount(once // len(self.hashes), weights=self.weights[once % len(self.hashes)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def train_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-5, beta: float = 0.0, gamma: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk, sigmoid loss, by Adam. Rows are texts, columns features (0 or 1)."""
    d = positive.shape[1]
    w, m, v = np.zeros(d + 1, np.float32), np.zeros(d + 1, np.float32), np.zeros(d + 1, np.float32)
    w[d] = np.log(prior / (1 - prior))
    xp, xu = (np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32) for x in (positive, unlabelled))

    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))

    for step in range(1, steps + 1):
        gp, gu = xp @ w, xu @ w
        sp, su = sigmoid(gp), sigmoid(gu)
        negative = su.mean() - prior * sp.mean()
        of_negative = xu.T @ (su * (1 - su) / len(xu)) - prior * (xp.T @ (sp * (1 - sp) / len(xp)))
        if negative >= -beta:
            grad = of_negative - prior * (xp.T @ (sp * (1 - sp) / len(xp)))
        else:
            grad = -gamma * of_negative
        grad[:d] += decay * w[:d]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:d].astype(np.float64), float(w[d])


def _sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows of least key hash: the same ones however the table is stored."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), key).limit(n)


def fit(documents: DataFrame, labels: DataFrame, key: str, text: str, toxic: str, training: Column, prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES) -> Model:
    """A model from the rows for which training holds, in both tables.

    Without training documents that are marked toxic it scores all texts near 0: so for empty tables and for labels of absent
    documents. Rows with a null key or label have no label. A key with several labels is toxic if one of them says so; of rows
    with one key one is taken. Ties in the choice of features go to the lesser hash. Null texts count as empty.
    """
    small_batches(documents.sparkSession)
    marked = labels.filter(training & F.col(key).isNotNull() & F.col(toxic).isNotNull()).groupBy(key).agg(F.max(F.col(toxic)).alias("y"))
    share = marked.agg(F.count(F.lit(1)), F.sum(F.when(F.col("y") == 1, 1).otherwise(0))).first()
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -60.0)
    if not share[1]:
        return none
    if prior is None:
        prior = min(max(share[1] / share[0], 1e-4), 0.9)
    own = documents.filter(training & F.col(key).isNotNull())
    keys = own.select(F.col(key))
    toxic_keys = marked.filter("y = 1").select(key)
    chosen = _sample(keys.join(toxic_keys, key, "left_semi").distinct(), key, max_positive).withColumn("p", F.lit(1)).unionByName(_sample(keys.distinct(), key, max_unlabelled).withColumn("p", F.lit(0)))
    chosen = settled(chosen.select(F.col(key).alias("k"), "p"))  # at most max_positive + max_unlabelled rows
    rows = own.select(F.col(key).alias("k"), text_bytes(text).alias("t")).join(F.broadcast(chosen), "k")
    rows = settled(rows.groupBy("k", "p").agg(F.min("t").alias("t")).select("p", "t"))
    n_p, n_u = (rows.filter(F.col("p") == x).count() for x in (1, 0))
    if not n_p:
        return none

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many toxic and other documents have each feature."""
        tables = Tables()
        for b in (piece for batch in batches for piece in pieces(batch, 1, CHUNK_BYTES)):
            y = b.column(0).to_numpy(zero_copy_only=False)
            h, row = features(b.column(1), tables)
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            fresh = np.ones(len(h), dtype=bool)
            fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, y_of = h[fresh], y[row[fresh]]
            kinds, at = np.unique(h, return_inverse=True)
            pos = np.bincount(at, weights=y_of, minlength=len(kinds)).astype(np.int64)
            every = np.bincount(at, minlength=len(kinds))
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64), pa.int64()), pa.array(pos, pa.int64()), pa.array(every - pos, pa.int64())], names=["h", "p", "u"])

    counted = rows.mapInArrow(count, "h long, p long, u long").groupBy("h").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    p, u = F.col("p") / n_p, F.col("u") / max(n_u, 1)
    mean = (F.col("p") + F.col("u")) / (n_p + n_u)
    z = (p - u) / F.sqrt(mean * (1 - mean) * F.lit(1 / n_p + 1 / max(n_u, 1)) + F.lit(1e-12))
    picked = counted.filter(f"p + u >= {LEAST_DOCUMENTS}").withColumn("z", z).filter(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "h").limit(max_features).collect()
    hashes = np.sort(np.array([r["h"] for r in picked], dtype=np.int64).view(np.uint64))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables()
        for b in (piece for batch in batches for piece in pieces(batch, 1, CHUNK_BYTES)):
            h, row = features(b.column(1), tables)
            if len(hashes) and len(h):
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = hashes[at] == h
                once = np.unique(row[hit] * len(hashes) + at[hit])
                found = np.split(once % len(hashes), np.searchsorted(once // len(hashes), np.arange(1, b.num_rows)))
            else:
                found = [np.zeros(0, np.int64)] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.array([x.astype("<u2").tobytes() for x in found], pa.binary())], names=["p", "at"])

    got = rows.mapInArrow(held, "p int, at binary").collect()  # a row per chosen one, of at most max_features indices
    x = np.zeros((len(got), len(hashes)), dtype=np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(bytes(r["at"]), "<u2")] = 1
    y = np.array([r["p"] for r in got]) == 1
    weights, bias = train_nnpu(x[y], x[~y], prior)
    return Model(hashes, weights, bias)


def score_texts(df: DataFrame, keep: Sequence[str], text: str, model: Model, name: str = "score") -> DataFrame:
    """The kept columns and, under the given name, the score, 0 to 1, of every whole text; null texts count as empty.

    Repeated rows get the same score each, an empty table gives none. If a kept column has the name, underscores are added.

    A long text is scored whole, by a task that handles it alone.
    """

    def make():
        tables = Tables()
        return lambda texts: [model.score(texts, tables)]

    return map_texts(df, keep, text, [T.StructField(name, T.DoubleType())], make)
