"""Language identification by a bidirectional gated recurrent network over bytes, trained by backpropagation through time.

A text is cut into spans of SPAN bytes; the recurrence runs over each span in both directions and gives every position its
own distribution over the languages. A text's distribution is the mean over all its positions. Training draws spans from the
whole texts of at most PER_LANGUAGE keys of each language, those of least key hash; every language is learned.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from orthobox.llm._rows import map_texts, raw, text_bytes
from orthobox.llm._shared import settled

SPAN = 64
HIDDEN = 8
PER_LANGUAGE = 400
#: Bytes of text that training takes from all languages together, but for one text of each.
SAMPLE_BYTES = 64 << 20
#: Chosen keys and languages are broadcast up to so many rows.
BROADCAST_ROWS = 300_000
PAD = 256
UNKNOWN = "und"

_ASCII_LETTERS = np.zeros(256, dtype=bool)
_ASCII_LETTERS[[*range(65, 91), *range(97, 123)]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """x: (2, 257, 3H) input to gates z, r and the candidate, per direction; u: (2, H, 3H) state to the same; v: (2, H, C)
    state to languages; c: (C,). A direction's state is h' = (1 - z) * tanh(x + r * (h u)) + z * h."""

    x: np.ndarray
    u: np.ndarray
    v: np.ndarray
    c: np.ndarray
    languages: list[str] = field(default_factory=list)

    @staticmethod
    def fresh(languages: Sequence[str], hidden: int = HIDDEN, seed: int = 7, dtype=np.float32) -> Network:
        r = np.random.default_rng(seed)
        n = len(languages)
        return Network(r.normal(0, 0.3, (2, 257, 3 * hidden)).astype(dtype), r.normal(0, 1 / np.sqrt(hidden), (2, hidden, 3 * hidden)).astype(dtype), r.normal(0, 0.3, (2, hidden, n)).astype(dtype), np.zeros(n, dtype), list(languages))

    def forward(self, codes: np.ndarray, keep: bool = False):
        """The logits (span, position, language) of codes (span, position); with keep, also what backward needs."""
        b, t = codes.shape
        hidden = self.u.shape[1]
        h = np.zeros((2, b, hidden), self.x.dtype)
        states = np.empty((t, 2, b, hidden), self.x.dtype)
        cache = []
        columns = np.ascontiguousarray(codes.T)
        for i in range(t):
            g = np.stack([self.x[0][columns[i]], self.x[1][columns[t - 1 - i]]])
            a = h @ self.u
            zr = _sigmoid(g[..., : 2 * hidden] + a[..., : 2 * hidden])
            z, r = zr[..., :hidden], zr[..., hidden:]
            n = np.tanh(g[..., 2 * hidden :] + r * a[..., 2 * hidden :])
            if keep:
                cache.append((h, z, r, n, a[..., 2 * hidden :]))
            h = n + z * (h - n)
            states[i] = h
        logits = states[:, 0].reshape(t * b, hidden) @ self.v[0] + states[::-1, 1].reshape(t * b, hidden) @ self.v[1] + self.c
        logits = logits.reshape(t, b, -1)
        return (logits, states, cache) if keep else logits

    def loss(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions that are no padding, and its gradient by x, u, v and c."""
        logits, states, cache = self.forward(codes, keep=True)
        t, b, n = logits.shape
        hidden = self.u.shape[1]
        real = (codes.T != PAD)[..., None]
        p = np.exp(logits - logits.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        total = max(1, int(real.sum()))
        value = float(-(np.log(np.maximum(p[:, np.arange(b), labels], 1e-30)) * real[..., 0]).sum() / total)
        d = p.copy()
        d[:, np.arange(b), labels] -= 1
        d *= real / self.x.dtype.type(total)
        gx, gu, gv = np.zeros_like(self.x), np.zeros_like(self.u), np.zeros_like(self.v)
        backwards = states[::-1, 1]
        gv[0] = states[:, 0].reshape(t * b, hidden).T @ d.reshape(t * b, n)
        gv[1] = backwards.reshape(t * b, hidden).T @ d.reshape(t * b, n)
        from_logits = np.stack([d @ self.v[0].T, (d @ self.v[1].T)[::-1]], axis=1)
        columns = codes.T
        dh = np.zeros((2, b, hidden), self.x.dtype)
        for i in reversed(range(t)):
            before, z, r, cand, a = cache[i]
            dh = dh + from_logits[i]
            dn = dh * (1 - z) * (1 - cand * cand)
            dz = dh * (before - cand) * z * (1 - z)
            dr = dn * a * r * (1 - r)
            dg = np.concatenate([dz, dr, dn], axis=-1)
            da = np.concatenate([dz, dr, dn * r], axis=-1)
            gu += before.transpose(0, 2, 1) @ da
            for k, at in ((0, columns[i]), (1, columns[t - 1 - i])):
                np.add.at(gx[k], at, dg[k])
            dh = dh * z + da @ self.u.transpose(0, 2, 1)
        return value, [gx, gu, gv, d.sum((0, 1))]

    def parameters(self) -> list[np.ndarray]:
        return [self.x, self.u, self.v, self.c]


def train(codes: np.ndarray, labels: np.ndarray, languages: Sequence[str], steps: int = 240, batch: int = 192, rate: float = 0.02, seed: int = 7) -> Network:
    """A network fitted to spans by Adam, each language as often as any other in a step."""
    net, r = Network.fresh(languages, seed=seed), np.random.default_rng(seed)
    by = [np.flatnonzero(labels == k) for k in range(len(languages))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, steps + 1):
        at = np.concatenate([r.choice(x, max(1, batch // len(by))) for x in by])
        _, grads = net.loss(codes[at], labels[at])
        scale = min(1.0, 1.0 / max(1e-12, float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads)))))
        now = rate * (1 - 0.9 * step / steps)
        for p, g, (m, v) in zip(net.parameters(), grads, moments):
            g = g * p.dtype.type(scale)
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
    return net


def spans(texts: pa.Array, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of all texts in rows of span codes, the last of a text padded, and each row's text."""
    data, offsets = raw(texts)
    sizes = np.diff(offsets)
    rows = -(-sizes // span)
    first = np.concatenate([[0], np.cumsum(rows)])
    out = np.full(int(first[-1]) * span, PAD, dtype=np.int16)
    of = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(data)) - offsets[of] + first[of] * span] = data
    return out.reshape(-1, span), np.repeat(np.arange(len(sizes)), rows)


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    data, offsets = raw(texts)
    out = np.diff(np.concatenate([[0], np.cumsum(_ASCII_LETTERS[data])])[offsets]) > 0
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = any(map(str.isalpha, texts[i].as_py().decode()))
    return out


def predict(net: Network, texts: pa.Array, rows_at_once: int = 2048) -> tuple[list[str], np.ndarray]:
    """The language and its pooled probability for each whole text; UNKNOWN and 0 where there is no letter."""
    if not net.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    codes, row = spans(texts)
    pooled = np.zeros((len(texts), len(net.languages)))
    for at in range(0, len(codes), rows_at_once):
        part = codes[at : at + rows_at_once]
        p = net.forward(part)
        p -= p.max(-1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(-1, keepdims=True)
        p *= (part.T != PAD)[..., None]
        np.add.at(pooled, row[at : at + rows_at_once], p.sum(0))
    letter = has_letter(texts)
    best = pooled.argmax(1)
    score = pooled[np.arange(len(texts)), best] / np.maximum(pooled.sum(1), 1e-30)
    return [net.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), letter.tolist())], np.where(letter, np.clip(score, 0, 1), 0.0)


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def fit(df: DataFrame, key: str, text: str, lang: str, training: Column, per_language: int = PER_LANGUAGE, most_bytes: int = SAMPLE_BYTES) -> Network:
    """A network from the rows for which training holds and language, key and text are not null.

    All languages of these rows are learned, each from the whole texts of at most per_language keys (of rows with one key and
    language one is taken, that of least text) and, but for each language's first text, most_bytes in all languages together,
    which is what reaches the driver. Without such rows, as for an empty table, the
    network knows none and all texts are UNKNOWN.
    """
    spark = df.sparkSession
    rows = df.filter(training & F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("l"), text_bytes(text).alias("t"))
    counts = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language
    if not counts:
        return Network.fresh([])
    # Of each language about twice the wanted keys pass by their hash, all if it has few, so no task sorts a large one.
    order = F.xxhash64(F.col("k").cast("string"), F.lit("sample"))
    share = [(r["l"], min(1.0, (2 * per_language + 100) / r["n"])) for r in counts]
    under = spark.createDataFrame([(l, min((1 << 63) - 1, int((s - 0.5) * 2.0**64))) for l, s in share], T.StructType([T.StructField("l", rows.schema["l"].dataType), T.StructField("under", T.LongType())]))
    passed = rows.select("k", "l", order.alias("h"), F.octet_length("t").cast("long").alias("b")).join(_few(under, len(counts)), "l").filter("h <= under").groupBy("k", "l", "h").agg(F.max("b").alias("b"))
    in_turn = Window.partitionBy("l").orderBy("h", "k")
    picked = settled(passed.withColumns({"place": F.row_number().over(in_turn), "before": F.coalesce(F.sum("b").over(in_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}).filter((F.col("place") <= per_language) & ((F.col("place") == 1) | (F.col("before") + F.col("b") <= most_bytes // len(counts)))).select("k", "l"))
    texts = rows.join(_few(picked, len(counts) * per_language), ["k", "l"]).groupBy("k", "l").agg(F.min("t").alias("t"))
    got = sorted((str(r["l"]), str(r["k"]), bytes(r["t"])) for r in texts.collect())  # at most per_language rows a language
    codes, row = spans(pa.array([t for _, _, t in got], pa.binary()))
    of = [l for l, _, _ in got]
    names = sorted({of[i] for i in np.unique(row).tolist()})
    number = {l: i for i, l in enumerate(names)}
    return train(codes, np.array([number.get(l, -1) for l in of], dtype=np.int64)[row], names) if names else Network.fresh([])


def label_texts(df: DataFrame, keep: Sequence[str], text: str, net: Network) -> DataFrame:
    """The kept columns with lang_pred and score of every whole text; null, empty and letterless texts are UNKNOWN, 0.

    Of languages with equal probability the first by name is taken; repeated rows get the same result each, and an empty table
    gives no rows. Where a kept column has one of the names, that of the result gets underscores at its end.

    A long text is read whole, in spans of 64 bytes.
    """

    def make() -> Callable:
        return lambda texts: predict(net, texts)

    return map_texts(df, keep, text, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)
