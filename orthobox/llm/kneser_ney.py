"""An interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted arrays that workers map.

Files of a model, in `buckets` parts each, in the cluster's shared folder:

- words, counts: the hashes of the distinct training tokens in order, and how often each occurs. A token's id is its place
  in all parts together. The start of a text has the id after the last.
- pairs, pair_counts, many, many_counts: the pairs of ids as sorted hashes, their counts up to 254, and the larger counts.
  A pair goes to the part of its first token's hash, or of its own hash if that token is so common that it would fill a part.
- followers (n, 3) and leaders (n,): for each id how many tokens follow it once, twice, and more; and how many precede it.

Tokens are counted first, so pairs travel as two small ids; counts are added up within a task before any is shuffled.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthobox.llm._files import map_array, write_array
from orthobox.llm._rows import CHUNK_BYTES, LOWER, Tables, map_texts, mixed, pieces, prefix_hashes, raw, small_batches, span_hashes, text_bytes, words
from orthobox.llm._shared import new_folder

#: The end of a text, as a token.
END = np.uint64(0x7F4A7C159E3779B9)
#: Tokens that a task counts before it passes them on.
FLUSH = 3_000_000
#: Bytes of text for which there is one bucket, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 4096
_BLOBS = "bucket int, kind int, blob binary"


def tokens(texts: pa.Array, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the lower-cased (A-Z) words of each text and of its end, and each one's text."""
    data, offsets = raw(texts)
    data = LOWER[data]
    starts, ends, row = words(data, offsets)
    h = span_hashes(data, prefix_hashes(data, tables), starts, ends, tables) if len(starts) else np.zeros(0, np.uint64)
    n = len(texts)
    last = np.cumsum(np.bincount(row, minlength=n) + 1) - 1
    out = np.full(len(h) + n, END)
    inner = np.ones(len(out), dtype=bool)
    inner[last] = False
    out[inner] = h
    rows = np.empty(len(out), np.int64)
    rows[inner] = row
    rows[last] = np.arange(n)
    return out, rows


def _summed(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and their summed counts."""
    if not len(key):
        return key, np.zeros(0, np.int64)
    if n is None:
        return np.unique(key, return_counts=True)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def _pack(*arrays: np.ndarray) -> bytes:
    """Unsigned integer arrays as bytes, each in the fewest planes of bytes that hold it, which compress well."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a, dtype="<u8")
        width = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T)
        out += [np.array([len(a), width], "<u8").tobytes(), planes.tobytes()]
    return b"".join(out)


def _unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        n, width = (int(x) for x in np.frombuffer(blob, "<u8", 2, at))
        at += 16
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
        out.append(a.view("<u8").ravel())
        at += n * width
    return out


def _part(h: np.ndarray, buckets: int) -> np.ndarray:
    """The part, in the hashes' order, of each hash."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _blobs(rows: Sequence[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "blob"])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, bytes]]]]:
    """The (kind, blob) of each bucket, of rows in the order of their bucket; they are read as they are asked for."""
    rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3))))
    for bucket, own in itertools.groupby(rows, key=lambda row: row[0]):
        yield bucket, (row[1:] for row in own)


def _merged(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of all parts in order and their summed counts.

    Parts are taken in until they are as long as the result so far, so that about twice the result is held, not all parts.
    """
    key, n, fresh, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
    for k, c in parts:
        fresh.append((k, c))
        size += len(k)
        if size >= max(FLUSH, len(key)):
            key, n = _summed(*(np.concatenate(x) for x in zip((key, n), *fresh)))
            fresh, size = [], 0
    return _summed(*(np.concatenate(x) for x in zip((key, n), *fresh))) if fresh else (key, n)


def _dealt(df: DataFrame, buckets: int) -> DataFrame:
    return df.repartition(buckets, "bucket").sortWithinPartitions("bucket")


@dataclass(frozen=True)
class Model:
    """Where a model's files are, and the numbers that belong to all of it. first[b]: the id of part b's first token."""

    folder: str
    buckets: int
    first: tuple[int, ...]
    total: int
    texts: int
    pair_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    spread: float = 1.0
    types: int = 0

    @property
    def distinct(self) -> int:
        return self.first[-1]


class Reader:
    """A model's arrays, mapped by a worker."""

    def __init__(self, model: Model):
        self.m = model
        self.open: dict[tuple[str, int], np.ndarray] = {}
        self.first = np.array(model.first, np.int64)
        self.limit = max(1, model.total // (4 * model.buckets))

    def array(self, name: str, part: int) -> np.ndarray:
        if (name, part) not in self.open:
            self.open[name, part] = map_array(f"{self.m.folder}/{name}-{part}")
        return self.open[name, part]

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id of each hash, -1 if it is unknown, and its count."""
        kinds, back = np.unique(h, return_inverse=True)
        ids, counts = np.full(len(kinds), -1, np.int64), np.zeros(len(kinds), np.int64)
        cuts = np.searchsorted(_part(kinds, self.m.buckets), np.arange(self.m.buckets + 1))
        for b in range(self.m.buckets):
            x = slice(cuts[b], cuts[b + 1])
            if cuts[b] == cuts[b + 1] or self.first[b] == self.first[b + 1]:
                continue
            known = self.array("words", b)
            at = np.minimum(np.searchsorted(known, kinds[x]), len(known) - 1)
            hit = known[at] == kinds[x]
            ids[x] = np.where(hit, at + self.first[b], -1)
            counts[x] = np.where(hit, self.array("counts", b)[at], 0)
        return ids[back], counts[back]

    def pair_part(self, u: np.ndarray, w: np.ndarray, of_u: np.ndarray) -> np.ndarray:
        """The part of each pair; of_u: how often u occurs as a first token."""
        alone = mixed(u.astype(np.uint64))
        return _part(np.where(of_u > self.limit, mixed(alone + w.astype(np.uint64)), alone), self.m.buckets)

    def pair_counts(self, u: np.ndarray, w: np.ndarray, of_u: np.ndarray) -> np.ndarray:
        """How often each pair of ids occurs."""
        key = u.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64)
        part = self.pair_part(u, w, of_u)
        order = np.lexsort((key, part))
        cuts = np.searchsorted(part[order], np.arange(self.m.buckets + 1))
        out = np.zeros(len(key), np.int64)
        for b in range(self.m.buckets):
            if cuts[b] == cuts[b + 1]:
                continue
            x = order[cuts[b] : cuts[b + 1]]
            known = self.array("pairs", b)
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, key[x]), len(known) - 1)
            n = np.where(known[at] == key[x], self.array("pair_counts", b)[at], 0).astype(np.int64)
            if (n == 255).any():
                many = np.searchsorted(self.array("many", b), at[n == 255])
                n[n == 255] = self.array("many_counts", b)[many]
            out[x] = n
        return out

    def dense(self, name: str, ids: np.ndarray) -> np.ndarray:
        """The values of an array that is parted by ids."""
        size = _range(self.m.distinct, self.m.buckets)
        part = ids // size
        out = np.zeros((len(ids), *self.array(name, 0).shape[1:]), np.float64)
        for b in np.unique(part).tolist():
            x = part == b
            out[x] = self.array(name, b)[ids[x] - b * size]
        return out


def _range(distinct: int, buckets: int) -> int:
    """Ids in each part of the arrays that are parted by ids, the start of a text included."""
    return -(-(distinct + 1) // buckets)


def discounts(n: Sequence[int]) -> tuple[float, float, float]:
    """What modified Kneser-Ney takes from counts of 1, 2 and more, of the numbers of counts 1, 2, 3 and 4."""
    if min(n[:3]) == 0:
        return (0.5, 1.0, 1.5)
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3))


def _taken(counts: np.ndarray, d: Sequence[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


def train(df: DataFrame, text: str, buckets: int | None = None) -> Model:
    """A model of all rows' whole texts, null ones as empty; repeated rows count as often as they occur, and an empty table
    gives a model that knows nothing. Its files stay in the shared folder.

    There are as many buckets as shuffle partitions, or one for BUCKET_BYTES of text if those are more, but no more than
    MOST_BUCKETS: a task holds one bucket, a scoring task maps six files of each, and a counting task sends at most one row to
    each whenever it has FLUSH tokens, so rows grow with the input's splits and not with their square.
    """
    spark = df.sparkSession
    small_batches(spark)
    folder = new_folder(spark, "bigrams")
    texts = df.select(text_bytes(text).alias("t"))
    if buckets is None:
        size = texts.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
        buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables()
        key, n, fresh, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def flushed(key, n):
            cuts = np.searchsorted(_part(key, buckets), np.arange(buckets + 1))
            return _blobs([(b, 0, _pack(key[x:y], n[x:y])) for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if x < y])

        for batch in batches:
            for piece in pieces(batch, 0, CHUNK_BYTES):
                fresh.append(tokens(piece.column(0), tables)[0])
                size += len(fresh[-1])
                if size >= FLUSH:
                    k, c = _summed(np.concatenate(fresh))
                    key, n = _summed(np.concatenate([key, k]), np.concatenate([n, c]))
                    fresh, size = [], 0
                    if len(key) >= FLUSH:
                        yield flushed(key, n)
                        key, n = key[:0], n[:0]
        if fresh:
            k, c = _summed(np.concatenate(fresh))
            key, n = _summed(np.concatenate([key, k]), np.concatenate([n, c]))
        if len(key):
            yield flushed(key, n)

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _by_bucket(batches):
            key, n = _merged((k, n.astype(np.int64)) for k, n in (_unpack(b) for _, b in held))
            write_array(f"{folder}/words-{bucket}", key)
            write_array(f"{folder}/counts-{bucket}", n.astype(np.uint32 if len(n) == 0 or n.max() < 1 << 32 else np.uint64))
            at = np.searchsorted(key, END)
            ends = int(n[at]) if at < len(key) and key[at] == END else 0
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (bucket, len(key), int(n.sum()), ends)], names=["bucket", "n", "total", "ends"])

    made = {r["bucket"]: r for r in _dealt(texts.mapInArrow(count_words, _BLOBS), buckets).mapInArrow(write_words, "bucket long, n long, total long, ends long").collect()}  # one row per bucket
    sizes = [made[b]["n"] if b in made else 0 for b in range(buckets)]
    model = Model(folder, buckets, tuple(np.concatenate([[0], np.cumsum(sizes)]).tolist()), sum(r["total"] for r in made.values()), sum(r["ends"] for r in made.values()))
    if not model.texts:
        return model
    if model.distinct >= 1 << 32:
        raise ValueError("more than 2**32 distinct tokens")

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, reader = Tables(), Reader(model)
        held, size = [], 0

        def flushed() -> pa.RecordBatch:
            key, n = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            u, w = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            part = reader.pair_part(u, w, _of(reader, u))
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                x = order[cuts[b] : cuts[b + 1]]
                if len(x):
                    first = np.flatnonzero(np.concatenate([[True], u[x][1:] != u[x][:-1]]))
                    rows.append((b, 0, _pack(np.diff(u[x][first], prepend=0), np.diff(np.append(first, len(x))), w[x], n[x])))
            return _blobs(rows)

        for batch in batches:
            for piece in pieces(batch, 0, CHUNK_BYTES):
                h, row = tokens(piece.column(0), tables)
                w = reader.ids(h)[0]
                u = np.empty_like(w)
                u[1:] = w[:-1]
                u[0] = model.distinct
                u[1:][row[1:] != row[:-1]] = model.distinct
                held.append(_summed(u.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64)))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield flushed()
                    held, size = [], 0
        if held:
            yield flushed()

    size = _range(model.distinct, buckets)

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _by_bucket(batches):
            unpacked = (_unpack(blob) for _, blob in held)
            key, n = _merged((np.repeat(np.cumsum(u), runs.astype(np.int64)) << np.uint64(32) | w, n.astype(np.int64)) for u, runs, w, n in unpacked)
            write_array(f"{folder}/pairs-{bucket}", key)
            write_array(f"{folder}/pair_counts-{bucket}", np.minimum(n, 255).astype(np.uint8))
            many = np.flatnonzero(n >= 255)
            write_array(f"{folder}/many-{bucket}", many)
            write_array(f"{folder}/many_counts-{bucket}", n[many])
            u, w = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            follow = [np.add.reduceat((n == 1).astype(np.int64), first), np.add.reduceat((n == 2).astype(np.int64), first), np.add.reduceat((n > 2).astype(np.int64), first)]
            u = u[first]
            w, lead = np.unique(w, return_counts=True)
            rows = [(0, 2, _pack(np.bincount(np.minimum(n, 5), minlength=6)))]
            for kind, ids, values in ((0, u, follow), (1, w, [lead])):
                cuts = np.searchsorted(ids // size, np.arange(buckets + 1))
                rows += [(b, kind, _pack(np.diff(ids[x:y], prepend=0), *(v[x:y] for v in values))) for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if x < y]
            yield _blobs(rows)

    def write_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _by_bucket(batches):
            follow, lead, of_counts = np.zeros((size, 3), np.uint32), np.zeros(size, np.uint32), np.zeros(6, np.int64)
            for kind, blob in held:
                got = [x.astype(np.int64) for x in _unpack(blob)]
                if kind == 2:
                    of_counts += got[0]
                    continue
                ids = np.cumsum(got[0]) - bucket * size
                if kind:
                    lead[ids] += got[1].astype(np.uint32)
                else:
                    for k in range(3):
                        follow[ids, k] += got[1 + k].astype(np.uint32)
            write_array(f"{folder}/followers-{bucket}", follow)
            write_array(f"{folder}/leaders-{bucket}", lead)
            of_lead = np.bincount(np.minimum(lead, 5), minlength=6)
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist()], pa.list_(pa.int64())) for x in (of_counts, of_lead)] + [pa.array([int(lead.sum())], pa.int64()), pa.array([bucket], pa.int64())], names=["pairs", "leads", "types", "bucket"])

    counted = _dealt(texts.mapInArrow(count_pairs, _BLOBS), buckets).mapInArrow(write_pairs, _BLOBS)
    done = _dealt(counted, buckets).mapInArrow(write_ids, "pairs array<long>, leads array<long>, types long, bucket long").collect()  # one row per bucket
    for b in set(range(buckets)) - {r["bucket"] for r in done}:
        write_array(f"{folder}/followers-{b}", np.zeros((size, 3), np.uint32))
        write_array(f"{folder}/leaders-{b}", np.zeros(size, np.uint32))
    of_pairs, of_leads = (np.sum([r[c] for r in done], axis=0) for c in ("pairs", "leads"))
    types, d = sum(r["types"] for r in done), discounts(of_leads[1:5].tolist())
    spread = float(d[0] * of_leads[1] + d[1] * of_leads[2] + d[2] * of_leads[3:].sum()) / types
    return Model(folder, buckets, model.first, model.total, model.texts, discounts(of_pairs[1:5].tolist()), d, spread, types)


def _of(reader: Reader, u: np.ndarray) -> np.ndarray:
    """How often each id is a first token: as often as it occurs, the start once per text. u is sorted."""
    m, out = reader.m, np.full(len(u), reader.m.texts, np.int64)
    cuts = np.searchsorted(u, np.array(m.first))
    for b, (x, y) in enumerate(zip(cuts, cuts[1:])):
        if x < y:
            out[x:y] = reader.array("counts", b)[u[x:y] - m.first[b]]
    return out


def score_tokens(reader: Reader, texts: pa.Array, tables: Tables) -> list[np.ndarray]:
    """Per text: tokens, known tokens, base score, and the model's log10 probability."""
    m = reader.m
    h, row = tokens(texts, tables)
    w, c = reader.ids(h)
    n = len(texts)
    base = np.log10((c + 0.1) / (m.total + 0.1 * (m.distinct + 1)))
    uniform = 1 / (m.distinct + 1)
    if m.texts:
        u, of_u = np.empty_like(w), np.empty_like(c)
        u[1:], of_u[1:] = w[:-1], c[:-1]
        start = np.concatenate([[True], row[1:] != row[:-1]])
        u[start], of_u[start] = m.distinct, m.texts
        key = np.where((u >= 0) & (w >= 0), u << 32 | np.maximum(w, 0), -1)
        kinds, at, back = np.unique(key, return_index=True, return_inverse=True)
        both = kinds >= 0
        counts = np.zeros(len(kinds), np.int64)
        counts[both] = reader.pair_counts(kinds[both] >> 32, kinds[both] & 0xFFFFFFFF, of_u[at[both]])
        counts = counts[back]
        ids, where = np.unique(np.concatenate([u, w]), return_inverse=True)
        real = ids >= 0
        lead, gamma = np.zeros(len(ids)), np.zeros(len(ids))
        lead[real] = reader.dense("leaders", ids[real])
        gamma[real] = reader.dense("followers", ids[real]) @ np.array(m.pair_discounts)
        lead = lead[where[len(u) :]]
        single = np.maximum(lead - _taken(lead, m.discounts), 0) / m.types + m.spread * uniform
        seen = (u >= 0) & (of_u > 0)
        times = np.where(seen, of_u, 1)
        p = np.where(seen, np.maximum(counts - _taken(counts, m.pair_discounts), 0) / times + np.where(seen, gamma[where[: len(u)]] / times, 1.0) * single, single)
    else:
        p = np.full(len(w), uniform)
    return [np.bincount(row, minlength=n), np.bincount(row[c > 0], minlength=n), np.bincount(row, weights=base, minlength=n), np.bincount(row, weights=np.log10(p), minlength=n)]


def score_texts(df: DataFrame, keep: Sequence[str], text: str, model: Model) -> DataFrame:
    """The kept columns with n_tokens, n_known, train_tokens, base_score, score and perplexity of every whole text.

    A null or empty text has one token, its end. Without training text every probability is 1. Repeated rows get the same
    result each, an empty table gives no rows. Where a kept column has one of the names, that of the result gets underscores.

    A long text is scored whole, by a task that handles it alone.
    """
    outputs = [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")] + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score", "perplexity")]

    def make():
        reader, tables = Reader(model), Tables()

        def work(texts: pa.Array):
            n, known, base, score = score_tokens(reader, texts, tables)
            return [n, known, np.full(len(n), model.total), base, score, 10 ** np.minimum(-score / n, 300)]

        return work

    return map_texts(df, keep, text, outputs, make)
