"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprints differing in at most tau of 64 bits are found through masks. The bits are dealt into partitions, bits that
vary together into the same one, and partition i gets a threshold t_i >= -1 with sum(t_i + 1) = tau + 1: two fingerprints
within tau then lie within t_i in some partition i. A partition with threshold t stands for the masks that hide t of its
bits, so such a pair is equal under one of the masks. The partitions' number and thresholds come from a dynamic program
over estimated candidate counts, from statistics of all fingerprints.

Fingerprints equal under a mask form a bucket. A bucket is searched by growing its components, so it yields fewer links
than members and never all pairs. Buckets over BUCKET members are dealt out again under finer masks, of the hidden bits'
own pigeonhole, until none is larger or a mask hides no more than tau bits, when all members are within tau.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthobox.llm._rows import map_texts
from orthobox.llm._shared import join_dealt, stored
from orthobox.llm.components import connected

BUCKET = 20_000
#: Rows of one fingerprint, and fingerprints of one component, from which they are dealt to several tasks.
HOT = 1_000_000
#: Cells of the sketch that estimates how many pairs a mask brings together.
CELLS = 4096
#: The cost of verifying one candidate pair, in units of dealing out one row.
PAIR_COST = 0.02
SEED = 42
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of each shingle of a text's lower-cased (A-Z) words, repeats included; of all words if there are fewer."""
    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    hashed = xxhash.xxh64_intdigest
    return [hashed(line[a:b], SEED) for a, b in zip([0, *(e + 1 for e in ends)], ends[width - 1 :])]


def fingerprints(texts: Sequence[bytes], width: int) -> np.ndarray:
    """The 64-bit SimHash of each text: a bit is 1 where over half of the hashes have it; 0 for no words. Repeated shingles
    count as often as they occur."""
    hashes = [shingle_hashes(t, width) for t in texts]
    counts = np.array([len(h) for h in hashes], dtype=np.int64)
    out = np.zeros(len(texts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        every = np.fromiter(itertools.chain.from_iterable(hashes), dtype="<u8", count=int(counts.sum()))
        bits = np.unpackbits(every.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        out[full] = ((2 * ones > counts[full, None]) * _BITS).sum(axis=1, dtype=np.uint64)
    return out


def fingerprint_texts(df: DataFrame, keep: Sequence[str], text: str, width: int = 3) -> DataFrame:
    """The kept columns and the fingerprint fp, a long with the same 64 bits. Null texts count as empty: 0."""

    def make():
        def work(texts: pa.Array):
            return [fingerprints(texts.to_pylist(), width).view(np.int64)]

        return work

    return map_texts(df, keep, text, [T.StructField("fp", T.LongType())], make)


def partitionings(most: int = 4) -> Iterator[int]:
    """The numbers of partitions that are weighed."""
    yield from range(1, most + 1)


def group_bits(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m partitions of the 64 bits, correlated ones together. together: how often bits i and j are both 1, of n rows."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(r, 0)
    left, parts = set(range(64)), []
    for k in range(m):
        room = len(left) // (m - k)
        part = [max(left, key=lambda b: (r[b, sorted(left)].sum(), -b))]
        left.remove(part[0])
        while len(part) < room:
            b = max(left, key=lambda b: (r[b, part].sum(), -b))
            part.append(b)
            left.remove(b)
        parts.append(sorted(part))
    return parts


def allocate(costs: Sequence[Sequence[float]], tau: int) -> tuple[float, list[int]]:
    """Thresholds of least summed cost with sum(t + 1) = tau + 1. costs[i][k]: partition i's cost at threshold k - 1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for k in range(min(len(row) - 1, tau + 1 - used) + 1):
                if (c := cost + row[k]) < nxt.get(used + k, (np.inf,))[0]:
                    nxt[used + k] = (c, [*ts, k - 1])
        best = nxt
    return best[tau + 1]


def masks_of(bits: Sequence[int], t: int) -> list[int]:
    """The masks that hide t of the bits: equal under one of them is within t in them."""
    return [] if t < 0 else [sum(1 << b for b in bits if b not in hidden) for hidden in map(set, itertools.combinations(bits, min(t, len(bits))))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _statistics(fps: DataFrame, plans: dict[int, list[list[int]]]) -> dict[tuple[int, int], float]:
    """For each partition (m, i), an estimate of the sum of squared counts of its values, by a signed-count sketch of all rows."""
    flat = [(m, i, np.uint64(sum(1 << b for b in bits))) for m, parts in plans.items() for i, bits in enumerate(parts)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from orthobox.llm._rows import mixed

        cells = np.zeros((len(flat), CELLS), dtype=np.int64)
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (_, _, mask) in enumerate(flat):
                h = mixed((x & mask) + np.uint64(k + 1))
                sign = (h >> np.uint64(63)).astype(np.int64) * 2 - 1
                cells[k] += np.bincount((h % np.uint64(CELLS)).astype(np.int64), weights=sign, minlength=CELLS).astype(np.int64)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(cells.ravel()[at], pa.int64())], names=["cell", "n"])

    summed = fps.select("fp").mapInArrow(sketch, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    per = summed.groupBy(F.floor(F.col("cell") / CELLS).cast("int").alias("k")).agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("f2")).collect()
    found = {row["k"]: row["f2"] for row in per}
    return {(m, i): found.get(k, 0.0) for k, (m, i, _) in enumerate(flat)}


def _together(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The rows' number and, for each two bits, how many rows have both."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((65, 64))
        for b in batches:
            x = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False))
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total[:64] += bits.T @ bits
            total[64, 0] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(65 * 64), pa.int64()), pa.array(total.ravel().astype(np.int64), pa.int64())], names=["cell", "n"])

    got = np.zeros(65 * 64)
    for row in fps.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # 4160 rows at most
        got[row["cell"]] = row["n"]
    return int(got[64 * 64]), got[: 64 * 64].reshape(64, 64)


def plan_masks(fps: DataFrame, tau: int) -> list[int]:
    """The masks of least estimated cost under which any two fingerprints within tau meet."""
    n, together = _together(fps)
    if n < 2:
        return []
    p = np.diag(together) / n
    odds = (2 * p * (1 - p)) / np.maximum(1 - 2 * p * (1 - p), 1e-9)
    plans = {m: group_bits(together, n, m) for m in partitionings()}
    f2 = _statistics(fps, plans)
    best: tuple[float, list[list[int]], list[int]] = (np.inf, [], [])
    for m, parts in plans.items():
        costs = []
        for i, bits in enumerate(parts):
            row = [0.0]
            for t in range(tau + 1):
                masks = int(np.prod([(len(bits) - k) / (k + 1) for k in range(t)]).round())
                near = [1.0] + [0.0] * t  # elementary symmetric sums of the odds: pairs that differ in 0 to t of the bits
                for b in bits:
                    for k in range(t, 0, -1):
                        near[k] += near[k - 1] * odds[b]
                row.append(n * masks + PAIR_COST * max(0.0, f2[m, i] - n) / 2 * sum(near) * masks / max(1, t + 1))
            costs.append(row)
        cost, ts = allocate(costs, tau)
        if cost < best[0]:
            best = (cost, parts, ts)
    return [x for bits, t in zip(best[1], best[2]) for x in masks_of(bits, t)]


def _bucket_links(fps: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join each component of a bucket's fingerprints: as many as its members less its components."""
    left = fps
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= tau
            if near.any():
                got, left = left[near], left[~near]
                yield np.full(len(got), x), got
                front += list(got)


def _links(batches: Iterator[pa.RecordBatch], tau: int) -> Iterator[pa.RecordBatch]:
    """Links of buckets that come in order of their key (mask, value); a bucket may go on over batches."""
    key = fps = None

    def done(key: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(fps)]])
        pairs = ends - starts == 2  # the commonest size, all at once
        x, y = fps[starts[pairs]], fps[starts[pairs] + 1]
        near = np.bitwise_count(x ^ y) <= tau
        a, b = [x[near]], [y[near]]
        for s, e in zip(*(z[ends - starts > 2].tolist() for z in (starts, ends))):
            for x, y in _bucket_links(fps[s:e], tau):
                a.append(x)
                b.append(y)
        once = np.unique(np.column_stack([np.concatenate(a), np.concatenate(b)]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(z).view(np.int64), pa.int64()) for z in once.T], names=["a", "b"])

    for batch in batches:
        k = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        f = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        key, fps = (k, f) if key is None else (np.concatenate([key, k]), np.concatenate([fps, f]))
        last = np.any(key != key[-1], axis=1) if len(key) else np.zeros(0, bool)
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if cut:
            yield from done(key[:cut], fps[:cut])
            key, fps = key[cut:], fps[cut:]
    if key is not None and len(key):
        yield from done(key, fps)


def _under(rows: DataFrame, masks: Column) -> DataFrame:
    return rows.select("fp", F.explode(masks).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")


def find_links(fps: DataFrame, tau: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links a, b that join all fingerprints (column fp, long, distinct) within tau bits of each other."""
    masks = plan_masks(fps, tau)
    spark = fps.sparkSession
    if not masks:
        return spark.createDataFrame([], "a long, b long")
    rows = _under(fps, F.array(*[F.lit(_signed(m)).cast("long") for m in masks]))
    links = None
    while True:
        can_be_finer = F.lit(64) - F.bit_count("mask") > tau  # else members are within tau: they stay together, none left out
        sizes = rows.filter(can_be_finer).groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket)
        large = stored(sizes.select("mask", "value"))
        hot = large.count()
        own = rows.join(large, ["mask", "value"], "left_anti") if hot else rows
        found = own.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp").mapInArrow(lambda it: _links(it, tau), "a long, b long")
        links = found if links is None else links.unionByName(found)
        if not hot:
            return links
        finer = {_signed(m): _finer(m, tau) for m in (row["mask"] & ((1 << 64) - 1) for row in large.select("mask").distinct().collect())}  # one row per mask of the plan
        table = spark.createDataFrame([(m, [_signed(x) for x in f]) for m, f in finer.items()], "mask long, finer array<long>")
        again = rows.join(large, ["mask", "value"], "left_semi").join(F.broadcast(table), "mask")
        rows = stored(_under(again.select("fp", "finer").distinct(), F.col("finer")).distinct())


def _finer(mask: int, tau: int) -> list[int]:
    """Masks that also show one of tau + 1 shares of the hidden bits, over tau of them: within tau in those is equal in some share."""
    hidden = [b for b in range(64) if not mask >> b & 1]
    return sorted({mask | sum(1 << b for b in hidden[i :: tau + 1]) for i in range(tau + 1)})


def near_duplicates(df: DataFrame, key: str, text: str, width: int = 3, tau: int = 3, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """One row per input row: key, fp (long) and component_id, the least key of the row's component.

    Two rows are linked if their fingerprints differ in at most tau bits; components are closed under links. Equal
    fingerprints are handled once, so copies cost no pairs. Null keys do not count for component_id, which is null only
    where a component has no other. Empty and null texts have fingerprint 0, and so are linked to each other. A bit that half
    of the hashes have is 0. No rows give no rows; other columns, whatever their names, are dropped.

    A long text is fingerprinted whole, by a task that handles it alone.
    """
    docs = stored(fingerprint_texts(df, [key], text, width))
    least = stored(docs.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n")))
    roots = connected(find_links(least.select("fp"), tau, bucket))
    labelled = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    classes = join_dealt(labelled, smallest.drop("n"), "root", smallest, hot).select("fp", "component_id")
    return join_dealt(docs, classes, "fp", least, hot).select(key, "fp", "component_id")
