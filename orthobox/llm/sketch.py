"""Threshold-scaled document sketches: every shingle hash below a fixed share of the hash range is kept.

The share is the same for all documents, so a sketch's size follows its document's. The sketch of two texts together is
the union of their sketches, and the share of one sketch found in another estimates containment even where one document
is a thousand times the other's size. A text of up to WHOLE different shingles keeps them all and is compared in full with
other such texts; beside a larger text only its hashes below the share count, and where it has none containment is unknown.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orthobox.llm._rows import CHUNK_BYTES, LOWER, Tables, map_texts, mixed, pieces, prefix_hashes, raw, small_batches, span_hashes, text_bytes, words

WIDTH = 5
SHARE = 1 / 4
#: Groups of neighbouring rows, at most: their bounds pass through the driver. A group is read as a stream.
GROUPS = 16_384
#: Different shingles up to which a text keeps the hashes of all.
WHOLE = 64


def shingles(texts: pa.Array, width: int, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each shingle of the lower-cased (A-Z) words of each text, and its text; all words if there are fewer."""
    data, offsets = raw(texts)
    data = LOWER[data]
    starts, ends, row = words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = span_hashes(data, prefix_hashes(data, tables), starts, ends, tables)
    first = np.searchsorted(row, np.arange(len(texts)))
    count = np.bincount(row, minlength=len(texts))
    place = np.arange(len(row)) - first[row]
    size = np.minimum(width, count[row])
    begins = place + size <= count[row]
    at, size = np.flatnonzero(begins), size[begins]
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(width):
        more = j < size
        out[more] = mixed(out[more] + word[at[more] + j] + np.uint64(j + 1))
    return out, row[at]


@dataclass(frozen=True)
class Sketch:
    """The hashes that a text keeps, sorted and without repeats; whole: whether they are all it has."""

    hashes: np.ndarray
    whole: bool

    def under(self, limit: np.uint64) -> np.ndarray:
        return self.hashes[: np.searchsorted(self.hashes, limit)]


def limit_of(share: float) -> np.uint64:
    """Kept hashes are below this."""
    return np.uint64(min((1 << 64) - 1, int(share * 2.0**64)))


def _sketch(hashes: np.ndarray, share: float) -> Sketch:
    """The sketch of a text, or of several together, that has these different hashes."""
    return Sketch(hashes, True) if len(hashes) <= WHOLE else Sketch(hashes[: np.searchsorted(hashes, limit_of(share))], False)


def sketches(texts: pa.Array, width: int, share: float, tables: Tables) -> list[Sketch]:
    """The sketch of each text."""
    h, row = shingles(texts, width, tables)
    n = len(texts)
    low = h < limit_of(share)
    under, of = _different(h[low], row[low])
    many = np.bincount(of, minlength=n) > WHOLE  # these have more shingles than that; of the others all are looked at
    rest, of_rest = _different(h[~many[row]], row[~many[row]])
    whole = np.split(rest, np.searchsorted(of_rest, np.arange(1, n)))
    return [_sketch(x, share) if not m else Sketch(y, False) for m, x, y in zip(many.tolist(), whole, np.split(under, np.searchsorted(of, np.arange(1, n))))]


def _different(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes in order and without repeats."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[fresh], row[fresh]


def _both(a: Sketch, b: Sketch, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each under the lower of both limits."""
    limit = limit_of(share)
    return (a.hashes, b.hashes) if a.whole and b.whole else (a.under(limit), b.under(limit))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many hashes two sorted arrays share."""
    return len(np.intersect1d(a, b, assume_unique=True)) if len(a) and len(b) else 0


def likeness(a: Sketch, b: Sketch, share: float = SHARE) -> float:
    """The Jaccard estimate: shared hashes of all under the lower limit. Two texts without shingles are alike; 0 where only
    one has any, and where neither has a hash under the limit."""
    x, y = _both(a, b, share)
    both = common(x, y)
    return both / (len(x) + len(y) - both) if len(x) or len(y) else float(not len(a.hashes) and not len(b.hashes))


def containment(a: Sketch, b: Sketch, share: float = SHARE) -> float | None:
    """The share of a's shingles that b has, as estimated by the share of its hashes under the lower limit; an empty a is
    contained, and where a has hashes but none under that limit nothing is known."""
    x, y = _both(a, b, share)
    if not len(x):
        return None if len(a.hashes) else 1.0
    return common(x, y) / len(x)


def merge(a: Sketch, b: Sketch, share: float = SHARE) -> Sketch:
    """The sketch of both texts' shingles together: the one that they would have as one set."""
    if a.whole and b.whole:
        return _sketch(np.union1d(a.hashes, b.hashes), share)
    limit = limit_of(share)
    return Sketch(np.union1d(a.under(limit), b.under(limit)), False)


def hexed(a: Sketch) -> str:
    """A sketch as text: + if it is whole, else -, and its hashes in order, 16 hex digits each."""
    return ("+" if a.whole else "-") + a.hashes.astype(">u8").tobytes().hex()


def sketch_texts(df: DataFrame, keep: Sequence[str], text: str, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """The kept columns, sketch (array of long, sorted as unsigned) and whole (whether it holds all of the text's hashes).

    Null and wordless texts have an empty, whole sketch; equal texts have equal ones; an empty table gives no rows. Where a kept
    column has one of the names, that of the result gets underscores at its end.
    """

    def make():
        tables = Tables()

        def work(texts: pa.Array):
            made = sketches(texts, width, share, tables)
            return [[x.hashes.view(np.int64) for x in made], [x.whole for x in made]]

        return work

    return map_texts(df, keep, text, [T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("whole", T.BooleanType())], make)


def deal_with_next(df: DataFrame, key: str, text: str, groups: int) -> DataFrame:
    """Columns group, tail, key, t: the rows in groups that follow each other by descending key, null keys last.

    A group's rows with tail 1 are those of the next group's greatest key (of the first group's after the last), so each
    row's successor in the whole order stands in its group. Ties go by the text's hash. Boundaries are keys, one per group;
    only they reach the driver. Texts are shuffled once, by the caller.
    """
    rows = df.select(F.col(key).alias("key"), text_bytes(text).alias("t"))
    spread = rows.select("key").filter("key is not null").repartitionByRange(groups, F.desc("key")).groupBy(F.spark_partition_id().alias("p")).agg(F.max("key").alias("top"))
    tops = sorted({r["top"] for r in spread.collect()})  # at most one per group
    if not tops:
        return rows.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("tail"), F.lit(0).alias("group"), "key", "t")
    n = len(tops)
    edges = np.array(tops)

    def place(keys: pd.Series) -> pd.Series:
        at = np.minimum(np.searchsorted(edges, keys.to_numpy()), n - 1)
        top, own = edges[at] == keys.to_numpy(), n - 1 - at
        return pd.Series([[g, (g - 1) % n] if t else [g] for g, t in zip(own.tolist(), top.tolist())])

    groups_ = F.when(F.col("key").isNull(), F.array(F.lit(n - 1))).otherwise(F.pandas_udf(place, "array<int>")(F.coalesce("key", F.lit(tops[0]))))
    return rows.select(F.posexplode(groups_).alias("tail", "group"), "key", "t").select("group", "tail", "key", "t")


def edited(text: str, following: str) -> str:
    """The text with its last third of code points replaced by as many first ones of the following text."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def compare_with_next(df: DataFrame, key: str, text: str, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """Each row's sketch beside those of its edited text and of the next row, by descending key (after the last, the first).

    Other columns, whatever their names, are dropped; no rows give no rows.

    Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint (sketches in hex), near_edited, near_next
    (Jaccard estimates) and in_edited (containment of the text in its edited form, null where it is unknown). Null texts count as empty, null keys
    come last, rows of one key follow each other in their texts' hash order; a single row is its own next.

    A long text is sketched whole, by a task that handles it alone. Ties of keys are stated above.
    """
    small_batches(df.sparkSession)
    parts = max(2, df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = deal_with_next(df, key, text, min(GROUPS, 4 * parts)).withColumn("h", F.xxhash64("t"))
    order = [F.asc("group"), F.asc("tail"), F.desc_nulls_last("key"), F.asc("h")]
    dealt = dealt.repartition(parts, "group").sortWithinPartitions(*order).select("group", "tail", "key", "t")
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next", "in_edited")]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables()
        last = None  # (group, tail, key, text, sketch) of the row before, which waits for its next

        for batch in batches:
            for piece in pieces(batch, 3, CHUNK_BYTES):
                groups, tails, keys, texts = (piece.column(i).to_pylist() for i in range(4))
                texts = [t.decode() for t in texts]
                own = sketches(piece.column(3), width, share, tables)
                rows = [last] * (last is not None) + list(zip(groups, tails, keys, texts, own))
                pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[1]]
                last = rows[-1]
                if not pairs:
                    continue
                new = [edited(a[3], b[3]).encode() for a, b in pairs]
                made = sketches(pa.array(new, pa.binary()), width, share, tables)
                yield pa.RecordBatch.from_arrays([
                    pa.array([a[2] for a, _ in pairs], arrow.field(0).type), pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in new]), pa.array([hexed(a[4]) for a, _ in pairs]), pa.array([hexed(x) for x in made]),
                    pa.array([likeness(a[4], x, share) for (a, _), x in zip(pairs, made)], pa.float64()), pa.array([likeness(a[4], b[4], share) for a, b in pairs], pa.float64()), pa.array([containment(a[4], x, share) for (a, _), x in zip(pairs, made)], pa.float64()),
                ], names=arrow.names)

    return dealt.mapInArrow(run, schema)
