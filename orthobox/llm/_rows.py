"""Per-document work in Arrow batches, and vectorised handling of the bytes of many texts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Text bytes handled at once by a Python worker; longer single texts are handled alone.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch of texts, about.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: ASCII lower-casing, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of a span beyond which its polynomial is not trusted.
LONG = 256

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def text_bytes(column: str):
    """The column's text as UTF-8 bytes, null as no bytes."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).cast("binary")


def small_batches(spark: SparkSession) -> None:
    """Lets a Python worker get texts in batches of about BATCH_BYTES, unless the session has a limit of its own."""
    if spark.conf.get(_BATCH, None) in (None, "64MB", "67108864", "67108864b"):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def free_name(name: str, taken: Sequence[str]) -> str:
    """The name, with as many underscores at its end as it takes to differ from the others whatever their case."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def map_texts(df: DataFrame, keep: Sequence[str], text: str, outputs: Sequence[T.StructField], make: Callable[[], Callable[[pa.BinaryArray], Sequence]], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The kept columns and, for each row, what make()(texts) returns: a sequence of values per output field.

    make runs once in each task. The text column reaches it as UTF-8 bytes without nulls, in pieces of about chunk_bytes,
    so a worker holds one piece and not a whole Arrow batch's intermediate results. A text column that is kept crosses to
    the worker once. Other input columns are not read, whatever they are called. An output with the name of a kept column
    gets underscores at its end.
    """
    small_batches(df.sparkSession)
    kept = [df.schema[c] for c in keep]
    taken = [*keep]
    named = []
    for f in outputs:
        named.append(T.StructField(free_name(f.name, taken), f.dataType))
        taken.append(named[-1].name)
    schema = T.StructType([*kept, *named])
    names = [f.name for f in schema.fields]
    n = len(kept)
    arrow = to_arrow_schema(schema)
    of = list(keep).index(text) if text in keep and isinstance(df.schema[text].dataType, T.StringType) else n
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], *[text_bytes(text).alias("t")] * (of == n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece in pieces(batch, of, chunk_bytes):
                made = work(as_bytes(piece.column(of)))
                columns = [piece.column(i).cast(arrow.field(i).type) for i in range(n)]
                columns += [v if isinstance(v, pa.Array) else pa.array(v, type=arrow.field(n + i).type) for i, v in enumerate(made)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema)


def as_bytes(texts: pa.Array) -> pa.Array:
    """A column of strings or bytes as bytes without nulls."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_binary(texts.type) or pa.types.is_large_string(texts.type)
    return texts.cast(pa.large_binary() if wide else pa.binary())


def pieces(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about limit bytes together."""
    if not batch.num_rows:
        return
    _, offsets = raw(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        stop = min(stop, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array, and where each value starts and ends in them: n + 1 offsets."""
    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    _, at, data = array.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    everything = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return everything[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * _ODD
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


#: A random-looking odd word for each byte value, so that hashes do not depend on bytes' numeric closeness.
BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The hash base's first n powers, or those of its inverse modulo 2**64."""
    out = np.full(n, _BASE_INVERSE if inverse else _BASE, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Tables:
    """Powers of the hash base, grown on demand and kept for a task."""

    def __init__(self):
        self.up, self.down = powers(0), powers(0, True)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = powers(n), powers(n, True)


def prefix_hashes(data: np.ndarray, tables: Tables) -> np.ndarray:
    """Running polynomial sums; (p[e] - p[s]) * down[s] is the polynomial of data[s:e], equal wherever the bytes stand."""
    tables.need(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[data] * tables.up[: len(data)], out=out[1:])
    return out


def span_hashes(data: np.ndarray, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, tables: Tables) -> np.ndarray:
    """A well-mixed 64-bit hash of each data[start:end].

    Polynomials modulo 2**64 are equal for some long strings that repeat themselves, whatever the base: spans of over LONG
    bytes get a cryptographic hash instead.
    """
    out = mixed((prefix[ends] - prefix[starts]) * tables.down[starts] + (ends - starts).astype(np.uint64) * _ODD)
    long = np.flatnonzero(ends - starts > LONG)
    if len(long):
        out[long] = digests(data, starts[long], ends[long])
    return out


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of the BLAKE2 hash of each data[start:end]."""
    whole, digest = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    return np.frombuffer(b"".join([digest(whole[s:e], digest_size=8).digest() for s, e in zip(starts.tolist(), ends.tolist())]), "<u8")


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside space and 09-0D, which never cross texts, and each one's text."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~_SPACE[data]
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    inner = offsets[1:-1]
    before[inner[inner < len(data)]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[inner[(inner > 0)] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1
