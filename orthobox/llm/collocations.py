"""Phrases by PCY and DHP hashing: bucket counts of the next length prune it before it is counted exactly.

Pass n counts all n-grams exactly that can be frequent, and at the same time counts all (n + 1)-grams that can be, by hash
bucket. An n-gram can be frequent if its two (n - 1)-grams are (Apriori) and its bucket is. Both tests are bitmaps of a fixed
size, broadcast to the tasks of the next pass: they pass too much now and then, and never too little, as counts in a bucket
only add up. Counts themselves are of the words, not of hashes: within a batch n-grams are told apart by their words' numbers,
between batches by their text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orthobox.llm._rows import LOWER, as_bytes, mixed, pieces, raw, small_batches, text_bytes
from orthobox.llm._shared import stored

SEED = 7
#: Bytes of text per bucket, and bounds of the number of buckets (as powers of two): a bitmap takes 2 KB to 8 MB.
BYTES_PER_BUCKET, LEAST_BITS, MOST_BITS = 64, 14, 26
#: Bytes of text that a task handles at once; a longer text is handled in shares that end with a piece.
PIECE_BYTES = 1 << 21
#: Counts that a task gathers before it adds those of one phrase up.
AT_ONCE = 1_000_000
#: Buckets that travel together.
BLOCK = 1 << 14
_END, _BLANK = (np.zeros(256, bool) for _ in range(2))
_ENDS = [bytes([c]) for c in b".,;:!?\n\x0b\x0c\r"]
_END[[c[0] for c in _ENDS]] = True
_BLANK[[0x20, 0x09]] = True
_COUNTED = "lang string, phrase string, n long, block int, cells binary"
_EMPTY = {"lang": pa.string(), "phrase": pa.string(), "n": pa.int64(), "block": pa.int32(), "cells": pa.binary()}


def _hash(x: bytes) -> int:
    return xxhash.xxh64_intdigest(x, SEED)


def _start(langs: Sequence[str]) -> np.ndarray:
    return mixed(np.array([_hash(x.encode()) for x in langs], np.uint64))


def _chain(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from that of its first words and that of its last."""
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + word)


class Words:
    """The words of some texts: their languages, numbers within the batch, hashes, and how many follow each in its piece."""

    def __init__(self, texts: pa.Array, langs: Sequence[str]):
        data, offsets = raw(texts)
        data = LOWER[data]
        end = _END[data]
        solid = ~(end | _BLANK[data])
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1 : len(data)]
        stops = solid.copy()
        stops[:-1] &= ~solid[1:] | edge[1 : len(data)]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.data = data
        doc = np.searchsorted(offsets, self.starts, side="right") - 1
        piece = np.cumsum(end)[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        same = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])  # a word and the next one
        self.left = np.ones(len(self.starts), np.int8)
        for _ in range(3):
            self.left[:-1][same] = np.minimum(self.left[1:][same] + 1, 4)
        at = np.empty(2 * len(self.starts) + 1, np.int64)  # words and what is between them, by turns
        at[0:-1:2], at[1::2] = self.starts, self.ends
        at[-1] = len(data)
        both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
        coded = both.take(pa.array(np.arange(0, len(at) - 1, 2))).dictionary_encode()
        self.names = coded.dictionary.to_pylist()
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known: dict[str, int] = {}
        of_doc = np.array([known.setdefault(x, len(known)) for x in langs], np.int64)
        self.langs = [*known]
        self.lang = of_doc[doc] if len(doc) else np.zeros(0, np.int64)
        self.word = self.lang * len(self.names) + number
        self.hash = np.array([_hash(x) for x in self.names], np.uint64)[number] if len(number) else np.zeros(0, np.uint64)
        self.first = _chain(_start(self.langs)[self.lang], self.hash) if len(number) else np.zeros(0, np.uint64)

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n-grams that begin at some words."""
        out = self.first[at]
        for k in range(1, n):
            out = _chain(out, self.hash[at + k])
        return out

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[at : at + n], self.ends[at : at + n]))

    def counted(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """A place and the count of each different n-gram among those at some words."""
        key = self.word[at]
        for k in range(1, n):
            if k > 1:
                key = np.unique(key, return_inverse=True)[1]
            key = key << 32 | self.word[at + k] % len(self.names) if len(key) else key
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        return at[first], counts


class Bitmap:
    """A set of hashes that has every member, and now and then others."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = bucket(hashes, self.bits)
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


class Pass:
    """Counts of all n-grams that can be frequent, and of the buckets of (n + 1)-grams."""

    def __init__(self, n: int, support: int, bits: int, shorter: Bitmap | None, buckets: Bitmap | None, longest: int):
        self.n, self.support, self.bits, self.shorter, self.buckets = n, support, bits, shorter, buckets
        self.cells = np.zeros(1 << bits, np.min_scalar_type(support)) if n < longest else None

    def places(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Where n-grams that can be frequent begin, and where two of them do that make an (n + 1)-gram."""
        n = self.n
        at = np.flatnonzero(words.left >= n)
        if n == 1:
            return at, at[words.left[at] > 1]
        some = np.zeros(len(words.left) + 1, bool)
        shorter = np.flatnonzero(words.left >= n - 1)
        some[shorter] = self.shorter.has(words.hashes(shorter, n - 1))
        at = at[some[at] & some[at + 1]]
        at = at[self.buckets.has(words.hashes(at, n))]
        can = np.zeros(len(words.left) + 1, bool)
        can[at] = True
        return at, at[can[at + 1] & (words.left[at] > n)]

    def add(self, words: Words) -> pa.RecordBatch:
        at, longer = self.places(words)
        if self.cells is not None and len(longer):
            own, n = np.unique(bucket(words.hashes(longer, self.n + 1), self.bits), return_counts=True)
            self.cells[own] = np.minimum(self.cells[own] + n, self.support)
        first, n = words.counted(at, self.n)
        columns = {"lang": [words.langs[i] for i in words.lang[first]], "phrase": [words.phrase(i, self.n) for i in first.tolist()], "n": n}
        return _rows(columns)

    def summed(self) -> Iterator[pa.RecordBatch]:
        """The buckets' counts, none over the support, in blocks."""
        size = min(BLOCK, 1 << self.bits)
        for block in range((1 << self.bits) // size) if self.cells is not None else ():
            own = self.cells[block * size : (block + 1) * size]
            if own.any():
                yield _rows({"block": [block], "cells": [own.tobytes()]})


def shares(text: bytes, most: int) -> Iterator[bytes]:
    """The text in shares that end with a piece, each of no more bytes unless a piece is longer: no phrase is cut."""
    start = 0
    while start < len(text):
        stop = start + most
        if stop < len(text):
            stop = 1 + max(text.rfind(c, start, stop) for c in _ENDS)
            if not stop:
                stop = min((x + 1 for x in (text.find(c, start + most) for c in _ENDS) if x >= 0), default=len(text))
        yield text[start:stop]
        start = stop


def _rows(columns: dict) -> pa.RecordBatch:
    n = max(map(len, columns.values()))
    arrays = []
    for name, kind in _EMPTY.items():
        if name not in columns:
            arrays.append(pa.nulls(n, kind))
        elif name == "phrase":
            arrays.append(pa.array(columns[name], pa.binary()).cast(pa.string()))
        else:
            arrays.append(pa.array(columns[name], kind))
    return pa.RecordBatch.from_arrays(arrays, names=[*_EMPTY])


def _added(batches: Sequence[pa.RecordBatch | pa.Table]) -> pa.Table:
    """The counts of all batches, one row per phrase."""
    table = pa.concat_tables([(x if isinstance(x, pa.Table) else pa.Table.from_batches([x])).select(["lang", "phrase", "n"]) for x in batches])
    return table.group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})


def _pieces_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in table.to_batches(max_chunksize=100_000):
        yield pa.RecordBatch.from_arrays([batch.column(k) if k in batch.schema.names else pa.nulls(batch.num_rows, kind) for k, kind in _EMPTY.items()], names=[*_EMPTY])


def _count(texts: DataFrame, make) -> DataFrame:
    piece_bytes, at_once = PIECE_BYTES, AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, merged = make(), [], 0
        for batch in batches:
            for piece in pieces(batch, 1, piece_bytes):
                texts, langs = as_bytes(piece.column(1)), piece.column(0).to_pylist()
                parts = [texts] if piece.num_rows > 1 or len(texts[0].as_py()) <= piece_bytes else (pa.array([x], pa.binary()) for x in shares(texts[0].as_py(), piece_bytes))
                for part in parts:
                    held.append(own.add(Words(part, langs)))
                    if sum(x.num_rows for x in held) - merged >= at_once:
                        held = [_added(held)]
                        merged = held[0].num_rows
                        if merged >= at_once:
                            yield from _pieces_of(held[0])
                            held, merged = [], 0
        if held:
            yield from _pieces_of(_added(held))
        yield from own.summed()

    return stored(texts.mapInArrow(run, _COUNTED))


def _frequent_buckets(counted: DataFrame, bits: int, support: int) -> Bitmap:
    """The buckets with at least the support: 2 ** bits bits, 8 MB at most, through the driver."""
    kind, size = np.min_scalar_type(support), min(BLOCK, 1 << bits)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, cells = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(cells >= support, bitorder="little").tobytes()], pa.binary())], names=["block", "cells"])

        for b in batches:
            for x, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if x != block:
                    if block is not None:
                        yield done()
                    block, cells = x, np.zeros(size, np.int64)
                cells = np.minimum(cells + np.frombuffer(own, kind), support)
        if block is not None:
            yield done()

    return _bitmap(counted.filter("block is not null").select("block", "cells").repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, cells binary"), bits)


def _members(frequent: DataFrame, bits: int) -> Bitmap:
    """The bitmap of phrases (lang, phrase)."""
    size = min(BLOCK, 1 << bits)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, split = b.column(0).to_pylist(), [x.split(b" ") for x in b.column(1).cast(pa.binary()).to_pylist()]
            if not split:
                continue
            out = _start(langs)
            for k in range(len(split[0])):
                out = _chain(out, np.array([_hash(x[k]) for x in split], np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(bucket(out, bits))], names=["at"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy()
            for block in np.unique(at // size).tolist():
                cells = np.zeros(size, bool)
                cells[at[at // size == block] % size] = True
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(cells, bitorder="little").tobytes()], pa.binary())], names=["block", "cells"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, cells = None, None
        for b in batches:
            for x, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if x != block and block is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["block", "cells"])
                cells = np.frombuffer(own, np.uint8) | (cells if x == block else 0)
                block = x
        if block is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["block", "cells"])

    at = frequent.select("lang", "phrase").mapInArrow(place, "at long").distinct().sortWithinPartitions("at").mapInArrow(pack, "block int, cells binary")
    return _bitmap(at.repartition("block").sortWithinPartitions("block").mapInArrow(either, "block int, cells binary"), bits)


def _bitmap(blocks: DataFrame, bits: int) -> Bitmap:
    size = min(BLOCK, 1 << bits) // 8
    packed = np.zeros((1 << bits) // 8, np.uint8)
    for row in blocks.collect():  # 2 ** bits / BLOCK rows at most, 8 MB
        packed[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["cells"], np.uint8)
    return Bitmap(bits, packed)


def _score(a: Column, both: Column) -> Column:
    """floor(2000000 a / both) without rounding."""
    return F.expr(f"cast(2000000 as decimal(10,0)) * cast({a} as decimal(20,0)) div cast({both} as decimal(21,0))")


def bits_for(text_bytes: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (text_bytes // BYTES_PER_BUCKET).bit_length()))


def mine_phrases(df: DataFrame, text: str, lang: str, support: int = 30, longest: int = 4, top: int = 2000, bits: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best `top` phrases of two to `longest` (4 at most) words.

    Texts are lower-cased (A-Z) and cut at `.,;:!?` and line ends into pieces, and those at spaces and tabs into words. A phrase
    of at least `support` occurrences within pieces is a candidate. Its score is the least over its cuts of 2000000 a / (l + r),
    rounded down; ties go to the first cut. Candidates within longer ones of at least 0.8 of their count go. Ties in score go
    by a, then by the phrase's bytes. A null language is `und`. Null and empty texts have no words; repeated rows count each
    time; an empty table gives an empty one. Long texts are
    handled in shares. Other columns are not read.
    """
    spark = df.sparkSession
    small_batches(spark)
    texts = df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), text_bytes(text).alias("t"))
    bits = bits or bits_for(texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0)
    shorter = buckets = None
    frequent, totals = [], None
    for n in range(1, longest + 1):
        sent = spark.sparkContext.broadcast((shorter, buckets))
        counted = _count(texts, lambda n=n, sent=sent: Pass(n, support, bits, *sent.value, longest))
        sums = counted.filter("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
        if n == 1:
            totals = counted.filter("phrase is not null").groupBy("lang").agg(F.sum("n").alias("n"))
        frequent.append(stored(sums.filter(F.col("a") >= support)))
        if n < longest:
            shorter, buckets = _members(frequent[-1], bits), _frequent_buckets(counted, bits, support)
    known = frequent[0]
    for f in frequent[1:]:
        known = known.unionByName(f)
    candidates = frequent[1].withColumn("m", F.lit(2))
    for m, f in enumerate(frequent[2:], 3):
        candidates = candidates.unionByName(f.withColumn("m", F.lit(m)))
    candidates = candidates.withColumn("w", F.split("phrase", " "))

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("m") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))
    within = candidates.filter("m > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    stay = candidates.join(within, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.lit(100) * F.col("longer").cast("decimal(20,0)") < F.lit(80) * F.col("a").cast("decimal(20,0)"))).drop("longer")

    cuts = stay.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.withColumns({"head": F.array_join(F.slice("w", F.lit(1), F.col("k")), " "), "tail": F.array_join(F.slice("w", F.col("k") + 1, F.col("m")), " ")}).drop("w", "m")
    parts = known.withColumnRenamed("a", "count")
    cuts = cuts.join(parts.select(F.col("lang"), F.col("phrase").alias("head"), F.col("count").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select(F.col("lang"), F.col("phrase").alias("tail"), F.col("count").alias("r")), ["lang", "tail"])
    cuts = cuts.withColumn("both", F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)")).withColumn("score", _score("a", "both"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.a", "b.l", "b.r", "b.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
