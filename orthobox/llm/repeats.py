"""Repeated byte strings by a depth-limited radix sort of suffixes.

Every byte starts a suffix, and suffixes are told apart only through their first `depth` bytes (a window): most
significant digits first, groups of one dropped after every pass, so that groups left at the end are exactly the repeated
windows. All but the first of each, by (document, start), have their bytes removed.

The first digit deals the suffixes out. It is the window's anchor: of its grams of GRAM bytes the one of least hash, the
leftmost of equals. Equal windows have equal anchors at equal offsets. Neighbouring windows mostly share an anchor, so one
row per run of such windows is shuffled, about one for 35 bytes, with a hash of the run's region, all the bytes its windows
cover. Runs whose region stands earlier too are repeats as a whole; this is found within a task's piece before the shuffle
and across pieces after it, in a sorted stream. Only the first runs of grams with several different regions go on to the
passes over their bytes. Of grams with over GROUP regions the windows are dealt out once more, in BANDS bands by the bytes that
all windows of a band have; only bands with too many regions still are sorted in parts, whose first windows meet in one more step.
Grams that a sample shows to fill tasks, as those of a common line do, are dealt by region too, so that no task gets all runs
of one; the sample decides only where rows go. Regions, and the windows of grams sorted in parts, are equal by 64 bits of a
cryptographic hash, within runs whose grams' hashes are equal: of n different runs of one gram n^2 / 2^65 pairs are expected
to be taken for equal (3 * 10^-8 for a million runs, 0.03 for 10^9 of one gram); no texts that do so can be constructed
without a search of 2^32 steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orthobox.llm._rows import Tables, digests, mixed, pieces, prefix_hashes, raw, small_batches, text_bytes
from orthobox.llm._shared import free_shuffles, settled
from orthobox.shared import with_rank

DEPTH = 100
GRAM = 32
GROUP = 2048
#: Bands of the windows around a hot gram: an eighth of a run's windows, so groups of bands may have as many times the rows.
BANDS = 8
#: A gram is hot if one row of so many, by a sample of 1 / SAMPLE of the documents, has it: its runs are dealt to several tasks.
SAMPLE = 64
LEAST_HOT = 16
CHUNK = 2 << 20
#: Windows sorted at once.
AT_ONCE = 400_000


def runs(data: np.ndarray, offsets: np.ndarray, depth: int, gram: int, tables: Tables) -> tuple[np.ndarray, ...]:
    """For each run of windows with one anchor: the anchor's hash, the region's, its text, first and last start, anchor."""
    n = len(data)
    if n < depth:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 4
    prefix = prefix_hashes(data, tables)
    grams = mixed((prefix[gram:] - prefix[:-gram]) * tables.down[: n - gram + 1])
    least = (grams >> np.uint64(32)).astype(np.uint32)
    at = np.arange(len(least), dtype=np.int32 if n < 1 << 31 else np.int64)
    size, width = 1, depth - gram + 1
    while size < width:
        step = min(size, width - size)
        less = least[step:] < least[:-step]
        at = np.where(less, at[step:], at[:-step])
        least = np.where(less, least[step:], least[:-step])
        size += step
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    start = np.flatnonzero(row[: n - depth + 1] == row[depth - 1 :])
    at = at[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    s0, s1, a = start[first], start[np.concatenate([first[1:], [len(start)]]) - 1] if len(first) else first, at[first].astype(np.int64)
    region = mixed(digests(data, s0, s1 + depth) + (a - s0).astype(np.uint64))
    return grams[a], region, row[s0].astype(np.int64), s0, s1, a


def _packed(start: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A run within its text as one long: first start, then bytes from there to the anchor and to the last start."""
    return start << 24 | lo << 12 | hi


def _unpacked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return x >> 24, x >> 12 & 0xFFF, x & 0xFFF


def merged(start: np.ndarray, end: np.ndarray, *of: np.ndarray) -> tuple[np.ndarray, ...]:
    """The spans of each owner (`of`, any number of arrays) joined where they touch: start, end and owner."""
    if not len(start):
        return (start, end, *of)
    order = np.lexsort((start, *of[::-1]))
    start, end, of = start[order], end[order], tuple(x[order] for x in of)
    fresh = np.ones(len(start), dtype=bool)
    same = np.logical_and.reduce([x[1:] == x[:-1] for x in of]) if of else np.ones(len(start) - 1, bool)
    owner = np.concatenate([[0], np.cumsum(~same)])
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + owner * far)
    fresh[1:] = ~same | (start[1:] + owner[1:] * far > reach[:-1])
    at = np.flatnonzero(fresh)
    ends = reach[np.concatenate([at[1:], [len(start)]]) - 1] - owner[at] * far
    return (start[at], ends, *(x[at] for x in of))


def _first_of(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Of rows in the given order, whether each is the first with its keys."""
    first = np.ones(len(order), dtype=bool)
    if len(order):
        first[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return first


_ROWS = "gram long, region long, doc long, run long"
_FOUND = "kind int, doc long, gram long, part long, a long, b long"


def _local_runs(batches: Iterator[pa.RecordBatch], depth: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Runs of all texts; of those with one region in a piece the first, and the others as removed spans (region null)."""
    tables = Tables()
    for batch in batches:
        for piece in pieces(batch, 1, CHUNK):
            doc = piece.column(0).to_numpy(zero_copy_only=False)
            data, offsets = raw(piece.column(1))
            g, region, row, s0, s1, a = runs(data, offsets, depth, gram, tables)
            if not len(g):
                continue
            base = offsets[row]
            order = np.lexsort((s0, doc[row], region, g))
            first = _first_of(order, g, region)
            keep, drop = np.sort(order[first]), order[~first]
            start, end, of = merged((s0 - base)[drop], (s1 - base)[drop] + depth, doc[row][drop])
            columns = [
                np.concatenate([g[keep].view(np.int64), mixed(of.astype(np.uint64)).view(np.int64)]),
                pa.array(np.concatenate([region[keep].view(np.int64), end]), pa.int64()),
                np.concatenate([doc[row][keep], of]),
                np.concatenate([_packed((s0 - base)[keep], (a - s0)[keep], (s1 - s0)[keep]), -1 - start]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["gram", "region", "doc", "run"])


def _sorted_runs(batches: Iterator[pa.RecordBatch], depth: int, group: int) -> Iterator[pa.RecordBatch]:
    """Over runs by (gram, share, region, doc, run): removed spans (kind 0: a to b), and the first run of each region of
    grams with several, or with several shares (kind 1: a the run, part the share and the number of regions of the gram and
    share before it, by group). The share of a gram that has only one is 0, that of others 1 or more."""
    gram = region = None
    held = None  # the first region's run of a gram of which no second has come yet
    count = 0
    for batch in batches:
        g, r, doc, run, share = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        span = run < 0
        out = [np.zeros(int(span.sum()), np.int64), doc[span], g[span], np.zeros(int(span.sum()), np.int64), -1 - run[span], r[span]]
        g, r, doc, run, share = g[~span], r[~span], doc[~span], run[~span], share[~span]
        if len(g):
            new_gram, new = np.ones(len(g), bool), np.ones(len(g), bool)
            new_gram[1:] = (g[1:] != g[:-1]) | (share[1:] != share[:-1])
            new_gram[0] = gram != (g[0], share[0])
            new[1:] = new_gram[1:] | (r[1:] != r[:-1])
            new[0] = new_gram[0] or r[0] != region
            again = ~new
            s, _, hi = _unpacked(run[again])
            a, b, of = merged(s, s + hi + depth, doc[again])
            kinds = [out, [np.zeros(len(a), np.int64), of, np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), a, b]]
            at = np.flatnonzero(new)
            starts = np.flatnonzero(new_gram[at])
            before = 0 if gram is None else count  # regions so far of the gram that goes on
            lead = starts[0] if len(starts) else len(at)
            number = np.empty(len(at), np.int64)
            number[:lead] = before + np.arange(lead)
            block = np.repeat(starts, np.diff(np.concatenate([starts, [len(at)]])))
            number[lead:] = np.arange(lead, len(at)) - block
            size = np.zeros(len(at), np.int64)
            ends = np.concatenate([starts, [len(at)]])
            size[:lead] = before + lead
            size[lead:] = np.repeat(np.diff(ends), np.diff(ends))
            if lead and held is not None:
                kinds.append(held)
                held = None
            last = slice(starts[-1] if len(starts) else 0, len(at))
            chosen = (size > 1) | (share[at] > 0)
            x = at[chosen]
            kinds.append([np.ones(len(x), np.int64), doc[x], g[x], share[x] << 32 | number[chosen] // group, run[x], np.zeros(len(x), np.int64)])
            if len(starts):
                count = len(at) - starts[-1]
                held = None
                if count == 1 and not share[at[-1]]:
                    i = at[-1]
                    held = [np.array([v], np.int64) for v in (1, doc[i], g[i], 0, run[i], 0)]
            else:
                count = before + len(at)
            gram, region = (g[-1], share[-1]), r[-1]
            out = [np.concatenate(c) for c in zip(*kinds)]
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.int64()) for c in out[1:])], names=["kind", "doc", "gram", "part", "a", "b"])


def radix_groups(data: np.ndarray, start: np.ndarray, label: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows data[start : start + depth] that equal another of their label, and the group of equals of each.

    One pass per eight bytes, most significant first. Sorting a pass refines the groups, and groups of one are dropped.
    """
    alive = np.arange(len(start))
    order = np.argsort(label, kind="stable")
    group = label
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    for d in range(-8, depth, 8):
        if d >= 0:
            digit = np.ascontiguousarray(words[start[alive] + d]).view(">u8").ravel().astype(np.uint64)
            if depth - d < 8:
                digit >>= np.uint64(8 * (8 - depth + d))
            order = np.lexsort((digit, group))
            new = _first_of(order, group, digit)
        else:
            new = _first_of(order, group)
        number = np.cumsum(new) - 1
        many = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)
        alive, group = alive[order][many], number[many]
        if not len(alive):
            break
    return alive, group


def _sort_regions(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Regions by (gram, part): removed spans (kind 0), and of hot grams the first of each window (kind 1: a start, b and
    part a hash of the window)."""
    def done(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        gram, part, doc, run, hot = (table.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        data, offsets = raw(table.column(5))
        s0, lo, hi = _unpacked(run)
        n = hi + 1
        of = np.repeat(np.arange(len(n)), n)
        j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        fresh = np.concatenate([[True], (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])])
        number = np.cumsum(fresh) - 1
        start = offsets[of] + j
        alive, group = radix_groups(data, start, number[of] * 4096 + lo[of] - j, depth)
        d, s = doc[of[alive]], s0[of[alive]] + j[alive]
        order = np.lexsort((s, d, group))
        later = order[~_first_of(order, group)]
        a, b, owner = merged(s[later], s[later] + depth, d[later])
        zero = np.zeros(len(a), np.int64)
        out = [[zero, owner, zero, zero, a, b]]
        if hot.any():
            left = np.ones(len(start), dtype=bool)
            left[alive[later]] = False
            left &= hot[of]
            x = np.flatnonzero(left)
            h = digests(data, start[x], start[x] + depth).view(np.int64)
            out.append([np.ones(len(x), np.int64), doc[of[x]], gram[of[x]], h, s0[of[x]] + j[x], np.zeros(len(x), np.int64)])
        c = [np.concatenate(x) for x in zip(*out)]
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), *(pa.array(x, pa.int64()) for x in c[1:])], names=["kind", "doc", "gram", "part", "a", "b"])

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        windows = np.cumsum((batch.column(3).to_numpy(zero_copy_only=False) & 0xFFF) + 1)
        cuts = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
        if held:
            tail = held[-1]
            if any(tail.column(i)[tail.num_rows - 1].as_py() != key[0, i] for i in (0, 1)):
                cuts = np.concatenate([[0], cuts])
        at, counted = 0, 0
        for cut in cuts.tolist():
            here = int(windows[cut - 1]) if cut else 0
            if size + here - counted >= AT_ONCE:
                if cut > at:
                    held.append(batch.slice(at, cut - at))
                if held:
                    yield from done(held)
                held, size, at, counted = [], 0, cut, here
        held.append(batch.slice(at))
        size += int(windows[-1]) - counted
    if held and any(x.num_rows for x in held):
        yield from done([x for x in held if x.num_rows])


def _first_windows(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Over windows by (gram, part, doc, a): all but the first of equals, as spans."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        gram, h, doc, a = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (h[1:] != h[:-1])
        new[0] = last != (gram[0], h[0])
        last = (gram[-1], h[-1])
        s, e, of = merged(a[~new], a[~new] + depth, doc[~new])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (of, s, e)], names=["doc", "a", "b"])


def _with_order(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Columns key, doc, t: doc a long that orders the documents; and doc, t with each document once.

    Unique integer keys are their own order. Else documents are the different pairs of key and text, by key (null last) and
    then the text's SHA-256.
    """
    rows = df.select(F.col(key).alias("key"), text_bytes(text).alias("t"))
    if df.schema[key].dataType in (T.LongType(), T.IntegerType(), T.ShortType(), T.ByteType()):
        repeated = rows.select("key").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or key is null")
        if not repeated.head(1):
            rows = rows.withColumn("doc", F.col("key").cast("long"))
            return rows, rows.select("doc", "t")
    named = rows.withColumn("sha", F.sha2("t", 256))
    order = named.select("key", "sha").distinct()
    numbered = with_rank(order, [F.asc_nulls_last("key"), F.asc("sha")], "doc").select(F.col("key").alias("key2"), F.col("sha").alias("sha2"), "doc")
    rows = named.join(numbered, named["key"].eqNullSafe(numbered["key2"]) & (named["sha"] == numbered["sha2"])).select("key", "t", "doc")
    return rows, rows.select("doc", "t").dropDuplicates(["doc"])


def _hot_grams(docs: DataFrame, depth: int, gram: int, partitions: int, least: int) -> DataFrame:
    """gram, shares: grams that fill a quarter of a task or more, by the runs of a sample of documents; few, as they are so large."""
    some = docs.filter(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0).select("doc", "t")
    counts = some.mapInArrow(lambda it: _local_runs(it, depth, gram), _ROWS).filter("run >= 0").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts = settled(counts.filter(F.col("n") >= 2))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(least, total // (4 * partitions))
    return counts.filter(F.col("n") >= most).select("gram", F.greatest(F.lit(2), F.least(F.lit(4 * partitions), F.ceil(F.col("n") * 2 / most))).cast("long").alias("shares"))


def _banded(runs: DataFrame, depth: int, gram: int) -> DataFrame:
    """gram, part, doc, run, hot, bytes: the regions of runs doc, t, r (gram, part, a, hot), those of hot grams in bands.

    The windows of a band start within a few bytes of each other, as seen from the anchor. So all of them hold the same bytes
    around it, most of a window, and these are the next digit: a hash of them is the band's part. Equal windows are in bands of
    one part.
    """
    top = depth - gram
    width = top // BANDS + 1
    first, lo, hi = F.shiftright("r.a", 24), F.shiftright("r.a", 12).bitwiseAND(F.lit(0xFFF)), F.col("r.a").bitwiseAND(F.lit(0xFFF))
    number = F.when(F.col("r.hot"), F.sequence(F.floor((lo - hi) / width), F.floor(lo / width))).otherwise(F.array(F.lit(-1).cast("long")))
    of = runs.select("doc", "t", "r.gram", "r.part", "r.hot", (first + lo).alias("at"), (lo - hi).alias("least"), lo.alias("most"), F.explode(number).alias("band"))
    from_, to = F.col("band") * width, F.least(F.col("band") * width + (width - 1), F.lit(top))
    least = F.when(F.col("hot"), F.greatest("least", from_)).otherwise(F.col("least"))
    most = F.when(F.col("hot"), F.least("most", to)).otherwise(F.col("most"))
    cut = of.withColumns({"least": least, "most": most})
    inner = F.substring("t", (F.col("at") - from_ + 1).cast("int"), (from_ + depth - to).cast("int"))
    run = F.shiftleft(F.col("at") - F.col("most"), 24).bitwiseOR(F.shiftleft("most", 12)).bitwiseOR(F.col("most") - F.col("least"))
    whole = F.substring("t", (F.col("at") - F.col("most") + 1).cast("int"), (F.col("most") - F.col("least") + depth).cast("int"))
    return cut.select("gram", F.when(F.col("hot"), F.xxhash64("band", inner)).otherwise(F.col("part")).alias("part"), "doc", run.alias("run"), "hot", whole.alias("bytes"))


def repeated_spans(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, group: int = GROUP, least_hot: int = LEAST_HOT) -> DataFrame:
    """doc, a, b: spans whose union, in each document, are its bytes that a window covers which also starts earlier.

    docs: doc (long, the order) and t (binary), one row per document.
    """
    gram = min(gram, depth)
    if depth < 2 or depth > 4000:
        raise ValueError("depth: 2 to 4000 bytes")
    small_batches(docs.sparkSession)
    partitions = max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    crowded = settled(_hot_grams(docs, depth, gram, partitions, least_hot))
    rows = docs.select("doc", "t").mapInArrow(lambda it: _local_runs(it, depth, gram), _ROWS)
    share = F.when((F.col("run") < 0) | F.col("shares").isNull(), F.lit(0)).otherwise(F.pmod("region", "shares") + 1)
    dealt = rows.join(F.broadcast(crowded), "gram", "left").select("gram", "region", "doc", "run", share.cast("long").alias("share"))  # 4 * partitions grams or so at most
    found = settled(dealt.repartition(partitions, "gram", "share").sortWithinPartitions("gram", "share", "region", "doc", "run").mapInArrow(lambda it: _sorted_runs(it, depth, group), _FOUND))
    free_shuffles(docs.sparkSession)
    spans = found.filter("kind = 0").select("doc", "a", "b")
    several = found.filter("kind = 1")
    hot = several.filter("part > 0").select("gram").distinct().withColumn("hot", F.lit(True))  # at most one gram for `group` rows
    wanted = several.join(hot, "gram", "left").select("doc", "gram", "part", "a", F.coalesce("hot", F.lit(False)).alias("hot"))
    per_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("gram", "part", "a", "hot")).alias("runs"))  # fewer than a document's bytes
    regions = settled(_banded(docs.select("doc", "t").join(per_doc, "doc").select("doc", "t", F.explode("runs").alias("r")), depth, gram))
    free_shuffles(docs.sparkSession)
    most = BANDS * group
    large = regions.filter("hot").groupBy("gram", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("gram", "part", F.ceil(F.col("n") / most).alias("shares"))
    shared = regions.drop("hot").join(F.broadcast(large), ["gram", "part"], "left")  # at most one group for `most` rows
    own = F.when(F.col("shares").isNull(), F.col("part")).otherwise(F.xxhash64("part", F.pmod(F.xxhash64("doc", "run"), "shares")))
    regions = shared.select("gram", own.alias("part"), "doc", "run", F.col("shares").isNotNull().alias("hot"), "bytes")
    regions = regions.repartition(partitions, "gram", "part").sortWithinPartitions("gram", "part")
    finer = settled(regions.mapInArrow(lambda it: _sort_regions(it, depth), _FOUND))
    free_shuffles(docs.sparkSession)
    spans = spans.unionByName(finer.filter("kind = 0").select("doc", "a", "b"))
    firsts = finer.filter("kind = 1").select("gram", "part", "doc", "a")
    if firsts.head(1):
        last = firsts.repartition(partitions, "gram", "part").sortWithinPartitions("gram", "part", "doc", "a").mapInArrow(lambda it: _first_windows(it, depth), "doc long, a long, b long")
        spans = spans.unionByName(last)
    return spans


def remove_repeats(df: DataFrame, key: str, text: str, depth: int = DEPTH, gram: int = GRAM, group: int = GROUP, kept: bool = False) -> DataFrame:
    """One row per input row: key, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, kept (binary).

    Removes each byte covered by a window of depth bytes that also starts earlier: in a document of a smaller key, or before
    in the same one. Windows are those of the input and never cross documents. Null texts count as empty. Null keys come
    last; rows with equal keys are ordered by their texts' SHA-256, and repeated rows (equal key and text) are one document,
    with one result. Other columns, whatever their names, are dropped; an empty table gives no rows.

    A long text is cut whole, by a task that handles it alone and holds some 60 times its bytes.
    """
    docs, once = _with_order(df, key, text)
    spans = repeated_spans(once, depth, gram, group).groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = docs.join(spans, "doc", "left").select("key", "t", F.expr("transform(spans, x -> x.a)").alias("a"), F.expr("transform(spans, x -> x.b)").alias("b"))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept", T.BinaryType())] if kept else [])])
    arrow = to_arrow_schema(schema)

    def cut(t: bytes, a: Sequence[int] | None, b: Sequence[int] | None) -> tuple[bytes, int]:
        if not a:
            return t, 0
        start, end = merged(np.array(a, np.int64), np.array(b, np.int64))
        edges = [0, *np.column_stack([start, end]).ravel().tolist(), len(t)]
        return b"".join(t[x:y] for x, y in zip(edges[::2], edges[1::2])), len(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1, CHUNK):
                texts = piece.column(1).to_pylist()
                left = [cut(*x) for x in zip(texts, piece.column(2).to_pylist(), piece.column(3).to_pylist())]
                columns = [piece.column(0).cast(arrow.field(0).type), [len(t) for t in texts], [len(t) - len(k) for t, (k, _) in zip(texts, left)], [n for _, n in left], [hashlib.sha256(k).hexdigest() for k, _ in left]] + [[k for k, _ in left]] * kept
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)], names=arrow.names)

    return joined.mapInArrow(run, schema)
