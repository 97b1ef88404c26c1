"""Bottom-up packing: entries into leaves, leaves into their parents, level after level until one node is left.

A grouping deals the rows of a level into numbered groups of at most `capacity`; the groups' boxes are the rows of the level
above. As a level has a capacity-th of the rows below, all but the first levels are small, and no node has more children than
the capacity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from orthobox.functions.boxes import Box, axes, mbr
from orthobox.operators.index import WHOLE, SpatialIndex, from_paths
from orthobox.shared import few, settled, tile, with_rank

#: Rows of a level up to which a window over them is cheaper than a range partitioning.
SMALL = 100_000
#: Ranks of a cell, in bits, whose rows are added up.
CELL_BITS = 14
#: Rows that a task looks through at once for a set's extremes.
AT_ONCE = 200_000
#: Rounds after which rows are written with their sets; until then the few cuts are joined again.
LAZY = 4
#: Bits of a Hilbert key.
KEY_BITS = 62

Grouping = Callable[[DataFrame, int, str], DataFrame]


def placed(df: DataFrame, rows: int, group: str, by: Column, key: str) -> DataFrame:
    """The rows with n_, their group's size, and place_, from 0, in their group's order."""
    if rows <= SMALL:
        own = Window.partitionBy(group)
        return df.withColumns({"n_": F.count(F.lit(1)).over(own), "place_": F.row_number().over(own.orderBy(by, key)) - 1})
    ranked = with_rank(df.withColumn("by_", by), [F.col(group), F.col("by_"), F.col(key)], "rank_")
    first = ranked.groupBy(group).agg(F.min("rank_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    return ranked.join(few(first), group).withColumn("place_", F.col("rank_") - F.col("first_")).drop("rank_", "first_", "by_")


def tiles(df: DataFrame, capacity: int, key: str = "id", within: str | None = None) -> DataFrame:
    """Sort-tile: `group` (a path) of each row. A set of n rows has to become p = ceil(n / capacity) groups: along each axis
    in turn it is cut into tiles of equal count, the (axes left)-th root of p, along the last one into p. All rows are one set,
    or those of each value of the column `within`."""
    d, rows = axes(df), df.count()
    now = df.withColumn("group", F.lit("t") if within is None else F.col(within))
    for axis in range(d):
        at = placed(now, rows, "group", Box.of(d).centroid()[axis], key)
        need = F.ceil(F.col("n_") / F.lit(capacity))
        cuts = need if axis == d - 1 else F.ceil(F.round(F.pow(need, F.lit(1.0 / (d - axis))), 9))
        now = settled(at.withColumn("group", F.concat("group", F.lit("."), tile(F.col("place_"), F.col("n_"), cuts).cast("string"))).drop("n_", "place_"))
    return now


def hilbert_key(box: Box, extent: Box, bits: int | None = None) -> Column:
    """The place, as a long, of a box's centre on the Hilbert curve of so many bits an axis through an extent.

    A fold over the bits from the highest: first all axes are reflected and exchanged as the curve turns, then the bits of
    all axes are read by turns, each as the parity of those before it (Gray code). Expressions only, no Python.
    """
    d = min(box.d, KEY_BITS)
    bits = bits or min(16, KEY_BITS // d)
    top = (1 << bits) - 1
    cells = F.array(*[F.least(F.floor((c - lo) / F.greatest(hi - lo, F.lit(1e-300)) * F.lit(float(1 << bits))), F.lit(top)).cast("long") for c, lo, hi in list(zip(box.centroid(), extent.lo, extent.hi))[:d]])

    def turn(x: Column, step: Column) -> Column:
        i, q = step % d, _shifted("shiftleft", F.lit(1).cast("long"), F.lit(bits - 1) - (step / d).cast("int"))
        low, first, own = q - 1, F.element_at(x, 1), F.element_at(x, (i + 1).cast("int"))
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        set_ = own.bitwiseAND(q) != 0
        return F.transform(x, lambda v, k: F.when(set_, F.when(k == 0, v.bitwiseXOR(low)).otherwise(v)).when((k == 0) & (i == 0), v).when((k == 0) | (k == i), v.bitwiseXOR(swap)).otherwise(v))

    turned = F.aggregate(F.sequence(F.lit(0), F.lit(d * (bits - 1) - 1)), cells, turn) if bits > 1 else cells
    read = F.sequence(F.lit(0), F.lit(d * bits - 1))

    def bit(x: Column, step: Column) -> Column:
        return _shifted("shiftright", F.element_at(x, (step % d + 1).cast("int")), F.lit(bits - 1) - (step / d).cast("int")).bitwiseAND(F.lit(1))

    start = F.struct(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("was"))
    # A bit of the curve is the parity of all bits read so far.
    once = F.transform(F.array(turned), lambda x: F.aggregate(read, start, lambda s, step: _next(s, bit(x, step)), lambda s: s["key"]))
    return F.element_at(once, 1)


def _shifted(how: str, x: Column, bits: Column) -> Column:
    return F.call_function(how, x, bits)


def _next(s: Column, bit: Column) -> Column:
    now = s["was"].bitwiseXOR(bit)
    return F.struct((F.shiftleft(s["key"], 1).bitwiseOR(now)).alias("key"), now.alias("was"))


def curve(df: DataFrame, capacity: int, key: str = "id") -> DataFrame:
    """Hilbert order: `group` of each row; runs of `capacity` rows by their centres' place on the curve, ties by key."""
    d, rows = axes(df), df.count()
    on_curve = df.join(F.broadcast(df.agg(*mbr(Box.of(d), "x"))))  # one row
    keyed = on_curve.withColumn("h_", hilbert_key(Box.of(d), Box.of(d, "x"))).drop(*[f"x{s}_{i}" for s in ("min", "max") for i in range(d)])
    if rows <= SMALL:
        ranked = keyed.withColumn("rank_", F.row_number().over(Window.orderBy("h_", key)) - 1)
    else:
        ranked = with_rank(keyed, [F.col("h_"), F.col(key)], "rank_")
    return ranked.withColumn("group", F.floor(F.col("rank_") / F.lit(capacity)).cast("string")).drop("h_", "rank_")


def _places(rows: pa.Table, d: int, key: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each row's place in the orders by the edges that extremes takes in turn, and by each centre; ties by key, nulls first."""
    rank = np.empty(len(rows), np.int64)
    rank[pc.sort_indices(rows.column(key), null_placement="at_start").to_numpy()] = np.arange(len(rows))
    lo, hi = ([rows.column(f"{s}_{i}").cast(pa.float64()).to_numpy() for i in range(d)] for s in ("min", "max"))
    no_lo, no_hi = ([rows.column(f"{s}_{i}").is_null().to_numpy() for i in range(d)] for s in ("min", "max"))

    def placed(x: np.ndarray, null: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.int64)
        out[np.lexsort((rank, np.where(null, -np.inf, x)))] = np.arange(len(rows))
        return out

    edges = [placed(x, n) for x, n in zip(lo, no_lo)] + [placed(-x, n) for x, n in zip(hi, no_hi)]
    return edges, [placed((a + b) / 2, m | n) for a, b, m, n in zip(lo, hi, no_lo, no_hi)]


def _taken(at: np.ndarray, places: Sequence[np.ndarray], capacity: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The `capacity` rows that each order in turn takes off, as long as there are more, and the rest."""
    out = []
    for place in places:
        if len(at) <= capacity:
            break
        own = place[at]
        first = own <= np.partition(own, capacity - 1)[capacity - 1]
        out.append(at[first])
        at = at[~first]
    return out, at


def _named(rows: pa.Table, column: str, names: list[str], of: np.ndarray) -> pa.Table:
    return rows.set_column(rows.schema.get_field_index(column), column, pa.array(names, pa.string()).take(pa.array(of)))


def _sides(d: int) -> list[str]:
    return [f"a{i}" for i in range(d)] + [f"b{i}" for i in range(d)]


def _priority(rows: pa.Table, d: int, capacity: int, key: str, level: int, rounds: int | None) -> pa.Table:
    """The rows of one set, which is due in round `level`, with their groups; after `rounds` the rest of a set is one group."""
    edges, centres = _places(rows, d, key)
    todo, names, of = [(np.arange(len(rows)), rows.column("group")[0].as_py(), level)], [], np.empty(len(rows), np.int64)
    while todo:
        at, path, level = todo.pop()
        groups, rest = ([], at) if level == rounds else _taken(at, edges, capacity)
        named = list(zip(_sides(d), groups))
        for side, own in [(f".{s}", own) for s, own in named] + ([("", rest)] if len(named) < 2 * d else []):
            of[own] = len(names)
            names.append(path + side)
        if len(named) == 2 * d and len(rest):
            own = centres[level % d][rest]
            first = own <= np.partition(own, (len(own) - 1) // 2)[(len(own) - 1) // 2] if len(own) > capacity else np.ones(len(own), bool)
            todo += [(rest[x], f"{path}.{i}", level + 1) for i, x in enumerate((first, ~first)) if x.any()]
    return _named(rows, "group", names, of)


def _outermost(batches: Iterator[pa.RecordBatch], d: int, capacity: int, key: str) -> Iterator[pa.RecordBatch]:
    """Of a task's rows those that may be among a set's extremes: by the n-th edge the first n times the capacity of each set."""

    def trimmed(rows: pa.Table) -> pa.Table:
        edges, _ = _places(rows, d, key)
        code = rows.column("group").combine_chunks().dictionary_encode().indices.to_numpy()
        keep = np.zeros(len(rows), bool)
        for x in np.unique(code):
            at = np.flatnonzero(code == x)
            for n, place in enumerate(edges):
                most = min(len(at), (n + 1) * capacity)
                own = place[at]
                keep[at[own <= np.partition(own, most - 1)[most - 1]]] = True
        return rows.filter(pa.array(keep))

    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size >= AT_ONCE:
            held = trimmed(pa.Table.from_batches(held)).to_batches()
            size = AT_ONCE // 2  # at the least so many more before the next look
    if held:
        yield from trimmed(pa.Table.from_batches(held)).to_batches()


def _extremes_of(rows: pa.Table, d: int, capacity: int, key: str) -> pa.Table:
    """The extremes of one large set, from its outermost rows, with their groups."""
    groups, _ = _taken(np.arange(len(rows)), _places(rows, d, key)[0], capacity)
    out = rows.take(pa.array(np.concatenate(groups)))
    path = rows.column("group")[0].as_py()
    return _named(out, "group", [f"{path}.{s}" for s in _sides(d)], np.repeat(np.arange(len(groups)), [len(g) for g in groups]))


def ranked(df: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    """The rows with their place in the whole table's order by the centre on each axis, ties by key; the names of those columns."""
    d = axes(df)
    for i in range(d):
        df = with_rank(df, [Box.of(d).centroid()[i], F.col(key)], f"rank_{i}_")
    return df, [f"rank_{i}_" for i in range(d)]


def runs_by_rank(df: DataFrame, sizes: DataFrame, ranks: dict[int, str]) -> DataFrame:
    """group, axis, run, last, min_i, max_i: boxes and last ranks of the runs of `size` rows of each group (sizes: group, size)
    in the order of each axis' rank, a column of unique whole numbers.

    Rows are added up by cells of ranks; only those of cells with an end of a run are ordered, so no row is moved otherwise.
    """
    d = axes(df)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), F.col(r).alias("at")) for i, r in ranks.items()]))
    wide = df.join(F.broadcast(sizes.select("group")), "group", "left_semi").select("group", *Box.of(d).named(), each.alias("o_"))
    wide = wide.select("group", *Box.of(d).named(), "o_.axis", "o_.at", F.shiftright("o_.at", CELL_BITS).alias("cell"))
    cells = settled(wide.groupBy("group", "axis", "cell").agg(F.count(F.lit(1)).alias("n_"), F.max("at").alias("last"), *mbr(Box.of(d))))
    before = F.sum("n_").over(Window.partitionBy("group", "axis").orderBy("cell")) - F.col("n_")
    at = settled(cells.join(F.broadcast(sizes), "group").withColumn("before_", before).withColumns({"run": F.floor(F.col("before_") / F.col("size")), "end_": F.floor((F.col("before_") + F.col("n_") - 1) / F.col("size"))}))
    columns = ["group", "axis", "run", "last", *[f"{s}_{i}" for s in ("min", "max") for i in range(d)]]
    cut = few(at.filter("run < end_").select("group", "axis", "cell", "before_", "size"))
    place = F.col("before_") + F.row_number().over(Window.partitionBy("group", "axis", "cell").orderBy("at")) - 1
    ordered = wide.join(cut, ["group", "axis", "cell"]).withColumn("run", F.floor(place / F.col("size"))).withColumnRenamed("at", "last")
    both = at.filter("run = end_").select(*columns).unionByName(ordered.select(*columns))
    return both.groupBy("group", "axis", "run").agg(F.max("last").alias("last"), *mbr(Box.of(d)))


def extremes(df: DataFrame, capacity: int, key: str = "id", whole: int = WHOLE, rounds: int | None = None) -> DataFrame:
    """Priority leaves: `group` of each row.

    Of every set of rows over the capacity, the `capacity` rows of least lower edge on each axis in turn, and then those of
    greatest upper edge, of what is left, become a group each; the rest is halved at the median of its centres along an axis,
    the next one in each round, and each half goes on. Sets of over `whole` rows are dealt with together, round by round: they
    give up a few rows, and a rank halves them where they lie. Each smaller one is a task's. With `rounds` there are no more
    than so many, and what is left of a set then is one group, whatever its size.
    """
    d = axes(df)
    whole = max(whole, (2 * d + 1) * capacity + 1)
    active, done, level = settled(df.withColumn("group", F.lit("p"))), [], 0
    spark, schema, large = df.sparkSession, active.schema, {"p": active.count()}
    columns = schema.names
    if large["p"] > whole:
        active, ranks = ranked(active, key)
    while max(large.values()) > whole and level != rounds:  # one set for `whole` rows at most; all of a round are of one size, but for a row
        own, one = F.col(ranks[0]), ranks[level % d]
        kinds = T.StructType([*schema.fields, T.StructField(ranks[0], T.LongType())])
        some = active.select(*columns, own).mapInArrow(lambda it: _outermost(it, d, capacity, key), kinds)
        out = settled(some.groupBy("group").applyInArrow(lambda rows: _extremes_of(rows, d, capacity, key), kinds))
        done.append(out.select(*columns))
        active = active.join(few(out.select(own)), ranks[0], "left_anti")
        left = {g: n - 2 * d * capacity for g, n in large.items()}
        sizes = spark.createDataFrame([(g, (n + 1) // 2) for g, n in left.items()], "group string, size long")
        halves = few(runs_by_rank(active, sizes, {0: one}).filter("run = 0").select("group", F.col("last").alias("cut_")))
        active = active.join(halves, "group").withColumn("group", F.concat("group", F.lit("."), (F.col(one) > F.col("cut_")).cast("int").cast("string"))).select(*columns, *ranks)
        large = {f"{g}.{i}": n for g, m in left.items() for i, n in enumerate(((m + 1) // 2, m // 2))}
        level += 1
        if not level % LAZY:
            active = settled(active)
    parted = active.select(*columns)
    if level != rounds:
        parted = parted.groupBy("group").applyInArrow(lambda rows: _priority(rows, d, capacity, key, level, rounds), schema)
    return reduce(DataFrame.unionByName, [settled(parted), *done])


def build_packed(df: DataFrame, capacity: int, grouping: Grouping = tiles, key: str = "id") -> SpatialIndex:
    """An index packed from its leaves up; grouping: tiles, curve or extremes. An empty table gives no nodes."""
    if capacity < 2:
        raise ValueError("capacity: 2 or more")
    d = axes(df)
    leaves = settled(grouping(df, capacity, key).withColumnRenamed("group", "leaf_"))
    steps, level, at = [], leaves, "leaf_"
    while True:
        boxes = settled(level.groupBy(F.col(at).alias("id")).agg(*mbr(Box.of(d))))
        if boxes.count() <= 1:
            break
        level = settled(grouping(boxes, capacity, "id").select("id", "group", *Box.of(d).named()))
        steps.append(level.select("id", "group"))
        at = "group"
    paths = boxes.select(F.col("id").alias("group"), F.lit("r").alias("path"))
    for step in reversed(steps):  # names from the root down, children numbered by their id
        number = F.row_number().over(Window.partitionBy("group").orderBy("id")) - 1
        paths = step.join(paths, "group").select(F.col("id").alias("group"), F.concat("path", F.lit("."), number.cast("string")).alias("path"))
    named = leaves.join(paths.withColumnRenamed("group", "leaf_"), "leaf_").drop("leaf_").withColumnRenamed("path", "node_id")
    return from_paths(settled(named))


def greedy_cuts(df: DataFrame, size: str = "size", group: str = "group", key: str = "id") -> DataFrame:
    """group, axis, first, cost: for each group of over `size` rows (a column, one value a group) its best cut in two.

    Cuts are across an axis, after `first` rows by their centres there, ties by key, where `first` is a multiple of the size.
    The best has the least summed area of both sides' boxes (to nine digits); of equals the first axis, then the least `first`.
    """
    d, rows = axes(df), df.count()
    wide = df.select(F.col(group).alias("g_"), F.col(size).cast("long").alias("s_"), F.col(key).alias("k_"), *Box.of(d).named(), F.explode(F.array(*[F.struct(F.lit(i).alias("axis_"), c.alias("at_")) for i, c in enumerate(Box.of(d).centroid())])).alias("o_"))
    wide = wide.select("g_", "s_", "k_", *Box.of(d).named(), "o_.axis_", "o_.at_").withColumn("ga_", F.concat("g_", F.lit("/"), F.col("axis_").cast("string")))
    at = placed(wide, rows * d, "ga_", F.col("at_"), "k_").filter("n_ > s_")
    blocks = at.groupBy("g_", "axis_", "s_", F.floor(F.col("place_") / F.col("s_")).alias("b_")).agg(*mbr(Box.of(d)))
    up, down = (Window.partitionBy("g_", "axis_").orderBy(o) for o in (F.asc("b_"), F.desc("b_")))
    head, rest = up.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(Window.unboundedPreceding, -1)
    sides = [Box(tuple(F.min(f"min_{i}").over(w) for i in range(d)), tuple(F.max(f"max_{i}").over(w) for i in range(d))) for w in (head, rest)]
    cuts = blocks.select("g_", "axis_", ((F.col("b_") + 1) * F.col("s_")).alias("first"), *sides[0].named("a"), *sides[1].named("b")).filter("bmin_0 is not null")
    cost = F.round(Box.of(d, "a").area() + Box.of(d, "b").area(), 9)
    best = cuts.groupBy("g_").agg(F.min(F.struct(cost.alias("cost"), F.col("axis_").alias("axis"), F.col("first"))).alias("m"))
    return best.select(F.col("g_").alias(group), F.col("m.axis").alias("axis"), F.col("m.first").alias("first"), F.col("m.cost").alias("cost"))


def _greedily(rows: pa.Table, d: int, capacity: int, key: str) -> pa.Table:
    """The rows of one part of a node, whose children have up to capacity^level_ rows, with their leaves as their group."""
    _, centres = _places(rows, d, key)
    lo, hi = (np.column_stack([rows.column(f"{s}_{i}").cast(pa.float64()).to_numpy() for i in range(d)]) for s in ("min", "max"))
    todo = [([np.argsort(c) for c in centres], rows.column("group")[0].as_py(), rows.column("level_")[0].as_py())]
    names, of, side = [], np.empty(len(rows), np.int64), np.empty(len(rows), bool)
    while todo:
        orders, path, level = todo.pop()
        n, size = len(orders[0]), capacity**level
        if n <= size:
            path = _child(path)
            if level > 1:
                todo.append((orders, f"{path}.", level - 1))
            else:
                of[orders[0]] = len(names)
                names.append(path)
            continue
        best = None
        for axis, order in enumerate(orders):
            starts = np.arange(0, n, size)
            low, high = np.fmin.reduceat(lo[order], starts), np.fmax.reduceat(hi[order], starts)
            head = np.fmax.accumulate(high) - np.fmin.accumulate(low)
            rest = (np.fmax.accumulate(high[::-1]) - np.fmin.accumulate(low[::-1]))[::-1]
            cost = np.prod(head[:-1], axis=1) + np.prod(rest[1:], axis=1)
            cost = np.nan_to_num(np.where(np.abs(cost) < 1e6, np.round(cost, 9), cost), nan=np.inf)
            at = int(np.argmin(cost))
            if best is None or cost[at] < best[0]:
                best = cost[at], axis, (at + 1) * size
        _, axis, first = best
        side[orders[axis][:first]], side[orders[axis][first:]] = False, True
        for i, x in enumerate((lambda o: ~side[o], lambda o: side[o])):
            todo.append(([o[x(o)] for o in orders], f"{path}{i}", level))
    return _named(rows, "group", names, of)


def _child(part: str) -> str:
    """The name of a child that a part of a node becomes."""
    return f"{part}_" if part.endswith(".") else part


def build_greedy(df: DataFrame, capacity: int, key: str = "id", whole: int = 2 * WHOLE) -> SpatialIndex:
    """Top-down greedy splits: a node of height h is cut in two at its best cut (see greedy_cuts), and its parts again, until
    each part has at most capacity^(h - 1) rows and so becomes a child. Parts of over `whole` rows are cut together, where they
    lie, all in the same step; each smaller one is cut down to its leaves by a task."""
    if capacity < 2:
        raise ValueError("capacity: 2 or more")
    d, spark, now = axes(df), df.sparkSession, settled(df.withColumn("node_id", F.lit("r")))
    rows, height = now.count(), 1
    while capacity**height < rows:
        height += 1
    if height == 1:
        return from_paths(now)
    active, columns, parts, step = now.withColumn("group", F.lit("r.")).drop("node_id"), [*df.columns, "group"], {"r.": (rows, height - 1)}, 0
    levels, waiting, ranks, whole = {}, [], [], max(whole, capacity)
    if rows > whole:
        active, ranks = ranked(active, key)

    def due(name: str, n: int, level: int) -> tuple[str, int]:
        while n <= capacity**level and n > whole:  # a child that is itself too large for a task
            name, level = f"{_child(name)}.", level - 1
        return name, level

    while True:
        levels |= {g: level for g, (n, level) in parts.items() if n <= whole}
        large = {g: x for g, x in parts.items() if x[0] > whole}
        if not large:
            break
        sizes = spark.createDataFrame([(g, capacity**level) for g, (_, level) in large.items()], "group string, size long")
        up, down = (Window.partitionBy("group", "axis").orderBy(o) for o in (F.asc("run"), F.desc("run")))
        head, rest = up.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(Window.unboundedPreceding, -1)
        sides = [Box(tuple(F.min(f"min_{i}").over(w) for i in range(d)), tuple(F.max(f"max_{i}").over(w) for i in range(d))) for w in (head, rest)]
        cuts = runs_by_rank(active, sizes, dict(enumerate(ranks))).select("group", "axis", "run", "last", F.lead("run").over(up).alias("next_"), *sides[0].named("a"), *sides[1].named("b")).filter("next_ is not null")
        cost = F.coalesce(F.round(Box.of(d, "a").area() + Box.of(d, "b").area(), 9), F.lit(float("inf")))
        best = cuts.groupBy("group").agg(F.min(F.struct(cost.alias("cost"), "axis", "run", "last")).alias("m")).select("group", "m.*").collect()  # a row for `whole` rows at most
        parts, made = {}, []
        for cut in best:
            n, level = large[cut["group"]]
            first = (cut["run"] + 1) * capacity**level
            names = []
            for i, own in enumerate((first, n - first)):
                name, below = due(f"{cut['group']}{i}", own, level)
                parts[name] = (own, below)
                names.append(name)
            made.append((cut["group"], cut["axis"], cut["last"], *names))
        made = F.broadcast(spark.createDataFrame(made, "group string, axis int, last_ long, zero_ string, one_ string"))
        met, rank = active.join(made, "group", "left"), F.element_at(F.array(*ranks), F.col("axis") + 1)
        name = F.when(F.col("axis").isNull(), F.col("group")).when(rank > F.col("last_"), F.col("one_")).otherwise(F.col("zero_"))
        active = met.withColumn("group", name).select(*columns, *ranks)
        step += 1
        if not step % LAZY:
            still = F.broadcast(spark.createDataFrame([(g,) for g, (n, _) in parts.items() if n > whole], "group string"))
            both = settled(active)
            waiting.append(both.join(still, "group", "left_anti").select(*columns))
            active = both.join(still, "group", "left_semi")
    of = F.broadcast(spark.createDataFrame([*levels.items()], "group string, level_ int"))
    every = reduce(DataFrame.unionByName, [active.select(*columns), *waiting]).join(of, "group").select(*columns, "level_")
    parted = every.groupBy("group").applyInArrow(lambda rows: _greedily(rows, d, capacity, key).drop_columns(["level_"]), active.select(*columns).schema)
    return from_paths(settled(parted.withColumnRenamed("group", "node_id")))
