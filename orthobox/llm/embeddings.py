"""Near-duplicate vectors by randomly rotated binary codes.

Equal vectors are one class. Classes are gathered into balls: a pivot and a radius under half of the threshold's angle, so all
members of a ball are linked to each other, and groups of near-copies shrink to a few balls without their pairs being made.
Balls are formed among vectors that lie side by side in the order of their codes, at most CHUNK at a time, and then among
balls in the same way, in rounds, until they hardly get fewer: no group is gathered in one task, however large.

Candidates are balls with members in a common cell of one of several sets of random half-spaces. A cell's balls are compared
by their pivots' codes. A code has the signs of the rotated pivot o and the factor f, the inner product of o with its signs
o' (scaled to length 1). For a rotated, randomly rounded vector q, <o', q> / f is an unbiased estimate of <o, q>, whose error
is under EPSILON * sqrt((1 - f^2) / f^2 * (1 - <o, q>^2) / (d - 1)) but for a share of about 3e-5. Pairs whose upper bound is
under what the threshold and the radii ask for go; for all others the pivots' inner product is computed exactly. That decides
two single vectors, and balls that lie wholly within or without the threshold; the members of the balls left are compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthobox.llm._rows import mixed
from orthobox.llm._shared import stored
from orthobox.llm.components import connected

#: Vectors, or balls, among which balls are formed at once.
CHUNK = 2048
#: Balls of a cell that are compared at once, and members of a ball that stand in one row; larger cells and balls are cut up.
CELL, BLOCK = 2048, 512
#: Standard deviations of the estimate's error that the bounds leave room for.
EPSILON = 4.0
#: The share of pairs just at the threshold that may have no cell in common.
MISSED = 0.01
#: Room for rounding when balls are taken to be wholly within or without the threshold, in radians.
SLACK = 1e-6
SEED = 20240521

_CLASS = "digest binary, vec binary, dim int"
_BALL = "id long, ball long, pivot binary, radius double, size long, dim int, sign long"
_CODED = "ball long, code binary, factor double, query binary, scale double, radius double"


def rotation(dim: int, number: int = 0) -> np.ndarray:
    """A random rotation of so many dimensions; the same one in every task."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def half_spaces(dim: int, tables: int, bits: int) -> np.ndarray:
    """Normals of the half-spaces of all tables."""
    return np.random.default_rng([SEED, dim, 1 << 20]).standard_normal((dim, tables * bits))


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def encode(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (packed signs of the rotated vectors), their factors, and the rotated vectors rounded at random to bytes, with scales."""
    turned = units @ turn
    signs = turned > 0
    factor = np.abs(turned).sum(1) / math.sqrt(turned.shape[1])
    scale = np.maximum(np.abs(turned).max(1), 1e-300) / 127
    steps = turned / scale[:, None]
    with np.errstate(over="ignore"):
        noise = mixed(steps.view(np.uint64)) >> np.uint64(11)
    return np.packbits(signs, axis=1), factor, np.clip(np.floor(steps + noise / 2**53), -127, 127).astype(np.int8), scale


def estimates(codes: np.ndarray, factors: np.ndarray, queries: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of all coded vectors (rows) and all queries (columns)."""
    dim = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    raw = signs @ (queries.astype(np.float32) * scales[:, None].astype(np.float32)).T
    return raw / (math.sqrt(dim) * factors[:, None]).astype(np.float32)


def _units(rows: pa.Array, dim: int) -> np.ndarray:
    x = np.stack([np.frombuffer(b, "<f8") for b in rows.to_pylist()]) if len(rows) else np.zeros((0, dim))
    return x


def _normal(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1; lengths that a double's squares do not hold are scaled first."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, digest, vec (doubles of length 1) and dim; null where a vector is null, zero or not finite."""
    for batch in batches:
        digests, vectors, dims = [], [], []
        for v in batch.column(1).to_pylist():
            x = None if not v or None in v else np.array(v, "<f8")
            if x is None or not np.isfinite(x).all() or not x.any():
                digests.append(None), vectors.append(None), dims.append(None)
                continue
            x = x + 0.0  # one zero
            digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            vectors.append(_normal(x[None])[0].tobytes())
            dims.append(len(x))
        columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary()), pa.array(dims, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "digest", "vec", "dim"])


def gather(units: np.ndarray, radii: np.ndarray, sizes: np.ndarray, most: float) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, float]]]:
    """For each ball the number of the one it goes into, and the changed pivots and radii of those: none is over `most`.

    A ball's pivot is the mean of what it takes in, so a group that lies about a centre becomes one ball.
    """
    into, made = np.arange(len(units)), {}
    reach = np.cos(np.minimum(math.pi, 2 * most))
    near = units @ units.T >= reach
    left = near.sum(1) > 1
    for i in np.flatnonzero(left):
        if not left[i]:
            continue
        own = np.flatnonzero(near[i] & left)
        pivot = units[i]
        for _ in range(2):
            pivot = (units[own] * sizes[own, None]).sum(0)
            if (length := math.sqrt(pivot @ pivot)) < 1e-9:
                break
            pivot = pivot / length
            far = angle(units @ pivot) + radii + SLACK
            own = np.flatnonzero(left & (far <= most))
            if not len(own):
                break
        if len(own) > 1 and length >= 1e-9:
            into[own] = own[0]
            made[int(own[0])] = (pivot, float(far[own].max()))
            left[own] = False
        left[i] = False
    return into, made


def _balls(batches: Iterator[pa.RecordBatch], most: float) -> Iterator[pa.RecordBatch]:
    """id and the ball it goes into for each row; pivot, radius, size and sign with the row that gives the ball its number."""
    held: list[pa.RecordBatch] = []

    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for dim in sorted(set(rows.column("dim").to_pylist())):
            own = rows.filter(pc.equal(rows.column("dim"), dim))
            turn = rotation(dim)
            for at in range(0, own.num_rows, CHUNK):
                part = own.slice(at, CHUNK)
                ids, sizes = part.column("id").to_numpy(), part.column("size").to_numpy()
                units, radii = _units(part.column("pivot").combine_chunks(), dim), part.column("radius").to_numpy().copy()
                into, made = gather(units, radii, sizes, most)
                sums = np.bincount(into, weights=sizes, minlength=len(ids)).astype(np.int64)
                for i, (pivot, radius) in made.items():
                    units[i], radii[i] = pivot, radius
                heads = into == np.arange(len(ids))
                pivots = pa.array([u.tobytes() if h else None for u, h in zip(units, heads)], pa.binary())
                arrays = [pa.array(ids), pa.array(ids[into]), pivots, pa.array(radii), pa.array(sums), pa.array(np.full(len(ids), dim, np.int32)), pa.array(_sign(units, turn))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "ball", "pivot", "radius", "size", "dim", "sign"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield from done(pa.Table.from_batches(held))
            held = []
    if held:
        yield from done(pa.Table.from_batches(held))


def _sign(units: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The first 63 signs of the rotated vectors as a number."""
    bits = (units @ turn[:, :63]) > 0
    return (bits.astype(np.int64) << np.arange(62, 62 - bits.shape[1], -1)).sum(1)


def _gathered(rows: DataFrame, n: int, most: float, shift: int) -> DataFrame:
    """Balls formed of n rows (id, pivot, radius, size, dim, sign) that are neighbours in the order of their signs, from bit `shift` on."""
    order = F.shiftleft("sign", shift).bitwiseOR(F.shiftrightunsigned("sign", 63 - shift)).bitwiseAND(F.lit((1 << 63) - 1))
    parts = min(max(1, math.ceil(n / CHUNK)), max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions()))
    placed = rows.repartitionByRange(parts, "dim", order, "id").sortWithinPartitions("dim", order, "id")
    return stored(placed.select("id", "pivot", "radius", "size", "dim").mapInArrow(lambda it: _balls(it, most), _BALL))


def _heads(balls: DataFrame) -> DataFrame:
    return balls.filter("pivot is not null").drop("id").withColumnRenamed("ball", "id")


def cells_for(n: int, threshold: float, cell: int = CELL, missed: float = MISSED) -> tuple[int, int]:
    """Tables and bits of the half-spaces for n vectors: about `cell` a cell, and a pair at the threshold rarely in none."""
    bits = max(0, math.ceil(math.log2(max(1, n / cell))))
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return (1, 0) if bits == 0 else (math.ceil(math.log(missed) / math.log(1 - p)), bits)


def _in_cells(batches: Iterator[pa.RecordBatch], tables: int, bits: int) -> Iterator[pa.RecordBatch]:
    """id, dim and, for each table, which half-spaces hold the vector."""
    spaces: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column(2).to_numpy()
        for dim in np.unique(dims).tolist():
            own = batch.filter(pa.array(dims == dim))
            if dim not in spaces:
                spaces[dim] = half_spaces(dim, tables, bits)
            inside = (_units(own.column(1), dim) @ spaces[dim] > 0).reshape(own.num_rows, tables, bits)
            cells = (inside.astype(np.int64) << np.arange(bits)).sum(2)
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array(list(cells), pa.list_(pa.int64()))], names=["id", "dim", "cells"])


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turns: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column(3).to_numpy()
        for dim in np.unique(dims).tolist():
            own = batch.filter(pa.array(dims == dim))
            if dim not in turns:
                turns[dim] = rotation(dim)
            codes, factors, queries, scales = encode(_units(own.column(1), dim), turns[dim])
            binary = [pa.array([x.tobytes() for x in rows], pa.binary()) for rows in (codes, queries)]
            yield pa.RecordBatch.from_arrays([own.column(0), binary[0], pa.array(factors), binary[1], pa.array(scales), own.column(2)], names=["ball", "code", "factor", "query", "scale", "radius"])


def _bounded(rows: pa.Table, threshold: float) -> pa.Table:
    """Pairs of a cell's balls whose members' inner product may reach the threshold by the codes' bounds.

    Rows of two shares (columns i < j of their numbers) are compared across, those of one (i = j) among themselves.
    """
    ball, share = rows.column("ball").to_numpy(), rows.column("share").to_numpy()
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    left, right = np.flatnonzero(share == i), np.flatnonzero(share == j)
    names = ["a", "b"]
    if not len(left) or not len(right):
        return pa.table({n: pa.array([], pa.int64()) for n in names})
    code, query = (np.stack([np.frombuffer(x, kind) for x in rows.column(c).to_pylist()]) for c, kind in (("code", np.uint8), ("query", np.int8)))
    factor, scale, radius = (rows.column(c).to_numpy() for c in ("factor", "scale", "radius"))
    dim, base = query.shape[1], math.acos(threshold)

    def may(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """By the codes of x and the rounded vectors of y."""
        with_radius = np.minimum(base + radius[x][:, None] + radius[y][None], math.pi)
        least, side = np.cos(with_radius), np.sin(with_radius)
        room = EPSILON * np.sqrt(np.maximum(1 - factor[x] ** 2, 0)) / factor[x] / math.sqrt(max(dim - 1, 1))
        return estimates(code[x], factor[x], query[y], scale[y]) >= least - room[:, None] * side - 1e-4 - scale[y][None] * EPSILON

    keep = may(left, right) & may(right, left).T
    x, y = np.nonzero(keep)
    x, y = ball[left[x]], ball[right[y]]
    if i == j:
        x, y = x[x < y], y[x < y]
    once = np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)]), axis=0)
    once = once[once[:, 0] < once[:, 1]]
    return pa.table({n: pa.array(np.ascontiguousarray(c)) for n, c in zip(names, once.T)})


def _decide(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """a, b and whether all members are linked; pairs that lie wholly apart go. null: the members must be compared."""
    most = math.acos(threshold)
    for b in batches:
        p, q = b.column("p").to_pylist(), b.column("q").to_pylist()
        r, s = b.column("r").to_numpy(), b.column("s").to_numpy()
        cosine = np.array([float(np.frombuffer(x, "<f8") @ np.frombuffer(y, "<f8")) if len(x) == len(y) else -2.0 for x, y in zip(p, q)])
        single = (r == 0) & (s == 0)
        apart = angle(cosine)
        all_in = np.where(single, cosine >= threshold, apart + r + s <= most - SLACK)
        none_in = np.where(single, cosine < threshold, apart - r - s > most + SLACK) | (cosine == -2)
        keep = ~none_in
        sure = pa.array(all_in[keep], mask=~all_in[keep])
        yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep)), sure], names=["a", "b", "sure"])


def _blocks(rows: pa.Table) -> pa.Table:
    return pa.table({"ball": rows.column("ball").slice(0, 1), "ids": pa.array([rows.column("id").to_pylist()], pa.list_(pa.int64())), "copies": pa.array([rows.column("copies").to_pylist()], pa.list_(pa.int64())), "vecs": pa.array([b"".join(rows.column("vec").to_pylist())], pa.binary())})


def _compared(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """id, n: how many rows of the other block each member is linked to; and a, b once where any are."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            x, y = (np.frombuffer(row[c], "<f8").reshape(len(row[i]), -1) for c, i in (("p", "ids_a"), ("q", "ids_b")))
            near = x @ y.T >= threshold
            counts = [near @ np.array(row["copies_b"], np.int64), near.T @ np.array(row["copies_a"], np.int64)]
            ids, n = np.array([*row["ids_a"], *row["ids_b"]], np.int64), np.concatenate(counts)
            ids, n = ids[n > 0], n[n > 0]
            a, b = (pa.array([row[c]] + [None] * (len(ids) - 1), pa.int64()) for c in ("a", "b")) if len(ids) else (pa.array([], pa.int64()),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), a, b], names=["id", "n", "a", "b"])


def near_vectors(df: DataFrame, key: str, vector: str, threshold: float = 0.95, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """One row per input row: the key, n_links (other rows with a cosine of the threshold or more), component_id (the least key
    that links lead to) and kept (whether that is the row's own key).

    Vectors that are null or zero, or hold null or non-finite components, link with nothing, nor do vectors of different
    lengths with each other. Equal vectors are linked and compared once; repeated rows count like any others. Links are exact
    where they are found; MISSED and EPSILON bound what is not. Null keys take part, but name no component unless all of its
    keys are null. An empty table gives an empty one. Other columns, whatever their names, are not read. 0 < threshold < 1.
    """
    spark, most = df.sparkSession, math.acos(threshold) / 2 - SLACK
    kind = df.schema[key].dataType.simpleString()
    narrow = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = stored(narrow.mapInArrow(_read, f"key {kind}, {_CLASS}"))
    valid = rows.filter("digest is not null")
    classes = stored(valid.groupBy("digest").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"), F.first("dim").alias("dim")).withColumn("id", F.monotonically_increasing_id()))
    n = classes.count()

    singles = classes.select("id", F.col("vec").alias("pivot"), F.lit(0.0).alias("radius"), F.lit(1).cast("long").alias("size"), "dim", F.lit(0).cast("long").alias("sign"))
    signed = singles.mapInArrow(_signed, "id long, pivot binary, radius double, size long, dim int, sign long")
    step = _gathered(signed, n, most, 0)
    of, heads = step.select("id", "ball"), stored(_heads(step))
    before, now, turns = n, heads.count(), 0
    while now < 0.99 * before:
        turns += 1
        step = _gathered(heads, now, most, 13 * turns % 63)
        of = of.join(step.select(F.col("id").alias("ball"), F.col("ball").alias("next")), "ball").select("id", F.col("next").alias("ball"))
        heads = stored(_heads(step))
        before, now = now, heads.count()
    members = stored(classes.select("id", "least", "copies").join(of, "id"))

    tables, bits = cells_for(n, threshold, cell)
    placed = classes.select("id", "vec", "dim").mapInArrow(lambda it: _in_cells(it, tables, bits), "id long, dim int, cells array<long>")
    in_cells = placed.join(members.select("id", "ball"), "id").select("dim", "ball", F.posexplode("cells").alias("t", "cell")).distinct()
    codes = heads.select(F.col("id").alias("ball"), "pivot", "radius", "dim").mapInArrow(_coded, _CODED)
    in_cells = stored(in_cells.join(codes, "ball"))
    where = ["t", "cell", "dim"]
    shares = stored(in_cells.groupBy(where).agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("shares")).filter("shares > 1"))
    mine = F.pmod(F.xxhash64("ball"), F.col("shares").cast("long")).cast("int")
    own = in_cells.join(shares, where, "left").withColumn("shares", F.coalesce("shares", F.lit(1))).withColumn("share", mine)
    tiles = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumns({"i": F.least("share", "other"), "j": F.greatest("share", "other")}).drop("other", "shares")
    found = tiles.groupBy(*where, "i", "j").applyInArrow(lambda t: _bounded(t, threshold), "a long, b long").distinct()

    pivots = heads.select("id", "pivot", "radius")
    ends = found.join(pivots.toDF("a", "p", "r"), "a").join(pivots.toDF("b", "q", "s"), "b")
    decided = stored(ends.mapInArrow(lambda it: _decide(it, threshold), "a long, b long, sure boolean"))
    weights = stored(members.groupBy("ball").agg(F.sum("copies").alias("weight"), F.count(F.lit(1)).alias("members"), F.min("least").alias("least")))
    sure, open_ = decided.filter("sure"), decided.filter("sure is null").select("a", "b")
    both = sure.select("a", "b").unionByName(sure.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(weights.select(F.col("ball").alias("b"), "weight"), "b").groupBy("a").agg(F.sum("weight").alias("linked")).withColumnRenamed("a", "ball")

    links, exact = sure.select("a", "b"), None
    if open_.head(1):
        asked = open_.select(F.explode(F.array("a", "b")).alias("ball")).distinct()
        share = F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / block).cast("long"))
        of_asked = members.select("id", "ball", "copies").join(asked, "ball").join(weights.select("ball", "members"), "ball").withColumn("share", share)
        blocks = stored(of_asked.join(classes.select("id", "vec"), "id").select("ball", "share", "id", "copies", "vec").groupBy("ball", "share").applyInArrow(_blocks, "ball long, ids array<long>, copies array<long>, vecs binary"))
        pairs = open_.join(blocks.toDF("a", "ids_a", "copies_a", "p"), "a").join(blocks.toDF("b", "ids_b", "copies_b", "q"), "b")
        compared = stored(pairs.mapInArrow(lambda it: _compared(it, threshold), "id long, n long, a long, b long"))
        exact = compared.groupBy("id").agg(F.sum("n").alias("exact"))
        links = links.unionByName(compared.filter("a is not null").select("a", "b"))

    roots = connected(links).toDF("ball", "root")
    rooted = weights.join(roots, "ball", "left").join(linked, "ball", "left").select("ball", "weight", "least", F.coalesce("root", "ball").alias("root"), F.coalesce("linked", F.lit(0)).alias("linked"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    rooted = rooted.join(least, "root").select("ball", "component", (F.col("weight") - 1 + F.col("linked")).alias("n"))
    known = members.select("id", "ball").join(rooted, "ball")
    if exact is not None:
        known = known.join(exact, "id", "left").withColumn("n", F.col("n") + F.coalesce("exact", F.lit(0)))
    known = classes.select("id", "digest").join(known.select("id", "component", "n"), "id").drop("id")
    done = valid.select("key", "digest").join(known, "digest").select("key", "n", "component")
    done = done.unionByName(rows.filter("digest is null").select("key", F.lit(0).cast("long").alias("n"), F.col("key").alias("component")))
    return done.select(F.col("key").alias(key), F.col("n").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.col("key").eqNullSafe(F.col("component")).alias("kept"))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the signs of their pivots."""
    turns: dict[int, np.ndarray] = {}
    for batch in batches:
        dims, sign = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int64)
        for dim in np.unique(dims).tolist():
            own = np.flatnonzero(dims == dim)
            if dim not in turns:
                turns[dim] = rotation(dim)
            sign[own] = _sign(_units(batch.column("pivot").take(pa.array(own)), dim), turns[dim])
        yield batch.set_column(batch.schema.get_field_index("sign"), "sign", pa.array(sign))
