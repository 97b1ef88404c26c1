"""Conversation structure repair over a bidirectional tight-arc DAG.

A conversation's rows in order, and the state of the roles put out so far, span a graph: from row i in state s, Delete leads
to row i + 1 in s, Keep and Rerole to row i + 1 in the next state, and Insert to row i in the next state. Forward costs (from
the start) and backward costs (to an accepted end) say which arcs lie on a cheapest way: those whose ends' costs and own cost
add up to the least of all. From the start, a frontier of states then takes, letter by letter, the least letter that has
such an arc. Only deterministic letters occur, so the text of the repaired rows follows from the letters.

Conversations of up to ROWS rows and BYTES bytes are solved whole, many in a task. Longer ones are cut into segments that any
task may hold. Their costs are 4 x 4 tables (state to state), which are composed in one pass from the last segment to the
first; all segments are then solved side by side for each state they may begin in, a pass over them picks that state, and
each is solved again for it. Only the digest and the edits' letters, which are one value, are put together in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthobox.llm._rows import free_name, small_batches
from orthobox.llm._shared import stored

#: Rows and bytes of a conversation that is solved whole, and of a segment of a longer one (a longer text is one by itself).
ROWS, BYTES = 1024, 8 << 20
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
INF = 1 << 60
#: States: nothing yet, after the system's row, the user's, the assistant's; and what an inserted or reroled row is in each.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = ("user", "user", "assistant", "user")
#: The least cost from each state to an accepted end.
END = (0, 2 * INSERT, INSERT, 0)
LEGAL = ("su", "ua", "au")
FAULTS = ("", "blank", "duplicate", "truncated")
_BLANK = " \t\n\x0b\x0c\r"
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def damage(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text and `gone` of the rows after seeded damage; null roles and texts are one space.

    The CRC-32 of `conv:turn` modulo 20 decides: 0 drops a row (gone, so that its conversation stays known), 1 empties its text,
    2 takes all of `.!?` out of it, 3 repeats it, 4 makes its role user.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(f"`{conv}`").cast("string"), space), F.lit(":"), F.coalesce(F.col(f"`{turn}`").cast("string"), space))
    rows = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), *[F.coalesce(F.col(f"`{c}`").cast("string"), space).alias(n) for c, n in ((role, "role"), (text, "text"))], (F.crc32(key) % 20).alias("way"))
    text_ = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), text_.alias("text"), "way")
    return rows.withColumn("_n", F.explode(F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv", "turn", "role", "text", (F.col("way") == 0).alias("gone"))


def _arcs(state: int, initial: str, must_go: bool, cut: bool) -> Iterator[tuple[str, int, int, int]]:
    """letter, rows passed, next state and cost of each way on from a row, in the letters' order."""
    more = TRUNCATED if cut else 0
    yield "D", 1, state, DELETE
    yield "I", 0, NEXT[state], INSERT
    if not must_go:
        if (state, initial) in KEPT:
            yield "K", 1, KEPT[state, initial], more
        yield "R", 1, NEXT[state], REROLE + more


def _settle(costs: list[int], forward: bool) -> list[int]:
    """The costs of a row's states with any inserts before it; three in a row reach all that any number does."""
    for _ in range(3):
        for s in range(4):
            if forward:
                costs[NEXT[s]] = min(costs[NEXT[s]], costs[s] + INSERT)
            else:
                costs[s] = min(costs[s], costs[NEXT[s]] + INSERT)
    return costs


def backward(initials: Sequence[str], faults: Sequence[int], end: Sequence[int]) -> list[list[int]]:
    """The least cost from each row and state, given that from the states after the last row."""
    out = [list(end)]
    for initial, fault in zip(reversed(initials), reversed(faults)):
        after = out[-1]
        out.append(_settle([min(c + after[t] for _, n, t, c in _arcs(s, initial, fault in (1, 2), fault == 3) if n) for s in range(4)], False))
    return out[::-1]


def forward(initials: Sequence[str], faults: Sequence[int], start: Sequence[int]) -> list[list[int]]:
    """The least cost to each row and state, given that to the states before the first row."""
    out = [list(start)]
    for initial, fault in zip(initials, faults):
        before, after = _settle(out[-1], True), [INF] * 4
        for s in range(4):
            for _, n, t, c in _arcs(s, initial, fault in (1, 2), fault == 3):
                if n:
                    after[t] = min(after[t], before[s] + c)
        out.append(after)
    return out


def solve(initials: Sequence[str], faults: Sequence[int], entry: int = START, end: Sequence[int] = END, last: bool = True) -> tuple[int, str, list[tuple[int, str | None]], int]:
    """Cost, letters, repaired rows (the row's number or -1, and its new role if any) and the state after them.

    entry: the state before the rows; end: costs from the states after them; last: whether inserts may follow them.
    """
    n = len(initials)
    ahead, behind = backward(initials, faults, end), forward(initials, faults, [0 if s == entry else INF for s in range(4)])
    if last:
        _settle(behind[n], True)
    total = ahead[0][entry]
    frontier, i, letters, rows = {entry}, 0, [], []
    while i < n or (last and min(ahead[n][s] for s in frontier)):
        ways: dict[str, set] = {}
        for s in frontier:
            arcs = _arcs(s, initials[i], faults[i] in (1, 2), faults[i] == 3) if i < n else [("I", 0, NEXT[s], INSERT)]
            for letter, passed, t, c in arcs:
                if behind[i][s] + c + ahead[i + passed][t] == total:  # a tight arc
                    ways.setdefault(letter, set()).add((passed, s, t))
        letter = min(ways)
        letters.append(letter)
        passed, s, _ = min(ways[letter])  # a letter leads from a state to one other, and names one role there
        frontier = {t for _, _, t in ways[letter]}
        if letter == "I":
            rows.append((-1, NAMES[s]))
        elif letter == "R":
            rows.append((i, NAMES[s]))
        elif letter == "K":
            rows.append((i, None))
        i += passed
    return total, "".join(letters), rows, min(frontier)


class Tally:
    """What is counted along a conversation's rows after damage, of one segment or several in order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None  # initials; turns

    def row(self, turn: int | None, initial: str, fault: int) -> None:
        if fault:
            setattr(self, FAULTS[fault], getattr(self, FAULTS[fault]) + 1)
        self._meet(initial)
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None:
            self._turn(turn, turn, 1)

    def _meet(self, initial: str) -> None:
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1

    def _turn(self, low: int, high: int, n: int) -> None:
        self.turns += n - (self.high == low)
        self.low, self.high = low if self.low is None else self.low, high

    def add(self, other: Tally) -> None:
        """The rows of another that come after these."""
        for f in (*FAULTS[1:], "illegal"):
            setattr(self, f, getattr(self, f) + getattr(other, f))
        if other.first is not None:
            self._meet(other.first)
            self.first, self.last = other.first if self.first is None else self.first, other.last
        if other.low is not None:
            self._turn(other.low, other.high, other.turns)

    def counts(self) -> list[int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]

    def packed(self) -> list:
        return [self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.low, self.high, self.first, self.last]

    @classmethod
    def unpacked(cls, values: Sequence) -> Tally:
        out = cls()
        out.blank, out.duplicate, out.truncated, out.illegal, out.turns, out.low, out.high, out.first, out.last = values
        return out


def repaired_text(rows: Sequence[tuple[int, str | None]], roles: Sequence[str], texts: Sequence[str]) -> str:
    """The repaired rows as `role:text`, a line each; inserted ones have no text."""
    return "\n".join(f"{name if name is not None else roles[i]}:{texts[i] if i >= 0 else ''}" for i, name in rows)


def _same(x, y) -> bool:
    return x == y or (x != x and y != y)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[list]]]:
    """Each conversation of sorted rows, and the columns of its rows."""
    key, rows = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        start = 0
        for i, x in enumerate(columns[0]):
            if rows is not None and _same(x, key):
                continue
            if rows is not None:
                yield key, [r + c[start:i] for r, c in zip(rows, columns)]
            key, rows, start = x, [[] for _ in columns], i
        if rows is not None:
            rows = [r + c[start:] for r, c in zip(rows, columns)]
    if rows is not None:
        yield key, rows


def _with_duplicates(roles: Sequence[str], texts: Sequence[str], faults: Sequence[int]) -> list[int]:
    """The rows' first faults: blank, else seen before, else truncated."""
    seen, out = set(), []
    for role, text, fault in zip(roles, texts, faults):
        out.append(2 if fault != 1 and (role, text) in seen else fault)
        seen.add((role, text))
    return out


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[list] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out))
        arrays = [pa.array(columns[0], kind)] + [pa.array(c, pa.int64()) for c in columns[1:7]] + [pa.array(c, pa.string()) for c in columns[7:]]
        return pa.RecordBatch.from_arrays(arrays, names=["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

    def typed() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for b in batches:
            kind = b.schema.field(0).type
            yield b

    kind = None
    for key, (_, turns, roles, texts, faults, gone) in _runs(typed()):
        stay = [i for i, g in enumerate(gone) if not g]
        turns, roles, texts, faults = ([x[i] for i in stay] for x in (turns, roles, texts, faults))
        faults, initials, tally = _with_duplicates(roles, texts, faults), [r[:1] for r in roles], Tally()
        for row in zip(turns, initials, faults):
            tally.row(*row)
        cost, letters, rows, _ = solve(initials, faults)
        out.append([key, *tally.counts(), cost, letters, hashlib.sha256(repaired_text(rows, roles, texts).encode()).hexdigest()])
        if len(out) == 10_000:
            yield flush()
            out.clear()
    if out:
        yield flush()


def repair(df: DataFrame, conv: str, turn: str, role: str, text: str, gone: Column | None = None, rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Rows are taken by turn (a whole number, nulls first), those of one turn by role and text, so repeated rows are adjacent.
    Null roles and texts are one space; a null conversation is one like others. A role that is empty has no initial and is
    never kept. Rows that are gone do not count, but keep their conversation in the result: with no others its counts are 0,
    its audit is empty, its digest that of no bytes. An empty table gives an empty one. Other columns are not read.
    Edits and their costs: Keep 0 (3 more for a truncated row), Rerole 3 (likewise), Delete 4 and required for blank and
    repeated rows, Insert 3. The kept roles' initials match (s?(ua)+)?; of the cheapest repairs, the one with the least letters.
    """
    spark = df.sparkSession
    small_batches(spark)
    text_ = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role, text)]
    data = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), text_[0].alias("role"), text_[1].alias("text"), (F.lit(False) if gone is None else gone).alias("gone"))
    solid = F.rtrim("text", F.lit(_BLANK))
    fault = F.when(solid == "", 1).when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    data = data.select("conv", "turn", "role", "text", fault.alias("fault"), "gone")
    own = F.octet_length("text").cast("long")
    sizes = data.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sum(own).alias("b"))
    large = stored(sizes.filter((F.col("n") > rows) | ((F.col("b") > most_bytes) & (F.col("n") > 1))).select(F.col("conv").alias("large")))
    some = bool(large.head(1))
    is_large = data["conv"].eqNullSafe(large["large"])
    small = data.join(large, is_large, "left_anti") if some else data
    kind = df.schema[conv].dataType.simpleString()
    done = small.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(_whole, f"conv {kind}, {_RESULT}")
    if some:
        done = done.unionByName(_long(data.join(large, is_large, "left_semi"), kind, rows, most_bytes))
    return done.withColumnRenamed("conv", conv if conv.lower() not in {c.lower() for c in done.columns[1:]} else free_name(conv, done.columns[1:]))


_SEGMENT = "seg long, tally array<string>, costs array<long>, roles array<string>, texts array<string>, faults array<int>"


def _packed(tally: Tally) -> list:
    return [None if x is None else str(x) for x in tally.packed()]


def _unpacked(values: Sequence) -> Tally:
    return Tally.unpacked([None if x is None else int(x) for x in values[:7]] + list(values[7:]))


def _segments(batches: Iterator[pa.RecordBatch], rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Segments of sorted rows conv, at, turn, role, text, fault: no longer than given, of one conversation each."""
    held, size, kind = [], 0, None

    def done() -> pa.RecordBatch:
        conv, at, _, roles, texts, faults = zip(*held)
        tally, initials = Tally(), [r[:1] for r in roles]
        for _, _, turn, role, _, fault in held:
            tally.row(turn, role[:1], fault)
        costs = []
        for t in range(4):
            costs += backward(initials, faults, [0 if s == t else INF for s in range(4)])[0]
        values = ([conv[0]], [at[0]], [_packed(tally)], [costs], [list(roles)], [list(texts)], [list(faults)])
        kinds = (kind, pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["conv", "seg", "tally", "costs", "roles", "texts", "faults"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            own = len(row[4].encode())
            if held and (not _same(held[0][0], row[0]) or len(held) >= rows or size + own > most_bytes):
                yield done()
                held, size = [], 0
            held.append(row)
            size += own
    if held:
        yield done()


def _fold(batches: Iterator[pa.RecordBatch], step, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows that step makes of each row and what it made of the row before, None where a conversation begins."""
    key = state = None
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if state is None or not _same(row[0], key):
                key, state = row[0], None
            made, state = step(row, state)
            out.append(made)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], names=schema.names)


def _long(data: DataFrame, kind: str, rows: int, most_bytes: int) -> DataFrame:
    """The same of conversations that are cut into segments."""
    from pyspark.sql.pandas.types import to_arrow_type

    arrow, parts = to_arrow_type(data.schema["conv"].dataType), int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", "turn", "role", "text"]
    placed = stored(data.filter("not gone").repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("gone"))
    sign = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    firsts = placed.groupBy("conv", sign.alias("sign")).agg(F.min("at").alias("first")).select("first")
    seen = placed.join(firsts, placed["at"] == firsts["first"], "left")
    seen = seen.select("conv", "at", "turn", "role", "text", F.when((F.col("fault") != 1) & F.col("first").isNull(), 2).otherwise(F.col("fault")).alias("fault"))
    cut = seen.repartitionByRange(parts, "at").sortWithinPartitions("at").mapInArrow(lambda it: _segments(it, rows, most_bytes), f"conv {kind}, {_SEGMENT}")
    cut = stored(cut)

    def folded(df: DataFrame, step, schema: str, up: bool) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        shape = to_arrow_schema(_parse_datatype_string(schema))
        sorted_ = df.repartition("conv").sortWithinPartitions("conv", F.asc("seg") if up else F.desc("seg"))
        return sorted_.mapInArrow(lambda it: _fold(it, step, shape), schema)

    def ends(row, after):
        """The costs from the states after a segment; the state is those from before it."""
        conv, seg, costs = row
        end = list(END) if after is None else after
        before = [min(min(costs[4 * t + s] + end[t] for t in range(4)), INF) for s in range(4)]
        return (conv, seg, end, after is None), _settle(before, False)

    behind = folded(cut.select("conv", "seg", "costs"), ends, f"conv {kind}, seg long, end array<long>, last boolean", False)
    cut = stored(cut.drop("costs").join(behind.drop("conv"), "seg"))

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for conv, seg, tally, roles, faults, end, last in zip(*(c.to_pylist() for c in b.columns)):
                initials = [r[:1] for r in roles]
                nexts = [solve(initials, faults, s, end, last)[3] for s in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((conv, arrow), (seg, pa.int64()), (nexts, pa.list_(pa.int32())))], names=["conv", "seg", "nexts"])

    def enter(row, state):
        entry = START if state is None else state
        return (row[0], row[1], entry), row[2][entry]

    narrow = cut.select("conv", "seg", "tally", "roles", "faults", "end", "last")
    entries = folded(narrow.mapInArrow(exits, f"conv {kind}, seg long, nexts array<int>"), enter, f"conv {kind}, seg long, entry int", True)

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "seg", "tally", "cost", "letters", "lines"]
        kinds = [arrow, pa.int64(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            for conv, seg, tally, roles, texts, faults, end, last, entry in zip(*(c.to_pylist() for c in b.columns)):
                cost, letters, made, _ = solve([r[:1] for r in roles], faults, entry, end, last)
                values = (conv, seg, tally, cost, letters, repaired_text(made, roles, texts) if made else None)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    whole = cut.join(entries.drop("conv"), "seg").select("conv", "seg", "tally", "roles", "texts", "faults", "end", "last", "entry")
    pieces = whole.mapInArrow(repaired, f"conv {kind}, seg long, tally array<string>, cost long, letters string, lines string")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tally, cost, letters, digest, any_line = None, None, 0, [], None, False

        def done() -> pa.RecordBatch:
            values = [key, *tally.counts(), cost, "".join(letters), digest.hexdigest()]
            kinds = [arrow, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

        for b in batches:
            for conv, _, packed, total, more, lines in zip(*(c.to_pylist() for c in b.columns)):
                if tally is None or not _same(conv, key):
                    if tally is not None:
                        yield done()
                    key, tally, cost, letters, digest, any_line = conv, Tally(), total, [], hashlib.sha256(), False
                tally.add(_unpacked(packed))
                letters.append(more)
                if lines is not None:
                    digest.update(("\n" if any_line else "").encode() + lines.encode())
                    any_line = True
        if tally is not None:
            yield done()

    made = pieces.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(joined, f"conv {kind}, {_RESULT}")
    lost = data.groupBy("conv").agg(F.min("gone").alias("all_gone")).filter("all_gone")
    none = lost.select("conv", *[F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.lit("").alias("audit"), F.lit(_EMPTY_SHA).alias("repaired_sha256"))
    return made.unionByName(none)
