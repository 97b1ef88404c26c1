"""Conversation repair against all edits of short conversations and against a search over longer ones."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from orthobox.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, gaps int, audit string"
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        role = "user" if way == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(way, 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = text.strip(SPACE)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_edit(rows, faults):
    """Least cost, letters and lines over all edits with up to two inserts in a place."""
    gaps = [p for n in range(3) for p in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    for plan in itertools.product(*[x for f in faults for x in (gaps, ["D"] if f in ("blank", "duplicate") else ["D", "K", "user", "assistant"])], gaps):
        cost, letters, lines, initials = 0, "", [], ""
        for k, step in enumerate(plan):
            if isinstance(step, tuple):
                cost, letters, lines, initials = cost + 3 * len(step), letters + "I" * len(step), lines + [f"{x}:" for x in step], initials + "".join(x[0] for x in step)
                continue
            _, role, text = rows[k // 2]
            letters += step if step in "DK" else "R"
            cost += 4 if step == "D" else (0 if step == "K" else 3) + 3 * (faults[k // 2] == "truncated")
            if step != "D":
                role = role if step == "K" else step
                lines, initials = lines + [f"{role}:{text}"], initials + (role[:1] or "-")
        if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, letters) < best[:2]):
            best = cost, letters, "\n".join(lines)
    return best


def searched(rows, faults):
    """The same by the least (cost, letters) to each place, over the initials put out last."""
    best = {"": (0, "", [])}
    grammar = {"": "su", "s": "u", "u": "a", "a": "u"}

    def insert(at):
        for _ in range(3):
            for s, (c, w, x) in list(at.items()):
                for t in grammar[s].replace("s", ""):
                    new = (c + 3, w + "I", [*x, {"u": "user:", "a": "assistant:"}[t]])
                    at[t] = min(at.get(t, new), new)
        return at

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for s, (c, w, x) in insert(best).items():
            ways = [(s, (c + 4, w + "D", x))]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                ways += [(role[:1], (c + more, w + "K", [*x, f"{role}:{text}"]))] if role[:1] and role[:1] in grammar[s] else []
                ways += [(t, (c + 3 + more, w + "R", [*x, {"u": "user:", "a": "assistant:"}[t] + text])) for t in grammar[s].replace("s", "")]
            for t, new in ways:
                after[t] = min(after.get(t, new), new)
        best = after
    cost, letters, lines = min(v for k, v in insert(best).items() if k in ("", "a"))
    return cost, letters, "\n".join(lines)


def expected(original, rows, solver):
    out = {}
    for conv in {r[0] for r in original}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, turns = faults_of(own), [r[0] for r in own if r[0] is not None]
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, letters, text = solver(own, faults)
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256(text.encode()).hexdigest())
    return out


def made(spark, chat, **limits):
    df = spark.createDataFrame([(*r, 0, "x") for r in chat], SCHEMA).repartition(3)
    got = conversations.repair(conversations.damage(df, "conv_id", "turn", "role", "text"), "conv", "turn", "role", "text", F.col("gone"), **limits).collect()
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: tuple(r)[1:] for r in got}


def chats(seed, n, most):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in sorted(rng.sample(range(most * 2), rng.randint(1, most))):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["a.", "b!", "c", "", None, " \n", "é? \t", "d.", "e.", "x" * 300 + "?"])
            rows += [(conv, rng.choice([turn] * 9 + [None]), role, text)] * rng.choice([1, 1, 1, 2])
    return rows


def test_short_conversations_equal_all_edits(spark):
    rng = random.Random(1)
    for _ in range(40):
        rows = [(i, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b", "", "c!"])) for i in range(rng.randint(0, 3))]
        faults = faults_of(rows)
        cost, letters, lines, _ = conversations.solve([r[1][:1] for r in rows], [conversations.FAULTS.index(f) for f in faults])
        assert (cost, letters, conversations.repaired_text(lines, [r[1] for r in rows], [r[2] for r in rows])) == every_edit(rows, faults) == searched(rows, faults)


def test_repair_equals_a_search(spark):
    rows = chats(2, 150, 9)
    want = expected(rows, damaged(rows), searched)
    assert made(spark, rows) == want
    assert made(spark, rows, rows=3) == want  # most conversations in segments
    assert made(spark, rows, most_bytes=5) == want
    assert made(spark, []) == {}


def test_a_conversation_of_many_rows_and_a_long_text(spark):
    rng = random.Random(4)
    rows = [(1, i, rng.choice(["user", "assistant", "assistant"]), f"{i % 1700}{rng.choice('.!x')}") for i in range(4000)] + [(2, 0, "user", "y" * 3_000_000 + "."), (2, 1, "assistant", "z.")]
    assert made(spark, rows, rows=256) == expected(rows, damaged(rows), searched)
