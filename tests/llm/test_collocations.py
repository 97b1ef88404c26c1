"""Phrase mining against counting everything."""

import random
import re
from collections import Counter, defaultdict

import pytest

from orthobox.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, n int"


def brute(rows, support, top):
    counts = defaultdict(Counter)
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            for n in range(1, 5):
                counts[lang if lang is not None else "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        chosen = {p for p in f if len(p) > 1 and f[p] >= support}
        covered = {p[i:j] for p in chosen for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * f[p] >= 80 * f[p[i:j]]}
        scored = []
        for p in chosen - covered:
            score, k = min((2000000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        total = sum(n for p, n in f.items() if len(p) == 1)
        out += [(lang, i, p.decode(), -a, l, r, total, -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "City", "é", "x\x00y", "日本", "a" * 50, "in", "Zürich", *[f"w{i}" for i in range(40)]]
    weights = [40, 30, *[5] * 9, *[1] * 40]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            words += rng.choice([["New", "York", "city"], ["the", "united", "STATES", "of"], ["la", "la", "la", "la", "la"]]) if rng.random() < 0.1 else rng.choices(vocabulary, weights)
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "; "]) for w in words)
        rows.append((i, rng.choice([text, text, text, text, "", None, "..", " "]) if i % 9 == 0 else text, rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows + rows[:20]


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA).repartition(4)
    got = collocations.mine_phrases(df, "text", "lang", **more)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("bits", [None, 6])
def test_equals_counting_everything(spark, bits):
    rows = texts(1, 500)
    want = brute(rows, 12, 15)
    assert len(want) > 40
    assert mined(spark, rows, support=12, top=15, bits=bits) == want


def test_a_long_text_in_shares(spark, monkeypatch):
    rows = [(0, " ".join(t for _, t, _ in texts(2, 400) if t), "en"), (1, "one two " * 3000, "en"), (2, None, "en")]
    monkeypatch.setattr(collocations, "PIECE_BYTES", 1000)
    monkeypatch.setattr(collocations, "AT_ONCE", 300)
    assert b"".join(collocations.shares(rows[0][1].encode(), 1000)).decode() == rows[0][1]
    assert all(len(x) <= 1000 for x in collocations.shares(("ab cd." * 999).encode(), 1000))
    assert mined(spark, rows, support=30, top=50) == brute(rows, 30, 50)
    assert mined(spark, []) == []


def test_counts_over_a_byte(spark):
    rows = [(i, "a b a b a b c", "en") for i in range(400)]
    assert mined(spark, rows, support=300) == brute(rows, 300, 2000)


def test_scores_are_exact_beyond_64_bits(spark):
    a = 9_000_000_000_000_000_001
    df = spark.createDataFrame([(a, a, a)], "a long, l long, r long").selectExpr("a", "cast(l as decimal(20,0)) + cast(r as decimal(20,0)) both")
    assert df.select(collocations._score("a", "both").alias("s")).first()["s"] == 2000000 * a // (2 * a)
