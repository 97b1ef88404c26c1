"""Encoding, secrets, sketches, sharding: each against another way to the same result."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orthobox.llm import bpe, registry, secrets, sharding, sketch

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Null and empty texts, repeated rows, a null key, ties, and columns whose names operators use themselves.
ODD = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", "x"), (None, "zürich  \n", "x"), (4, "a b", None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, shard string").withColumns({c: F.lit("clash") for c in ("t", "score", "spans", "fp", "k", "key", "n", "words", "doc")}).cache()


def brute_bpe(piece, coder):
    parts = [coder.byte_ids[b] for b in piece]
    while True:
        ranks = [(coder.ranks.get(a << coder.shift | b, bpe.NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        if not ranks or min(ranks)[0] == bpe.NONE:
            return parts
        rank, i = min(ranks)
        parts[i : i + 2] = [coder.merged[rank]]


def test_bpe_is_the_library():
    coder, library, r = bpe.Codec(PATH), Tokenizer.from_file(PATH), random.Random(1)
    pool = "aAbZ zé²½Ⅷ٣字 \t\n\r\x0b\x1c\x1f\x85\xa0 'sdrellmtv🎉́_-9 0"
    for i in range(3000):
        text = "".join(r.choice(pool) for _ in range(r.randint(0, 30))) + "<|endoftext|>y" * (i % 9 == 0)
        expected = library.encode(text, add_special_tokens=False).ids
        got = coder.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == expected, repr(text)
        assert coder.decode(got) == library.decode(expected, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["ab" * 700, "x" * 1000, "the" * 400, "".join(random.Random(2).choice("abcdehtonr") for _ in range(3000))])
def test_long_pieces(text):
    coder = bpe.Codec(PATH)
    assert coder.merge_long(text.encode()) == brute_bpe(text.encode(), coder)
    assert coder.merge_long(text[:200].encode()) == coder.merge(text[:200].encode())


def test_bpe_rows(spark, odd):
    rows = bpe.encode_texts(odd, ["doc_id"], "text", PATH).collect()
    assert len(rows) == len(ODD)
    assert collections.Counter(r["decoded"] for r in rows) == collections.Counter(t or "" for _, t, _ in ODD)
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert bpe.encode_texts(odd.limit(0), ["doc_id"], "text", PATH).count() == 0


def brute_secrets(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A | re.I) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_secrets_are_the_patterns():
    r, parts = random.Random(3), ["password", "Secret", "tokEn", "api_key", "APIKEY", "ſecret", " ", "=", ":", '"', "'", "AKIA", "ABCD1234EFGH5678", "é", "0123456789abcdef", "deadbeef", "x/y+z", "\n", "abc", "AKIAKIA"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    for text, found in zip(texts, secrets.scan(pa.array([t.encode() for t in texts], pa.binary()))):
        assert [x for x in found if x[1] < 3] == brute_secrets(text), repr(text)


def test_entropy():
    r = random.Random(4)
    text = "".join(r.choice("abcdef012 é") for _ in range(200))
    for i, h in enumerate(secrets.entropy_windows(text, 20)):
        counts = collections.Counter(text[i : i + 20])
        assert h == pytest.approx(-sum(c / 20 * math.log2(c / 20) for c in counts.values()))
    key = "q7Zx2LmP9vTr4KsW8nBc3DfG6hJk"
    found = secrets.scan(pa.array([f"see é {key} there".encode(), b"internationalizationalisms and-so-on-and-so-forth-it-goes 0f8fad5b-d9cb-469f-a165-70867728950e"], pa.binary()))
    assert found[0] == [(6, 3, 6 + len(key))] and found[1] == []
    assert secrets.scan(pa.array([key.encode()], pa.binary()), allowed=[key])[0] == []
    assert secrets.scan(pa.array([b"g7" * 20], pa.binary()))[0] == []


def test_candidates_of_any_kind_take_little_time():
    import time

    r = random.Random(3)
    texts = ["0" * 21 + "a1f", "a" * 21, "A" * 500 + "1", "x" * 10_000 + "1", "AbcDef" * 2000 + "1", "ab-cd_" * 2000 + "1a1", "-" * 10_000 + "1a", "a" + "-" * 10_000 + "1a1", "1" * 10_000 + "a", "=" * 10_000]
    texts += ["".join(r.choice("abcdefgh") for _ in range(10_000)) + "1", "".join(r.choice("abcXYZ019+/") for _ in range(1 << 20)), "password = " * 20_000, "token" + " " * 100_000 + "x=1"]
    start = time.process_time()
    found = secrets.scan(pa.array([t.encode() for t in texts], pa.binary()))
    assert time.process_time() - start < 10 and found[0] == [(0, 2, 24)] and not found[1] and not found[2]


def test_letters_alone_are_judged_by_entropy():
    word, name = "qzjxkvbwmfhpgydtrcnlsae", "Kraftfahrzeughaftpflichtversicherung"
    placeholder = "/docs/example/see/the/tests/and/the/tests/of/tests/Zx9Qp2Lm8Kd4Vt7Rw3Yb"
    found = secrets.scan(pa.array([x.encode() for x in (word, name, "AnExampleWordList", placeholder)], pa.binary()))
    assert found[0] == [(0, 3, 23)] and not found[2] and found[3]


def test_secret_rows(spark, odd):
    assert secrets.scan_texts(odd, ["doc_id", "spans"], "text").columns[-1] == "spans_" and secrets.scan_texts(odd.limit(0), ["doc_id"], "text").count() == 0
    rows = secrets.scan_texts(odd, ["doc_id"], "text").collect()
    assert len(rows) == len(ODD) and all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)
    docs = spark.createDataFrame([(1, "é token=abcdef12 b", 99, "s"), (2, None, None, "s"), (3, "clean", 5, "s")], "doc_id long, text string, n_chars long, spans string")
    assert sorted(map(tuple, secrets.redact_rows(docs, "text", "n_chars").collect())) == [(1, "é [SECRET] b", 12, "s"), (2, None, None, "s"), (3, "clean", 5, "s")]


def brute_shingles(text, width):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_sketches_estimate():
    from orthobox.llm._rows import Tables

    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(1500)) for _ in range(4)]
    texts += [texts[0][: len(texts[0]) * 2 // 3] + texts[1][-2000:], texts[2][: len(texts[2]) // 20], "", "One  two", "one two"]
    made = sketch.sketches(pa.array([t.encode() for t in texts], pa.binary()), 5, 0.25, Tables())
    shingled = [brute_shingles(t, 5) for t in texts]
    for i in range(6):
        for j in range(6):
            both = len(shingled[i] & shingled[j])
            assert sketch.likeness(made[i], made[j]) == pytest.approx(both / len(shingled[i] | shingled[j]), abs=0.08)
    assert sketch.containment(made[5], made[2]) > 0.8 and sketch.containment(made[2], made[5]) < 0.2
    assert len(made[6].hashes) == 0 and len(made[7].hashes) == 1 and made[7].hashes.tolist() == made[8].hashes.tolist()
    assert sketch.likeness(made[6], made[6]) == 1 and sketch.likeness(made[6], made[0]) == 0
    for i in range(9):  # a merged sketch is that of the shingles together
        for j in range(9):
            every = np.unique(np.concatenate([sketch.shingles(pa.array([texts[k].encode()], pa.binary()), 5, Tables())[0] for k in (i, j)]))
            together, got = sketch._sketch(every, 0.25), sketch.merge(made[i], made[j], 0.25)
            assert got.whole == together.whole and got.hashes.tolist() == together.hashes.tolist()


@pytest.mark.parametrize("words", [5, 7, 10, 20, 60, 100])
def test_containment_of_contained_texts(words):
    from orthobox.llm._rows import Tables

    r, known = random.Random(words), 0
    for _ in range(100):
        long = [f"w{r.randrange(4000)}" for _ in range(3000)]
        at = r.randrange(3000 - words)
        a, b = sketch.sketches(pa.array([" ".join(x).encode() for x in (long[at : at + words], long)], pa.binary()), 5, 0.25, Tables())
        share = sketch.containment(a, b)
        assert share in (None, 1.0) and sketch.likeness(a, a) == 1 and sketch.containment(a, a) == 1
        known += share == 1.0
    assert known >= 100 * (1 - 0.75 ** (words - 4)) - 15


def test_sketches_do_not_depend_on_the_batch():
    from orthobox.llm._rows import Tables

    texts = [b"a b c d e f g", b"", b"x", b"  a b  c d e f g ", b" ".join(b"%d" % (i % 70) for i in range(3000)), b" ".join(b"%d" % (i % 50) for i in range(3000)), b" ".join(b"%d" % i for i in range(300))]
    alone = [sketch.sketches(pa.array([t], pa.binary()), 5, 0.25, Tables())[0] for t in texts]
    for x, y, t in zip(sketch.sketches(pa.array(texts, pa.binary()), 5, 0.25, Tables()), alone, texts):
        every = np.unique(sketch.shingles(pa.array([t], pa.binary()), 5, Tables())[0])
        assert x.whole == y.whole == (len(every) <= sketch.WHOLE) and x.hashes.tolist() == y.hashes.tolist() == (every if x.whole else every[every < sketch.limit_of(0.25)]).tolist()
    assert alone[0].hashes.tolist() == alone[3].hashes.tolist()


def test_next_is_brute_force(spark):
    from orthobox.llm._rows import Tables

    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(30 if i % 3 else 3000)}" for _ in range(r.choice([0, 1, 4, 30, 200, 900]))) for i in range(60)]
    rows = [(i, t if i % 17 else None) for i, t in enumerate(texts)] + [(60, texts[59]), (61, "\u00e9 " * 100_000)]
    got = {x["doc_id"]: x for x in sketch.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "doc_id", "text").collect()}

    def sketched(t):
        every = set(sketch.shingles(pa.array([t.encode()], pa.binary()), 5, Tables())[0].tolist())
        return every, len(every) <= 64, {x for x in every if x < 1 << 62}

    def compared(a, b):
        x, y = (a[0], b[0]) if a[1] and b[1] else (a[2], b[2])
        like = len(x & y) / len(x | y) if x | y else float(not a[0] and not b[0])
        return like, (len(x & y) / len(x) if x else None if a[0] else 1.0)

    order = [(i, t or "") for i, t in rows[::-1]]
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        m = len(t) // 3
        new = t[: len(t) - m] + following[:m]
        own, changed, beside = sketched(t), sketched(new), sketched(following)
        want = (len(t), hashlib.sha256(new.encode()).hexdigest(), *["-+"[s[1]] + "".join(f"{x:016x}" for x in sorted(s[0] if s[1] else s[2])) for s in (own, changed)], *compared(own, changed)[:1], *compared(own, beside)[:1], compared(own, changed)[1])
        assert tuple(got[i][c] for c in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "in_edited")) == want


@pytest.mark.parametrize("parts", [1, 7])
def test_next_documents(spark, parts):
    r = random.Random(6)
    rows = [(i * 3, "".join(r.choice("ab é\n") for _ in range(r.randint(0, 40)))) for i in range(120)]
    shuffled = rows[:]
    r.shuffle(shuffled)
    got = {x["doc_id"]: x for x in sketch.compare_with_next(spark.createDataFrame(shuffled, "doc_id long, text string").repartition(parts), "doc_id", "text").collect()}
    order = rows[::-1]
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        m = len(t) // 3
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - m] + following[:m]).encode()).hexdigest()
        assert got[i]["n_chars"] == len(t)


def test_next_of_odd_rows(spark, odd):
    for df, n in ((odd, len(ODD)), (odd.limit(0), 0), (odd.filter("doc_id is null"), 1), (odd.filter("doc_id = 2"), 1)):
        assert sketch.compare_with_next(df, "doc_id", "text").count() == n


def test_shards(spark, odd):
    docs = spark.createDataFrame([(i, "é" * (i % 5) or None) for i in range(3000)], "doc_id long, text string")
    rows = sharding.shard_records(docs, "doc_id", "text", [1.0] * 5 + [2.0]).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        text = ("é" * (r["doc_id"] % 5)).encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 8, zlib.crc32(text))
        key = xxhash.xxh64_intdigest(xxhash.xxh64_digest(f"k{r['doc_id']}".encode(), 42)[::-1], 42)
        scores = []
        for s, w in enumerate([1.0] * 5 + [2.0, 1.0]):
            u = ((xxhash.xxh64_intdigest(int(s).to_bytes(4, "little"), key) >> 11) + 0.5) / 2**53
            scores.append((-w / math.log(u), -s))
        assert r["shard"] == -max(scores[:6])[1] and r["grown_shard"] == -max(scores)[1]
        assert r["grown_shard"] in (r["shard"], 6)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert 1.5 < len(by[5]) / (3000 / 7) < 2.5 and all(abs(len(by[s]) / (3000 / 7) - 1) < 0.25 for s in range(5))
    strange = sharding.shard_records(odd, "doc_id", "text", [1.0, 0.0, 1.0]).collect()
    assert len(strange) == len(ODD) and {r["shard"] for r in strange} <= {0, 2}
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit(1), [])


def test_registered(spark):
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in registry.queries()}
