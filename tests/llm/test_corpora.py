"""Operators over whole corpora against brute force."""

import collections
import hashlib
import itertools
import math
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orthobox.llm import decontamination, kneser_ney, near_copies, repeats, simhash
from orthobox.llm.components import connected


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def classes(n, links):
    low = list(range(n))
    for _ in range(n):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + r.randint(0, 40), 200 + r.randint(0, 40)) for _ in range(25)] + [(300, 300)]
    got = {x["node"]: x["root"] for x in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    low = classes(301, links)
    assert got == {i: low[i] for a, b in links if a != b for i in (a, b)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bucket", [20_000, 4])
def test_links_join_all_within_tau(spark, bucket):
    r = random.Random(2)
    fps = {r.getrandbits(64) for _ in range(30)}
    for x in list(fps):
        for _ in range(6):
            y = x
            for b in r.sample(range(64), r.randint(0, 5)):
                y ^= 1 << b
            fps.add(y)
    fps = sorted(fps)
    links = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3]
    low = classes(len(fps), links)
    signed = [simhash._signed(x) for x in fps]
    roots = {x["node"]: x["root"] for x in connected(simhash.find_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, bucket)).collect()}
    made = [roots.get(x, x) for x in signed]
    assert len(set(zip(low, made))) == len(set(low)) == len(set(made))


def test_masks_cover():
    for parts, ts in (([range(16 * i, 16 * i + 16) for i in range(4)], [0, 0, 0, 0]), ([range(32), range(32, 64)], [1, 1]), ([range(21), range(21, 42), range(42, 64)], [1, 0, 0])):
        masks = [m for bits, t in zip(parts, ts) for m in simhash.masks_of(list(bits), t)]
        r = random.Random(3)
        for _ in range(300):
            x = sum(1 << b for b in r.sample(range(64), 3))
            assert any(not x & m for m in masks)
    cost, ts = simhash.allocate([[0, 5, 9, 99, 999], [0, 1, 50, 99, 999], [0, 5, 6, 99, 999]], 3)
    assert sum(t + 1 for t in ts) == 4 and cost == min(sum(c[k] for c, k in zip([[0, 5, 9, 99, 999], [0, 1, 50, 99, 999], [0, 5, 6, 99, 999]], ks)) for ks in itertools.product(range(5), repeat=3) if sum(ks) == 4)


def test_fingerprint_by_definition():
    import xxhash

    for text in ("", "One", "a B c", "a b c d a b c d", "é x\x0by\x1cz w", "q " * 50):
        words = text.encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert int(simhash.fingerprints([text.encode()], 3)[0]) == expected


def test_near_duplicates_of_odd_rows(spark):
    rows = [(5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (9, None), (8, ""), (None, "a b c d"), (None, "alone here"), (7, "x " * 3000)]
    df = frame(spark, rows)
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (9, 8), (8, 8), (None, 3), (None, None), (7, 7)], key=str)
    kept = near_copies.one_of_each(df.withColumn("key_", F.lit("clash")), "doc_id", "text").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(3, "a b c d"), (8, ""), (None, "alone here"), (7, "x " * 3000)], key=str)
    assert simhash.near_duplicates(df.limit(0), "doc_id", "text").count() == 0
    assert near_copies.one_of_each(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("size", [2000, 7])
def test_one_of_each_is_brute_force(spark, size):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(25):
        words = [r.choice(vocabulary) for _ in range(r.randint(20, 300))]
        rows.append(" ".join(words))
        for _ in range(r.randint(0, 12)):
            edited = words[:]
            for _ in range(r.randint(0, 8)):
                edited[r.randrange(len(edited))] = r.choice(vocabulary)
            rows.append(" ".join(edited))
            words = edited if r.random() < 0.3 else words
    ids = r.sample(range(10_000), len(rows))
    rows = sorted(zip(ids, rows))
    stay = brute_one_of_each(rows)
    got = near_copies.one_of_each(frame(spark, rows), "doc_id", "text", size=size).collect()
    assert sorted(map(tuple, got)) == stay


def test_decisions_of_many_rounds_stay_fast(spark):
    """A component of distinct documents, ten to a round: plans must not grow from round to round."""
    sets = [np.sort(np.array([hash((i, j)) & (1 << 62) - 1 for j in range(20)], '<u8')) for i in range(200)]
    members = spark.createDataFrame([(1, i, i * 7, bytearray(x.tobytes())) for i, x in enumerate([*sets, *sets[::3]])], 'root long, key_ long, hash_ long, shingles binary')
    began = time.time()
    assert sorted(r['key_'] for r in near_copies._decide(members, 0.8, 10, 1 << 20).collect()) == list(range(200))
    assert time.time() - began < 180


def test_a_hot_fingerprint_is_dealt_to_several_tasks(spark):
    rows = [(i, 'the same words again and again' if i % 3 else f'word{i} other{i} third{i} fourth{i}') for i in range(300)]
    plain, dealt = (sorted(map(tuple, simhash.near_duplicates(frame(spark, rows), 'doc_id', 'text', hot=h).collect())) for h in (1_000_000, 20))
    assert plain == dealt and len({r[2] for r in plain}) > 50


def brute_one_of_each(rows):
    """The rows that stay of rows (id, text), by all pairs."""
    sets, stay = {k: set(simhash.shingle_hashes(t.encode(), 5)) for k, t in rows}, []
    for k, t in sorted(rows):
        if not any(len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j]) for j, _ in stay):
            stay.append((k, t))
    return stay


@pytest.mark.parametrize("common, bucket", [(10, 20_000), (2, 20_000), (10, 3)])
def test_one_of_each_misses_no_kind_of_edit(spark, monkeypatch, common, bucket):
    monkeypatch.setattr(near_copies, "COMMON", common)
    monkeypatch.setattr(near_copies, "BUCKET", bucket)
    r = random.Random(31)
    say = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    line, texts = say(12), []
    for n in (6, 10, 14, 40, 300, 300, 1500):
        for _ in range(3):
            words = say(n) + (line if r.random() < 0.5 else [])
            m = len(words)
            at = r.randrange(m)
            texts += [words, words + say(max(1, m // 5)), words + say(max(1, m // 9)), say(m // 6) + words, words[: -(m // 6) or None], words[m // 7 :], words[:at] + say(m // 8 + 1) + words[at:]]
    rows = [(k, " ".join(t)) for k, t in zip(r.sample(range(10_000), len(texts)), texts)]
    stay = brute_one_of_each(rows)
    assert len(stay) < len(rows) - 20
    assert sorted(map(tuple, near_copies.one_of_each(frame(spark, rows), "doc_id", "text").collect())) == stay


def test_one_of_each_takes_repeats_once(spark):
    r = random.Random(32)
    words = [f"w{r.randrange(5000)}" for _ in range(300)]
    passage = words[100:160]
    rows = [(k, " ".join(words[:160] + passage * k + words[160:])) for k in (0, 1, 5, 20, 60)]
    stay = brute_one_of_each(rows)
    assert stay == rows[:1]
    assert list(map(tuple, near_copies.one_of_each(frame(spark, rows), "doc_id", "text").collect())) == stay


def brute_repeats(rows, depth):
    seen, out = set(), {}
    for k, t in sorted(rows):
        gone = bytearray(len(t))
        for s in range(len(t) - depth + 1):
            w = t[s : s + depth]
            if w in seen:
                gone[s : s + depth] = b"\1" * depth
            seen.add(w)
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[k] = (len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("depth, gram, group, least", [(12, 5, 8192, 10**6), (12, 5, 8192, 2), (20, 8, 2, 3), (100, 32, 8192, 4), (7, 7, 3, 10**6)])
def test_repeats_are_brute_force(spark, monkeypatch, depth, gram, group, least):
    """With every gram alone in its task, and with those that occur `least` times dealt to several."""
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    own = repeats.repeated_spans
    monkeypatch.setattr(repeats, "repeated_spans", lambda docs, *a: own(docs, *a, least_hot=least))
    r = random.Random(depth)
    base = ["".join(r.choice("abé") for _ in range(160)) for _ in range(5)] + ["a" * 250, "ab" * 120]
    rows = [(i, "".join(r.choice(base)[r.randint(0, 9) : r.randint(20, 250)] for _ in range(r.randint(0, 5)))) for i in range(120)] + [(500, None), (501, "")]
    expected = brute_repeats([(k, (t or "").encode()) for k, t in rows], depth)
    r.shuffle(rows)
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in repeats.remove_repeats(frame(spark, rows), "doc_id", "text", depth, gram, group).collect()}
    assert got == expected


def test_windows_around_a_common_line_are_no_rows(spark, monkeypatch):
    """Different windows that share a hot gram are dealt in bands; none crosses to a further step by itself."""
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    own, made = repeats.settled, []
    monkeypatch.setattr(repeats, "settled", lambda df: made.append(own(df)) or made[-1])
    r = random.Random(8)
    line = "".join(r.choice("abcdefgh ") for _ in range(50))
    rows = [(i, "".join(r.choice("abcdefgh ") for _ in range(90)) + line + "".join(r.choice("abcdefgh ") for _ in range(90))) for i in range(80)]
    rows += [(100, rows[3][1][40:200]), (101, rows[5][1][60:170])]
    expected = brute_repeats([(k, t.encode()) for k, t in rows], 100)
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in repeats.remove_repeats(frame(spark, rows), "doc_id", "text", 100, 32, 4).collect()}
    assert got == expected and expected[100][1] == 160
    assert made[-1].filter("kind = 1").count() == 0


def test_repeats_of_odd_keys(spark):
    long = "0123456789" * 3
    rows = [(1, long), (1, long), (1, "z" + long), (None, long), (None, None)]
    got = repeats.remove_repeats(frame(spark, rows), "doc_id", "text", 20, 8, kept=True).collect()
    assert len(got) == 5
    by = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got)
    assert by[None, 30, 30] == 1 and by[None, 0, 0] == 1
    first, second = sorted([long, "z" + long], key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    # Periodic text repeats itself: windows 10 later start later too.
    expected = {t: n for t, n in zip((first, second), (20 if first == long else 20, 30))}
    assert by[1, 30, expected[long]] == 2 and by[1, 31, expected["z" + long]] == 1
    assert repeats.remove_repeats(frame(spark, rows).limit(0), "doc_id", "text").count() == 0


def oracle(documents, items):
    con = duckdb.connect()
    con.register("documents", documents.toPandas())
    con.register("benchmark", items.toPandas())
    return sorted(con.sql(f"select doc_id, n_words, n_hit, n_items, items_sha256, contaminated from ({decontamination.ORACLE})").fetchall(), key=str)


@pytest.mark.parametrize("lengths, broadcast", [((1, 3, 5, 9, 10, 11, 14, 0), True), ((10, 12, 30), True), ((4, 10, 15), False)])
def test_decontamination_is_its_sql(spark, monkeypatch, lengths, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    r = random.Random(sum(lengths))
    say = lambda n: "".join(r.choice(["a", "b", "é", "Cc", "É", "x1"]) + r.choice([" ", "_", ". ", "\n"]) for _ in range(n))
    items = spark.createDataFrame([(i, say(r.choice(lengths))) for i in range(30)] + [(100, None), (101, "?"), (7, say(12))], "item_id long, text string")
    texts = [r["text"] or "" for r in items.collect()]
    docs = frame(spark, [(i, say(r.randint(0, 40)) + r.choice(texts) + say(r.randint(0, 9))) for i in range(150)] + [(900, None), (901, "")])
    got = sorted(map(tuple, decontamination.find_contamination(docs, "doc_id", "text", items, "item_id", "text").collect()), key=str)
    assert got == oracle(docs, items)
    clean = {x["doc_id"] for x in decontamination.clean_rows(docs, "text", items, "item_id", "text").collect()}
    assert clean == {x[0] for x in got if not x[5]}


def test_decontamination_of_odd_rows(spark):
    items = spark.createDataFrame([(None, "one two three"), (5, "four")], "item_id long, text string")
    docs = frame(spark, [(1, "zero ONE two, three"), (1, "zero ONE two, three"), (None, "four four"), (2, None)])
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontamination.find_contamination(docs, "doc_id", "text", items, "item_id", "text").collect()), key=str)
    assert got == sorted([(1, 4, 3, 0, True)] * 2 + [(None, 2, 2, 1, True), (2, 0, 0, 0, False)], key=str)
    assert decontamination.find_contamination(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0


def brute_kneser_ney(train, test):
    cut = lambda t: [*(t or "").encode().lower().split(), "END"]
    one, two = collections.Counter(), collections.Counter()
    for t in train:
        s = cut(t)
        one.update(s)
        two.update(zip(["START", *s[:-1]], s))
    n, v = sum(one.values()), len(one)
    lead = collections.Counter(w for _, w in two)
    big = kneser_ney.discounts([sum(c == k for c in two.values()) for k in (1, 2, 3, 4)])
    small = kneser_ney.discounts([sum(c == k for c in lead.values()) for k in (1, 2, 3, 4)])
    spread = sum(small[min(c, 3) - 1] for c in lead.values()) / len(two)
    freed, total = collections.Counter(), collections.Counter()
    for (u, _), c in two.items():
        freed[u] += big[min(c, 3) - 1]
        total[u] += c

    def p(u, w):
        low = (lead[w] - small[min(lead[w], 3) - 1] if lead[w] else 0) / len(two) + spread / (v + 1)
        return ((two[u, w] - big[min(two[u, w], 3) - 1] if two[u, w] else 0) + freed[u] * low) / total[u] if total[u] else low

    assert sum(p("START", w) for w in [*one, "never seen"]) == pytest.approx(1)
    return [(len(s), sum(one[w] > 0 for w in s), n, sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s), sum(math.log10(p(u, w)) for u, w in zip(["START", *s[:-1]], s))) for s in map(cut, test)]


@pytest.mark.parametrize("buckets, flush", [(1, 10**6), (5, 50)])
def test_language_model_is_brute_force(spark, monkeypatch, buckets, flush):
    monkeypatch.setattr(kneser_ney, "FLUSH", flush)
    r = random.Random(8)
    say = lambda: " ".join(r.choice(["the", "The", "of", "é", "ü\x1cx", *map(str, range(60))][: r.randint(3, 60)]) for _ in range(r.randint(0, 60)))
    train, test = [say() for _ in range(60)] + ["the the " * 300, None], [say() for _ in range(30)] + ["unseen words", None, ""]
    model = kneser_ney.train(frame(spark, list(enumerate(train))), "text", buckets)
    got = {x["doc_id"]: x for x in kneser_ney.score_texts(frame(spark, list(enumerate(test))), ["doc_id"], "text", model).collect()}
    for i, (n, known, total, base, score) in enumerate(brute_kneser_ney(train, test)):
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (n, known, total)
        assert got[i]["base_score"] == pytest.approx(base) and got[i]["score"] == pytest.approx(score)


def test_language_model_of_nothing(spark):
    df = frame(spark, [(1, None), (2, "a b")])
    got = kneser_ney.score_texts(df, ["doc_id"], "text", kneser_ney.train(df.limit(0), "text")).collect()
    assert all(r["score"] == 0 and r["base_score"] == 0 and r["train_tokens"] == 0 for r in got) and len(got) == 2
    assert np.isfinite([r["perplexity"] for r in got]).all()
