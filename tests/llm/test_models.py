"""Trained models: gradients, held-out accuracy, odd rows; and the pipeline stage by stage."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orthobox.llm import kneser_ney, language, registry, secrets, sketch, toxicity
from orthobox.llm._rows import Tables

SF = "/root/testdata/sf0.01"


def test_backpropagation_through_time():
    net, r = language.Network.fresh(["a", "b", "c"], hidden=3, dtype=np.float64), np.random.default_rng(0)
    codes, labels = r.integers(0, 256, (5, 7)).astype(np.int16), np.array([0, 1, 2, 1, 0])
    codes[2, 4:] = language.PAD
    _, grads = net.loss(codes, labels)
    for p, g in zip(net.parameters(), grads):
        for _ in range(15):
            at = tuple(int(r.integers(0, s)) for s in p.shape)
            at = (at[0], int(r.choice(codes.ravel())), at[2]) if p is net.x else at
            old, values = p[at], []
            for step in (1e-6, -1e-6):
                p[at] = old + step
                values.append(net.loss(codes, labels)[0])
            p[at] = old
            assert (values[0] - values[1]) / 2e-6 == pytest.approx(g[at], abs=1e-7)


def test_spans_hold_every_byte():
    texts = [b"", b"x" * 64, b"y" * 65, b"", b"ab"]
    codes, row = language.spans(pa.array(texts, pa.binary()))
    back = [b"".join(bytes(c[c != language.PAD].astype(np.uint8)) for c in codes[row == i]) for i in range(5)]
    assert back == texts and codes.shape == (4, 64)
    assert language.has_letter(pa.array([b"", b"12 ?", "é".encode(), "字1".encode(), "²½".encode(), b"a"], pa.binary())).tolist() == [False, False, True, True, False, True]


def test_language_held_out(spark):
    rows = registry.op4_bigru_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert np.mean(held) > 0.97


def test_language_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "hello there", "en", "x"), (2, None, "en", "x"), (None, "", None, "x"), (3, "123 !", "de", "x"), (3, "123 !", "de", "x")], "doc_id long, text string, lang string, score string")
    net = language.fit(df, "doc_id", "text", "lang", F.lit(True))
    got = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in language.label_texts(df, ["doc_id"], "text", net).collect()), key=str)
    assert [x for x in got if x[1] == "und"] == sorted([(2, "und", 0.0), (None, "und", 0.0), (3, "und", 0.0), (3, "und", 0.0)], key=str) and len(got) == 5
    many = spark.createDataFrame([(i, f"text {'abcdefgh'[i % 8] * 9} {i % 70}", f"l{i % 70:02}") for i in range(700)] + [(1, "text", "l01")] * 300, "doc_id long, text string, lang string")
    assert len(language.fit(many, "doc_id", "text", "lang", F.lit(True), per_language=5).languages) == 70
    empty = language.fit(df.limit(0), "doc_id", "text", "lang", F.lit(True))
    assert {r["lang_pred"] for r in language.label_texts(df, ["doc_id"], "text", empty).collect()} == {"und"}


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = registry.op1_nnpu_toxicity(spark, SF).join(labels, "doc_id", "left").collect()
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    toxic, clean = ([r["predicted"] for r in rows if r["held_out"] and r["toxic"] == y] for y in (1, 0))
    assert np.mean(toxic) > 0.7 and np.mean(clean) < 0.03


def test_nnpu_separates():
    r = np.random.default_rng(1)
    y = r.random(3000) < 0.2
    x = (r.random((3000, 12)) < np.where(y[:, None], 0.5, 0.02) * np.array([1] * 6 + [0] * 6) + np.array([0] * 6 + [0.3] * 6)).astype(np.float32)
    w, bias = toxicity.train_nnpu(x[y][:200], x, 0.2)
    # The best decision, given the rates: two or more of the six features that toxic rows have more often.
    assert np.mean((x @ w + bias > 0) == (x[:, :6].sum(1) >= 2)) > 0.97


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "vile scum", "x"), (2, None, "x"), (None, "", "x"), (3, "fine words", "x"), (3, "fine words", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None), (3, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, "doc_id", "text", "toxic", F.lit(True))
    assert toxicity.score_texts(docs, ["doc_id", "score"], "text", model).columns == ["doc_id", "score", "score_"]
    absent = spark.createDataFrame([(9, 1), (1, 0)], "doc_id long, toxic int")
    for given, marked in ((docs.limit(0), labels), (docs, absent), (docs.limit(0), labels.limit(0))):
        assert toxicity.score_texts(docs, ["doc_id"], "text", toxicity.fit(given, marked, "doc_id", "text", "toxic", F.lit(True))).filter("score < 0.5").count() == 5
    many = docs.unionByName(docs.filter("doc_id = 1").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("i"))
    assert toxicity.fit(many, labels, "doc_id", "text", "toxic", F.lit(True), max_positive=5, max_unlabelled=5).bias == model.bias  # one row a key
    assert toxicity.score_texts(docs, ["doc_id"], "text", model).filter("score between 0 and 1").count() == 5
    for none in (toxicity.fit(docs, labels.limit(0), "doc_id", "text", "toxic", F.lit(True)), toxicity.fit(docs, labels.filter("toxic = 0"), "doc_id", "text", "toxic", F.lit(True))):
        assert none.score(pa.array([b"vile scum"], pa.binary()), Tables())[0] < 0.5


def test_run_is_brute_force(spark):
    """The whole pipeline, each stage by the plainest way to its result."""
    import hashlib

    import corpus_pipeline as pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from tests.llm.test_corpora import brute_one_of_each, oracle

    sf = "/root/testdata/sf0.001"
    docs, labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model, tables = toxicity.fit(docs, labels, "doc_id", "text", "toxic", F.lit(True)), Tables()
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows = sorted((k, t) for k, t in rows if model.score(pa.array([(t or "").encode()], pa.binary()), tables)[0] < pipeline.TOXIC)
    rows = brute_one_of_each(rows)
    hit = {x[0] for x in oracle(spark.createDataFrame(rows, "doc_id long, text string"), items) if x[5]}
    library, expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for k, t in rows:
        if k not in hit:
            masked = secrets.redacted(t or "", secrets.scan(pa.array([(t or "").encode()], pa.binary()))[0], "[SECRET]")
            ids = library.encode(masked, add_special_tokens=False).ids
            expected[k] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in pipeline.run(spark, sf).collect()} == expected


def test_stages_of_an_empty_table(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0).withColumns({c: F.lit("x") for c in ("score", "sha", "share", "t", "spans", "k", "key_", "hash_")})
    for name, stage in pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert got.count() == 0 and (name == "bpe" or got.columns == docs.columns)


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        got = stage(spark, docs, SF)
        if name != "bpe":
            assert got.columns == docs.columns
        got = spark.createDataFrame(got.toPandas(), got.schema) if name != "bpe" else got
        seen.append({r["doc_id"]: r["text"] for r in got.collect()} if name != "bpe" else {r["doc_id"]: r["decoded_sha256"] for r in got.collect()})
        docs = got
    clean, unique, whole, masked, encoded = seen
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([labels[i] == 0 for i in clean if i in labels]) > 0.97
    assert sum(labels.get(i) == 0 for i in clean) == sum(y == 0 for y in labels.values())
    assert len(set(unique.values())) == len(unique) and set(unique) <= set(clean)
    assert set(clean.values()) >= set(unique.values()) and set(masked) == set(whole) == set(encoded) and set(whole) <= set(unique)
    assert not any("AKIA" in t for t in masked.values()) and not any(secrets.scan(pa.array([t.encode() for t in masked.values()], pa.binary())))
    import hashlib

    assert all(encoded[i] == hashlib.sha256(t.encode()).hexdigest() for i, t in masked.items())


def test_random_bytes_of_text_do_not_break_hashes():
    r = random.Random(1)
    texts = [bytes(r.choice(b"ab \n") for _ in range(r.randint(0, 30))) for _ in range(50)]
    h, row = toxicity.features(pa.array(texts, pa.binary()), Tables())
    alone = [set(toxicity.features(pa.array([t], pa.binary()), Tables())[0].tolist()) for t in texts]
    assert [set(h[row == i].tolist()) for i in range(50)] == alone


@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
def test_self_similar_words_differ(n):
    """The Thue-Morse word and its complement are equal to every polynomial modulo 2 ** 64."""
    word = bytes(97 + i.bit_count() % 2 for i in range(n))
    other = bytes(195 - b for b in word)
    tables = Tables()
    texts = pa.array([word, other, word + b" " + other, other], pa.binary())
    h, row = kneser_ney.tokens(texts, tables)
    assert len(set(h.tolist())) == 3 and h[row == 0][0] != h[row == 1][0] and (h[row == 2][:2] == [h[row == 0][0], h[row == 1][0]]).all() and h[row == 3][0] == h[row == 1][0]
    own, of = toxicity.features(texts, tables)
    assert own[of == 0][0] != own[of == 1][0]
    shingle, of = sketch.shingles(texts, 5, tables)
    assert shingle[of == 0] != shingle[of == 1] and shingle[of == 1] == shingle[of == 3]


def test_language_model_of_many_partitions(spark):
    """Rows between tasks follow the input's splits, not their square; and merged runs are those of one go."""
    texts = spark.createDataFrame([(i, f"a b c{i % 50} d{i % 7}") for i in range(4000)], "k long, t string")
    one, many = (sorted(map(tuple, kneser_ney.score_texts(texts, ["k"], "t", kneser_ney.train(texts.repartition(p), "t")).collect())) for p in (1, 400))
    assert one == many
    runs = [np.unique(np.random.default_rng(i).integers(0, 1000, 300).astype(np.uint64), return_counts=True) for i in range(20)]
    key, n = kneser_ney._merged(iter(runs))
    want = np.bincount(np.concatenate([k for k, _ in runs]).astype(np.int64), weights=np.concatenate([c for _, c in runs]))
    assert key.tolist() == np.flatnonzero(want).tolist() and n.tolist() == want[want > 0].astype(int).tolist()


def test_training_bytes_are_bounded(spark, monkeypatch):
    rows = [(i, "wort " * (20 + i) if i % 2 else "word " * (20 + i), "de" if i % 2 else "en") for i in range(60)]
    seen = []
    monkeypatch.setattr(language, "train", lambda codes, of, names: seen.append((len(codes), names)) or language.Network.fresh(names))
    df = spark.createDataFrame(rows, "k long, t string, l string")
    for most in (64 << 20, 2000, 1):
        language.fit(df, "k", "t", "l", F.lit(True), most_bytes=most)
    assert [n for _, n in seen] == [["de", "en"]] * 3 and seen[0][0] > seen[1][0] > seen[2][0] > 0
