"""The registered query of each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthobox.llm import bpe, collocations, conversations, decontamination, embeddings, kneser_ney, language, repeats, secrets, sharding, simhash, sketch, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _fold(key: str, folds: int, held_out: int) -> Column:
    """Whether a key's text has the held-out remainder; null keys are never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == held_out, F.lit(False))


def op1_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, held_out = _read(spark, sf_dir, "documents"), _fold("doc_id", 3, 1)
    model = toxicity.fit(documents, _read(spark, sf_dir, "labels"), "doc_id", "text", "toxic", ~held_out)
    scored = toxicity.score_texts(documents, ["doc_id"], "text", model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(_read(spark, sf_dir, "documents"), "doc_id", "text", [1.0] * 24)


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(_read(spark, sf_dir, "documents"), "doc_id", "text", _read(spark, sf_dir, "benchmark"), "item_id", "text")


def op4_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, held_out = _read(spark, sf_dir, "documents"), _fold("doc_id", 4, 2)
    net = language.fit(documents, "doc_id", "text", "lang", ~held_out)
    return language.label_texts(documents, ["doc_id"], "text", net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_texts(_read(spark, sf_dir, "documents"), ["doc_id"], "text")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(_read(spark, sf_dir, "documents"), ["doc_id"], "text", public_tokenizers.path("byte_bpe_50k.json"), ids=False, decoded=False)


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, held_out = _read(spark, sf_dir, "documents"), _fold("doc_id", 10, 0)
    scored = kneser_ney.score_texts(documents, ["doc_id"], "text", kneser_ney.train(documents.filter(~held_out), "text"))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op8_simhash_gph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"), "doc_id", "text", width=3, tau=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compare_with_next(_read(spark, sf_dir, "documents"), "doc_id", "text")


def op10_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_read(spark, sf_dir, "documents"), "doc_id", "text")


def op11_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", threshold=0.95)


def op12_tight_arc_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(_read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return conversations.repair(damaged, "conv", "turn", "role", "text", F.col("gone")).withColumnRenamed("conv", "conv_id")


def op13_hashed_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(_read(spark, sf_dir, "documents"), "text", "lang", support=30, longest=4, top=2000)


_QUERIES = (op1_nnpu_toxicity, op2_rendezvous_sharding, op3_winnowing, op4_bigru_language, op5_entropy_secrets, op6_bpe, op7_kneser_ney, op8_simhash_gph, op9_scaled_sketch, op10_radix_repeats, op11_rotated_codes, op12_tight_arc_repair, op13_hashed_phrases)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_winnowing": decontamination.ORACLE}
