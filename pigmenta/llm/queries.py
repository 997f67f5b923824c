"""The registered queries of the corpus operators: production parameters, whole tables, digest columns."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from . import common as C
from . import conversations, decontaminate, licenses, lm, minhash, mixing, phrases, pii, quality, repeats, shards, tokens
from .oracles import ORACLES as ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file lies on this machine; TOKENIZER_DIR overrides the installed package."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_quality(_table(spark, sf_dir, "documents"))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = C.scratch_dir(spark)
    tokens.write_tokens(_table(spark, sf_dir, "documents"), path, str(tokenizer_path()))
    return tokens.token_digests(spark, path)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), n=3, pct=85)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.shard(_table(spark, sf_dir, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_bytes(_table(spark, sf_dir, "documents"))


def op9_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.remove_repeated_sentences(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_sentences", "n_removed", "n_spans", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(_table(spark, sf_dir, "conversations")))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_tokens": op2_tokens,
    "op3_minhash": op3_minhash,
    "op4_personal_data": op4_personal_data,
    "op5_decontamination": op5_decontamination,
    "op6_shards": op6_shards,
    "op7_language_model": op7_language_model,
    "op8_suffixes": op8_suffixes,
    "op9_sentences": op9_sentences,
    "op10_mixing": op10_mixing,
    "op11_conversations": op11_conversations,
    "op12_phrases": op12_phrases,
    "op13_licenses": op13_licenses,
}
