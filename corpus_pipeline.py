"""A corpus pipeline in stages: quality rules, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the docs of the
next. All but the last return the columns of docs, whatever further ones there are and however they are named.

Defined cases, for all stages: a null text is an empty text without words, which the quality rules drop; a null source
is a host and a source of its own; documents with a null doc_id are judged as one document by the quality rules and by
near duplicates, and each by itself after that; rows that repeat a doc_id go or stay together up to decontamination, and
each is mixed and written by itself; an empty table gives no rows. Each stage's docstring says what becomes of texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pigmenta import ship
from pigmenta.llm import common, decontaminate, minhash, mixing, quality, tokens
from pigmenta.llm.queries import tokenizer_path

#: The tokenizer can't be said in SQL; tests/llm/test_pipeline.py compares the stages with plain Python.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't depleted by boilerplate lines, without these lines.

    n_chars is set anew. A doc_id goes if any of its rows fails.
    """
    ship(spark)
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the smallest doc_id: five words a shingle, a similarity of 0.8.

    Documents without words are no duplicates; ties can't be, as all rows of the smallest doc_id stay.
    """
    ship(spark)
    return minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly such passages go. A null text stays null.

    n_chars is set anew.
    """
    ship(spark)
    return decontaminate.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the target mix of sources, repeats as further rows, parts as texts of the words that are taken.

    Documents without words give none.
    """
    return mixing.take(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document, read back from the token files; a null text is the end id."""
    ship(spark)
    path = common.scratch_dir(spark)
    tokens.write_tokens(docs, path, str(tokenizer_path()))
    return tokens.read_ids(spark, path).select("doc_id", "start", "n_tokens", "ids")


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("source mix", source_mix), ("token files", token_files)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents of sf_dir, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.staged(docs)
    return docs
