"""Intermediate tables in the shared folder of spark.checkpoint.dir: they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new place in the shared folder. Without the setting a session on one machine has a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints/pigmenta"
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df, written once and read from there on."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
