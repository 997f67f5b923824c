"""Operator 6, sharding: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to n-1 in doc_id order. A keyed Feistel network permutes the smallest power of four that holds n;
positions of n or more are walked on until they fall below n, which gives a permutation of 0 to n-1. The position of
a row is its place in the reproducible shuffle: shard = position % shards, slot = position // shards. Shards differ by
one row at most and slots have no gaps. position_of and row_at compute either way without any table.

Defined cases: a null or empty text has size 1 and crc 0; rows that repeat a doc_id are numbered by size and crc, and
full copies of a row take neighbouring numbers; null doc_ids come first; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

_U = np.uint64
ROUNDS = 4


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    mask = _U((1 << bits) - 1)
    left, right = x >> _U(bits), x & mask
    for k in keys:
        left, right = right, left ^ (C.mix(right + _U(k)) & mask)
    return (left << _U(bits)) | right


def _inverse(x: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    mask = _U((1 << bits) - 1)
    left, right = x >> _U(bits), x & mask
    for k in reversed(keys):
        left, right = right ^ (C.mix(left + _U(k)) & mask), left
    return (left << _U(bits)) | right


def _keys(seed: int) -> list[int]:
    return [int(k) for k in C.mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed % (1 << 64)))]


def _walk(step, x: np.ndarray, n: int, seed: int) -> np.ndarray:
    bits, keys = _half_bits(n), _keys(seed)
    out = step(np.asarray(x).astype(np.uint64), bits, keys)
    while len(far := np.flatnonzero(out >= _U(n))):
        out[far] = step(out[far], bits, keys)
    return out.astype(np.int64)


def position_of(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The shuffled position of each row number below n."""
    return _walk(_network, rows, n, seed)


def row_at(positions: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The row number at each shuffled position: the inverse of position_of."""
    return _walk(_inverse, positions, n, seed)


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """rows with row_number, gapless from 0 in the given order, and their count.

    One range shuffle; then only the count of each partition, a row a partition, is summed.
    """
    ranged = C.staged(rows.repartitionByRange(C.ranges(rows), *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    out = ranged.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("row_number", F.col("_before") + at)
    return out.drop("_id", "_part", "_before"), ranged.count()


def _placer(n: int, shards: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = position_of(b.column(3).to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array((at % shards).astype(np.int32)), pa.array(at // shards)], names=["doc_id", "size", "text_crc32", "row_number", "position", "shard", "slot"])

    return run


def shard(docs: DataFrame, shards: int = 16, seed: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, row_number, position, shard and slot of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows, n = numbered(rows, "doc_id", "size", "text_crc32")
    schema = "doc_id long, size long, text_crc32 long, row_number long, position long, shard int, slot long"
    return rows.select("doc_id", "size", "text_crc32", "row_number").mapInArrow(_placer(n, shards, seed), schema)
