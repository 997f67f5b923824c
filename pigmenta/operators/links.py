"""What belongs together by links within an image: every node gets the least node it is connected to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged

#: Links up to which one task connects them (some 100 MB); more are contracted by joins.
ONE_TASK = 1_000_000


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of nodes 0 to n - 1 with links a to b, the least node that each is connected to."""
    up = np.arange(n)
    while len(a):
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(up, hi, lo)
        while not np.array_equal(up, higher := up[up]):
            up = higher
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return up


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [tuple(batch.column(c).to_numpy() for c in ("image_id", "a", "b")) for batch in batches]
    if not held:
        return
    image, a, b = (np.concatenate(x) for x in zip(*held, strict=True))
    nodes, at = np.unique(np.stack([np.concatenate([image, image]), np.concatenate([a, b])]), axis=1, return_inverse=True)
    at = at.reshape(-1)
    top = connected(nodes.shape[1], at[: len(a)], at[len(a) :])
    yield pa.RecordBatch.from_arrays([pa.array(nodes[0]), pa.array(nodes[1]), pa.array(nodes[1][top])], names=["image_id", "node", "top"])


def tops(pairs: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """image_id, node and top of every node in pairs(image_id, a, b).

    Few links, by their count, are connected in one task. Otherwise each round points every node to its least neighbour,
    follows the pointers twice, and keeps the links between different tops, until there are none; in between are tables.
    """
    nodes = "image_id long, node long, top long"
    links = staged(pairs.select("image_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct())
    left = links.count()
    if left <= one_task:
        return links.repartition(1).mapInArrow(_in_one_task, nodes) if left else links.sparkSession.createDataFrame([], nodes)
    known = None
    while left:
        both = links.unionByName(links.select("image_id", F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("image_id", F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("top"))
        for _ in range(2):
            higher = up.select("image_id", F.col("node").alias("top"), F.col("top").alias("_top"))
            up = up.join(higher, ["image_id", "top"]).select("image_id", "node", F.col("_top").alias("top"))
        up = staged(up)
        if known is None:
            known = up
        else:
            moved = up.select("image_id", F.col("node").alias("top"), F.col("top").alias("_top"))
            known = staged(known.join(moved, ["image_id", "top"], "left").select("image_id", "node", F.coalesce("_top", "top").alias("top")))
        for end in "ab":
            links = links.join(up.select("image_id", F.col("node").alias(end), F.col("top").alias("_top")), ["image_id", end]).drop(end).withColumnRenamed("_top", end)
        links = staged(links.select("image_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
        left = links.count()
    return known
