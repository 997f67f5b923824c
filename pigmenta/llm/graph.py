"""Connected components of a table of links, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Parts that what hooks to one node is dealt to.
SALTS = 8


def components(links: DataFrame) -> DataFrame:
    """id and component of every id in links(a, b); a component is named by its smallest id.

    Each round hooks every node to its smallest neighbour, follows the hooks twice, and contracts the links; the links
    shrink until none is left, in about as many rounds as the logarithm of the longest path. Rounds are staged tables,
    each deleted when the next is there. Minima are taken before shuffles; in the joins a node with very many links has
    its rows on one side and one row on the other. Those that follow hooks are salted; beyond that, adaptive execution
    splits them (spark.sql.adaptive.skewJoin).
    """
    edges = C.staged(links.select("a", "b").where("a <> b").distinct())
    known = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("to"))
        for _ in range(2):
            up = hook.select(F.col("id").alias("to"), F.col("to").alias("top"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
            hook = hook.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(up, ["to", "salt"]).select("id", F.col("top").alias("to"))
        hook = C.staged(hook)
        if known is None:
            known = hook.select("id", F.col("to").alias("component"))
        else:
            up = hook.select(F.col("id").alias("component"), "to")
            before, known = known, C.staged(known.join(up, "component", "left").select("id", F.coalesce("to", "component").alias("component")))
            C.drop(before)
        moved = edges.join(hook.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(hook.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        before, edges = edges, C.staged(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        C.drop(before)
    return known if known is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
