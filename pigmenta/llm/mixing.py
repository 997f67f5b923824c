"""Operator 10, mixing sources to target weights: Sainte-Lague apportionment, in DataFrame operations alone.

The words to take are shared by weight; a source's target stops at max_repeat times its size and the excess goes to the
others by weight. Blocks of equally many words are allocated to the sources by highest quotients target / (2 * seats + 1),
down to the quotient that is worth half a block; the house is as many seats as that gives. A block has block_words words,
or fewer, so that the smallest target has some `finest` of them and no source is far from its target.

The documents are dealt to seeded shards. The documents of a source are laid end to end, shard by shard and in a seeded
order within each, and cut into such blocks once over the whole source, so that only its last block is shorter. A quota
of over all blocks takes all of them once or more, and the rest of it picks blocks at even seeded steps. Each shard's
quota is the difference of two whole numbers at its ends, so what rounding leaves is carried to the next shard, and what
a document gives is the sum over its words, by arithmetic on its place: no block becomes a row.

Sizes of shards follow the data, so a window never holds more than some shard_rows documents, whatever the sources.
Where a shard begins in a source is summed up in two steps, over groups of shards and within them. There is a row a
source in the table of targets, which one task makes; it is staged, and Spark broadcasts it by its size.

Defined cases: a null or empty text has size 0 and gives 0 words; a null source is a source, last in order; rows that
repeat a doc_id are documents of their own, in one shard; those with a null doc_id are dealt by their text; an empty
table gives no rows; other columns are ignored by mix() and kept by take().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_pct: int = 150, max_repeat: int = 2) -> DataFrame:
    """source, source_size and target of each source of sizes(source, size); one row a source.

    Water filling: with sources in order of cap / weight, the capped ones are a prefix, and the level is what is left
    over the weight that is left.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kind = (F.row_number().over(order) - 1) % len(weights) + 1
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), kind)).withColumn("cap", F.col("source_size") * max_repeat)
    every, filled = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(every) * (share_pct / 100.0)
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("place", F.row_number().over(filled)).withColumn("level", left / weight)
    # the first source that its level doesn't fill, and with it all later ones
    by = by.withColumn("open", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(every))
    target = F.when(F.col("place") >= F.col("open.place"), F.col("open.level") * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return by.select("source", "source_size", target.alias("target"))


def seats(targets: DataFrame, block_words: int, finest: int = 16) -> tuple[DataFrame, int]:
    """targets(source, source_size, target) with blocks and quota, the seats of each source, and the words of a block."""
    least = targets.where("target > 0").agg(F.min("target")).first()[0]
    words = max(1, min(block_words, int((least or 0) // finest)))
    blocks = F.expr(f"(source_size + {words - 1}) div {words}")
    # quotients target / (2 * k - 1) for k = 1, 2, ... that are at least half a block
    return targets.withColumns({"blocks": blocks, "quota": F.least(F.floor(F.col("target") / words + 0.5), blocks * 2)}), words


#: Shards that are summed up together.
GROUP = 1024


def _origins(cells: DataFrame) -> DataFrame:
    """_shard, _source and origin of cells(shard, source, words): the words of the source in all shards before."""
    cells = cells.withColumn("_group", F.expr(f"shard div {GROUP}"))
    before = Window.partitionBy("source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = cells.groupBy("source", "_group").agg(F.sum("words").alias("words")).select(F.col("source").alias("_source"), F.col("_group").alias("_of"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("source", "_group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_more", F.coalesce(F.sum("words").over(within), F.lit(0)))
    cells = cells.join(groups, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_group") == F.col("_of")))
    return cells.select(F.col("shard").alias("_shard"), "_source", (F.col("_base") + F.col("_more")).alias("origin"))


def _seed(column: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("-"))).cast("binary"))


def _given(at: str, block_words: int) -> str:
    """SQL: words that the picks take of the first `at` words of the source."""
    j = f"({at} div {block_words})"
    upto = f"((({j} + offset) * rest) div blocks)"
    after = f"((({j} + 1 + offset) * rest) div blocks)"
    return f"(({upto} - ((offset * rest) div blocks)) * {block_words} + ({after} - {upto}) * ({at} % {block_words}))"


def _placed(docs: DataFrame, sized: DataFrame, block_words: int, shard_rows: int, seed: int, weights: tuple[int, ...], share_pct: int, max_repeat: int) -> tuple[DataFrame, int]:
    """sized(doc_id, source, size, key, ...) with target, taken and what take() needs to know, and the words of a block."""
    targets = C.staged(source_targets(sized, weights, share_pct, max_repeat))
    quotas, words = seats(targets, block_words)
    offset = F.conv(F.substring(_seed(F.coalesce("source", F.lit("-")), seed), 1, 8), 16, 10).cast("long")
    some = F.greatest("blocks", F.lit(1))
    quotas = quotas.select(F.col("source").alias("_s"), "source_size", "target", some.alias("blocks"), F.expr("case when blocks > 0 then quota div blocks else 0 end").alias("passes"), F.expr("case when blocks > 0 then quota % blocks else 0 end").alias("rest"), (offset % some).alias("offset"))
    shards = max(1, -(-sized.count() // shard_rows))
    sized = sized.withColumn("shard", F.conv(F.substring("key", 1, 12), 16, 10).cast("long") % shards)
    origins = _origins(sized.groupBy("shard", "source").agg(F.sum("size").alias("words")))
    stream = Window.partitionBy("shard", "source").orderBy("key", "doc_id", "size", "tie")
    rows = sized.withColumn("end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(origins, (F.col("shard") == F.col("_shard")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_shard", "_source")
    rows = rows.withColumn("end", F.col("end") + F.col("origin")).withColumn("begin", F.col("end") - F.col("size"))
    rows = rows.join(quotas, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return rows.withColumn("taken", F.expr(f"passes * size + {_given('end', words)} - {_given('begin', words)}")), words


def _sized(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORDS)).cast("long")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(F.encode(text, "UTF-8"))))
    return C.staged(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), _seed(name, seed).alias("key"), F.xxhash64(text).alias("tie"), *more))


def mix(docs: DataFrame, block_words: int = 16, shard_rows: int = 500, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, share_pct: int = 150, max_repeat: int = 2) -> DataFrame:
    """doc_id, size, source_size, target and taken of each document."""
    rows, _ = _placed(docs, _sized(docs, seed), block_words, shard_rows, seed, weights, share_pct, max_repeat)
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def take(docs: DataFrame, block_words: int = 64, shard_rows: int = 500, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, share_pct: int = 150, max_repeat: int = 2) -> DataFrame:
    """The mixed documents, with the columns of docs: whole copies for full passes, and the words in picked blocks.

    A partly picked document keeps its picked words, joined by single spaces; n_chars, if there, is set anew.
    """
    sized = _sized(docs, seed, F.struct(*docs.columns).alias("given"))
    rows, words = _placed(docs, sized, block_words, shard_rows, seed, weights, share_pct, max_repeat)
    rows = rows.where("taken > 0").withColumn("text", F.col("given.text").cast("string"))
    picked = F.expr(f"array_join(filter(regexp_extract_all(text, '{WORDS}', 0), (w, i) -> {_given('(begin + i + 1)', words)} - {_given('(begin + i)', words)} > 0), ' ')".replace("\\", "\\\\"))
    copies = F.expr("case when passes > 0 then sequence(1, int(passes)) else array() end || case when taken > passes * size then array(0) else array() end")
    rows = rows.withColumn("copy", F.explode(copies)).withColumn("words", F.when((F.col("copy") > 0) | (F.col("taken") - F.col("passes") * F.col("size") == F.col("size")), F.col("text")).otherwise(picked))
    out = {"text": F.col("words")} | ({"n_chars": F.length("words").cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    return rows.select(*[out.get(c, F.col("given")[c]).alias(c) for c in docs.columns])
