"""Operator 3, near duplicates by b-bit MinHash.

A document is its set of distinct word shingles. Documents with equal sets form a class, for which the smallest doc_id
stands. Of each class, bands * rows minima are taken; bands of minima give bucket keys, and of every minimum the low
b = 8 bits stay, packed into 64-bit words. Of two signatures the bits are compared at once (exclusive or, folded to one
bit a minimum) and counted; similarity is estimated from the share p of equal minima, corrected for chance:
(p - 2**-b) / (1 - 2**-b). Pairs whose estimate is not far below the threshold (six standard deviations) are confirmed
on the full sets.

Pairs are never spread out within a bucket. First every member is compared with the bucket's smallest id, and the
components of the links so found are taken. A bucket is finished if all but its first member are in one component.
In the others, members outside the largest component are compared with all members of other components, in blocks,
inside tasks, except pairs that an earlier band has in one bucket too; only links that join components leave a task. So
every pair of a bucket is either compared or already connected, however large the bucket. There are as many bands as it
takes for a pair at the threshold to miss all buckets less than once in 20 million (23 at 85 percent, 32 at 80); one of
a thousand million is lost to the estimate.

Defined cases: a null or empty text, or one without words, has an empty set, links with nothing and is kept; a text
of fewer words than a shingle is one shingle; rows that repeat a doc_id are one document with several sets, linked by
any of them; documents with a null doc_id take part as doc_id -2**63 and come back as null; an empty table gives
no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components

_U = np.uint64
_NO_ID = -(1 << 63)
ROWS, BITS = 4, 8
_multipliers = np.random.default_rng(7).integers(1, 1 << 63, 1 << 10, dtype=np.uint64) * _U(2) + _U(1)
SCAN = "id long, n_shingles long, s1 long, s2 long, bands array<long>, signature binary"


def shingle_sets(s: C.Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text of a slice, laid end to end, and their texts."""
    start, end, doc = s.words()
    h = C.hash_bytes(s.lower(), start, end, C.SEEDS[0])[0]
    words = np.bincount(doc, minlength=len(s))
    last = np.cumsum(words)
    at = np.flatnonzero(np.arange(len(h)) + n <= last[doc])
    few = np.flatnonzero((words > 0) & (words < n))
    key = np.concatenate([C.chain(*(h[at + j] for j in range(n))), C.hash_runs(h, (last - words)[few], last[few], C.SEEDS[0])[0]])
    doc = np.concatenate([doc[at], few])
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[new], doc[new]


def bands_for(pct: int, rows: int = ROWS, miss: float = 5e-8) -> int:
    """Bands with which a pair of pct percent misses all buckets with a probability of at most miss."""
    return math.ceil(math.log(miss) / math.log(1 - (pct / 100) ** rows)) if pct < 100 else 1


def minima(shingles: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The n minima of each set of shingles; first: where the sets start."""
    return np.stack([np.minimum.reduceat(shingles * a, first) for a in _multipliers[:n]], axis=1)


def _sketch(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in C.slices(batch.column(1)):
                keys, doc = shingle_sets(s, n)
                counts = np.bincount(doc, minlength=len(s))
                has = np.flatnonzero(counts)
                if not len(has):
                    continue
                first = np.searchsorted(doc, has)
                low = C.mix(minima(keys, first, bands * rows))
                band = np.zeros((len(has), bands), dtype=np.uint64)
                for r in range(rows):
                    band = C.mix(band * _U(31) + low[:, r::rows])
                band = C.mix(band + np.arange(bands, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
                sign = packed(low)
                s1, s2 = (np.add.reduceat(C.mix(keys ^ _U(x)), first) for x in (1, 0xA5A5A5A5A5A5A5A5))
                ids = batch.column(0).slice(s.lo, len(s)).take(pa.array(has))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(counts[has]), C.signed(s1), C.signed(s2), C.to_lists(C.signed(band.reshape(-1)), np.full(len(has), bands)), pa.array([x.tobytes() for x in sign], pa.binary())],
                    names=["id", "n_shingles", "s1", "s2", "bands", "signature"],
                )

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in C.slices(batch.column(1)):
                keys, doc = shingle_sets(s, n)
                at = np.searchsorted(doc, np.arange(len(s) + 1))
                sets = [keys[at[i] : at[i + 1]] for i in range(len(s))]
                kind = pa.array([int(C.mix(x).sum()) - (1 << 63) for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, len(s)), kind, pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "kind", "shingles"])

    return run


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of each row's minima in 64-bit words, filled up with zeros."""
    out = np.zeros((len(low), -(-low.shape[1] // 8) * 8), dtype=np.uint8)
    out[:, : low.shape[1]] = (low & _U((1 << BITS) - 1)).astype(np.uint8)
    return out.view(np.uint64)


def unpacked(signatures: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), dtype=np.uint64).reshape(len(signatures), -1)


def agreeing(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """How many of n minima agree in their low bits: differing bits folded to one a minimum, and counted."""
    d = x ^ y
    for shift in (4, 2, 1):
        d |= d >> _U(shift)
    return n - np.bitwise_count(d & _U(0x0101010101010101)).sum(axis=-1, dtype=np.int64)


def estimate(equal: np.ndarray, n: int) -> np.ndarray:
    """Similarity from the number of equal low-bit minima among n, corrected for chance agreement."""
    chance = 2.0**-BITS
    return (equal / n - chance) / (1 - chance)


def least_estimate(threshold: float, n: int) -> float:
    """Six standard deviations below the threshold."""
    return threshold - 6 * (threshold * (1 - threshold) / n) ** 0.5


def similar(a: np.ndarray, b: np.ndarray, pct: int) -> bool:
    """Whether two sorted sets share pct percent of their union."""
    if 100 * min(len(a), len(b)) < pct * max(len(a), len(b)):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= pct * (len(a) + len(b) - both)


def _near(pct: int, n: int):
    """Keeps pairs (id, leader, na, sa, nb, sb) whose signatures allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            na, nb = b.column(2).to_numpy(), b.column(4).to_numpy()
            equal = agreeing(unpacked(b.column(3)), unpacked(b.column(5)), n)
            ok = (estimate(equal, n) >= least_estimate(pct / 100, n)) & (100 * np.minimum(na, nb) >= pct * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return run


def _confirmed(pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), pct) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _block(pct: int, n: int):
    """Links that join components among the rows of a block; left rows are compared with right rows."""

    def run(table: pa.Table) -> pa.Table:
        ids, comp = table["id"].to_pylist(), table["component"].to_pylist()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table["shingles"].to_pylist()]
        sign = unpacked(table["signature"])
        bands = np.array(table["bands"].to_pylist(), dtype=np.int64).reshape(len(ids), -1)
        earlier = bands[:, : int(np.argmax(bands[0] == table["key"][0].as_py()))]  # buckets of these bands are compared elsewhere
        size = np.array([len(x) for x in sets])
        left = np.flatnonzero(table["is_left"].to_numpy())
        right = np.flatnonzero(table["is_right"].to_numpy())
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = p
            return x

        out: list[tuple[int, int]] = []
        floor, others = least_estimate(pct / 100, n), earlier[right]
        for u in left.tolist():
            near = (estimate(agreeing(sign[right], sign[u], n), n) >= floor) & ~(others == earlier[u]).any(axis=1)
            near &= 100 * np.minimum(size[right], size[u]) >= pct * np.maximum(size[right], size[u])
            for v in right[near].tolist():
                x, y = root(comp[u]), root(comp[v])
                if x != y and similar(sets[u], sets[v], pct):
                    parent[max(x, y)] = min(x, y)
                    out.append((ids[u], ids[v]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _links(texts: DataFrame, classes: DataFrame, n: int, pct: int, block_rows: int, size: int) -> DataFrame:
    """Links a, b between classes(id, n_shingles, bands, signature): enough to connect all that is similar."""
    keyed = classes.select("id", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("size")).where("size > 1")
    members = C.staged(keyed.join(buckets, "key"))
    signs = C.staged(classes.select("id", F.col("n_shingles").alias("n"), "signature", "bands").join(members.select("id").distinct(), "id", "left_semi"))
    pairs = members.where("id <> leader").select("id", "leader").distinct()
    first = pairs.join(signs, "id").select("id", "leader", F.col("n").alias("na"), F.col("signature").alias("sa"))
    second = signs.select(F.col("id").alias("leader"), F.col("n").alias("nb"), F.col("signature").alias("sb"))
    near = C.staged(first.join(second, "leader").select("id", "leader", "na", "sa", "nb", "sb").mapInArrow(_near(pct, size), "a long, b long"))
    # full sets of the documents in question alone
    asked = members.select(F.col("id").alias("of")).distinct()
    full = C.staged(texts.join(asked, F.col("id") == F.col("of"), "left_semi").select("id", "text").mapInArrow(_sets(n), "id long, kind long, shingles binary").dropDuplicates(["id", "kind"]).drop("kind"))
    a = near.join(full.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = a.join(full.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    links = C.staged(both.mapInArrow(_confirmed(pct), "a long, b long"))
    # buckets in which pairs without the leader may still join components
    known = components(links)
    placed = C.staged(members.where("size > 2").join(known, "id", "left").select("key", "id", "leader", "size", F.coalesce("component", "id").alias("component")))
    open_ = placed.where("id <> leader").groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    shares = placed.join(open_, "key", "left_semi").groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = shares.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    blocks = F.ceil(F.col("size") / block_rows).cast("int")
    rows = placed.join(largest, "key").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = rows.where("component <> largest").select("key", "id", "component", F.col("own").alias("i"), F.explode(every).alias("j"), F.lit(True).alias("is_left"))
    right = rows.select("key", "id", "component", F.explode(every).alias("i"), F.col("own").alias("j"), F.lit(False).alias("is_left"))
    grid = left.unionByName(right).groupBy("key", "i", "j", "id", "component").agg(F.max("is_left").alias("is_left"), F.min("is_left").alias("only_left"))
    grid = grid.select("key", "i", "j", "id", "component", "is_left", (~F.col("only_left")).alias("is_right")).join(signs.select("id", "signature", "bands"), "id").join(full, "id")
    more = grid.groupBy("key", "i", "j").applyInArrow(_block(pct, size), "a long, b long")
    return links.unionByName(more)


def near_duplicates(docs: DataFrame, n: int = 5, pct: int = 80, bands: int | None = None, rows: int = ROWS, block_rows: int = 1000) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document: n words a shingle, links from pct percent on.

    bands: as many as bands_for() says, unless given.
    """
    C.bounded(docs.sparkSession)
    bands = bands or bands_for(pct, rows)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.col("text").cast("string").alias("text"))
    scan = C.staged(texts.mapInArrow(_sketch(n, bands, rows), SCAN))
    classes = C.staged(scan.groupBy("s1", "s2").agg(F.min_by(F.struct("n_shingles", "bands", "signature"), "id").alias("v"), F.min("id").alias("id")).select("s1", "s2", "id", "v.*"))
    found = components(_links(texts, classes, n, pct, block_rows, bands * rows))
    of = classes.join(found.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select("s1", "s2", F.coalesce("component", "id").alias("component"))
    sets = scan.select("id", "n_shingles", "s1", "s2").join(of, ["s1", "s2"]).groupBy("id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component").alias("component"))
    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = doc.join(sets, F.coalesce("doc_id", F.lit(_NO_ID)) == F.col("id"), "left")
    own = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.when(own != _NO_ID, own).alias("component_id"), (F.coalesce("component", F.lit(_NO_ID)) == F.coalesce(F.when(F.col("component").isNull(), F.lit(_NO_ID)).otherwise(F.col("doc_id")), F.lit(_NO_ID))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all their columns: of each component, the one with the smallest doc_id."""
    (name,) = C.unused(docs, "kept")
    kept = near_duplicates(docs, **options).where("kept").select(F.coalesce("doc_id", F.lit(_NO_ID)).alias(name)).distinct()
    return docs.join(kept, F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)) == F.col(name), "left_semi")
