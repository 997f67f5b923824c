"""Operators 8 and 9, exact repeats: bucket-pointer refinement of suffixes, and sliding spans of sentences.

Both find, for keyed places of documents, those whose key also occurs at an earlier place (a smaller doc_id, or an
earlier start in the same document), and remove what those places cover. Tasks first drop repeats among some BUFFER
places of their own, so a passage that a third of all documents hold gives a row for each such lot and not one a
document. Keys have 128 bits.

Operator 8. Suffixes are bucketed by their first q bytes and buckets are refined by the bucket identifiers of later
offsets, each refinement reused by the next (8, 16 ... q bytes, then on to the full width), until equal strings of the
full width are together. Bucket identifiers are hashes and not ranks, since only equality is asked for, so no global
sort is needed, and a refinement of suffixes needs no table of the others' identifiers: they are computed where the
text is. Two things keep the suffixes few. Each start is reached through its anchor: the leftmost smallest q-gram of
its string, which equal strings share at the same offset; the starts of one anchor are consecutive, and the initial
buckets hold anchors. A bucket with one member is finished; members that agree in the whole context of their starts are
refined in one step; only where contexts differ within a bucket are single starts refined. Of a bucket that has over
WIDE members of different context in one lot, two stand for the lot in the bucket: that contexts differ is known, so
the others go on to single starts without meeting there.

Operator 9. Sentences end at a word that ends in . ! or ?, or at the end of a line; those with equal words are equal. A
run has at least n sentences and at least min_words words; sentences that lie in any run that is not the first of its
kind go. Of all runs the shortest from each sentence and the shortest up to each sentence are hashed: a repeated run is
covered by those within it, and they repeat where it repeats.

Defined cases: a null or empty text has no bytes and no sentences; strings never cross documents; rows that repeat a
doc_id are the same document: their equal places are one place, and each row gets the result; null doc_ids order
before all others; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

_U = np.uint64
_NO_ID = -(1 << 63)
#: Rows that a task gathers before it drops repeats among them.
BUFFER = 400_000
#: Members of a bucket with different contexts in one lot, beyond which only two go to the bucket.
WIDE = 16
_STOP = np.isin(np.arange(256), list(b".!?"))


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy() if column.null_count else column.to_numpy()


def _locally_later(keys: tuple[np.ndarray, ...], doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which places have an earlier place with equal keys among these. The last key alone sorts: it is a hash."""
    order = np.lexsort((at, doc, keys[-1]))
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    d, a = doc[order], at[order]
    out = np.zeros(len(order), dtype=bool)
    out[order] = (d != d[first]) | (a != a[first])
    return out


def _merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [lo, hi], sorted by document and lo, with those that touch joined."""
    if not len(doc):
        return doc, lo, hi
    far = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) * (int(hi.max()) + 2)  # keeps documents apart
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (lo + far)[1:] > np.maximum.accumulate(hi + far)[:-1] + 1
    first = np.flatnonzero(new)
    return doc[first], lo[first], np.maximum.reduceat(hi, first)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _by_document(texts: DataFrame, places: DataFrame) -> DataFrame:
    """texts with los and his: the arrays of the places of each document, null if it has none."""
    lists = places.groupBy("doc").agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his"))
    return texts.join(lists, F.coalesce("doc_id", F.lit(_NO_ID)) == F.col("doc"), "left").select("doc_id", "text", "los", "his")


# Operator 8

#: at packs the range of starts, the first in the low half and how many follow in the high one; it is below 0 for starts
#: that are known to be repeats. Mostly zeros, so few bytes to shuffle.
ANCHORS = "k1 long, k2 long, k3 long, doc long, at long, wide boolean"
_LO = "if(at < 0, -at - 1, at) & 4294967295"
_HI = f"({_LO}) + shiftright(if(at < 0, -at - 1, at), 32)"


def _pack(lo: np.ndarray, hi: np.ndarray, done: bool = False) -> np.ndarray:
    at = lo + ((hi - lo) << 32)
    return -at - 1 if done else at


def _known(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, done: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, document and packed range of what is known to be a repeat; the keys spread what needs no company."""
    later = np.flatnonzero(done)
    later = later[np.lexsort((lo[later], doc[later]))]
    d, a, b = _merged(doc[later], lo[later], hi[later])
    return C.mix(d.astype(np.uint64) * _U(31) + a.astype(np.uint64)), d, _pack(a, b, True)


def _lots(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Joins tuples of columns until they have BUFFER rows."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= BUFFER:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _identifiers(data: np.ndarray, depth: int, seed: np.uint64) -> np.ndarray:
    """The bucket identifier of the first depth bytes of every suffix that has them; depth is 8 or more."""
    ids = C.mix(C.eights(data)[: max(0, len(data) - 7)] + seed)
    return _refined(ids, 8, depth)


def _refined(ids: np.ndarray, reach: int, depth: int) -> np.ndarray:
    """Identifiers of depth bytes from those of reach bytes, each with the one at a later offset."""
    while reach < depth:
        step = min(reach, depth - reach)
        ids = C.mix(ids[:-step] * C.GOLD + ids[step:])
        reach += step
    return ids


def _anchors_of(width: int, q: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """k1, k2, k3, document, first and last start of each anchor."""
    span = width - q + 1
    for batch in batches:
        ids = _ids(batch.column(0))
        for s in C.slices(batch.column(1)):
            n = len(s.data)
            if n < width:
                continue
            gram = _identifiers(s.data, q, C.SEEDS[0])
            least = (gram & _U(0xFFFFFFFF00000000)) | np.arange(n - q + 1, dtype=np.uint64)
            reach = 1
            while reach * 2 <= span:
                least = np.minimum(least[:-reach], least[reach:])
                reach *= 2
            if reach < span:
                least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
            anchor = (least & _U(0xFFFFFFFF)).astype(np.int64)  # of each start up to n - width
            doc = np.repeat(np.arange(len(s)), np.diff(s.offs))[: n - width + 1]
            start = np.flatnonzero(np.arange(n - width + 1) + width <= s.offs[doc + 1])
            if not len(start):
                continue
            anchor, doc = anchor[start], doc[start]
            new = np.ones(len(start), dtype=bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(start)) - 1
            lo, hi, anchor, doc = start[first], start[last], anchor[first], doc[first]
            k2, k3 = (C.chain((anchor - lo).astype(np.uint64), h) for h in C.hash_bytes(C.eights(s.data), lo, hi + width, *C.SEEDS))
            base = s.offs[doc]
            yield gram[anchor], k2, k3, ids[s.lo + doc], lo - base, hi - base


def _anchors(width: int, q: int):
    """Rows of anchors: the q-gram, the context of its starts, and the range of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k1, k2, k3, doc, lo, hi in _lots(_anchors_of(width, q, batches)):
            done = _locally_later((k1, k2, k3), doc, lo)
            k, d, a = _known(doc, lo, hi, done)
            keep = np.flatnonzero(~done)
            keep = keep[np.argsort(k1[keep], kind="stable")]
            _, first, back, n = np.unique(k1[keep], return_index=True, return_inverse=True, return_counts=True)
            wide = (n[back] > WIDE) & (np.arange(len(keep)) >= first[back] + 2)
            key = np.where(wide, C.mix(k2[keep]), k1[keep])
            columns = [C.signed(np.concatenate([x, k])) for x in (key, k2[keep], k3[keep])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([doc[keep], d])), pa.array(np.concatenate([_pack(lo, hi)[keep], a])), pa.array(np.concatenate([wide, np.zeros(len(d), dtype=bool)]))], names=["k1", "k2", "k3", "doc", "at", "wide"])

    return run


def _starts_of(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """k1, k2, document and place of single starts."""
    for batch in batches:
        ids = _ids(batch.column(0))
        for s in C.slices(batch.column(1)):
            if len(s.data) < width:
                continue
            los, his = (batch.column(c).slice(s.lo, len(s)) for c in (2, 3))
            doc = np.repeat(np.arange(len(s)), los.value_lengths().fill_null(0).to_numpy())
            lo, hi = los.flatten().to_numpy(), his.flatten().to_numpy()
            of, k = C.spread(hi - lo + 1)
            doc, at = doc[of], lo[of] + k
            start = at + s.offs[doc]
            fits = start + width <= s.offs[doc + 1]
            doc, at, start = doc[fits], at[fits], start[fits]
            k1, k2 = (_identifiers(s.data, width, seed)[start] for seed in C.SEEDS)
            yield k1, k2, ids[s.lo + doc], at


def _starts(width: int):
    """Rows of single starts: the bucket identifier of their full width, refined by doubling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k1, k2, doc, at in _lots(_starts_of(width, batches)):
            done = _locally_later((k1, k2), doc, at)
            k, d, a = _known(doc, at, at, done)
            keep = ~done
            columns = [C.signed(np.concatenate([x[keep], k])) for x in (k1, k2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([doc[keep], d])), pa.array(np.concatenate([_pack(at, at)[keep], a]))], names=["k1", "k2", "doc", "at"])

    return run


BYTES = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(width: int, batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Of each row: its number, its bytes and which of them go."""
    los, his = batch.column(2).to_pylist(), batch.column(3).to_pylist()
    for s in C.slices(batch.column(1)):
        for i in range(len(s)):
            data = s.data[s.offs[i] : s.offs[i + 1]]
            edge = np.zeros(len(data) + 1, dtype=np.int64)
            if lo := los[s.lo + i]:
                np.add.at(edge, np.minimum(np.array(lo), len(data)), 1)
                np.add.at(edge, np.minimum(np.array(his[s.lo + i]) + width, len(data)), -1)
            yield s.lo + i, data, np.cumsum(edge)[:-1] > 0


def _byte_digests(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, data, gone in _cut(width, batch):
                spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)) if len(gone) else 0
                rows.append((len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _byte_texts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [data[~gone].tobytes() for _, data, gone in _cut(width, batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())], names=["doc_id", "kept"])

    return run


def repeated_starts(docs: DataFrame, width: int = 100, q: int = 48) -> DataFrame:
    """doc, lo and hi: ranges of starts whose string of width bytes also starts earlier. q is from 8 to width / 2."""
    C.bounded(docs.sparkSession)
    texts = _texts(docs)
    anchors = texts.mapInArrow(_anchors(width, q), ANCHORS)
    bucket = Window.partitionBy("k1")
    within = Window.partitionBy("k1", "k2", "k3").orderBy("doc", F.expr(_LO))
    refined = anchors.repartition(C.shuffle_partitions(docs.sparkSession), "k1").withColumn("later", (F.col("at") < 0) | (F.dense_rank().over(within) > 1)).withColumn("shared", F.col("wide") | (F.min("k2").over(bucket) != F.max("k2").over(bucket)))
    refined = C.staged(refined.where("later or shared").select("doc", F.expr(_LO).alias("lo"), F.expr(_HI).alias("hi"), "later"))
    finest = _by_document(texts, refined.where("not later")).where("los is not null").mapInArrow(_starts(width), "k1 long, k2 long, doc long, at long")
    same = Window.partitionBy("k1", "k2").orderBy("doc", F.expr(_LO))
    single = finest.withColumn("later", (F.col("at") < 0) | (F.dense_rank().over(same) > 1)).where("later").select("doc", F.expr(_LO).alias("lo"), F.expr(_HI).alias("hi"))
    return refined.where("later").select("doc", "lo", "hi").unionByName(single)


def repeated_bytes(docs: DataFrame, width: int = 100, q: int = 48) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    return _by_document(_texts(docs), repeated_starts(docs, width, q)).mapInArrow(_byte_digests(width), BYTES)


def remove_repeated_bytes(docs: DataFrame, width: int = 100, q: int = 48) -> DataFrame:
    """doc_id and kept: the bytes that stay."""
    return _by_document(_texts(docs), repeated_starts(docs, width, q)).mapInArrow(_byte_texts(width), "doc_id long, kept binary")


# Operator 9


def _sentences(s: C.Slice) -> tuple[np.ndarray, ...]:
    """Of each sentence: its text, first and last word + 1; and of each word its start and end."""
    start, end, doc = s.words()
    lines = np.zeros(len(s.data) + 1, dtype=np.int64)
    np.cumsum(s.data == 10, out=lines[1:])
    final = _STOP[s.data[end - 1]]
    final[:-1] |= (lines[start[1:]] > lines[end[:-1]]) | (doc[1:] != doc[:-1])
    final[-1:] = True
    last = np.flatnonzero(final) + 1
    first = np.concatenate([np.zeros(1, dtype=np.int64), last[:-1]])[: len(last)]
    return doc[first] if len(first) else doc, first, last, start, end


def _runs_of(n: int, min_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """k1, k2, document, first and last sentence of the shortest runs from and up to each sentence."""
    for batch in batches:
        ids = _ids(batch.column(0))
        for s in C.slices(batch.column(1)):
            doc, first, last, start, end = _sentences(s)
            if len(first) < n:
                continue
            words = C.hash_bytes(s.lower(), start, end, *C.SEEDS)
            upto = np.maximum(np.arange(len(first)) + n, np.searchsorted(last, first + min_words) + 1)
            i = np.flatnonzero(upto <= len(first))
            since = np.minimum(np.arange(len(first)) + 1 - n, np.searchsorted(first, last - min_words, side="right") - 1)
            e = np.flatnonzero(since >= 0)
            both = np.unique(np.stack([np.concatenate([i, since[e]]), np.concatenate([upto[i] - 1, e])]), axis=1)
            i, e = both[:, doc[both[0]] == doc[both[1]]]
            k1, k2 = (C.hash_runs(C.hash_runs(h, first, last, seed)[0], i, e + 1, seed)[0] for h, seed in zip(words, C.SEEDS, strict=True))
            base = np.searchsorted(doc, doc[i])
            yield k1, k2, ids[s.lo + doc[i]], i - base, e - base


def _runs(n: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k1, k2, doc, lo, hi in _lots(_runs_of(n, min_words, batches)):
            done = _locally_later((k1, k2), doc, lo)
            k, d, a = _known(doc, lo, hi, done)
            keep = ~done
            columns = [C.signed(np.concatenate([x[keep], k])) for x in (k1, k2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([doc[keep], d])), pa.array(np.concatenate([_pack(lo, hi)[keep], a]))], names=["k1", "k2", "doc", "at"])

    return run


def _sentence_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        los, his = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        n, removed, spans, kept = [], [], [], []
        for s in C.slices(batch.column(1)):
            doc, first, _, start, _ = _sentences(s)
            at = np.searchsorted(doc, np.arange(len(s) + 1))
            for i in range(len(s)):
                count = int(at[i + 1] - at[i])
                edge = np.zeros(count + 1, dtype=np.int64)
                if lo := los[s.lo + i]:
                    np.add.at(edge, np.minimum(np.array(lo), count), 1)
                    np.add.at(edge, np.minimum(np.array(his[s.lo + i]) + 1, count), -1)
                gone = np.cumsum(edge)[:-1] > 0
                cut = [*start[first[at[i] : at[i + 1]]].tolist(), int(s.offs[i + 1])]
                raw = s.data[s.offs[i] : s.offs[i + 1]].tobytes()
                base = int(s.offs[i])
                pieces, done = [], 0
                for j in np.flatnonzero(gone).tolist():
                    pieces.append(raw[done : cut[j] - base])
                    done = cut[j + 1] - base
                n.append(count)
                removed.append(int(gone.sum()))
                spans.append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)) if count else 0)
                kept.append(b"".join([*pieces, raw[done:]]).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(kept, pa.string())], names=["doc_id", "n_sentences", "n_removed", "n_spans", "kept_text"])


def remove_repeated_sentences(docs: DataFrame, n: int = 2, min_words: int = 16) -> DataFrame:
    """doc_id, n_sentences, n_removed, n_spans (maximal removed runs) and kept_text of each document."""
    C.bounded(docs.sparkSession)
    texts = _texts(docs)
    runs = texts.mapInArrow(_runs(n, min_words), "k1 long, k2 long, doc long, at long")
    within = Window.partitionBy("k1", "k2").orderBy("doc", F.expr(_LO))
    later = runs.withColumn("later", (F.col("at") < 0) | (F.dense_rank().over(within) > 1)).where("later").select("doc", F.expr(_LO).alias("lo"), F.expr(_HI).alias("hi"))
    return _by_document(texts, later).mapInArrow(_sentence_cuts, "doc_id long, n_sentences long, n_removed long, n_spans long, kept_text string")
