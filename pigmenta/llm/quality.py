"""Operator 1, quality rules: cross-document line frequency.

Lines are normalised (ASCII lower case, digits as 0, white space collapsed) and hashed; for each host the distinct
documents that hold a line are counted; lines above the limits are boilerplate. line_quality counts their words: a
document of which too much is boilerplate is depleted. clean() rejects those that fail and removes the boilerplate
lines of the others; the base rules are judged before lines are removed.

Copies must not condemn a text: documents with the same whole text, byte for byte, count as one document for a line.
Any other document counts, however many lines it shares with others, also if it differs in a number alone.

Defined cases: a null or empty text has no words and fails the base rule; a null host is a host of its own; rows that
repeat a doc_id are judged together with the sum of their removed words; an empty table gives no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_NORMAL = np.where((np.arange(256) >= 48) & (np.arange(256) <= 57), 48, C.LOWER).astype(np.uint8)

SCAN = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_key long, line_hash array<long>, line_words array<int>"


def _repeated(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per text, the words that lie in a 3-word window found twice or more in it."""
    if len(h) < 3:
        return np.zeros(n, dtype=np.int64)
    key = C.chain(doc[:-2].astype(np.uint64), h[:-2], h[1:-1], h[2:])
    at = np.flatnonzero(doc[:-2] == doc[2:])
    key = key[at]
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k) + 1, dtype=bool)
    same[1:-1] = k[1:] == k[:-1]
    twice = at[order[same[1:] | same[:-1]]]
    hit = np.zeros(len(h), dtype=bool)
    for j in range(3):
        hit[twice + j] = True
    return np.bincount(doc[hit], minlength=n)


def _lines(s: C.Slice, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each line with a word: its text, start and end in bytes, and its first and last word + 1."""
    cut = np.flatnonzero(s.data == 10)
    lo = np.sort(np.concatenate([s.offs[:-1], cut + 1]), kind="stable")
    hi = np.sort(np.concatenate([cut, s.offs[1:]]), kind="stable")
    first, last = np.searchsorted(start, lo), np.searchsorted(start, hi)
    keep = last > first
    lo, hi, first, last = lo[keep], hi[keep], first[keep], last[keep]
    return np.searchsorted(s.offs, lo, side="right") - 1, lo, hi, first, last


def _keys(s: C.Slice, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of each line's normalised words."""
    normal = C.hash_bytes(C.eights(_NORMAL[s.data]), start, end, C.SEEDS[0])[0]
    return C.hash_runs(normal, first, last, C.SEEDS[0])[0].view(np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in C.slices(batch.column(2)):
            n = len(s)
            start, end, doc = s.words()
            eights = C.eights(s.data)
            repeat = _repeated(C.hash_bytes(eights, start, end, C.SEEDS[0])[0], doc, n)
            line_doc, lo, hi, first, last = _lines(s, start)
            exact = C.chain(line_doc.astype(np.uint64), C.hash_bytes(eights, lo, hi, C.SEEDS[0])[0])
            distinct = np.bincount(line_doc[np.unique(exact, return_index=True)[1]], minlength=n)
            dup = np.bincount(line_doc, minlength=n) - distinct
            key = _keys(s, start, end, first, last)
            order = np.lexsort((key, line_doc))
            key, line_doc, size = key[order], line_doc[order], (last - first)[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (line_doc[1:] != line_doc[:-1])
            size = np.add.reduceat(size, np.flatnonzero(new)) if len(key) else size
            counts = np.bincount(line_doc[new], minlength=n)
            text_key = C.hash_bytes(eights, s.offs[:-1], s.offs[1:], C.SEEDS[1])[0]
            code_points = s.per_text(C.WORD[s.data] & ((s.data & 0xC0) != 0x80))
            head = batch.slice(s.lo, n)
            yield pa.RecordBatch.from_arrays(
                [
                    head.column(0), head.column(1), pa.array(np.bincount(doc, minlength=n)), pa.array(code_points), pa.array(s.per_text(_SYMBOL[s.data])),
                    pa.array(dup), pa.array(repeat), C.signed(text_key), C.to_lists(pa.array(key[new]), counts), C.to_lists(pa.array(size.astype(np.int32)), counts),
                ],
                names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_key", "line_hash", "line_words"],
            )


def _scanned(docs: DataFrame, host: str) -> DataFrame:
    C.bounded(docs.sparkSession)
    return C.staged(docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.col("text").cast("string")).mapInArrow(_scan, SCAN))


def _boilerplate(scan: DataFrame, min_documents: int, share: float) -> DataFrame:
    """of_doc, host, line and words of the boilerplate lines of each document."""
    lines = scan.select("doc_id", "host", "text_key", F.explode(F.arrays_zip("line_hash", "line_words")).alias("l")).select("doc_id", "host", "text_key", F.col("l.line_hash").alias("line"), F.col("l.line_words").alias("words"))
    held = lines.select("host", "line", "text_key").distinct().groupBy("host", "line").agg(F.count("*").alias("documents")).where(F.col("documents") > min_documents)
    hosts = scan.groupBy(F.col("host").alias("of_host")).agg(F.count("*").alias("host_documents"))
    common = held.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).where(F.col("documents") > share * F.col("host_documents")).select(F.col("host").alias("of_host"), F.col("line").alias("of_line"))
    return lines.join(common, (F.col("line") == F.col("of_line")) & F.col("host").eqNullSafe(F.col("of_host"))).select(F.col("doc_id").alias("of_doc"), "host", "line", "words")


def _judged(scan: DataFrame, removed: DataFrame, max_removed_pct: int) -> DataFrame:
    """The scan with the verdicts; removed has of_doc and removed_words."""
    out = scan.drop("text_key", "line_hash", "line_words", "host").join(removed, F.col("doc_id").eqNullSafe(F.col("of_doc")), "left").drop("of_doc").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = 100 * F.col("removed_words") > max_removed_pct * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("depleted", depleted).withColumn("kept", ~failed & ~depleted)


def line_quality(docs: DataFrame, host: str = "source", min_documents: int = 20, share: float = 0.005, max_removed_pct: int = 60) -> DataFrame:
    """One row per document: base measures, base_failed, removed_words, depleted and kept.

    A line is boilerplate on a host if more than min_documents and more than share of the host's documents hold it.
    A document is depleted if over max_removed_pct percent of its words are in boilerplate lines.
    """
    scan = _scanned(docs, host)
    removed = _boilerplate(scan, min_documents, share).groupBy("of_doc").agg(F.sum("words").alias("removed_words"))
    return _judged(scan, removed, max_removed_pct)


def reject(docs: DataFrame, **options) -> DataFrame:
    """The documents that line_quality keeps, with all their columns."""
    of, kept = C.unused(docs, "of", "kept")
    verdict = line_quality(docs, **options).groupBy(F.col("doc_id").alias(of)).agg(F.bool_and("kept").alias(kept))
    return docs.join(verdict.where(F.col(kept)), docs["doc_id"].cast("long").eqNullSafe(F.col(of)), "left_semi")


def _cutter(column: int, chars: int | None):
    """Removes from each text the lines whose hashes are listed in the last column, and drops that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, lists = batch.columns
            some = np.flatnonzero(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
            if len(some):
                texts, gone = columns[column].to_pylist(), lists.take(pa.array(some)).to_pylist()
                for s in C.slices(columns[column].take(pa.array(some))):
                    start, end, _ = s.words()
                    line_doc, lo, hi, first, last = _lines(s, start)
                    key = _keys(s, start, end, first, last)
                    at = np.searchsorted(line_doc, np.arange(len(s) + 1))
                    for i in range(len(s)):
                        cut = at[i] + np.flatnonzero(np.isin(key[at[i] : at[i + 1]], np.array(gone[s.lo + i], dtype=np.int64)))
                        done, stop, pieces = int(s.offs[i]), int(s.offs[i + 1]), []
                        for a, b in zip(lo[cut].tolist(), hi[cut].tolist(), strict=True):
                            pieces.append(s.data[done:a].tobytes())
                            done = min(b + 1, stop)
                        out = b"".join([*pieces, s.data[done:stop].tobytes()])
                        if len(cut) and hi[cut[-1]] == stop:
                            out = out.removesuffix(b"\n")  # the last line has none of its own
                        texts[some[s.lo + i]] = out.decode()
                columns[column] = pa.array(texts, columns[column].type)
            if chars is not None:
                columns[chars] = pc.utf8_length(columns[column]).cast(columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-1]))

    return run


def clean(docs: DataFrame, host: str = "source", min_documents: int = 20, share: float = 0.005, max_removed_pct: int = 60) -> DataFrame:
    """The documents that line_quality keeps, with all their columns, without their boilerplate lines.

    n_chars, if there, is set anew for all rows. A null text stays null.
    """
    scan = _scanned(docs, host)
    removed = _boilerplate(scan, min_documents, share).groupBy("of_doc").agg(F.sum("words").alias("removed_words"), F.collect_set(F.struct("host", "line")).alias("cuts"))
    of, kept, cuts = C.unused(docs, "of", "kept", "cuts")
    verdict = _judged(scan, removed, max_removed_pct).groupBy(F.col("doc_id").alias(of)).agg(F.bool_and("kept").alias(kept), F.first("cuts", ignorenulls=True).alias(cuts))
    rows = docs.join(verdict.where(F.col(kept)), docs["doc_id"].cast("long").eqNullSafe(F.col(of))).drop(of, kept)
    here = F.filter(cuts, lambda x: x["host"].eqNullSafe(F.col(host).cast("string")))
    rows = rows.withColumn(cuts, F.transform(here, lambda x: x["line"]))
    return rows.mapInArrow(_cutter(docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None), docs.schema)
