"""Operator 2, token-ID output: Parquet list columns of token ids.

Documents are range-partitioned and sorted by doc_id, encoded, ended with an end id and written as Parquet: one file
per partition, ids as a list column in dictionary or delta encoding, row groups and pages of a set size, with column
and offset indexes, so that a reader can take the metadata alone or the ids of a few documents.

Columns of the files: part (number of the file), doc_id, start_in_part (ids before the document in its file), n_tokens
and ids. The start of a document among all ids is start_in_part plus the n_tokens of all earlier parts.

Defined cases: a null or empty text has the end id alone; rows that repeat a doc_id are all written, ordered by
the hash of their text; an empty table gives files without rows; null doc_ids come first; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: What makes a text go to the tokenizer whole: rare white space, control characters, and what may be a special token.
_WHOLE = re.compile("[\x00-\x09\x0b-\x1f\x7f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]|<[|]")
#: Bytes that rare white space, control characters and '<' can begin with.
_ODD = np.isin(np.arange(256), [*range(10), *range(11, 32), 60, 127, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF])
#: Classes of bytes. Byte-level BPE splits between letters, digits and marks; apostrophes and most of Unicode are other.
_SPACE, _BREAK, _LETTER, _DIGIT, _MARK, _OTHER = range(6)
_CLASS = np.array([_SPACE if b == 32 else _BREAK if b == 10 else _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _MARK if 32 < b < 127 and b != 39 else _OTHER for b in range(128)] + [_OTHER] * 128, dtype=np.uint8)
#: How the tokenizer takes a piece: as one run of a class, by its own rules, or as a whole text.
_RUN, _RULES, _TEXT = range(3)
_print = [*range(33, 127), *range(161, 173), *range(174, 256)]
_rest = iter(range(256, 512))
#: Byte-level BPE writes each byte as a character: printable ones as themselves, the others from 256 on.
BYTE_CHARS = np.array([b if b in _print else next(_rest) for b in range(256)], dtype="<u2")
#: New pieces that are encoded at once: runs, and those that go by the tokenizer's rules.
RUNS_AT_ONCE, LINES_AT_ONCE = 1000, 200
#: The encoder of this worker, by the digest of its tokenizer: one at a time.
_worker: dict[str, Encoder] = {}
#: Bytes of pieces and ids that make a generation of an encoder's memory, some overhead of each piece included.
GENERATION_BYTES, PIECE_BYTES = 128 << 20, 200
FILE = "part int, doc_id long, start_in_part long, n_tokens long, ids array<int>"


def _cut(data: np.ndarray, offs: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of texts start, and how the tokenizer takes each.

    data and offs: the bytes of the texts, and where each starts. Texts that aren't cut are one piece. Of a run of spaces
    and line breaks all but the last are a piece, or all at the end of a text; the last is the head of the word that
    follows if it is a space, else a piece.
    """
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # the letters from U+00C0 to U+00FF; the signs of multiplication and division are none
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    blank, edge = kind <= _BREAK, np.zeros(len(data) + 1, dtype=bool)
    edge[offs] = True
    outer = edge[:-1].copy()
    outer[1:] |= (blank[1:] & ~blank[:-1]) | ((kind[:-1] == _BREAK) & ~blank[1:])
    last = np.flatnonzero(blank[1:-1] & blank[:-2] & ~blank[2:]) + 1
    outer[last[~edge[last + 1]]] = True
    inner = (kind[1:] != kind[:-1]) & ~blank[1:] & ~blank[:-1]
    inner &= ~outer[1:]
    rules = np.zeros(0, dtype=np.int64)
    other = np.flatnonzero(kind == _OTHER)
    if len(other):
        words, change = np.flatnonzero(outer), np.flatnonzero(inner)
        hard = np.zeros(len(words), dtype=bool)
        hard[np.searchsorted(words, other, side="right") - 1] = True
        inner[change[hard[np.searchsorted(words, change, side="right") - 1]]] = False
        rules = words[hard]
    outer[1:] |= inner
    if not cut.all():
        outer &= np.repeat(cut, np.diff(offs)) | edge[:-1]
    at = np.flatnonzero(outer)
    how = np.full(len(at), _RUN, dtype=np.uint8)
    how[np.searchsorted(at, rules, side="right") - 1] = _RULES
    how[np.searchsorted(at, offs[:-1][~cut & (np.diff(offs) > 0)])] = _TEXT
    return at, how


def splits(model: str) -> bool:
    """Whether a tokenizer's file is byte-level BPE that splits as encode_array does: texts of others are encoded whole."""
    said = json.loads(model)
    before = said.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    return bool(plain and not said.get("normalizer") and said.get("model", {}).get("type") == "BPE" and not said["model"].get("ignore_merges"))


def _gap(model: str) -> int | None:
    """The id of byte 0 in a byte-level BPE file, if no merge has it and pieces between such bytes are encoded by themselves."""
    said, mark = json.loads(model).get("model", {}), chr(BYTE_CHARS[0])
    plain = said.get("type") == "BPE" and not any(said.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    return said["vocab"].get(mark) if plain and not any(mark in "".join(m) for m in said["merges"]) else None


class Encoder:
    """A tokenizer that remembers the ids of pieces of text.

    Its memory is bounded in bytes: there are two generations of pieces, and when the younger one is full, the older is
    forgotten and the younger takes its place. A piece that is asked for again moves to the younger one.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        #: The model without the rules that split, and the id of byte 0, if that is merged with nothing.
        self.runs, self.gap = Tokenizer(self.tokenizer.model), _gap(model)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.size = 0

    def _put(self, names: list[bytes], ids: list[bytes]) -> None:
        self.known.update(zip(names, ids, strict=True))
        self.size += sum(map(len, names)) + sum(map(len, ids)) + PIECE_BYTES * len(names)

    def encode(self, texts: list[str], chunked: bool = True) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        ids, counts = self.encode_array(pa.array(texts, pa.string()), chunked, b"")
        ends = np.cumsum(counts)
        return [ids[lo:hi].tobytes() for lo, hi in zip(ends - counts, ends, strict=True)]

    def encode_array(self, texts: pa.Array, chunked: bool, end: bytes, odd: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the ids of end, and how many each has.

        Byte-level BPE first splits texts into runs of letters, digits, marks or white space, a space going with the run
        it precedes, so the ids of a text are the ids of its pieces in order, and a piece that has been seen needs no
        second encoding. chunked is for such tokenizers alone. odd: whether any text may have bytes of _ODD.
        Pieces are found by their bytes, and Arrow finds the different ones; the rest is done once for each of these.
        """
        if self.size > GENERATION_BYTES:
            self.known, self.older, self.size = {}, self.known, 0
        if not len(texts):
            return np.zeros(0, dtype="<i4"), np.zeros(0, dtype=np.int64)
        (rows,) = C.slices(texts, 1 << 62)
        cut = np.full(len(texts), chunked and len(self.line) == 1)
        if odd:
            for i in np.flatnonzero(cut):
                cut[i] = _WHOLE.search(texts[i].as_py()) is None
        at, how = _cut(rows.data, rows.offs, cut)
        offs = pa.py_buffer(np.append(at, len(rows.data)))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, offs, pa.py_buffer(rows.data)]).dictionary_encode()
        codes, names = pieces.indices.to_numpy(), pieces.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each first
        taken = np.full(len(names), _RUN, dtype=np.uint8)
        for k in (_RULES, _TEXT):
            taken[codes[how == k]] = k
        entries = self._ids(names, taken)
        entries.append(end)
        # the entries of each text in order, end last
        last = np.searchsorted(at, rows.offs[1:]) + np.arange(len(texts))
        own = np.ones(len(at) + len(texts), dtype=bool)
        own[last] = False
        entry = np.full(len(own), len(entries) - 1, dtype=np.int32)
        entry[own] = codes
        size = np.fromiter(map(len, entries), dtype=np.int64, count=len(entries))
        count = size[entry] // 4
        # Arrow lays the ids of all entries end to end, by entries and not by ids
        offs = np.zeros(len(entries) + 1, dtype=np.int64)
        np.cumsum(size, out=offs[1:])
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(entries), [None, pa.py_buffer(offs), pa.py_buffer(b"".join(entries))])
        values = whole.take(pa.array(entry)).buffers()[2]
        ids = np.frombuffer(values, dtype="<i4", count=int(count.sum())) if values is not None else np.zeros(0, dtype="<i4")
        return ids, np.add.reduceat(count, np.append(0, last[:-1] + 1))

    def _ids(self, pieces: list[bytes], how: np.ndarray) -> list[bytes]:
        """The ids of different pieces, from memory or learnt."""
        out = list(map(self.known.get, pieces))
        new = [i for i, x in enumerate(out) if x is None]
        if self.older:
            for i, x in zip(new, map(self.older.get, [pieces[i] for i in new]), strict=True):
                out[i] = x
            again = [i for i in new if out[i] is not None]
            self._put([pieces[i] for i in again], [out[i] for i in again])
            new = [i for i in new if out[i] is None]
        kinds = how[new].tolist()
        for kind in (_RUN, _RULES, _TEXT):
            own = [i for i, k in zip(new, kinds, strict=True) if k == kind]
            names = [pieces[i] for i in own]
            ids = [self._plain(x.decode()) for x in names] if kind == _TEXT else self._learnt(names, kind)
            if kind != _TEXT:
                self._put(names, ids)
            for i, x in zip(own, ids, strict=True):
                out[i] = x
        return out

    def _learnt(self, new: list[bytes], kind: int) -> list[bytes]:
        """The ids of new pieces, many in one text: runs by the model alone, between bytes 0, others in a line each."""
        if not new or (kind == _RUN and self.gap is None):
            return [self._plain(x.decode()) for x in new]
        out, mark, most = [], self.gap if kind == _RUN else self.line[0], RUNS_AT_ONCE if kind == _RUN else LINES_AT_ONCE
        for k in range(0, len(new), most):
            part = new[k : k + most]
            if kind == _RUN:
                text = BYTE_CHARS[np.frombuffer(b"\0".join(part), dtype=np.uint8)].tobytes().decode("utf-16-le")
            else:
                text = b"\n".join(part).decode()
            ids = np.array((self.runs if kind == _RUN else self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(ids == mark) * 4
            raw = ids.tobytes()
            out += [raw[lo:hi] for lo, hi in zip([0, *(at + 4).tolist()], [*at.tolist(), len(raw)], strict=True)]
        return out

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def _encoder(shared, digest: str, end_id: int, chunked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if digest not in _worker:
            _worker.clear()
            _worker[digest] = Encoder(C.read_once(shared))
        encoder = _worker[digest]
        before, end = 0, np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for s in C.slices(batch.column(2), 4 << 20):
                head = batch.slice(s.lo, len(s))
                flat, counts = encoder.encode_array(head.column(2).fill_null(""), chunked, end, bool(_ODD[s.data].any()))
                starts = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                yield pa.RecordBatch.from_arrays([head.column(0), head.column(1), pa.array(starts), pa.array(counts), C.to_lists(pa.array(flat), counts)], names=["part", "doc_id", "start_in_part", "n_tokens", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10) -> None:
    """Writes the token files of docs in ascending doc_id order. encoding: 'dictionary' or 'delta'.

    tokenizer: the path of a tokenizer's file on the driver, which sends its content, some megabytes, to the tasks.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding must be dictionary or delta, not {encoding}")
    spark = docs.sparkSession
    C.bounded(spark)
    model = Path(tokenizer).read_text(encoding="utf-8")
    coder = _encoder(spark.sparkContext.broadcast(model), hashlib.sha256(model.encode()).hexdigest(), end_id, splits(model))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = texts.repartitionByRange(C.ranges(texts), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(coder, FILE)
    (
        rows.write.mode("overwrite").option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.dictionary.page.size", 1 << 20).parquet(path)
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens of every document; the ids are not read."""
    rows = spark.read.schema(FILE).parquet(path).select("part", "doc_id", "start_in_part", "n_tokens")
    return _with_start(spark, path, rows).drop("part", "start_in_part")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document; filters on doc_id use the page indexes."""
    return _with_start(spark, path, spark.read.schema(FILE).parquet(path)).drop("part", "start_in_part")


def _with_start(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Adds start. There is one row a file in parts, so it is broadcast."""
    parts = spark.read.schema(FILE).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(parts.select("part", before.alias("_before"))), "part").withColumn("start", F.col("_before") + F.col("start_in_part")).drop("_before")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        offs, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
        crc = np.fromiter((zlib.crc32(flat[offs[i] : offs[i + 1]].data) for i in range(len(ids))), dtype=np.int64, count=len(ids))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the files at path, read back."""
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", "ids").mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
