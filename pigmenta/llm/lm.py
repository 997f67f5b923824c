"""Operator 7, language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs of the training documents are quantised to levels (level q stands for counts of 2**(q-1)
to 2**q - 1) and put into Bloom filters as the keys (n-gram, 1) to (n-gram, q). The level of an n-gram is found by
probing (n-gram, 1), (n-gram, 2) ... until one is missing. A word's probability is interpolated,

    P(w | v) = weight * c(v w) / c(v) + (1 - weight) * (c(w) + 1) / (N + V + 1),

with all counts from the filters, so it is never 0.

Everything is counted over all training documents. N-grams travel as 64-bit hashes in packed blocks, by bucket, so the
shuffle has few rows. A filter grows with its n-grams (bits_per_key each) and keeps all levels at every size. It is cut
by n-gram hash into parts of at most filter_bytes, which are broadcast; the driver and each task hold one at a time, and
tasks with several parts probe all n-grams of a lot of text in one part after the other. A filter of pairs of over
max_parts parts isn't broadcast: what a token needs of its words is looked up in the filter of words, and the pairs are
sent to the block of their bucket and probed there. Either way has the same bits and gives the same scores. Pairs with
over 1 / heavy of all tokens (at most `heavy`) are broadcast with their levels, so no block is hot.

The base score needs exact counts. Words with over 1 / heavy of all tokens (at most `heavy` words) are broadcast; the
occurrences of all others are sent to their word's bucket, where they are counted and their logarithms go back to the
documents. No bucket has a word with more than 1 / heavy of the tokens, so none is hot.

Tokens: words between ASCII white space, A-Z in lower case, then one end token. Documents whose crc32 of the doc_id's
text modulo folds is `held` are held out. Defined cases: a null or empty text is the end token alone; a null doc_id
counts as the text ''; rows that repeat a doc_id are scored each by itself; with no training document all counts are 0;
an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_U = np.uint64
END, START = _U(0x0123456789ABCDEF), _U(0x0F1E2D3C4B5A6978)
_NO_ID = -(1 << 63)
#: Tokens that a task gathers before it counts them.
FLUSH = 2_000_000
PROBES = 7
LEVELS = 40
#: Stands for the start of a text where a word's level is asked for.
AT_START = 255


def held_out(doc_id: int | None, folds: int, held: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == held


def _tokens(s: C.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, hash of the one before, and text of each token of a slice."""
    start, end, doc = s.words()
    h = C.hash_bytes(s.lower(), start, end, C.SEEDS[0])[0]
    n = len(s)
    out = np.full(len(h) + n, END, dtype=np.uint64)
    at = np.arange(len(h)) + doc
    out[at] = h
    ends = np.cumsum(np.bincount(doc, minlength=n) + 1) - 1
    of = np.repeat(np.arange(n), np.diff(ends, prepend=-1))
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[np.concatenate([[0], ends[:-1] + 1])] = START
    return out, before, of


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return C.chain(before, word)


def _bucket_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), dtype=np.int64)


def _packed(kind: int, h: np.ndarray, n: np.ndarray, bits: int) -> list[tuple[int, int, bytes, bytes]]:
    """Sorted hashes and their counts as one row a bucket."""
    at = np.searchsorted(_bucket_of(h, bits), np.arange((1 << bits) + 1))
    return [(kind, b, h[at[b] : at[b + 1]].tobytes(), n[at[b] : at[b + 1]].astype(np.uint32).tobytes()) for b in np.flatnonzero(np.diff(at)).tolist()]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["kind", "bucket", "hashes", "counts"])


PACKED = "kind int, bucket int, hashes binary, counts binary"


def _count(bits: int, folds: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[np.ndarray] = []
        pairs: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            rows = []
            for kind, parts in ((0, words), (1, pairs)):
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                rows += _packed(kind, h, n, bits)
                parts.clear()
            return _table(rows)

        size = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for s in C.slices(batch.column(1)):
                h, before, of = _tokens(s)
                learn = ~np.fromiter((held_out(x, folds, held) for x in ids[s.lo : s.hi]), dtype=bool, count=len(s))[of]
                words.append(h[learn])
                pairs.append(_pair(before[learn], h[learn]))
                size += len(h)
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if words:
            yield flush()

    return run


COUNTED = "kind int, bucket int, tokens long, distinct_keys long, levels array<long>, hashes binary, counts binary"


def _level(n: np.ndarray) -> np.ndarray:
    """1 + floor(log2(n)), of counts from 1."""
    return np.frexp(n.astype(np.float64))[1].astype(np.int64)


def _summed(table: pa.Table) -> pa.Table:
    """One bucket's exact counts."""
    kind = table["kind"][0].as_py()
    h = np.frombuffer(b"".join(table["hashes"].to_pylist()), dtype=np.uint64)
    n = np.frombuffer(b"".join(table["counts"].to_pylist()), dtype=np.uint32)
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    h, n = h[first], np.add.reduceat(n, first)
    tokens, distinct = int(n.sum()), len(n)
    levels = np.bincount(_level(n), minlength=LEVELS)
    return pa.table({"kind": pa.array([kind], pa.int32()), "bucket": table["bucket"][:1].cast(pa.int32()), "tokens": pa.array([tokens]), "distinct_keys": pa.array([distinct]), "levels": pa.array([levels.tolist()], pa.list_(pa.int64())), "hashes": pa.array([h.tobytes()], pa.binary()), "counts": pa.array([n.astype("<i8").tobytes()], pa.binary())})


class Filter:
    """A log-frequency Bloom filter in equal blocks, one for each bucket of hashes."""

    def __init__(self, bits: int, block_bits: int, least: int, data: bytearray | bytes, first: int = 0):
        self.bits, self.block_bits, self.least, self.data, self.first = bits, block_bits, least, data, first

    def _begin(self, h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the block of each hash begins, and the state of its probes."""
        return (_bucket_of(h, self.bits) - self.first) * self.block_bits, C.mix(h + _U(level * 0x51ED2701A3B5C7D9 % (1 << 64)))

    def _next(self, base: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = C.mix(x + C.GOLD)
        return x, base + (x % _U(self.block_bits)).astype(np.int64)

    def _places(self, h: np.ndarray, level: int) -> Iterator[np.ndarray]:
        base, x = self._begin(h, level)
        for _ in range(PROBES):
            x, at = self._next(base, x)
            yield at

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The level of each hash, 0 if it isn't in the filter."""
        data = np.frombuffer(self.data, dtype=np.uint8)
        out = np.zeros(len(h), dtype=np.int64)
        alive = np.arange(len(h))
        for level in range(self.least, LEVELS):
            if not len(alive):
                break
            base, x = self._begin(h[alive], level)
            for _ in range(PROBES):
                x, at = self._next(base, x)
                hit = (data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                alive, base, x = alive[hit], base[hit], x[hit]
            out[alive] = level
        return out


def counts_of(level: np.ndarray) -> np.ndarray:
    """The middle of the counts that each level stands for."""
    return np.where(level > 0, np.exp2(level.astype(np.float64) - 1) * 1.5 - 0.5, 0.0)


class Parted(Filter):
    """A filter in parts of `each` blocks, as broadcasts by number; a part without n-grams is left out."""

    def __init__(self, bits: int, block_bits: int, least: int, each: int, shared: dict):
        super().__init__(bits, block_bits, least, b"")
        self.each, self.shared = each, shared

    def levels(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), dtype=np.int64)
        part = _bucket_of(h, self.bits) // self.each
        order = np.argsort(part, kind="stable")
        for k, shared in self.shared.items():
            at = order[slice(*np.searchsorted(part[order], [k, k + 1]))] if len(self.shared) > 1 else np.flatnonzero(part == k)
            data = shared.value if len(self.shared) == 1 else C.read_once(shared)
            out[at] = Filter(self.bits, self.block_bits, self.least, data, k * self.each).levels(h[at])
        return out


def _block_of(plans: dict[int, tuple[int, int, int]]):
    """Of each counted bucket, the block of its kind's filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, bucket, hashes, counts in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                bits, block, least = plans[kind]
                one = Filter(0, block, least, b"")
                h, level = np.frombuffer(hashes, dtype=np.uint64), _level(np.frombuffer(counts, dtype=np.int64))
                marks = np.zeros(block, dtype=bool)
                for q in range(least, int(level.max(initial=0)) + 1):
                    for at in one._places(h[level >= q], q):
                        marks[at] = True
                rows.append((kind, bucket, np.packbits(marks, bitorder="little").tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["kind", "bucket", "block"])

    return run


def _plan(levels: np.ndarray, buckets: int, bits_per_key: int) -> tuple[int, int]:
    """Bits of a block, and the least level: always 1, as a filter grows in parts."""
    keys = int((np.asarray(levels, dtype=np.int64) * np.arange(len(levels))).sum())
    block = max(64, -(-keys * bits_per_key // buckets))
    return -(-block // 8) * 8, 1


class Heavy:
    """Hashes of common n-grams, sorted, with a number each."""

    def __init__(self, rows: list):
        top = np.array([(r.hash, r.n) for r in rows], dtype=np.int64).reshape(-1, 2)
        keys = top[:, 0].astype(np.int64).view(np.uint64) if len(top) else np.zeros(0, dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.n = np.ascontiguousarray(keys[order]), top[order, 1]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of h are among them, and where."""
        at = np.searchsorted(self.keys, h)
        found = at < len(self.keys)
        found[found] = self.keys[at[found]] == h[found]
        return found, at[found]


class Model:
    """What scoring tasks get: the common words with their exact counts, the common pairs, and totals."""

    def __init__(self, words: Heavy, pairs: Heavy, tokens: int, distinct: int, documents: int, weight: float):
        self.words, self.pairs = words, pairs
        self.tokens, self.distinct, self.documents, self.weight = tokens, distinct, documents, weight

    def log10(self, pair: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 P(word | before) from the levels of the pair, the word before (or AT_START) and the word."""
        c_before = np.where(before == AT_START, float(self.documents), counts_of(before))
        follow = np.minimum(1.0, counts_of(pair) / np.maximum(c_before, 1.0))
        return np.log10(self.weight * follow + (1 - self.weight) * (counts_of(word) + 1) / (self.tokens + self.distinct + 1))


#: kind 0: occurrences of words on the way to their bucket, and a text's own row; kind 1: pairs on the way to theirs.
ROUTED = "kind int, bucket int, hashes binary, rows binary, times binary, extra binary, row long, doc_id long, n_tokens long, n_known long, base double, score double"
_ROUTED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), *((x, pa.binary()) for x in ("hashes", "rows", "times", "extra")), *((x, pa.int64()) for x in ("row", "doc_id", "n_tokens", "n_known")), ("base", pa.float64()), ("score", pa.float64())])


def _sent(kind: int, bucket: np.ndarray, buckets: int, *arrays: np.ndarray) -> list[tuple]:
    """One row a bucket with the entries of arrays that go there."""
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    out = []
    for b in np.flatnonzero(np.diff(cut)).tolist():
        i = order[cut[b] : cut[b + 1]]
        out.append((kind, b, *(x[i].tobytes() for x in arrays)))
    return out


def _levels_of_words(words: Parted, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels of the words before, AT_START for none, and of the words."""
    both, back = np.unique(np.concatenate([before, word]), return_inverse=True)
    level = words.levels(both)[back]
    return np.where(before == START, AT_START, level[: len(before)]), level[len(before) :]


def _score(shared, filters: dict[int, Parted], route: bool, buckets: int, folds: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        words, pairs = filters[0], filters[1]
        limit = 1 << 20 if max(len(f.shared) for f in filters.values()) <= 1 else C.BATCH_BYTES // 2
        logs = np.log10(m.words.n + 1.0)
        for batch in batches:
            ids = batch.column(0).fill_null(_NO_ID).to_numpy()
            given = batch.column(0).to_pylist()
            numbers = batch.column(2).to_numpy()
            for s in C.slices(batch.column(1), limit):
                h, before, of = _tokens(s)
                n = len(s)
                row = numbers[s.lo : s.hi]
                key, first, back = np.unique(_pair(before, h), return_index=True, return_inverse=True)
                c_before, c_word = _levels_of_words(words, before[first], h[first])
                sent: list[tuple] = []
                near, at = m.pairs.find(key)
                if route:
                    value = np.zeros(len(key))
                    value[near] = m.log10(m.pairs.n[at], c_before[near], c_word[near])
                    far = np.flatnonzero(~near[back])
                    far = far[np.lexsort((of[far], back[far]))]
                    new = np.ones(len(far), dtype=bool)
                    new[1:] = (back[far][1:] != back[far][:-1]) | (of[far][1:] != of[far][:-1])
                    times = np.diff(np.append(np.flatnonzero(new), len(far))).astype(np.uint32)
                    k, to = back[far[new]], of[far[new]]
                    sent = _sent(1, _bucket_of(key[k], pairs.bits), 1 << pairs.bits, key[k], row[to], times, np.stack([c_before[k], c_word[k]], axis=1).astype(np.uint8))
                else:
                    level = pairs.levels(key)
                    level[near] = m.pairs.n[at]
                    value = m.log10(level, c_before, c_word)
                score = np.bincount(of, weights=value[back], minlength=n)
                heavy, at = m.words.find(h)
                base = np.bincount(of[heavy], weights=logs[at], minlength=n)
                known = np.bincount(of[heavy], minlength=n)
                rare, rare_of = h[~heavy], of[~heavy]
                order = np.lexsort((rare_of, rare))
                rare, rare_of = rare[order], rare_of[order]
                new = np.ones(len(rare), dtype=bool)
                new[1:] = (rare[1:] != rare[:-1]) | (rare_of[1:] != rare_of[:-1])
                times = np.diff(np.append(np.flatnonzero(new), len(rare))).astype(np.uint32)
                rare, rare_of = rare[new], rare_of[new]
                learn = ~np.fromiter((held_out(x, folds, held) for x in given[s.lo : s.hi]), dtype=bool, count=n)
                sent += _sent(0, (rare % _U(buckets)).astype(np.int64), buckets, rare, row[rare_of], times, learn[rare_of])
                # a text's own row needs no company: it goes to any bucket
                k, none = len(sent), [None] * n
                own = (np.zeros(n, dtype=np.int64).tolist(), (np.arange(s.lo, s.hi) * 7919 % buckets).tolist(), none, none, none, none)
                columns = [[*x, *y] for x, y in zip(list(zip(*sent, strict=True)) or [()] * 6, own, strict=True)]
                tail = (row, ids[s.lo : s.hi], np.bincount(of, minlength=n), known, base, score)
                columns += [[None] * k + x.tolist() for x in tail]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _ROUTED, strict=True)], schema=_ROUTED)

    return run


PARTIAL = "doc_id long, n_tokens long, n_known long, base double, score double"
_PART = np.dtype([("row", "<i8"), ("doc", "<i8"), ("own", "?"), ("n_tokens", "<i8"), ("n_known", "<i8"), ("base", "<f8"), ("score", "<f8")])
_SUMS = ("n_tokens", "n_known", "base", "score")


def _homes(rows: np.ndarray, homes: int) -> pa.Table:
    """Partial sums, packed as one row for each home, the place where a text's sums meet."""
    home = (C.mix(rows["row"].astype(np.uint64)) % _U(homes)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    cut = np.searchsorted(home[order], np.arange(homes + 1))
    full = np.flatnonzero(np.diff(cut)).tolist()
    return pa.table({"home": pa.array(full, pa.int64()), "rows": pa.array([rows[order[cut[k] : cut[k + 1]]].tobytes() for k in full], pa.binary())})


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), dtype=kind)


def _rare(table: pa.Table, homes: int) -> pa.Table:
    """One bucket of words: sums by text."""
    own, sent = table.filter(pc.is_null(table["hashes"])), table.filter(pc.is_valid(table["hashes"]))
    h, to, times, learn = (_column(sent, c, t) for c, t in (("hashes", np.uint64), ("rows", np.int64), ("times", np.uint32), ("extra", np.bool_)))
    word, back = np.unique(h, return_inverse=True)
    count = np.bincount(back, weights=times * learn, minlength=len(word))[back] if len(h) else np.zeros(0)
    texts, at = np.unique(to, return_inverse=True)
    rows = np.zeros(len(own) + len(texts), dtype=_PART)
    for name, column in (("row", "row"), ("doc", "doc_id"), *((x, x) for x in _SUMS)):
        rows[name][: len(own)] = own[column].to_numpy()
    rows["own"][: len(own)] = True
    rest = rows[len(own) :]
    rest["row"] = texts
    if len(texts):
        rest["base"] = np.bincount(at, weights=times * np.log10(count + 1.0), minlength=len(texts))
        rest["n_known"] = np.bincount(at, weights=times * (count > 0), minlength=len(texts))
    return _homes(rows, homes)


def _probed(table: pa.Table, block: pa.Table, model: Model, plan: tuple[int, int, int], homes: int) -> pa.Table:
    """One bucket of pairs beside its block of the filter: scores by text."""
    h, to, times, known = (_column(table, c, t) for c, t in (("hashes", np.uint64), ("rows", np.int64), ("times", np.uint32), ("extra", np.uint8)))
    data = block["block"][0].as_py() if len(block) else bytes(plan[1] // 8)
    level = Filter(0, plan[1], plan[2], data).levels(h)
    texts, at = np.unique(to, return_inverse=True)
    rows = np.zeros(len(texts), dtype=_PART)
    rows["row"] = texts
    before, word = known.reshape(-1, 2).astype(np.int64).T if len(known) else np.zeros((2, 0), dtype=np.int64)
    rows["score"] = np.bincount(at, weights=times * model.log10(level, before, word), minlength=len(texts))
    return _homes(rows, homes)


def _summing(homes: int):
    return lambda table: _rare(table, homes)


def _summing_or_probing(shared, plan: tuple[int, int, int], homes: int):
    empty = pa.table({"home": pa.array([], pa.int64()), "rows": pa.array([], pa.binary())})

    def run(table: pa.Table, block: pa.Table) -> pa.Table:
        if not len(table):
            return empty  # a block that no pair is sent to
        return _probed(table, block, shared.value, plan, homes) if table["kind"][0].as_py() else _rare(table, homes)

    return run


def _added(table: pa.Table) -> pa.Table:
    """The sums of the texts of one home."""
    rows = np.frombuffer(b"".join(table["rows"].to_pylist()), dtype=_PART)
    texts, at = np.unique(rows["row"], return_inverse=True)
    doc = np.zeros(len(texts), dtype=np.int64)
    doc[at[rows["own"]]] = rows["doc"][rows["own"]]
    sums = {c: np.bincount(at, weights=rows[c], minlength=len(texts)) for c in _SUMS}
    return pa.table({"doc_id": doc, **{c: v.astype(np.int64) if c[0] == "n" else v for c, v in sums.items()}})


def _broadcast_parts(ordered: DataFrame, plans: dict[int, tuple[int, int, int]], each: dict[int, int]) -> dict[int, dict]:
    """The parts of the filters as broadcasts by kind and number; the driver holds one at a time."""
    context = ordered.sparkSession.sparkContext
    shared: dict[int, dict] = {0: {}, 1: {}}
    for (kind, k), rows in groupby(ordered.toLocalIterator(), key=lambda r: (r.kind, r.part)):
        (bits, block, _), first = plans[kind], k * each[kind]
        n = block // 8
        data = bytearray(n * min(each[kind], (1 << bits) - first))
        for r in rows:
            data[(r.bucket - first) * n : (r.bucket - first + 1) * n] = r.block
        shared[kind][k] = context.broadcast(data)
    return shared


def score(docs: DataFrame, folds: int = 7, held: int = 2, weight: float = 0.4, heavy: int = 100_000, bits_per_key: int = 16, filter_bytes: int = 8 << 20, max_parts: int = 32) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document.

    weight: of word pairs, picked on a slice of training texts.
    """
    spark = docs.sparkSession
    C.bounded(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(5, int(total // (4 << 20)).bit_length())
    counted = C.staged(texts.mapInArrow(_count(bits, folds, held), PACKED).groupBy("kind", "bucket").applyInArrow(_summed, COUNTED))
    sums = {r.kind: r for r in counted.groupBy("kind").agg(F.sum("tokens").alias("tokens"), F.sum("distinct_keys").alias("distinct_keys"), F.array(*[F.sum(F.get("levels", F.lit(i))) for i in range(LEVELS)]).alias("levels")).collect()}
    tokens, distinct = (sums[0].tokens, sums[0].distinct_keys) if 0 in sums else (0, 0)
    plans = {k: (bits, *_plan(sums[k].levels if k in sums else [0] * LEVELS, 1 << bits, bits_per_key)) for k in (0, 1)}
    each = {k: max(1, filter_bytes // (block // 8)) for k, (_, block, _) in plans.items()}
    route = -(-(1 << bits) // each[1]) > max_parts
    blocks = counted.select("kind", "bucket", "hashes", "counts").mapInArrow(_block_of(plans), "kind int, bucket int, block binary")
    if route:
        blocks = C.staged(blocks)
    part = F.expr(f"bucket div if(kind = 0, {each[0]}, {each[1]})").cast("int")
    ordered = blocks.where("kind = 0" if route else "true").withColumn("part", part).repartition(C.shuffle_partitions(spark), "kind", "part").sortWithinPartitions("kind", "bucket")
    shared = _broadcast_parts(ordered, plans, each)
    filters = {k: Parted(*plans[k], each[k], shared[k]) for k in (0, 1)}
    top = counted.select("kind", "hashes", "counts").mapInArrow(_heavy(tokens / heavy), "kind int, hash long, n long").collect()
    documents = sum(r.n for r in counted.where(F.col("kind") == 0).where(F.col("bucket") == int(_bucket_of(np.array([END]), bits)[0])).select("hashes", "counts").mapInArrow(_count_of(int(END)), "n long").collect())
    model = spark.sparkContext.broadcast(Model(Heavy([r for r in top if r.kind == 0]), Heavy([r for r in top if r.kind == 1]), tokens, distinct, documents, weight))
    buckets = max(C.shuffle_partitions(spark), tokens // 2_000_000, 1)
    routed = texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_score(model, filters, route, buckets, folds, held), ROUTED)
    packed = "home long, rows binary"
    if route:
        met = routed.groupBy("kind", "bucket").cogroup(blocks.where("kind = 1").groupBy("kind", "bucket")).applyInArrow(_summing_or_probing(model, plans[1], buckets), packed)
    else:
        met = routed.groupBy("bucket").applyInArrow(_summing(buckets), packed)
    sums = met.groupBy("home").applyInArrow(_added, PARTIAL)
    out = F.crc32(F.coalesce(F.when(F.col("doc_id") != _NO_ID, F.col("doc_id").cast("string")), F.lit("")).cast("binary")) % folds == held
    return sums.select(F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"), out.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(tokens + distinct + 1)))).alias("base_score"), "score")


def _heavy(floor: float):
    """Words counted over floor times, of which there are at most tokens / floor, with their counts; pairs, with levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, hashes, counts in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                n = np.frombuffer(counts, dtype=np.int64)
                at = np.flatnonzero(n > floor)
                own = _level(n[at]) if kind else n[at]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.int32()), C.signed(np.frombuffer(hashes, dtype=np.uint64)[at]), pa.array(own)], names=["kind", "hash", "n"])

    return run


def _count_of(key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = np.flatnonzero(np.frombuffer(hashes, dtype=np.uint64) == _U(key))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(counts, dtype=np.int64)[at])], names=["n"])

    return run
