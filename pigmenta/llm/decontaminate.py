"""Operator 5, benchmark decontamination: a generalised suffix automaton of the test items.

The automaton reads the normalised words of all items. Tasks stream the words of documents through it and follow the
length of the longest match at each word; a match of window words or more, or of a whole shorter item, marks its words
as hit. The items of a match are found at the automaton's state for the window.

The automaton is broadcast, so its size is checked: the items of a benchmark of over max_item_words words are dealt by
hash to parts of about that. Tasks build the automata of the parts and stage them; the driver hands them on one at a
time. A scanning task reads its texts through one part after the other and joins the spans of each text; what to cut or
drop is decided once, from the spans of all parts on the text as given.

Words: A-Z in lower case, then runs of digits, letters a-z and characters outside ASCII. Defined cases: a null or empty
text has no words and no hits; an item without words has no window; items with equal words are hit together, rows that
repeat an item_id count once; rows that repeat a doc_id are judged each by itself; an empty
table of documents gives no rows, of items no hits; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_b = np.arange(256)
_IS = ((_b >= 48) & (_b <= 57)) | ((_b >= 97) & (_b <= 122)) | (_b >= 128)
#: Lower-cases A-Z and turns all that no word has into spaces.
NORMAL = bytes(np.where(_IS[C.LOWER], C.LOWER, 32).astype(np.uint8))
SCHEMA = "doc_id long, n_words long, hit_spans array<int>, items array<string>"


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.translate(NORMAL).split()


class Automaton:
    """Suffix automaton of several word sequences.

    step: transitions of each state; link: its suffix link; length: its longest string. window_items: for a state whose
    strings include one of window words, the items with that window. whole: for a state that is the end of a shorter
    item, (its words, the items).
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._add(last, self.words.setdefault(w, len(self.words)))
        self.window_items: dict[int, set[str]] = {}
        self.whole: dict[int, tuple[int, set[str]]] = {}
        for name, words in items:
            state = 0
            for at, w in enumerate(words):
                state = self.step[state][self.words[w]]
                if at + 1 >= window:
                    state = self._shrink(state)
                    self.window_items.setdefault(state, set()).add(name)
            if 0 < len(words) < window:
                self.whole.setdefault(state, (len(words), set()))[1].add(name)
        #: The nearest state at or above each that ends a whole shorter item, or -1.
        self.ends = [-1] * len(self.link)
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.ends[s] = s if s in self.whole else self.ends[self.link[s]] if s else -1

    def _shrink(self, state: int) -> int:
        """The state of the last window words of what led to state."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _copy(self, p: int, q: int, w: int) -> int:
        new = len(self.step)
        self.step.append(dict(self.step[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = new
            p = self.link[p]
        return new

    def _add(self, last: int, w: int) -> int:
        q = self.step[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, q, w)
        new = len(self.step)
        self.step.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, q, w)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Hit spans as start, end, start, end ... in words, and the items that occur."""
        step, link, length, window, ends = self.step, self.link, self.length, self.window, self.ends
        spans: list[int] = []
        found: set[str] = set()
        state = matched = 0
        for at, w in enumerate(map(self.words.get, words)):
            if w is None:
                state = matched = 0
                continue
            while state and w not in step[state]:
                state = link[state]
                matched = length[state]
            nxt = step[state].get(w)
            if nxt is None:
                continue
            state = nxt
            matched += 1
            hit = 0
            if matched >= window:
                while length[link[state]] >= window:
                    state = link[state]
                matched = min(matched, length[state])
                found |= self.window_items[state]
                hit = window
            e = ends[state]
            if e == state and matched < self.whole[e][0]:
                e = ends[link[e]]
            while e >= 0:
                n, names = self.whole[e]
                found |= names
                hit = max(hit, n)
                e = ends[link[e]] if e else -1
            if hit:
                lo = at + 1 - hit
                while spans and spans[-1] >= lo:
                    hi = spans.pop()
                    lo = min(lo, spans.pop())
                    del hi
                spans += [lo, at + 1]
        return spans, found


def _union(a: list[int], b: list[int]) -> list[int]:
    """Spans that are in one of two lists of spans, with those that touch joined."""
    out: list[int] = []
    for lo, hi in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and out[-1] >= lo:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


class Parts:
    """The broadcast parts of the benchmark. Only one is in a task's memory at a time."""

    def __init__(self, shared: list):
        self.shared = shared
        self.only: Automaton | None = None

    def _automata(self) -> Iterator[Automaton]:
        if len(self.shared) > 1:
            yield from (pickle.loads(C.read_once(x)) for x in self.shared)
        else:
            self.only = self.only or pickle.loads(self.shared[0].value)
            yield self.only

    def scan(self, texts: pa.Array) -> tuple[list[int], list[list[int]], list[set[str]]]:
        """Of each text: its words, its hit spans and the items that occur."""
        n, spans, items = [0] * len(texts), [[] for _ in range(len(texts))], [set() for _ in range(len(texts))]
        for k, automaton in enumerate(self._automata()):
            for s in C.slices(texts):
                raw = s.data.tobytes().translate(NORMAL)
                for i, (lo, hi) in enumerate(zip(s.offs[:-1].tolist(), s.offs[1:].tolist(), strict=True), s.lo):
                    words = raw[lo:hi].split()
                    n[i] = len(words)
                    found, names = automaton.scan(words)
                    spans[i] = _union(spans[i], found) if k and found else spans[i] if k else found
                    items[i] |= names
        return n, spans, items


def _scanner(shared: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(shared)
        for batch in batches:
            n, spans, items = parts.scan(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                names=["doc_id", "n_words", "hit_spans", "items"],
            )

    return run


def _builder(window: int):
    def run(table: pa.Table) -> pa.Table:
        part = sorted((name or "", words_of(text)) for name, text in zip(table["item_id"].to_pylist(), table["text"].to_pylist(), strict=True))
        return pa.table({"part": table["part"][:1], "automaton": pa.array([pickle.dumps(Automaton(part, window))], pa.binary())})

    return run


#: Words as words_of() has them, for counting.
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _shared(docs: DataFrame, items: DataFrame, window: int, max_item_words: int) -> list:
    """The automata of the parts, broadcast. The driver has one at a time."""
    context = docs.sparkSession.sparkContext
    C.bounded(docs.sparkSession)
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    words = rows.agg(F.sum(F.regexp_count("text", F.lit(_WORDS)))).first()[0] or 0
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-words // max_item_words)))).cast("int")
    built = C.staged(rows.withColumn("part", part).groupBy("part").applyInArrow(_builder(window), "part int, automaton binary"))
    shared = [context.broadcast(bytes(row.automaton)) for row in built.orderBy("part").toLocalIterator()]
    return shared or [context.broadcast(pickle.dumps(Automaton([], window)))]


def scan(docs: DataFrame, items: DataFrame, window: int = 10, max_item_words: int = 100_000) -> DataFrame:
    """doc_id, n_words, hit_spans (start, end, ... in words) and the items found, of each document."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(_scanner(_shared(docs, items, window, max_item_words)), SCHEMA)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document."""
    rows = scan(docs, items, window)
    hit = F.aggregate(F.sequence(F.lit(1), F.size("hit_spans")), F.lit(0).cast("long"), lambda s, i: s + F.get("hit_spans", i - 1) * F.when(i % 2 == 0, 1).otherwise(-1))
    return rows.select("doc_id", "n_words", F.when(F.size("hit_spans") > 0, hit).otherwise(F.lit(0)).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def items_digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _cleaner(shared: list, column: int, chars: int | None, max_span: int, max_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(shared)
        for batch in batches:
            texts, keep = batch.column(column).to_pylist(), []
            _, found, _ = parts.scan(batch.column(column))
            for i, text in enumerate(texts):
                raw = (text or "").encode()
                spans = found[i]
                cut = [(a, b) for a, b in zip(spans[::2], spans[1::2], strict=True) if b - a >= max_span]
                if not cut:
                    keep.append(True)
                    continue
                s = C.Slice(0, 1, np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
                start, end, _ = s.words(_IS[C.LOWER])
                covered = sum(b - a for a, b in cut)
                keep.append(covered <= max_coverage * len(start))
                at, out = 0, []
                for a, b in cut:
                    out.append(raw[at : start[a]])
                    at = end[b - 1]
                texts[i] = b"".join([*out, raw[at:]]).decode()
            new = pa.array(texts, batch.schema.field(column).type)
            columns = list(batch.columns)
            columns[column] = new
            if chars is not None:
                columns[chars] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return run


def remove_spans(docs: DataFrame, items: DataFrame, window: int = 10, max_span: int = 1, max_coverage: float = 0.5, max_item_words: int = 100_000) -> DataFrame:
    """docs, without the hit spans of max_span words or more, and without documents they cover beyond max_coverage.

    n_chars, if there, is set anew for all rows. A null text stays null.
    """
    names = docs.columns
    chars = names.index("n_chars") if "n_chars" in names else None
    shared = _shared(docs, items, window, max_item_words)
    return docs.mapInArrow(_cleaner(shared, names.index("text"), chars, max_span, max_coverage), docs.schema)
