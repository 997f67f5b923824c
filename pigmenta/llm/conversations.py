"""Operator 11, repair of conversation structure by dynamic programming over the turns that are retained.

A repaired conversation has role initials (s?(ua)+)?. Between two retained turns, kept or given another role, the gap
costs what the deletions in it cost, by prefix sums, and the insertions that the pair of roles asks for; so for each
state, the role last said, a running minimum of cost less deleted prefix is all that a later turn needs of earlier ones.
Of equally cheap ways the one whose audit, the initials of its edits, is least in ASCII is taken. Two different audits of
equal cost over the same turns never begin one with the other, as an insertion costs, so minima may be taken early.

Conversations of up to long_rows turns and long_bytes of text are dealt by their id, and a task holds one at a time.
Longer ones are sorted by range over many tasks, after equal rows are counted as one, and cut into pieces; a piece is
priced for every state it may be entered and left in, these prices are chained piece by piece, and the pieces are then
repaired each by itself. The hash of a repaired conversation is the one thing that passes along its pieces in order.

Defined cases: a null role or text is one space; a null conv_id is a conversation of its own; null turns come first;
rows of one turn go by role, then text, in UTF-8 byte order, so repeated rows are neighbours; conversations of which no
row is left have zeros, an empty audit and the hash of an empty text; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ship
from . import common as C

SPACE = " \t\n\v\f\r"
KEEP, DELETE, EDIT = 0, 4, 3
#: What was said last: nothing, a first system turn, a user's, an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Insertions between a state and a turn of the role, and at the end.
GAPS = {SYSTEM: {START: 0}, USER: {START: 0, SYSTEM: 0, USER: 1, ASSISTANT: 0}, ASSISTANT: {START: 1, SYSTEM: 1, USER: 0, ASSISTANT: 1}}
TAIL = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
LEGAL = {"su", "ua", "au"}
SALTS = 16
#: Turns and bytes of a piece of a long conversation.
PIECE_ROWS, PIECE_BYTES = 1024, 4 << 20
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damage(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) with copies: how often a row is there after damage, 0 if it is dropped.

    The crc32 of conv_id:turn, modulo 20, says what happens: 0 drops, 1 empties the text, 2 takes its .!? away, 3 repeats
    the row, 4 makes the role user. Nulls are written as one space.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(said("conv_id"), F.lit(":"), said("turn")), "UTF-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    return rows.select("conv_id", F.col("turn").cast("long"), F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


class Turn:
    """A row with its first fault, and how many equal rows follow it."""

    __slots__ = ("fault", "more", "role", "text")

    def __init__(self, role: str, text: str, seen: bool, more: int):
        bare = text.rstrip(SPACE)
        self.role, self.text, self.more = role, text, more
        self.fault = "blank" if not bare else "duplicate" if seen else "truncated" if bare[-1] not in ".!?" else ""

    def faults(self, kind: str) -> int:
        """Its copies are as blank as it is, else duplicates."""
        return (self.fault == kind) + self.more * (kind == ("blank" if self.fault == "blank" else "duplicate"))


def priced(turns: list[Turn], entry: int) -> dict[int, tuple[int, str]]:
    """Cost and audit of the cheapest way through the turns from a state, by the state in which it ends."""
    deleted, best = 0, {entry: (0, "")}  # of each state: cost less all deletions so far, audit
    for t in turns:
        held = {}
        if t.fault in ("", "truncated"):
            extra, initial = EDIT * (t.fault == "truncated") - DELETE, t.role[:1]
            for state, gaps in GAPS.items():
                keep = initial == "?sua"[state]
                if keep or state != SYSTEM:
                    own = extra + (KEEP if keep else EDIT)
                    ways = [(cost + own + EDIT * gaps[s], audit + "I" * gaps[s] + ("K" if keep else "R")) for s, (cost, audit) in best.items() if s in gaps]
                    if ways:
                        held[state] = min(ways)
        best = {s: (cost, audit + "D") for s, (cost, audit) in best.items()}
        for s, way in held.items():
            best[s] = min(way, best.get(s, way))
        deleted += DELETE * (1 + t.more)
        if t.more:
            best = {s: (cost, audit + "D" * t.more) for s, (cost, audit) in best.items()}
    return {s: (cost + deleted, audit) for s, (cost, audit) in best.items()}


def ended(ways: dict[int, tuple[int, str]]) -> tuple[int, str, int]:
    """Cost, audit and last state of the cheapest of ways that is completed at the end."""
    return min((cost + EDIT * TAIL[s], audit + "I" * TAIL[s], s) for s, (cost, audit) in ways.items())


def edited(turns: list[Turn], audit: str, state: int) -> list[tuple[str, str]]:
    """The repaired turns, role and text, that an audit makes of turns."""
    out, todo = [], iter([x for t in turns for x in (t, *[t] * t.more)])
    for edit in audit:
        t = next(todo) if edit != "I" else None
        if edit == "D":
            continue
        if edit == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[t.role[0]]
            out.append((t.role, t.text))
        else:
            state = ASSISTANT if state == USER else USER
            out.append((ROLE[state], t.text if t else ""))
    return out


def _illegal(turns: list[Turn], before: str | None) -> int:
    count = 0
    for t in turns:
        one = t.role[:1]
        count += (before is not None and before + one not in LEGAL) + t.more * (one + one not in LEGAL)
        before = one
    return count


def _said(items: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in items)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[dict]]]:
    """Rows of the same conv_id, which follow each other."""
    conv, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["conv_id"] != conv:
                yield conv, held
                held = []
            conv = row["conv_id"]
            held.append(row)
    if held:
        yield conv, held


def _made(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _emitted(rows: Iterator[tuple], schema: pa.Schema, most: int = 512, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, list)))
        if len(held) >= most or size >= most_bytes:
            yield _made(held, schema)
            held, size = [], 0
    if held:
        yield _made(held, schema)


def _arrow(schema: str) -> pa.Schema:
    """Arrow's schema of name type, ...; lists of texts are written lines, of numbers longs."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "lines": pa.list_(pa.string()), "longs": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def _ddl(schema: str) -> str:
    return schema.replace(" lines", " array<string>").replace(" longs", " array<long>")


def _order() -> list[Column]:
    return [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _short(rows: DataFrame, kind: str, turns_too: bool) -> DataFrame:
    """The report, repaired_sha256 and, if asked for, repaired turns of conversations that a task may hold, one at a time."""
    schema = f"conv_id {kind}, {REPORT}, repaired_sha256 string, roles lines, texts lines"
    arrow = _arrow(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, held in _groups(batches):
            seen, turns, numbers = set(), [], set()
            for r in held:
                if r["copies"]:
                    key = (r["role"], r["text"])
                    turns.append(Turn(*key, key in seen, r["copies"] - 1))
                    seen.add(key)
                    numbers.add(r["turn"])
            numbers.discard(None)
            gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
            cost, audit, _ = ended(priced(turns, START))
            items = edited(turns, audit, START)
            sha = hashlib.sha256(_said(items).encode()).hexdigest()
            yield conv, gaps, *(sum(t.faults(k) for t in turns) for k in ("blank", "duplicate", "truncated")), _illegal(turns, None), cost, audit, sha, *(([r for r, _ in items], [t for _, t in items]) if turns_too else (None, None))

    dealt = rows.repartition(C.ranges(rows), "conv_id").sortWithinPartitions(*_order())
    return dealt.mapInArrow(lambda batches: _emitted(each(batches), arrow), _ddl(schema))


def _flagged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies and seen of the different rows: whether an earlier turn says the same."""
    rows = rows.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumns({"_at": F.struct(F.col("turn").isNotNull().alias("given"), "turn"), "_h": F.xxhash64("role", "text"), "_g": F.xxhash64(F.lit(1), "text", "role")})
    first = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("_h").alias("_fh"), F.col("_g").alias("_fg")).agg(F.min("_at").alias("_first"))
    first = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_h") == F.col("_fh")) & (F.col("_g") == F.col("_fg")) & (F.col("_own") == F.col("_salt")))
    return rows.select("conv_id", "turn", "role", "text", "copies", (F.col("_at") != F.col("_first")).alias("seen"))


def _pieces(rows: DataFrame, kind: str, piece_rows: int, piece_bytes: int) -> DataFrame:
    """The pieces of long conversations, in order of (part, no): their turns, and what each way through them costs."""
    schema = f"conv_id {kind}, part int, no long, first string, last string, blank long, duplicate long, truncated long, illegal long, roles lines, texts lines, seen longs, more longs, costs longs, audits lines"
    arrow = _arrow(schema)

    def piece(conv: object, part: int, no: int, turns: list[Turn]) -> tuple:
        ways = [priced(turns, entry) for entry in range(4)]
        costs = [w.get(s, (-1, ""))[0] for w in ways for s in range(4)]
        audits = [w.get(s, (-1, ""))[1] for w in ways for s in range(4)]
        counts = [sum(t.faults(k) for t in turns) for k in ("blank", "duplicate", "truncated")]
        return conv, part, no, turns[0].role[:1], turns[-1].role[:1], *counts, _illegal(turns, None), [t.role for t in turns], [t.text for t in turns], [int(t.fault == "duplicate") for t in turns], [t.more for t in turns], costs, audits

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from pyspark import TaskContext

        part, no, conv, turns, size = TaskContext.get().partitionId(), 0, None, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if turns and (r["conv_id"] != conv or len(turns) >= piece_rows or size >= piece_bytes):
                    yield piece(conv, part, no, turns)
                    no, turns, size = no + 1, [], 0
                conv = r["conv_id"]
                turns.append(Turn(r["role"], r["text"], r["seen"], r["copies"] - 1))
                size += len(r["text"])
        if turns:
            yield piece(conv, part, no, turns)

    rows = C.staged(rows)
    dealt = rows.repartitionByRange(C.ranges(rows), *_order()).sortWithinPartitions(*_order())
    return C.staged(dealt.mapInArrow(lambda batches: _emitted(each(batches), arrow, 64), _ddl(schema)))


def _chained(pieces: DataFrame, kind: str) -> DataFrame:
    """A row a piece with the audit it gets and the state it begins in; the first of a conversation has its totals."""
    schema = f"conv_id {kind}, part int, no long, entry int, own string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    arrow = _arrow(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, held in _groups(batches):
            ways, before, illegal, back = {START: (0, "")}, None, 0, []
            for p in held:
                illegal += p["illegal"] + (before is not None and before + p["first"] not in LEGAL)
                before, reached, came = p["last"], {}, {}
                for s, (cost, audit) in ways.items():
                    for to in range(4):
                        if (own := p["costs"][4 * s + to]) >= 0:
                            way = (cost + own, audit + p["audits"][4 * s + to])
                            if to not in reached or way < reached[to]:
                                reached[to], came[to] = way, s
                ways = reached
                back.append(came)
            cost, audit, state = ended(ways)
            tail, path = "I" * TAIL[state], []
            for p, came in zip(reversed(held), reversed(back), strict=True):
                path.append((p["part"], p["no"], came[state], p["audits"][4 * came[state] + state] + tail))
                tail, state = "", came[state]
            totals = [sum(p[k] for p in held) for k in ("blank", "duplicate", "truncated")]
            for k, row in enumerate(reversed(path)):
                yield conv, *row, *([None] * 6 if k else [*totals, illegal, cost, audit])

    small = pieces.select("conv_id", "part", "no", "first", "last", "blank", "duplicate", "truncated", "illegal", "costs", "audits")
    dealt = small.repartition(C.ranges(small), "conv_id").sortWithinPartitions("conv_id", "part", "no")
    return C.staged(dealt.mapInArrow(lambda batches: _emitted(each(batches), arrow), _ddl(schema)))


def _mended(pieces: DataFrame, chained: DataFrame, kind: str) -> DataFrame:
    """conv_id, part, no, roles and texts of repaired pieces."""
    schema = f"conv_id {kind}, part int, no long, roles lines, texts lines"
    arrow = _arrow(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for p in batch.to_pylist():
                turns = [Turn(*x) for x in zip(p["roles"], p["texts"], map(bool, p["seen"]), p["more"], strict=True)]
                items = edited(turns, p["own"], p["entry"])
                yield p["conv_id"], p["part"], p["no"], [r for r, _ in items], [t for _, t in items]

    both = pieces.select("conv_id", "part", "no", "roles", "texts", "seen", "more").join(chained.select("part", "no", "entry", "own"), ["part", "no"])
    return both.mapInArrow(lambda batches: _emitted(each(batches), arrow, 64), _ddl(schema))


def _hashed(mended: DataFrame, kind: str) -> DataFrame:
    schema = f"conv_id {kind}, repaired_sha256 string"
    arrow = _arrow(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, sha = None, None
        for batch in batches:
            for p in batch.to_pylist():
                if sha is not None and p["conv_id"] != conv:
                    yield conv, sha.hexdigest()
                    sha = None
                if sha is None:
                    conv, sha, begun = p["conv_id"], hashlib.sha256(), False
                if p["roles"]:
                    sha.update(("\n" * begun + _said(list(zip(p["roles"], p["texts"], strict=True)))).encode())
                    begun = True
        if sha is not None:
            yield conv, sha.hexdigest()

    dealt = mended.repartition(C.shuffle_partitions(mended.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "no")
    return dealt.mapInArrow(lambda batches: _emitted(each(batches), arrow), _ddl(schema))


def _long(rows: DataFrame, kind: str, piece_rows: int, piece_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The report with repaired_sha256, and the repaired pieces, of conversations of any length."""
    flagged = _flagged(rows)
    numbers = rows.where("copies > 0").groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    pieces = _pieces(flagged, kind, piece_rows, piece_bytes)
    chained = _chained(pieces, kind)
    mended = _mended(pieces, chained, kind)
    report = chained.where("cost is not null").drop("part", "no", "entry", "own")
    for more in (numbers, _hashed(mended, kind)):
        more = more.withColumnRenamed("conv_id", "_conv")
        report = report.join(more, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    return report, mended


def _split(rows: DataFrame, long_rows: int, long_bytes: int) -> tuple[DataFrame, DataFrame | None, str]:
    """Rows of shorter and of longer conversations, and what type their ids have."""
    spark = rows.sparkSession
    ship(spark)
    C.bounded(spark)
    rows = rows if "copies" in rows.columns else rows.withColumn("copies", F.lit(1).cast("long"))
    said = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")}
    kind = "string" if dict(rows.dtypes)["conv_id"] == "string" else "long"
    rows = rows.select(F.col("conv_id").cast(kind), F.col("turn").cast("long"), said["role"], F.when(F.col("copies") > 0, said["text"]).otherwise("").alias("text"), F.col("copies").cast("long"))
    sizes = rows.groupBy(F.col("conv_id").alias("_conv")).agg(F.count("*").alias("rows"), F.sum(F.octet_length("text") * F.col("copies")).alias("bytes"), F.sum("copies").alias("copies"))
    many = C.staged(sizes.where((F.col("rows") > long_rows) | (F.col("copies") > long_rows) | (F.col("bytes") > long_bytes)).where("copies > 0").select("_conv"))
    if many.isEmpty():
        return rows, None, kind
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    return rows.join(many, same, "left_anti"), rows.join(many, same, "left_semi"), kind


def repair(rows: DataFrame, long_rows: int = 4096, long_bytes: int = 8 << 20, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation.

    rows: conv_id, turn, role, text, and maybe copies, how often each row counts; one of 0 only names its conversation.
    """
    few, many, kind = _split(rows, long_rows, long_bytes)
    out = _short(few, kind, False).drop("roles", "texts")
    return out if many is None else out.unionByName(_long(many, kind, piece_rows, piece_bytes)[0])


def repaired_turns(rows: DataFrame, long_rows: int = 4096, long_bytes: int = 8 << 20, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """conv_id, part, place, role and text of the repaired conversations' turns, in order of part and place."""
    few, many, kind = _split(rows, long_rows, long_bytes)
    out = _short(few, kind, True).select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("no"), "roles", "texts")
    if many is not None:
        out = out.unionByName(_long(many, kind, piece_rows, piece_bytes)[1])
    turns = out.select("conv_id", "part", "no", F.posexplode(F.arrays_zip(F.col("roles").alias("role"), F.col("texts").alias("text"))))
    return turns.select("conv_id", F.struct("part", "no").alias("part"), F.col("pos").alias("place"), "col.role", "col.text")
