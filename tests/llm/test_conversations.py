"""Repair of conversations against all edits there are, in one go and by pieces, and on odd tables."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from pigmenta.llm import conversations as conv

ROWS = "conv_id long, turn long, role string, text string, state string, part int, cost long"
random.seed(4)
ROLES = ["user", "assistant", "system", "tool", "", None, "umpire"]
SAID = ["Yes.", "no", "Why?", "", " \n", None, "A.\nB", "done! ", "Yes."]


def table():
    rows = []
    for c in range(60):
        alternating = c % 3 == 0
        for t in range(random.randint(1, 9)):
            role = ["user", "assistant"][t % 2] if alternating else random.choice(ROLES)
            rows.append((c, None if random.random() < 0.1 else t + random.choice([0, 0, 0, 2]), role, random.choice(SAID) if random.random() < 0.5 else f"turn {random.random()}.", "x", 1, 2))
    rows += rows[:12]
    rows += [(None, 1, "user", "Hello.", "x", 1, 2), (None, 2, "assistant", "Hi.", "x", 1, 2), (99, None, "user", "long " * 20_000 + ".", "x", 1, 2), (98, 2**62, "system", "s.", "x", 1, 2)]
    rows += [(77, t // 3, "user" if t % 2 else "assistant", f"{t}{'.' * (t % 5 > 0)}", "x", 1, 2) for t in range(60)]
    return rows


def repaired(rows):
    """The contract, read literally."""
    out = {}
    for c in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text, *_ in (r for r in rows if r[0] == c):
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if kind:
                turns += [(turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        faults = []
        for k, (_, role, text) in enumerate(turns):
            bare = re.findall(r"[^\x20\x09-\x0d]", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in [t[1:] for t in turns[:k]] else "truncated" if bare[-1] not in ".!?" else "")
        known = {t[0] for t in turns} - {None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        marks = [t[1][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

        @lru_cache(None)
        def best(i, state, room, turns=turns, faults=faults):
            """Cost, audit and what is said, from row i on; room: insertions in a row that may follow."""
            ways = [(0, "", ())] if i == len(turns) and state in ("", "a") else []
            for role in ("user", "assistant") if room else ():
                if to := after.get((state, role[0])):
                    ways += [(3 + x[0], "I" + x[1], (role + ":", *x[2])) for x in [best(i, to, room - 1)] if x]
            if i < len(turns):
                ways += [(4 + x[0], "D" + x[1], x[2]) for x in [best(i + 1, state, 2)] if x]
                if faults[i] not in ("blank", "duplicate"):
                    for edit, role in (("K", turns[i][1]), ("R", "user"), ("R", "assistant")):
                        if to := after.get((state, role[:1])):
                            own = 3 * (edit == "R") + 3 * (faults[i] == "truncated")
                            ways += [(own + x[0], edit + x[1], (f"{role}:{turns[i][2]}", *x[2])) for x in [best(i + 1, to, 2)] if x]
            return min(ways) if ways else None

        cost, audit, said = best(0, "", 2)
        out[c] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()), said
    return out


@pytest.fixture(scope="module")
def case(spark):
    rows = table()
    return conv.damage(spark.createDataFrame(rows, ROWS).repartition(3)), repaired(rows)


@pytest.mark.parametrize("bounds", [{}, {"long_rows": 0, "piece_rows": 3}, {"long_rows": 5, "piece_rows": 1}, {"long_bytes": 30, "piece_bytes": 20}])
def test_equals_the_cheapest_of_all_edits(case, bounds):
    rows, want = case
    got = conv.repair(rows, **bounds).collect()
    assert len(got) == len(want) and {r.conv_id: tuple(r)[1:] for r in sorted(got, key=str)} == {c: x for c, (x, _) in want.items()}


@pytest.mark.parametrize("bounds", [{}, {"long_rows": 4, "piece_rows": 2}])
def test_repaired_turns(case, bounds):
    rows, want = case
    got = {}
    for r in sorted(conv.repaired_turns(rows, **bounds).collect(), key=lambda r: (r.part, r.place)):
        got.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert got == {c: list(said) for c, (_, said) in want.items() if said}
    assert all(re.fullmatch("(s?(ua)+)?", "".join(s[0] for s in said)) for said in got.values())


def test_equal_rows_of_a_long_conversation_are_counted_as_one(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", 5000), (1, 1, "assistant", "Yes.", 1), (1, 2, "user", "Hi.", 1)], "conv_id long, turn long, role string, text string, copies long")
    got = conv.repair(rows).first()
    assert (got.duplicate, got.cost, got.audit) == (5000, 20000, "K" + "D" * 4999 + "KD")


def test_empty_tables_and_dropped_conversations(spark):
    assert conv.repair(conv.damage(spark.createDataFrame([], ROWS))).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = conv.repair(conv.damage(spark.createDataFrame([(dropped, 0, "user", "Hi.", "x", 1, 2)], ROWS))).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
