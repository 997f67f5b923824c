"""Texts that polynomial hashes modulo a power of two can't tell apart must be told apart by every operator."""

import re
import zlib

import numpy as np
import pytest

from pigmenta.llm import common as C
from pigmenta.llm import lm, minhash, quality, repeats


def thue_morse(bits, a, b):
    """Two different texts of 2**bits characters that collide under all polynomials modulo 2**64 from 11 bits on."""
    ones = [bin(i).count("1") % 2 for i in range(1 << bits)]
    return "".join(a if x else b for x in ones), "".join(b if x else a for x in ones)


X, Y = thue_morse(11, "a", "b")


def polynomial(text):
    h = 0
    for c in text:
        h = (h * 0x9E3779B97F4A7C15 + ord(c)) % (1 << 64)
    return h


def test_the_two_texts_do_collide_elsewhere():
    assert X != Y and polynomial(X) == polynomial(Y)


def test_hashes_of_ranges_depend_on_their_bytes_alone():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    start = rng.integers(0, 4900, 3000)
    end = start + rng.integers(0, 40, 3000)
    one, two = C.hash_bytes(C.eights(data), start, end, *C.SEEDS)
    by = {}
    for a, b, h, g in zip(start, end, one, two, strict=True):
        by.setdefault(data[a:b].tobytes(), set()).add((h, g))
    assert all(len(x) == 1 for x in by.values()) and len({h for x in by.values() for h, _ in x}) == len({g for x in by.values() for _, g in x}) == len(by)
    runs = C.hash_runs(one, np.array([0, 3, 3]), np.array([3, 3, 9]), C.SEEDS[0])[0]
    assert runs[0] == C.hash_runs(one[:3], np.array([0]), np.array([3]), C.SEEDS[0])[0][0] and len(set(runs.tolist())) == 3


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")


def test_lines(spark):
    row = quality.line_quality(docs_of(spark, [f"{X}\n{Y}\n{X}"])).first()
    assert row.n_dup_lines == 1


def test_shingles(spark):
    words = " ".join(X.replace("a", "aa ").replace("b", "bb ").split())
    other = " ".join(Y.replace("a", "aa ").replace("b", "bb ").split())
    rows = minhash.near_duplicates(docs_of(spark, [f"{X} one two", f"{Y} one two", f"{words[:50]} x", f"{other[:50]} x"]), n=3, pct=85).collect()
    assert {r.doc_id: r.component_id for r in rows} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_words_of_the_model(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2][:2] + [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    table = spark.createDataFrame([(i, t) for i, t in zip(ids, [X, "z", X, Y], strict=True)], "doc_id long, text string")
    rows = {r.doc_id: r for r in lm.score(table).collect()}
    assert rows[ids[2]].n_known == 2 and rows[ids[3]].n_known == 1


@pytest.mark.parametrize("width", [100, 600])
def test_bytes(spark, width):
    kept = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeated_bytes(docs_of(spark, [X, Y, X]), width=width).collect()}
    seen, want = set(), {}
    for i, raw in enumerate(t.encode() for t in (X, Y, X)):
        gone = set()
        for k in range(len(raw) - width + 1):
            if raw[k : k + width] in seen:
                gone |= set(range(k, k + width))
            seen.add(raw[k : k + width])
        want[i] = bytes(c for k, c in enumerate(raw) if k not in gone)
    assert kept == want


def test_sentences(spark):
    say = lambda t: f"{t}. and then some more words follow here to make the run long enough for it."
    rows = {r.doc_id: r.n_removed for r in repeats.remove_repeated_sentences(docs_of(spark, [say(X), say(Y), say(X)])).collect()}
    assert rows == {0: 0, 1: 0, 2: 2} and len(re.findall(r"\S+", say(X))) >= 16
