"""The stages of the pipeline, and the queries without SQL, against plain Python on small tables.

The tables have nulls in all columns, repeated rows, ties, empty and long texts, and columns whose names clash with
those that operators make.
"""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from pigmenta.llm import lm, mixing, shards, tokens
from pigmenta.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
MORE = f"{DOCS}, kept boolean, component long, size string, given string, words int, _cuts string"
pick = random.Random(21)
VOCABULARY = ["".join(pick.choice("abcdefghijkl") for _ in range(pick.randint(2, 9))) for _ in range(900)]


def prose(n):
    return " ".join(pick.choice(VOCABULARY) for _ in range(n))


def corpus():
    base = prose(150)
    near = base.split()
    near[70] = "other"
    item = prose(14)
    texts = [None, "", " \n ", "too short", base, base, " ".join(near), f"{prose(80)} {item} {prose(60)}", f"{item} {prose(3)} " + prose(36), prose(2500), "again and again " * 30, "é ü " + prose(70), f"shared\n{prose(60)}"]
    texts += [f"shared menu 1\nall rights\n{prose(70)}" for _ in range(30)] + ["shared menu 2\nall rights\n" + "x y z"]
    rows = [(i, t, "en" if i % 3 else None, ["a", "b", None][i % 3], len(t or "") if i % 5 else None) for i, t in enumerate(texts)]
    rows += [rows[4], rows[7], (None, prose(90), None, None, None), (None, prose(90), None, "a", 7)]
    return rows, [(1, item), (2, "rare words"), (3, None), (4, "")]


ROWS, ITEMS = corpus()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([x for x in ROWS], DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    return at


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema).repartition(3)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_quality(rows):
    """Base rules, line frequency with over 20 documents and 0.5 percent of a host, depletion over 60 percent."""
    key = lambda line: re.sub("[0-9]", "0", " ".join(words_of(lower(line))))
    lines = [[x for x in (r[1] or "").split("\n") if words_of(x)] for r in rows]
    held, hosts = {}, {}
    for r, own in zip(rows, lines, strict=True):
        hosts[r[3]] = hosts.get(r[3], 0) + 1
        for line in own:
            held.setdefault((r[3], key(line)), set()).add(r[1])
    common = {x for x, sets in held.items() if len(sets) > 20 and len(sets) > 0.005 * hosts[x[0]]}
    verdict, removed = {}, {}
    for r, own in zip(rows, lines, strict=True):
        w = words_of(r[1])
        at = {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        repeat = {i + j for x in at.values() if len(x) > 1 for i in x for j in range(3)}
        removed[r[0]] = removed.get(r[0], 0) + sum(len(words_of(x)) for x in own if (r[3], key(x)) in common)
        verdict.setdefault(r[0], []).append(len(w) >= 50 and 100 * len(repeat) <= 50 * len(w))
    out = []
    for r in rows:
        if all(verdict[r[0]]) and 100 * removed[r[0]] <= 60 * len(words_of(r[1])):
            text = "\n".join(x for x in r[1].split("\n") if not words_of(x) or (r[3], key(x)) not in common)
            out.append((r[0], text, r[2], r[3], len(text)))
    return out


def test_quality_rules(spark, sf_dir):
    got = P.quality_rules(spark, frame(spark, ROWS), sf_dir)
    want = brute_quality(ROWS)
    assert 20 < len(want) < len(ROWS) and any("shared" in r[1] for r in ROWS if r[1]) and rows_of(got) == sorted(want, key=repr)


def brute_near(rows, n=5, pct=80):
    sets = []
    for r in rows:
        w = words_of(lower(r[1]))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    ids = [-(1 << 63) if r[0] is None else r[0] for r in rows]
    root = dict(zip(ids, ids, strict=True))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= pct * len(a | b):
                x, y = root[ids[i]], root[ids[j]]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return [r for r, k in zip(rows, ids, strict=True) if root[k] == k]


def test_near_duplicates(spark, sf_dir):
    want = brute_near(ROWS)
    assert {r[0] for r in ROWS} - {r[0] for r in want} == {5, 6}
    assert rows_of(P.near_duplicates(spark, frame(spark, ROWS), sf_dir)) == sorted(want, key=repr)


def test_near_duplicates_of_the_small_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    want = brute_near([tuple(r) for r in docs.collect()])
    assert rows_of(P.near_duplicates(spark, docs, "")) == sorted(want, key=repr)


def brute_decontaminated(rows, items, window=10):
    said = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = set()
    for _, text in items:
        w = said(text)
        windows |= {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1)) if w}
    out = []
    for r in rows:
        text = r[1]
        if text is None:
            out.append((*r[:4], None))
            continue
        found = list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text))
        w = [lower(m[0]) for m in found]
        hit = set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if len(hit) > 0.5 * len(w):
            continue
        at, kept = 0, []
        for i in sorted(hit):
            if i - 1 not in hit:
                kept.append(text[at : found[i].start()])
            at = found[i].end() if i + 1 not in hit else at
        new = "".join([*kept, text[at:]])
        out.append((*r[:1], new, *r[2:4], len(new)))
    return out


def test_decontamination(spark, sf_dir):
    want = brute_decontaminated(ROWS, ITEMS)
    assert len(want) == len(ROWS) and sum(a[1] != b[1] for a, b in zip(ROWS, want, strict=True)) == 3
    assert rows_of(P.decontamination(spark, frame(spark, ROWS), sf_dir)) == sorted(want, key=repr)


def test_source_mix(spark, sf_dir):
    docs = frame(spark, ROWS)
    got = P.source_mix(spark, docs, sf_dir)
    assert got.columns == docs.columns and rows_of(got) == rows_of(P.source_mix(spark, docs.repartition(5), sf_dir))
    own = {}
    for r in ROWS:
        own.setdefault((r[0], r[3]), []).append(r)
    taken, sizes = {}, {}
    for r in got.collect():
        source = own[(r.doc_id, r.source)]
        whole = [x for x in source if x[1] == r.text]
        assert r.n_chars == len(r.text) and (whole or any(_picked(words_of(r.text), words_of(x[1])) for x in source))
        taken[r.source] = taken.get(r.source, 0) + len(words_of(r.text))
    for r in ROWS:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words_of(r[1]))
    targets = brute_targets(sizes)
    assert all(abs(taken[s] - t) <= 64 for s, t in targets.items())
    per_doc = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert all(r.taken <= 2 * r["size"] for r in per_doc.values())


def _picked(some, all_):
    rest = iter(all_)
    return all(x in rest for x in some)


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    open_, target, left = set(order), {}, 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2 * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full


def test_token_files(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(tokenizer_path()))
    got = sorted(P.token_files(spark, frame(spark, ROWS), sf_dir).collect(), key=lambda r: r.start)
    want = sorted(((r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in ROWS), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert [r.doc_id for r in got] == [x[0] for x in want] and all(r.n_tokens == len(r.ids) for r in got)
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in got) == sorted((x[0] is not None, x[0] or 0, x[1]) for x in want)


def test_all_stages_one_after_the_other(spark, sf_dir):
    rows = brute_decontaminated(brute_near(brute_quality(ROWS)), ITEMS)
    ids = {r.doc_id for r in P.run(spark, sf_dir).collect()}
    assert ids and ids <= {r[0] for r in rows}


def test_stages_on_empty_tables_and_on_further_columns(spark, sf_dir):
    empty, wide = spark.createDataFrame([], DOCS), frame(spark, [(*r, False, 1, "s", "g", 2, "c") for r in ROWS], MORE)
    for name, stage in P.STAGES:
        made = stage(spark, empty, sf_dir)
        assert made.count() == 0, name
        if stage is not P.token_files:
            assert made.columns == empty.columns and stage(spark, wide, sf_dir).columns == wide.columns
            narrow = stage(spark, frame(spark, ROWS), sf_dir)
            assert rows_of(stage(spark, wide, sf_dir).select(*narrow.columns)) == rows_of(narrow), name


def test_shards_by_hand(spark):
    """Sizes, checksums and places by Python's zlib and a plain walk of the permutation."""
    got = shards.shard(frame(spark, ROWS), 16).collect()
    told = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode())))
    bits, mask = shards._half_bits(len(ROWS)), (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    keys = [mixed((i * 0x9E3779B97F4A7C15 + 1) & mask) for i in range(1, 5)]

    def place(x):
        while True:
            left, right = x >> bits, x & ((1 << bits) - 1)
            for k in keys:
                left, right = right, left ^ (mixed((right + k) & mask) & ((1 << bits) - 1))
            x = (left << bits) | right
            if x < len(ROWS):
                return x

    want = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), place(i) % 16, place(i) // 16) for i, r in enumerate(told)]
    # rows that repeat an id may change places with each other
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got), key=repr) == sorted(want, key=repr)


def test_language_model_by_hand(spark):
    """Base scores and counts from dictionaries; scores from counts by level, as no filter errs on so few n-grams."""
    rows = [r for r in ROWS if r[0] is not None]
    fold = lambda i: zlib.crc32(str(i).encode()) % 7
    said = lambda t: [*words_of(lower(t)), None]
    uni, bi, docs = {}, {}, 0
    for r in rows:
        if fold(r[0]) != 2:
            docs += 1
            before = "<s>"
            for w in said(r[1]):
                uni[w] = uni.get(w, 0) + 1
                bi[before, w] = bi.get((before, w), 0) + 1
                before = w
    n, v = sum(uni.values()), len(uni)
    level = lambda c: 2 ** (c.bit_length() - 1) * 1.5 - 0.5 if c else 0
    want = []
    for r in rows:
        tokens_, before, base, score = said(r[1]), "<s>", 0.0, 0.0
        for w in tokens_:
            base += np.log10((uni.get(w, 0) + 1) / (n + v + 1))
            c = docs if before == "<s>" else level(uni.get(before, 0))
            score += np.log10(0.4 * min(1, level(bi.get((before, w), 0)) / max(c, 1)) + 0.6 * (level(uni.get(w, 0)) + 1) / (n + v + 1))
            before = w
        want.append((r[0], fold(r[0]) == 2, len(tokens_), sum(w in uni for w in tokens_), n, base, score))
    got = lm.score(frame(spark, rows), bits_per_key=64).collect()
    for a, b in zip(sorted(map(tuple, got)), sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_token_queries_on_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    tokens.write_tokens(spark.createDataFrame([], DOCS), path, str(tokenizer_path()))
    assert tokens.token_digests(spark, path).count() == 0 and tokens.read_metadata(spark, path).agg(F.sum("n_tokens")).first()[0] is None
