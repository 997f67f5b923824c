"""The corpus operators on odd tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pigmenta.llm import decontaminate, lm, minhash, mixing, pii, quality, repeats, shards, tokens
from pigmenta.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component long, size string"
random.seed(5)
WORDS = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(400)]
PROSE = [". ".join(" ".join(random.choice(WORDS) for _ in range(12)) for _ in range(8)) for _ in range(6)]
TEXTS = [None, "", "   \n\t ", "one", "two words", PROSE[0], PROSE[0], PROSE[0] + " more", PROSE[1] + " " + PROSE[2], PROSE[2] + "\n" + PROSE[3], "x" * 30_000, "a b " * 5_000, "é ü 日本 " * 50, PROSE[4] + " mail me@example.com 4485275742308327 +1 (555) 555-0100 or 10.0.0.1"]


def table(spark, texts=TEXTS):
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), False, 7, "big") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[5:6], DOCS)  # one row twice


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def items(spark):
    return spark.createDataFrame([(1, " ".join(PROSE[1].split()[3:25])), (2, "two words"), (3, None), (4, ""), (2, "two words")], "item_id long, text string")


def test_empty_tables_give_no_rows(spark, empty):
    made = [quality.line_quality(empty), minhash.near_duplicates(empty), pii.find_personal_data(empty), decontaminate.contamination(empty, items(spark)), shards.shard(empty), lm.score(empty), repeats.repeated_bytes(empty), repeats.remove_repeated_sentences(empty), mixing.mix(empty)]
    assert [df.count() for df in made] == [0] * len(made)


def test_quality(docs):
    rows = by_id(quality.line_quality(docs))
    assert rows[0].n_words == rows[2].n_words == 0 and rows[0].base_failed and not rows[3].kept
    assert rows[5].kept and rows[11].base_failed and rows[11].n_repeat_words == 10_000
    assert rows[12].word_chars == 50 * 4


def test_common_lines_are_removed_but_copies_are_not(spark):
    bare = [f"shared menu line\n{' '.join(random.choice(WORDS) for _ in range(60))}" for _ in range(40)]
    worn = ["shared menu line\nshared footer line\n" + "\n".join(f"{a} {b}" for a, b in zip(WORDS[:2], WORDS[2:4], strict=True))]
    rows = spark.createDataFrame([(i, t, "h") for i, t in enumerate(bare + worn + [PROSE[5]] * 60)], "doc_id long, text string, source string")
    got = by_id(quality.line_quality(rows))
    assert all(got[i].removed_words == 3 and got[i].kept for i in range(40))
    assert all(got[i].kept and got[i].removed_words == 0 for i in range(41, 101))


@pytest.mark.parametrize("mark", ["{}", "letter {}"])
def test_pages_that_differ_in_a_number_are_documents(spark, mark):
    menu = "\n".join(f"{' '.join(WORDS[k : k + 6])}" for k in range(0, 72, 6))
    own = lambda i: mark.format(i if mark == "{}" else "".join(chr(97 + int(c)) for c in str(i)))
    rows = spark.createDataFrame([(i, f"{menu}\nprice {own(i)} only", "h") for i in range(500)], "doc_id long, text string, source string")
    got = quality.line_quality(rows).collect()
    assert sum(r.depleted for r in got) == 500 and all(r.removed_words >= 72 for r in got)
    assert quality.clean(rows).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_tokens(spark, docs, tmp_path, encoding):
    from tokenizers import Tokenizer

    path, t = str(tmp_path / "t"), Tokenizer.from_file(str(tokenizer_path()))
    tokens.write_tokens(docs, path, str(tokenizer_path()), encoding=encoding)
    got = sorted(tokens.token_digests(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, text) in zip(got, sorted([*enumerate(TEXTS), (5, TEXTS[5])], key=lambda x: x[0]), strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert {r.n_tokens for r in tokens.read_metadata(spark, path).where("doc_id = 0").collect()} == {1}


def test_pieces_equal_whole_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(tokenizer_path()))
    parts = ["a", "Bc", "é", "to,", "be. ", " ", "\n", "'s", "1", "23", ".", ",", "  ", "\t", "日", "ж", "<|endoftext|>", "!", "_", "🙂", "\r", "\xa0"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 12))) for _ in range(2000)]
    got = tokens.Encoder(open(tokenizer_path(), encoding="utf-8").read()).encode(texts)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def brute_components(texts, n, pct):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= pct * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return sets, root


def test_near_duplicates_agree_with_brute_force(spark, docs):
    sets, root = brute_components(TEXTS, 3, 85)
    rows = by_id(minhash.near_duplicates(docs, n=3, pct=85))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in rows.items()} == {i: (len(s), root[i], root[i] == i) for i, s in enumerate(sets)}


def test_a_large_group_of_near_copies_in_small_blocks(spark):
    base = [random.choice(WORDS) for _ in range(90)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(random.randint(0, 8)):
            w[random.randrange(90)] = random.choice(WORDS)
        texts.append(" ".join(w))
    sets, root = brute_components(texts, 3, 85)
    rows = by_id(minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=3, pct=85, block_rows=20))
    assert {i: r.component_id for i, r in rows.items()} == dict(enumerate(root))


def test_estimates_are_corrected_for_chance():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 62, 1000, dtype=np.uint64), rng.integers(0, 1 << 62, 1000, dtype=np.uint64)
    both = np.concatenate([a, b])
    x, y = np.concatenate([a, both[1000:1250]]), np.concatenate([a, both[1250:1500]])  # 1000 of 1500
    low = [minhash.C.mix(minhash.minima(s, np.array([0]), 1000)) for s in (x, y)]
    agree = minhash.agreeing(*map(minhash.packed, low), 1000)
    assert agree.tolist() == [np.count_nonzero(low[0] % np.uint64(256) == low[1] % np.uint64(256))]
    assert minhash.estimate(agree, 1000)[0] == pytest.approx(2 / 3, abs=0.06)


def test_personal_data(docs):
    rows = by_id(pii.find_personal_data(docs))
    assert (rows[13].n_email, rows[13].n_ip, rows[13].n_card, rows[13].n_phone) == (1, 1, 1, 1)
    assert rows[0].spans == "" and rows[0].base_sha256 == rows[1].base_sha256


@pytest.mark.parametrize("text", ["a@b@c.d.e@f.g", "..@x.y", "1.2.3.4.5.6.7.8", "0256.1.1.1 300.1.1.1", "@" * 50, "a" * 2000 + "@", "1" * 5000 + ".1.1", "+1 +2 (3) 4-5678901234 5", "4111 1111 1111 1111-4111"])
def test_base_patterns_equal_plain_regular_expressions(text):
    want = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    want += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    want += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    want += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    assert pii.base_spans(text) == sorted(want)


def test_labelers_learn_from_each_other(spark):
    good = [f"please mail joe{i} (at) example (dot) com today" for i in range(200)]
    base = [f"please mail joe{i}@example.com today" for i in range(200)]
    rows = by_id(pii.find_personal_data(spark.createDataFrame(list(enumerate(base + good)), "doc_id long, text string")))
    assert all(rows[i].n_email == 1 for i in range(200))
    assert all(rows[i].n_email == 0 and rows[i].n_added == 1 and rows[i].spans.startswith("email:12:") for i in range(200, 400))


def test_decontamination_agrees_with_brute_force(spark, docs):
    rows = by_id(decontaminate.contamination(docs, items(spark)))
    assert (rows[4].n_hit, rows[4].n_items, rows[4].contaminated) == (2, 1, True)
    assert rows[8].n_hit == 22 and rows[5].n_hit == 0 and rows[0].n_words == 0
    in_parts = {r.doc_id: (sum(r.hit_spans[1::2]) - sum(r.hit_spans[::2]), sorted(r["items"])) for r in decontaminate.scan(docs, items(spark), max_item_words=5).collect()}
    assert in_parts == {r.doc_id: (sum(r.hit_spans[1::2]) - sum(r.hit_spans[::2]), sorted(r["items"])) for r in decontaminate.scan(docs, items(spark)).collect()}
    left = by_id(decontaminate.remove_spans(docs, items(spark)))
    assert 4 not in left and len(left[8].text.split()) == len(TEXTS[8].split()) - 22 and left[0].text is None


@pytest.mark.parametrize("seed", range(5))
def test_the_automaton_finds_all_windows(seed):
    rng = random.Random(seed)
    texts = [[str(rng.randrange(3)).encode() for _ in range(rng.randrange(1, 9))] for _ in range(6)]
    doc = [str(rng.randrange(4)).encode() for _ in range(300)]
    windows = {}
    for k, t in enumerate(texts):
        for i in range(max(1, len(t) - 3)):
            windows.setdefault(tuple(t[i : i + 4]), set()).add(str(k))
    hit, found = set(), set()
    for n in range(1, 5):
        for i in range(len(doc) - n + 1):
            if names := windows.get(tuple(doc[i : i + n])):
                hit |= set(range(i, i + n))
                found |= names
    spans, names = decontaminate.Automaton([(str(k), t) for k, t in enumerate(texts)], 4).scan(doc)
    assert {i for a, b in zip(spans[::2], spans[1::2], strict=True) for i in range(a, b)} == hit and names == found


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000, 4097])
def test_the_permutation_and_its_inverse(n):
    at = shards.position_of(np.arange(n), n, 3)
    assert sorted(at.tolist()) == list(range(n)) and shards.row_at(at, n, 3).tolist() == list(range(n))


def test_shards(docs):
    rows = shards.shard(docs, 4).collect()
    counts = [sorted(r.slot for r in rows if r.shard == s) for s in range(4)]
    assert [c == list(range(len(c))) for c in counts] == [True] * 4 and max(map(len, counts)) - min(map(len, counts)) <= 1
    assert {r["size"] for r in rows if r.doc_id in (0, 1)} == {1}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, shards.shard(docs.repartition(3), 4).collect()))


def test_language_model(docs):
    rows = by_id(lm.score(docs, heavy=10))
    plain = by_id(lm.score(docs))
    assert rows[0].n_tokens == rows[1].n_tokens == 1 and rows[5].n_tokens == len(TEXTS[5].split()) + 1
    assert lm.score(docs).count() == len(TEXTS) + 1
    assert all(rows[i].base_score == pytest.approx(plain[i].base_score) and rows[i].n_known == plain[i].n_known for i in rows)
    assert all(r.score < 0 for r in rows.values())


def test_filter_levels_have_one_side_error():
    rng = np.random.default_rng(1)
    h, n = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2), rng.integers(1, 5000, 2000)
    level = lm._level(n)
    block, least = lm._plan(np.bincount(level, minlength=lm.LEVELS), 1, 12)
    f = lm.Filter(0, block, least, bytearray(block // 8))
    marks = np.zeros(block, dtype=bool)
    for q in range(least, level.max() + 1):
        for at in f._places(h[level >= q], q):
            marks[at] = True
    f.data = np.packbits(marks, bitorder="little").tobytes()
    got = f.levels(h)
    assert (got >= level).all() and (got == level).mean() > 0.9


def brute_bytes(texts, width):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - width + 1):
            if raw[i : i + width] in seen:
                gone[i : i + width] = True
            seen.add(raw[i : i + width])
        out.append(bytes(b for b, g in zip(raw, gone, strict=True) if not g))
    return out


def test_repeated_bytes_agree_with_brute_force(spark, docs):
    got = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeated_bytes(docs).collect()}
    assert got == dict(enumerate(brute_bytes(TEXTS, 100)))
    texts = ["".join(random.choice("ab") for _ in range(random.randint(0, 400))) for _ in range(20)]
    texts += [texts[0][50:250] + texts[1][:90] + "c" + texts[2][:150], "ab" * 200]
    got = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeated_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=20, q=8).collect()}
    assert got == dict(enumerate(brute_bytes(texts, 20)))


def test_repeated_sentences(spark, docs):
    rows = by_id(repeats.remove_repeated_sentences(docs))
    assert rows[5].n_removed == 0 and rows[6].n_removed == rows[6].n_sentences == 8 and rows[6].kept_text == ""
    assert rows[9].n_removed >= 6 and rows[9].kept_text.endswith(PROSE[3][20:]) and rows[0].kept_text == ""


def brute_sentences(texts, n, min_words):
    """Per text: sentences, removed sentences, removed runs and the kept text, from all runs of sentences."""
    seen, out = set(), []
    for text in texts:
        t = text or ""
        words = list(re.finditer(r"[^\x20\x09-\x0D]+", t))
        ends = [i + 1 for i, w in enumerate(words) if w[0][-1] in ".!?" or i + 1 == len(words) or "\n" in t[w.end() : words[i + 1].start()]]
        firsts = [0, *ends[:-1]][: len(ends)]
        gone = [False] * len(ends)
        sentences = [tuple(re.sub("[A-Z]", lambda m: m[0].lower(), w[0]) for w in words[a:b]) for a, b in zip(firsts, ends, strict=True)]
        for i in range(len(ends)):
            for upto in range(i + n, len(ends) + 1):
                if ends[upto - 1] - firsts[i] >= min_words:
                    run = tuple(sentences[i:upto])
                    if run in seen:
                        gone[i:upto] = [True] * (upto - i)
                    seen.add(run)
        starts = [*(words[f].start() for f in firsts), len(t)]
        kept = t[: starts[0]] + "".join(t[starts[i] : starts[i + 1]] for i in range(len(ends)) if not gone[i])
        out.append((len(ends), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), kept))
    return out


def test_repeated_sentences_agree_with_brute_force(spark, docs):
    def got(df, *limits):
        return {r.doc_id: (r.n_sentences, r.n_removed, r.n_spans, r.kept_text) for r in repeats.remove_repeated_sentences(df, *limits).collect()}

    assert got(docs) == dict(enumerate(brute_sentences(TEXTS, 2, 16)))
    pick = random.Random(5)
    texts = ["".join(pick.choice(["a", "B", "b", "é"]) + pick.choice([" ", " ", ". ", "! ", "\n", "\n \n"]) for _ in range(pick.randint(0, 60))) for _ in range(60)] + [None, " ", "\n", "a. b."]
    for limits in ((2, 4), (3, 1)):
        brute = brute_sentences(texts, *limits)
        assert any(x[1] for x in brute) and got(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), *limits) == dict(enumerate(brute))


def test_mixing(spark, docs):
    rows = mixing.mix(docs, block_words=4).collect()
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(5), block_words=4).collect()))
    share = {r.target: 0 for r in rows}
    for r in rows:
        share[r.target] += r.taken
    assert all(abs(t - n) <= 16 for t, n in share.items())
    taken = mixing.take(docs.where("doc_id <> 5"), block_words=4)
    assert taken.columns == docs.columns
    words = {r.doc_id: r.n for r in taken.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORDS))).alias("n")).collect()}
    assert words == {r.doc_id: r.taken for r in mixing.mix(docs.where("doc_id <> 5"), block_words=4).collect() if r.taken}


def test_quotas_go_by_highest_quotients(spark):
    goals = [7.3, 3.1, 9.9, 0.4, 5.5, 64.0]
    rows = spark.createDataFrame([(f"s{i}", 100, v) for i, v in enumerate(goals)], "source string, source_size long, target double")
    quotas, words = mixing.seats(rows, 2, finest=0.1)
    got = [r.quota for r in quotas.orderBy("source").collect()]
    seats = [0] * len(goals)
    for _ in range(sum(got)):
        k = max(range(len(goals)), key=lambda i: (goals[i] / (2 * seats[i] + 1), -i))
        seats[k] += 1
    assert words == 2 and got == seats
    assert mixing.seats(rows, 50)[1] == 1 and mixing.seats(rows.where("target > 60"), 50)[1] == 4


def _off(rows):
    """Source sizes and by how many words each source is off its target; no document may exceed twice its size."""
    taken, target, size = {}, {}, {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        key = r.doc_id // 1_000_000
        taken[key], target[key], size[key] = taken.get(key, 0) + r.taken, r.target, r.source_size
    return {k: (taken[k] - target[k], target[k], size[k]) for k in taken}


def test_a_small_source_beside_large_ones_gets_its_words(spark):
    rows = [(k * 1_000_000 + i, f"s{k}", "one two three" if k == 2 else "w " * (i % 90 + 30)) for k, n in enumerate((3000, 3000, 80)) for i in range(n)]
    off = _off(mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(8)).collect())
    assert off[2][1:] == (480.0, 240) and all(abs(d) <= 16 for d, _, _ in off.values())


def test_very_many_small_sources_get_their_words(spark):
    rnd = random.Random(1)
    rows = [(k * 1_000_000 + i, f"source {k:05}", "w " * rnd.randint(3, 7)) for k in range(4000) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs, shard_rows=100).collect()
    off = _off(got)
    assert len(off) == 4000 and all(abs(d) <= 1 for d, _, _ in off.values())
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7), shard_rows=100).collect()))


def test_blocks_lie_end_to_end_over_all_shards(spark):
    """Against plain Python: documents of a source in the order of shard and key, blocks at even steps from the offset."""
    import hashlib

    rnd = random.Random(2)
    rows = [(i, f"s{i % 3}", "w " * rnd.randint(0, 60)) for i in range(400)]
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in mixing.mix(docs, block_words=8, shard_rows=20).collect()}
    for s in range(3):
        own = sorted((int(md5(f"1:{i}")[:12], 16) % 20, md5(f"1:{i}"), i, len(t.split())) for i, source, t in rows if source == f"s{s}")
        stream = [i for *_, i, n in own for _ in range(n)]
        blocks, target = -(-len(stream) // 8), got[own[0][2]].target
        passes, rest = divmod(min(int(target / 8 + 0.5), 2 * blocks), blocks)
        offset = int(md5(f"1:s{s}")[:8], 16) % blocks
        taken = dict.fromkeys((i for *_, i, _ in own), 0)
        for at, i in enumerate(stream):
            j = at // 8 + offset
            taken[i] += passes + ((j + 1) * rest // blocks - j * rest // blocks)
        assert taken == {i: got[i].taken for i in taken}


def test_only_byte_level_tokenizers_are_split(tmp_path):
    from pathlib import Path

    model = Path(tokenizer_path()).read_text(encoding="utf-8")
    assert tokens.splits(model) and not tokens.splits(model.replace('"add_prefix_space":false', '"add_prefix_space":true', 1))
    assert not tokens.splits(Path(tokenizer_path("word_bpe_49k.json")).read_text(encoding="utf-8"))


def test_a_tokenizer_of_another_kind_encodes_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    path, file = str(tmp_path / "t"), tokenizer_path("word_bpe_49k.json")
    t, texts = Tokenizer.from_file(file), ["Two words, here.", "a  b\nc", "", "don't"]
    tokens.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, file)
    assert [r.ids for r in tokens.read_ids(spark, path).orderBy("doc_id").collect()] == [[*t.encode(x, add_special_tokens=False).ids, 0] for x in texts]
