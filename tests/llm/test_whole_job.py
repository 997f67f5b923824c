"""Cases in which operators once did less than the whole job."""

import random
import re

import pytest

import corpus_pipeline
from pigmenta.llm import decontaminate, lm, quality, repeats


def all_runs(texts, n, min_words):
    """The removed sentences of each text, from all runs. Sentences end at . ! ? only, or with the text."""
    seen, out = set(), []
    for text in texts:
        sentences = [s.split() for s in re.findall(r"[^.!?]*[.!?]+|[^.!?]+$", text or "") if s.strip()]
        gone = set()
        for i in range(len(sentences)):
            for j in range(i + n, len(sentences) + 1):
                run = tuple(w.lower() for s in sentences[i:j] for w in s)
                if len(run) >= min_words:
                    if run in seen:
                        gone |= set(range(i, j))
                    seen.add(run)
        out.append(sorted(gone))
    return out


def test_all_runs_of_sentences_count(spark):
    a, b, c = " ".join(f"a{i}" for i in range(10)) + ".", " ".join(f"b{i}" for i in range(10)) + ".", "short one."
    pick = random.Random(9)
    texts = [f"{a} {b} {c} here it ends", f"it starts. {a} {b} {c} other words follow"]
    texts += [" ".join(" ".join(pick.choice("xyz") for _ in range(pick.randint(1, 4))) + pick.choice(".!") for _ in range(pick.randint(0, 25))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for limits in ((2, 16), (2, 6), (3, 1)):
        want = all_runs(texts, *limits)
        assert {r.doc_id: r.n_removed for r in repeats.remove_repeated_sentences(docs, *limits).collect()} == {i: len(x) for i, x in enumerate(want)}
    rows = {r.doc_id: r.kept_text for r in repeats.remove_repeated_sentences(docs).collect()}
    assert rows[1] == "it starts. other words follow"


def menu_pages(n):
    menu = "\n".join(f"menu item {chr(97 + i)} with words to click" for i in range(10))
    return [f"{menu}\nonly page {chr(97 + i // 26)}{chr(97 + i % 26)} says so" for i in range(n)]


def test_pages_that_share_many_lines_count_each(spark):
    rows = spark.createDataFrame([(i, t, "h") for i, t in enumerate(menu_pages(100))], "doc_id long, text string, source string")
    got = quality.line_quality(rows).collect()
    assert len(got) == 100 and all(r.removed_words == 70 and r.depleted and not r.kept for r in got)


def test_boilerplate_lines_leave_the_texts(spark):
    pick = random.Random(3)
    own = [" ".join(pick.choice("abcdefghij") + pick.choice("klmnopq") + pick.choice("rstuvw") for _ in range(60)) for _ in range(60)]
    shapes = ["Shared MENU  line 7\n{}\nlast one here", "{}\n\nlast one here", "é {}\n shared menu line 8\nlast one here\n", "{}"]
    texts = [shapes[i % 4].format(x) for i, x in enumerate(own)] + ["shared menu line 3\nlast one here\nfew words of its own"]
    hosts = ["h"] * 61
    texts += ["shared menu line 1\n" + " ".join(own[0].split()[::-1])]
    hosts += ["elsewhere"]
    rows = [(i, t, h, -1, f"x{i}") for i, (t, h) in enumerate(zip(texts, hosts, strict=True))]
    docs = spark.createDataFrame([*rows, (99, None, None, None, "n")], "doc_id long, text string, source string, n_chars long, more string")
    bare = {"shared menu line 0", "last one here"}
    want = ["\n".join(x for x in t.split("\n") if re.sub("[0-9]", "0", " ".join(x.lower().split())) not in bare) for t in texts[:60]]
    want = {i: (t, len(t), f"x{i}") for i, t in enumerate(want)} | {61: (texts[61], len(texts[61]), "x61")}
    for made in (quality.clean(docs), corpus_pipeline.quality_rules(spark, docs, "")):
        assert made.columns == docs.columns
        assert {r.doc_id: (r.text, r.n_chars, r.more) for r in made.collect()} == want


def test_spans_of_all_parts_are_cut_at_once(spark):
    w = [f"w{i}" for i in range(100)]
    items = [(1, " ".join(w[:30])), (2, " ".join(w[40:70])), (3, " ".join(w[75:87])), (4, " ".join(w[80:92]))]
    texts = [" ".join(w[:30] + ["x"] * 40 + w[40:70]), " ".join(["y"] * 50 + w[75:92] + ["z"] * 20), "nothing of it", None]
    want = {1: " ".join(["y"] * 50) + "  " + " ".join(["z"] * 20), 2: texts[2], 3: None}
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for most in (5, 60, 100_000):
        rows = decontaminate.remove_spans(docs, benchmark, max_item_words=most).collect()
        assert {r.doc_id: r.text for r in rows} == want
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_a_filter_over_its_bound_keeps_all_counts(spark):
    pick = random.Random(4)
    rows = [(i, " ".join(f"w{pick.randrange(300)}" for _ in range(pick.randint(0, 200)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    score = lambda **options: {r.doc_id: (r.n_known, r.base_score, r.score) for r in lm.score(docs, **options).collect()}
    by_heavy = {heavy: score(heavy=heavy) for heavy in (20, 100_000)}
    for bound, most, heavy in ((1, 1000, 100_000), (1000, 1000, 100_000), (1, 4, 100_000), (1000, 0, 20)):
        got, whole = score(filter_bytes=bound, max_parts=most, heavy=heavy), by_heavy[heavy]
        assert got.keys() == whole.keys() and all(got[i] == pytest.approx(whole[i]) for i in whole)
