"""Licence scans against plain Python, and on odd tables."""

import random
import re

import pytest

from pigmenta.llm import licenses

DOCS = "doc_id long, text string, n_words string, label int, _w int"
MIT = licenses.NOTICES[0][1]
random.seed(3)
NOISE = ["".join(random.choice("abcdefgh") for _ in range(4)) for _ in range(60)] + ["the", "of", "license", "free", "software", "under", "Kelvin", "İx"]


def noise(n):
    return " ".join(random.choice(NOISE) for _ in range(n))


TEXTS = [
    None, "", " \n", "MIT\nLicense, mit license; MIT-LICENSE", "the general public License", "apache licence", noise(300),
    f"{noise(40)} {MIT} {noise(40)}", f"{noise(40)} {MIT.replace('any person', 'any one person')} {noise(40)}", MIT.replace("free of charge", "for a fee"),
    "Licensed under CC BY-NC 4.0.", f"{noise(9)} Licensed under CC BY 4.0. {noise(30)} Released under the MIT License.", "license under " * 4000, "x" * 100_000 + " mit license",
    f"{noise(5000)} This work is licensed under the GNU General Public License, version 3. {noise(5000)} apache license",
]


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def scanned(texts, rare=6, slack=2):
    """doc number to (n_words, places, base labels, labels, score)."""
    held = [words(t) for t in texts]
    df = lambda w: sum(w in h for h in held)
    out = []
    for w in held:
        places = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        found = {}
        for label, said, phrases in licenses.NOTICES:
            n = said.split()
            anchors = sorted(set(n), key=lambda x: (df(x), x))[:rare]
            need = (len(anchors) + 1) // 2
            if len(set(anchors) & set(w)) < need:
                continue
            near = lambda at, x: x in w[max(at - slack, 0) : max(at + slack + 1, 0)]  # noqa: B023, E731
            for b in {i - q for i, x in enumerate(w) if x in anchors for q, y in enumerate(n) if x == y}:
                if sum(any(near(b + q, a) for q, y in enumerate(n) if y == a) for a in anchors) < need:
                    continue
                window = f" {' '.join(w[max(b - slack, 0) : max(b + len(n) + slack, 0)])} "
                if all(f" {p} " in window for p in phrases):
                    found[label] = max(found.get(label, 0), sum(near(b + q, x) for q, x in enumerate(n)) / len(n))
        at = [i for i, _ in places]
        base = {x for _, x in places}
        out.append((len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(found))), max([*found.values(), 0.5 if at else 0])))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    table = spark.createDataFrame([(i if i else None, t, "clash", 1, 2) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "clash", 1, 2)], DOCS)
    return licenses.scan(table).collect()


def test_equals_plain_python(rows):
    want = scanned([*TEXTS, TEXTS[3]])
    got = sorted([(r.doc_id or 0, tuple(r)[1:]) for r in rows])
    assert got == sorted([(i, x) for i, x in enumerate(want[:-1])] + [(3, want[-1])])


def test_notices_are_found_where_they_stand(rows):
    by = {r.doc_id: r for r in rows}
    assert by[7].labels == "mit" and by[7].base_labels == "" and by[7].score == 1.0
    assert by[8].labels == "mit" and 0.9 < by[8].score
    assert by[9].labels == "" and by[10].labels == "cc-by-nc" and by[11].labels == "cc-by,mit"
    assert (by[3].n_base, by[3].first_word, by[3].last_word) == (3, 0, 4)
    assert by[14].labels == "apache,gpl" and by[12].labels == by[6].labels == ""


def test_an_empty_table_gives_no_rows(spark):
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_no_python_and_no_shuffle_in_the_second_pass(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "mit license")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange", "Join"))
