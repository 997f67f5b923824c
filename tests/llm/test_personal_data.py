"""Added spans against planted ones, kind by kind, among decoys of the same looks."""

import hashlib
import random
import re

import pytest

from pigmenta.llm import pii

pick = random.Random(11)
WORDS = ["".join(pick.choice("abcdefghijklmnoprstuvw") for _ in range(pick.randint(2, 8))) for _ in range(500)]


def words(n):
    return " ".join(pick.choice(WORDS) for _ in range(n))


def digits(n):
    return "".join(pick.choice("0123456789") for _ in range(n))


def card(sep):
    while not pii.luhn(d := "4" + digits(15)):
        pass
    return sep.join(d[i : i + 4] for i in range(0, 16, 4))


def not_card(sep):
    while pii.luhn(d := "9" + digits(15)):
        pass
    return sep.join(d[i : i + 4] for i in range(0, 16, 4))


def secret():
    return pick.choice([lambda: hashlib.sha1(digits(9).encode()).hexdigest(), lambda: "ghp_" + "".join(pick.choice("abcdefXYZ0123456789") for _ in range(36))])()


GOOD = {
    "email": lambda: ("please mail ", f"{pick.choice(WORDS)}{digits(2)} (at) {pick.choice(WORDS)} (dot) com"),
    "ip": lambda: ("the server address ", ".".join(str(pick.randrange(1, 255)) for _ in range(4)).replace(".", "[.]")),
    "card": lambda: ("paid by credit card ", card(".")),
    "phone": lambda: ("please call my phone ", f"0{pick.choice(['33', '44', '49'])} {digits(4)} {digits(4)}"),
    "secret": lambda: ("the api key = ", secret()),
    "name": lambda: ("please call and ask for ", f"{pick.choice(['Anna', 'John', 'Maria', 'Peter'])} {pick.choice(WORDS).title()}"),
}
BAD = {
    "email": lambda: ("look up version ", f"{pick.choice(WORDS)} at {pick.choice(WORDS)} dot 99"),
    "ip": lambda: ("build ", "[.]".join(str(pick.randrange(300, 999)) for _ in range(4))),
    "card": lambda: ("order ", not_card(".")),
    "phone": lambda: ("invoice ", f"0{digits(2)} {digits(3)}{digits(3)}"[:10]),
    "secret": lambda: ("commit ", "".join(pick.choice("a1") for _ in range(24))),
    "name": lambda: ("page name: ", pick.choice(WORDS).upper()[:1] + pick.choice(WORDS).upper() + "X"),
}


def corpus(kind, n=150):
    rows, want = [], {}
    for i in range(n):
        kinds = (GOOD, BAD)[i % 3 == 2]
        before, span = kinds[kind]()
        text = f"{words(8)} {before}{span} {words(8)}"
        rows.append((i, text))
        if kinds is GOOD:
            at = text.index(before) + len(before)
            want[i] = f"{kind}:{at}:{at + len(span)}"
    return rows, want


@pytest.mark.parametrize("kind", pii.KINDS)
def test_added_spans_of_each_kind(spark, kind):
    rows, want = corpus(kind)
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {(i, x) for i, r in got.items() for x in r.spans.split(",") if x}
    right = len(found & set(want.items()))
    print(kind, "precision", right / max(1, len(found)), "recall", right / len(want))
    assert right >= 0.9 * len(found) and right >= 0.9 * len(want)
    assert all(r.n_added == len(r.spans.split(",")) * bool(r.spans) for r in got.values() if not any(r[f"n_{k}"] for k in pii.BASE))


def test_all_kinds_at_once_and_base_spans_stay(spark):
    rows, want = [], {}
    for kind in pii.KINDS:
        more, some = corpus(kind, 90)
        want |= {len(rows) + i: x for i, x in some.items()}
        rows += [(len(rows) + i, t) for i, t in more]
    rows += [(len(rows) + i, f"{words(5)} joe{i}@{pick.choice(WORDS)}.com {words(5)}") for i in range(50)] + [(9999, None), (9998, "")]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and got[9999].spans == got[9998].spans == ""
    for i, text in rows:
        base = pii.base_spans(text or "")
        assert got[i].base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert not base or set(pii.joined(base).split(",")) <= set(got[i].spans.split(","))
    found = {(i, x) for i, r in got.items() for x in r.spans.split(",") if x and i in want}
    assert len(found & set(want.items())) >= 0.9 * len(want)


def test_forms_in_any_case_and_overlaps():
    assert [x[1] for x in pii.loose_spans("name (At) host.com and me [aT] host [DOT] org")] == [0, 0]
    assert pii.loose_spans("x" * 30_000) == [] and pii.loose_spans("1" * 5000) == []
    assert [("2001:db8:0:0:0:0:0:1"[:0], x[1]) for x in pii.loose_spans("at 2001:db8:0:0:0:0:0:1 ok")] == [("", 1)]
    assert re.fullmatch(r"[0-9a-f]{40}", "0" * 40) and [x[1] for x in pii.loose_spans("key " + "ab12" * 10)] == [4]


def test_named_digests_are_no_secrets_and_long_secrets_are(spark):
    rnd = random.Random(12)
    sign = lambda n, of="0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ": "".join(rnd.choice(of) for _ in range(n))
    digests = [f"{lead}{sign(n, '0123456789abcdef')} in the log" for lead, n in (("see commit ", 40), ("sha256: ", 64), ("md5sum=", 32), ("checksum is ", 40), ('"digest": "', 64), ("parent ", 40)) for _ in range(40)]
    keys = [f"api_key={sign(n)} for the service" for n in (40, 600, 3000) for _ in range(60)]
    words = " ".join(["some plain words that say nothing at all about it"] * 3)
    texts = [f"{words} {x} {words}" for x in digests + keys]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(got[i].n_secret for i in range(len(digests))) == 0
    assert sum(got[i].n_secret == 1 for i in range(len(digests), len(texts))) >= 0.9 * len(keys)
    long = [i for i in range(len(digests), len(texts)) if len(texts[i]) > 3000]
    assert all(int(got[i].spans.split(":")[2]) - int(got[i].spans.split(":")[1]) == 3000 for i in long if got[i].n_secret)


def test_the_gazetteer_has_every_shared_key(spark):
    # more keys than the 20,000 that were kept once; names come last among keys as common
    mails = [f"a{i % 3}@host{i // 3}.example" for i in range(60_300)]
    names = [f"please call and ask for {n} Miller now" for n in ("Zora", "Zora", "Zora", "Zelda", "Zelda")]
    texts = [" ".join(mails[i : i + 300]) for i in range(0, len(mails), 300)] + names
    rows = pii.voted(pii.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    found = [(s.kind, s.span, v // 3 % 3) for r in rows for s, v in zip(r.spans, r.votes, strict=True)]
    assert len(found) == len(mails) + len(names)
    assert all(known == 2 for kind, _, known in found if kind == 0)
    assert sorted(x for x in found if x[0] == 5) == [(5, "Zelda Miller", 1)] * 2 + [(5, "Zora Miller", 2)] * 3


def test_labelers_see_whole_spans(spark):
    middle = "".join(chr(97 + i * 7 % 26) + str(i * i % 10) for i in range(400))
    text = "token " + "a1" * 128 + middle + "a1" * 128
    rows = pii.voted(pii.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    (span,), (vote,) = rows[0].spans, rows[0].votes
    assert span.span == text[6:] and vote // 9 % 3 == 2  # both ends alone are of two characters
