"""Operator 4, personal data by weak supervision.

Base spans (e-mail addresses, IP addresses, cards, phones) come from four patterns with their checks and always stay.
Looser patterns propose further spans: the same kinds in other writings (spelled out, spaced, dotted), secrets (keys
and tokens) and names beside contact words. Labelers vote on every span: form (a regular expression), check (checksum,
range or entropy), gazetteer (fixed lists, and the domains, prefixes and names that spans of the whole corpus share)
and context (the words before). Expectation-maximisation over the counts of all vote vectors estimates, kind by kind,
how reliable each labeler is and how likely each vector is to be personal data. With these probabilities as targets a
logistic regression is fitted for each kind on features of spans (votes, lengths, shares of characters, hashed
character shapes and context words); it alone decides on the looser proposals.

What reaches the driver is bounded: counts by vote vector (3**4 a kind), and the features of fit_rows spans a kind that
the classifier is fitted on, picked by hash. Everything else covers all spans, whole: gazetteer keys are joined to them.

Defined cases: a null or empty text has no spans; proposals that overlap a base span are dropped; of proposals that
overlap each other the likeliest stays; rows that repeat a doc_id are searched each by itself; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "name")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: What a text must have for the looser patterns of a kind to be tried.
_HINT = {
    "email": re.compile(r"[(\[{] ?at ?[)\]}]|\bat [A-Za-z0-9-]{1,63} dot ", re.I),
    "ip": re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:|[0-9] ?(?:\[\.\]|\(\.\)| \. )"),
    "card": _DIGIT,
    "phone": _DIGIT,
    "secret": re.compile(r"[A-Za-z0-9_+/=-]{20}"),
    "name": re.compile(r"\b(?:[Cc]ontact|[Aa]sk for|Mrs?|Ms|Dr|Prof|Herrn?|Frau|Se\u00f1ora?|Sra?|Mme|Monsieur|[Nn]ame)\b"),
}
#: The looser patterns, by kind; a group, if there is one, is the span.
_LOOSE = {
    "email": re.compile(r"\b[A-Za-z0-9._%+-]{1,64}(?: ?[(\[{] ?at ?[)\]}] ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?[(\[{] ?dot ?[)\]}] ?| dot |\.)[A-Za-z0-9-]{2,63}){1,4}", re.I),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| \. )[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}([./_]| - )[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+.])(?:00[1-9][0-9]{0,2}[ -]|\(0?[0-9]{2,4}\) ?|0[0-9]{2,4}[ /-]|[0-9]{3}[.-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}(?![A-Za-z0-9_+/=-])"),
    "name": re.compile(r"\b(?:[Cc]ontact|[Aa]sk for|Mrs?\.?|Ms\.?|Dr\.?|Prof\.?|Herrn?|Frau|Se\u00f1ora?|Sra?\.|Mme|Monsieur|[Nn]ame(?: is|:))\s(?P<span>[A-Z\u00c0-\u00d6\u00d8-\u00de][A-Za-z\u00c0-\u00ff'-]{1,30}(?: [A-Z\u00c0-\u00d6\u00d8-\u00de][A-Za-z\u00c0-\u00ff'-]{1,30}){0,2})"),
}
_CONTEXT = {
    "email": re.compile(r"mail|contact|write|correo|courriel|schreib", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|client|adresse", re.I),
    "card": re.compile(r"card|visa|master|credit|payment|karte|tarjeta|carte", re.I),
    "phone": re.compile(r"phone|tel|call|fax|mobile|anruf|llam|appel", re.I),
    "secret": re.compile(r"(?:key|token|secret|passw(?:or)?d|pwd|auth|bearer|credential)[\"']?\s*(?:[:=]|is)?\s*[\"']?$", re.I),
    "name": re.compile(r"mail|phone|call|write|reach|contact|ask for|appel|anruf|llam|Mrs?\.?\s$|Dr\.?\s$|Herrn?\s$|Frau\s$", re.I),
}
_AGAINST = re.compile(r"version|\bv\.?$|isbn|order|serial|invoice|\bid\b|\bno\.?\s*$|#\s*$|sha|build|commit|checksum|page", re.I)
_TOP = frozenset("com org net edu gov info io de fr es uk eu it nl ch at".split())
_CALLING = ("1", "33", "34", "39", "41", "43", "44", "49", "7", "81", "86", "91")
_ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
# How the tokens of common services begin.
_KEY_HEADS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "glpat-", "sk-", "sk_", "xoxb-", "xoxp-", "eyJ")
_KEY_FORM = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$")
#: A digest in hexadecimal digits that the text before it names as one is no secret.
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})$", re.I)
_DIGEST_NAMED = re.compile(r"\b(?:commit|revision|rev|sha-?(?:1|224|256|384|512)?(?:sum)?|md5(?:sum)?|checksum|digest|hash|etag|blob|tree|parent)[\"']?(?:\s+(?:is|of|id))?[\s:=#@(\[\"']*$", re.I)
VOTES = 4
#: Characters of the text before a span that labelers see.
BEFORE = 40
#: Spans that must share a key to make it one of the corpus gazetteer.
SHARED = 3


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            yield lo, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base spans, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return sorted(out)


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for k, kind in enumerate(KINDS):
        if _HINT[kind].search(text):
            group = "span" if kind == "name" else 0
            out += [(m.start(group), k, m.end(group)) for m in _LOOSE[kind].finditer(text) if kind != "secret" or (_mixed(m[0]) and not _named_digest(text, m))]
    return sorted(out)


def _named_digest(text: str, m: re.Match) -> bool:
    return bool(_DIGEST.match(m[0]) and _DIGEST_NAMED.search(text[max(m.start() - 32, 0) : m.start()]))


def _mixed(s: str) -> bool:
    """Whether digits and letters are mixed: words and numbers alone are no secrets."""
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def key_of(k: int, span: str) -> str:
    """What spans of a kind may share: a domain, a prefix, a first name."""
    kind, digits = KINDS[k], _digits(span)
    if kind == "email":
        return re.sub(r"^.*?(?:@|\bat\b[)\]} ]*)|[\s()\[\]{}]|\bdot\b", "", span.lower().replace(" dot ", ".").replace("(dot)", ".").replace("[dot]", "."))
    return {"ip": digits[:2], "card": digits[:4], "phone": digits.lstrip("0")[:3], "secret": span[:4], "name": span.split(" ")[0]}[kind]


def votes(k: int, span: str, before: str, base: bool, common: bool) -> int:
    """The labelers' votes (0 against, 1 none, 2 for), as one number. common: the span's key is in the corpus gazetteer."""
    kind, digits = KINDS[k], _digits(span)
    form = 2 if base else 1
    if kind == "email":
        end = re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]}"))[-1].lower()
        check, known = (2 if end.isalpha() and len(end) >= 2 else 0), (2 if end in _TOP else 1)
    elif kind == "ip":
        parts = re.findall(r"[0-9]+", span)
        check, known = (2 if base or (":" not in span and all(int(p) <= 255 for p in parts)) else 1 if ":" in span else 0), (0 if digits.startswith(("0", "255")) else 1)
    elif kind == "card":
        check, known = (2 if luhn(digits) else 0), (2 if digits.startswith(_ISSUERS) else 0)
    elif kind == "phone":
        check, known = (2 if 9 <= len(digits) <= 15 else 0), (2 if digits.lstrip("0").startswith(_CALLING) else 1)
    elif kind == "secret":
        form = 2 if _KEY_FORM.match(span) else 1
        check, known = (2 if _entropy(span) >= 3 else 0), (2 if span.startswith(_KEY_HEADS) else 1)
    else:
        form = 2 if " " in span else 1
        check, known = (2 if all(w[1:].islower() for w in span.split(" ")) else 0), 1
    if common and known == 1:
        known = 2
    context = 2 if _CONTEXT[kind].search(before) else 0 if _AGAINST.search(before[-16:]) else 1
    return ((form * 3 + check) * 3 + known) * 3 + context


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()), ("span", pa.string()), ("before", pa.string()), ("after", pa.string()), ("key", pa.string())]))
SCAN = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans array<struct<start:long,kind:int,end:long,base:boolean,span:string,before:string,after:string,key:string>>"


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in (x.as_py() or "" for x in batch.column(1)):
            base = base_spans(text)
            loose = [x for x in loose_spans(text) if all(x[2] <= b[0] or b[2] <= x[0] for b in base)]
            spans = []
            for (lo, k, hi), own in [*((x, True) for x in base), *((x, False) for x in loose)]:
                span = text[lo:hi]
                spans.append({"start": lo, "kind": k, "end": hi, "base": own, "span": span, "before": text[max(0, lo - BEFORE) : lo], "after": text[hi : hi + 1], "key": key_of(k, span)})
            rows.append((*(sum(x[1] == k for x in base) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), spans))
        kinds = (*(pa.int64() for _ in BASE), pa.string(), SPANS)
        columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def _split(vector: np.ndarray) -> np.ndarray:
    """The votes of each vector, one column a labeler."""
    return np.stack([vector // 3**j % 3 for j in reversed(range(VOTES))], axis=1)


def expectation_maximisation(vector: np.ndarray, count: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """The probability of personal data for each vote vector, and each labeler's reliability [class, labeler, vote]."""
    v = _split(vector)
    prior, rely = 0.5, np.zeros((2, VOTES, 3))
    rely[1], rely[0] = (0.1, 0.3, 0.6), (0.6, 0.3, 0.1)
    p = np.zeros(len(v))
    for _ in range(rounds):
        like = [np.prod([rely[c, j, v[:, j]] for j in range(VOTES)], axis=0) * w for c, w in ((0, 1 - prior), (1, prior))]
        p = like[1] / np.maximum(like[0] + like[1], 1e-300)
        prior = float(np.clip((p * count).sum() / max(count.sum(), 1), 0.01, 0.99))
        for c, w in ((0, (1 - p) * count), (1, p * count)):
            for j in range(VOTES):
                # a prior of ten made-up votes keeps classes from swapping where a labeler is always alike
                start = np.array((0.6, 0.3, 0.1) if c == 0 else (0.1, 0.3, 0.6)) * 10
                n = np.bincount(v[:, j], weights=w, minlength=3) + start
                rely[c, j] = n / n.sum()
    return p, rely


_HASHED = 32
FEATURES = VOTES * 3 + 3 + 8 + 4 + 2 * _HASHED + 1


def _hashed(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % _HASHED


def features(vector: int, span: str, before: str, after: str) -> np.ndarray:
    """The features of a span: votes, borders, length, shares of characters, shapes, and words before."""
    x = np.zeros(FEATURES)
    for j, v in enumerate(_split(np.array([vector]))[0]):
        x[j * 3 + v] = 1
    at = VOTES * 3
    x[at : at + 3] = (not before[-1:].isalnum(), not after.isalnum(), len({c for c in span if not c.isalnum()}) > 1)
    x[at + 3 + min(7, len(span) // 6)] = 1
    n = max(1, len(span))
    x[at + 11 : at + 15] = [sum(map(f, span)) / n for f in (str.isdigit, str.isupper, str.islower, str.isspace)]
    shape = re.sub(r"[0-9]", "0", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", span)))
    for three, times in Counter(map("".join, zip(shape, shape[1:], shape[2:], strict=False))).items():
        x[at + 15 + _hashed(three)] += times / n
    for word in re.findall(r"\w+", before.lower())[-3:]:
        x[at + 15 + _HASHED + _hashed(word)] += 0.3
    x[-1] = 1
    return x


def fit_classifier(x: np.ndarray, target: np.ndarray, rounds: int = 400, rate: float = 0.8) -> np.ndarray:
    """Weights of a logistic regression on the estimated labels."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w -= rate * (x.T @ (p - target) / max(len(x), 1) + 1e-4 * w)
    return w


def scanned(docs: DataFrame) -> DataFrame:
    """The base columns and all proposed spans of each row of docs, staged, under a number of its own."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan, SCAN)
    return C.staged(rows.withColumn("row", F.monotonically_increasing_id()))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds votes, an array beside spans, by the gazetteer keys in common, which goes."""
    for b in batches:
        spans, common = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("spans", "common"))
        found = []
        for own, keys in zip(spans, common, strict=True):
            known = {(x["kind"], x["key"]) for x in keys or ()}
            found.append([votes(s["kind"], s["span"], s["before"], s["base"], (s["kind"], s["key"]) in known) for s in own])
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.int32()))], names=[*b.schema.names[:-1], "votes"])


def voted(scan: DataFrame) -> DataFrame:
    """scan with votes. The corpus gazetteer has every key that SHARED spans have; each row is joined to those of its own."""
    shared = scan.select(F.explode("spans").alias("s")).select("s.kind", "s.key", "s.base").where((F.col("base") | (F.col("kind") >= len(BASE))) & (F.col("key") != ""))
    gazetteer = shared.groupBy("kind", "key").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED).select("kind", "key")
    keys = F.array_distinct(F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["key"].alias("key"))))
    common = scan.select("row", F.explode(keys).alias("k")).select("row", "k.*").join(gazetteer, ["kind", "key"])
    common = common.groupBy("row").agg(F.collect_list(F.struct("kind", "key")).alias("common"))
    rows = scan.join(common, "row", "left").select(*scan.columns, "common")
    return rows.mapInArrow(_vote, f"{SCAN}, row long, votes array<int>")


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [features(*row).tobytes() for row in zip(*(b.column(c).to_pylist() for c in range(1, 5)), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], names=["kind", "votes", "x"])


def _decide(weights: dict[int, np.ndarray], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, added = [], []
            for spans, vs in zip(b.column(6).to_pylist(), b.column(8).to_pylist(), strict=True):
                kept = [(s["start"], s["kind"], s["end"]) for s in spans if s["base"]]
                own = len(kept)
                scored = []
                for s, v in zip(spans, vs, strict=True):
                    if not s["base"] and s["kind"] in weights:
                        p = 1 / (1 + math.exp(-float(features(v, s["span"], s["before"], s["after"]) @ weights[s["kind"]])))
                        if p >= threshold:
                            scored.append((-p, s["start"], s["kind"], s["end"]))
                for _, lo, k, hi in sorted(scored):
                    if all(hi <= x[0] or x[2] <= lo for x in kept[own:]):
                        kept.append((lo, k, hi))
                out.append(joined(sorted(kept)))
                added.append([sum(x[1] == k for x in kept[own:]) for k in (4, 5)] + [len(kept) - own, len(kept)])
            counts = np.array(added, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], *(pa.array(counts[:, j]) for j in range(4)), pa.array(out, pa.string())], names=[*b.schema.names[:6], "n_secret", "n_name", "n_added", "n_spans", "spans"])

    return run


def find_personal_data(docs: DataFrame, threshold: float = 0.9, fit_rows: int = 4000) -> DataFrame:
    """doc_id, the counts and digest of base spans, the numbers of added secrets, names and spans, of all spans, and
    all spans as kind:start:end.

    fit_rows: spans of each kind that the classifier is fitted on; it decides on all.
    """
    C.bounded(docs.sparkSession)
    rows = C.staged(voted(scanned(docs)))
    pairs = rows.select("row", "doc_id", F.explode(F.arrays_zip("spans", "votes")).alias("p")).select("row", "doc_id", "p.spans.*", "p.votes")
    counts = pairs.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    placed = pairs.select("row", "kind", "start", F.xxhash64("span", "before", "doc_id", "start").alias("order"))
    picked = [placed.where(F.col("kind") == k).orderBy("order", "row").limit(fit_rows).drop("order") for k in sorted({r.kind for r in counts})]
    fitted = []
    if picked:
        chosen = pairs.join(F.broadcast(reduce(DataFrame.unionAll, picked)), ["row", "kind", "start"])
        fitted = chosen.select("kind", "votes", "span", "before", "after").mapInArrow(_featured, "kind int, votes int, x binary").collect()
    weights = {}
    for k in {r.kind for r in fitted}:
        vectors, n = (np.array([r[c] for r in sorted(counts) if r.kind == k]) for c in (1, 2))
        p, _ = expectation_maximisation(vectors, n.astype(float))
        own = [r for r in fitted if r.kind == k]
        target = dict(zip(vectors.tolist(), p, strict=True))
        weights[k] = fit_classifier(np.stack([np.frombuffer(r.x) for r in own]), np.array([target[r.votes] for r in own]))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, n_secret long, n_name long, n_added long, n_spans long, spans string"
    return rows.mapInArrow(_decide(weights, threshold), schema)
