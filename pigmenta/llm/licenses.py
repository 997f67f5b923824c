"""Operator 13, licence scans by a positional index of rare words, in DataFrame operations alone.

The postings of a few licence notices say at which word of which notice a word stands. A first pass counts in how many
documents each word of the notices occurs. A notice is known by its rarest words there. In the second pass, which needs
no shuffle, a document that holds half of a notice's rarest words is looked up: every place of such a word, less the
place of the word in the notice, is where the notice may begin; there the others must stand at their relative places,
give or take slack words. What remains must hold the mandatory phrases of the notice, word by word, in the same window.

The notices have some 200 different words, so the counts that come to the driver are as few, whatever the documents.

Defined cases: a null or empty text has no words, no places, no labels and a score of 0; every row is judged by itself,
so repeated rows and null ids give equal rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands between words, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KNOWN = "array<struct<label: string, words: array<string>, phrases: array<string>, rare: array<string>, need: int, posts: array<struct<word: string, place: int>>>>"

#: The phrases of the base rule and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Label, words of the notice, phrases that it can't do without.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ["free of charge", "deal in the software"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ["required by applicable law", "as is basis"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["free software", "gnu general public license"]),
    ("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "redistribute it and or modify it under the terms of the gnu affero general public license", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms", "following conditions are met"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("cc0", "dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", ["related and neighboring rights", "public domain"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
]


def words_of(text: Column) -> Column:
    """Words in lower case. Beside A-Z the Kelvin sign alone becomes ASCII by lower(); another letter takes its place."""
    plain = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u0138"))
    return F.array_remove(F.split(F.lower(plain), BETWEEN), "")


def _strings(words: list[str]) -> Column:
    return F.from_json(F.lit(json.dumps(words)), "array<string>")


def document_counts(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many documents each of a few given words occurs."""
    found = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), _strings(words))).alias("word"))
    held = {r.word: r.n for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: held.get(w, 0) for w in words}


def index(docs: DataFrame, notices: list[tuple[str, str, list[str]]], rare: int) -> list[dict]:
    """Of each notice its label, words and phrases, its rarest words in the documents, and where these stand in it.

    The rarest come first, of equal ones the first by code point; half of them are needed.
    """
    counts = document_counts(docs, sorted({w for _, text, _ in notices for w in text.split()}))
    known = []
    for label, text, phrases in notices:
        words = text.split()
        rarest = sorted(set(words), key=lambda w: (counts[w], w))[:rare]
        posts = [{"word": w, "place": k} for k, w in enumerate(words) if w in rarest]
        known.append({"label": label, "words": words, "phrases": phrases, "rare": rarest, "need": (len(rarest) + 1) // 2, "posts": posts})
    return known


def _starts(phrase: str) -> Column:
    """Where the phrase stands in _w."""
    parts = phrase.split()
    here = " and ".join(f"get(_w, i + {k}) = '{part}'" for k, part in enumerate(parts))
    return F.expr(f"case when array_contains(_held, '{parts[-1]}') and size(_w) >= {len(parts)} then filter(sequence(0, size(_w) - {len(parts)}), i -> {here}) else cast(array() as array<int>) end")


def _near(place: str, word: str, slack: int) -> str:
    """SQL: the word stands within slack words of a place of _w."""
    low = f"greatest({place} - {slack}, 0)"
    return f"array_contains(slice(_w, {low} + 1, greatest({place} + {slack + 1} - {low}, 0)), {word})"


def _found(slack: int) -> Column:
    """label and share of each notice of _known that half of its rarest words speak for; share is 0 if it isn't there."""
    low = f"greatest(b - {slack}, 0)"
    window = f"concat(' ', array_join(slice(_w, {low} + 1, greatest(b + size(n.words) + {slack} - {low}, 0)), ' '), ' ')"
    votes = f"size(filter(n.rare, a -> exists(n.posts, q -> q.word = a and {_near('b + q.place', 'a', slack)})))"
    said = f"forall(n.phrases, f -> contains({window}, concat(' ', f, ' ')))"
    stand = f"size(filter(transform(n.words, (x, q) -> {_near('b + q', 'x', slack)}), v -> v)) / cast(size(n.words) as double)"
    begins = "array_distinct(flatten(transform(filter(_places, p -> array_contains(n.rare, p.x)), p -> transform(filter(n.posts, q -> q.word = p.x), q -> p.i - q.place))))"
    share = f"coalesce(array_max(transform({begins}, b -> case when {votes} >= n.need and {said} then {stand} else 0D end)), 0D)"
    return F.expr(f"transform(_asked, n -> struct(n.label as label, {share} as share))")


def scan(docs: DataFrame, notices: list[tuple[str, str, list[str]]] = NOTICES, rare: int = 6, slack: int = 2, base_score: float = 0.5) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row.

    score: the largest share of a verified notice's words that stand in their places; base_score, or more, where a base
    phrase stands.
    """
    known = index(docs, notices, rare)
    words = sorted({w for n in known for w in n["words"]} | {w for phrase, _ in BASE for w in phrase.split()})
    rarest = sorted({w for n in known for w in n["rare"]})
    rows = docs.select(F.col("doc_id").cast("long"), words_of(F.col("text")).alias("_w"))
    rows = rows.select("*", F.array_intersect("_w", _strings(words)).alias("_held"), F.from_json(F.lit(json.dumps(known)), KNOWN).alias("_known"))
    rows = rows.withColumn("_asked", F.expr("filter(_known, n -> size(array_intersect(n.rare, _held)) >= n.need)"))
    # the places of rare words, for documents that are looked up
    places = F.filter(F.transform("_w", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: F.array_contains(_strings(rarest), p["x"]))
    rows = rows.withColumn("_places", F.when(F.size("_asked") > 0, places))
    base = [_starts(phrase) for phrase, _ in BASE]
    rows = rows.select("doc_id", F.size("_w").cast("long").alias("n_words"), F.array(*base).alias("_base"), F.filter(_found(slack), lambda x: x["share"] > 0).alias("_found"))
    own = F.filter(F.array(*[F.when(F.size(F.col("_base")[k]) > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "n_words", F.flatten("_base").alias("_at"), own.alias("_own"), "_found")

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    score = F.greatest(F.coalesce(F.array_max(F.transform("_found", lambda x: x["share"])), F.lit(0.0)), F.when(F.size("_at") > 0, base_score).otherwise(0.0))
    return rows.select(
        "doc_id", "n_words", F.size("_at").cast("long").alias("n_base"), F.array_min("_at").cast("long").alias("first_word"), F.array_max("_at").cast("long").alias("last_word"),
        joined(F.col("_own")).alias("base_labels"), joined(F.concat("_own", F.transform("_found", lambda x: x["label"]))).alias("labels"), score.alias("score"),
    )
