"""Licence scans with a positional index of rare words, in DataFrame functions only.

Every licence template has its words by position. The rarest words of each template, by how
many documents have them, form the index. A document's places of such words point to template
starts; starts on which enough rare words agree are verified: a mandatory key phrase must
stand in place, and enough of the template's words must match by position.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, functions as F

#: (phrase, label) pairs that the contract fixes.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: (label, template, key phrase within it).
TEMPLATES = (
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "gnu general public license as published by the free software foundation either version 3"),
    ("gpl-2", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "gnu general public license as published by the free software foundation either version 2"),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license as published"),
    ("agpl-3", "it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license as published"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "nor the names of its contributors"),
    ("mit", "spdx license identifier mit", "license identifier mit"),
    ("apache-2", "spdx license identifier apache 2 0", "license identifier apache 2 0"),
    ("gpl-3", "spdx license identifier gpl 3 0", "license identifier gpl 3 0"),
    ("gpl-2", "spdx license identifier gpl 2 0", "license identifier gpl 2 0"),
    ("agpl-3", "spdx license identifier agpl 3 0", "license identifier agpl 3 0"),
    ("bsd", "spdx license identifier bsd 3 clause", "license identifier bsd"),
    ("isc", "spdx license identifier isc", "license identifier isc"),
    ("mpl-2", "spdx license identifier mpl 2 0", "license identifier mpl 2 0"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms with or without modification"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
)
RARE, AGREE, SHARE = 3, 2, 0.7
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, on lower-cased text and on text whose A-Z are still capitals.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def rarity(docs: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """Documents that have each template word, over whole texts; one row per word reaches the driver."""
    own = F.split(F.lower(_text()), BETWEEN)
    found = docs.select(F.explode(F.array_intersect(own, F.array(*[F.lit(w) for w in vocabulary]))).alias("word"))
    seen = {r.word: r.n for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: seen.get(w, 0) for w in vocabulary}


def rare_places(template: Sequence[str], seen: Mapping[str, int], rare: int) -> list[int]:
    """Places of the words with the highest IDF, each word once."""
    first = {w: k for k, w in reversed(list(enumerate(template)))}
    return sorted(sorted(first.values(), key=lambda k: (seen[template[k]], k))[:rare])


def _same(start: Column, place: int, word: str) -> Column:
    return F.coalesce(F.get(F.col("words"), (start + place).cast("int")) == F.lit(word), F.lit(False))


def _words_at(start: Column, phrase: Sequence[str]) -> Column:
    """The phrase's words stand from ``start`` on."""
    return reduce(and_, [_same(start, k, w) for k, w in enumerate(phrase)])


def _matching(start: Column, template: Sequence[str], places: Sequence[int]) -> Column:
    return reduce(add, [_same(start, k, template[k]).cast("int") for k in places])


def _starts(word: str, place: int) -> Column:
    """Template starts that the places of one rare word point to."""
    return F.transform(F.filter("hits", lambda h: h.word == F.lit(word)), lambda h: h.place - F.lit(place))


def _phrase_places(phrase: list[str], rarest: int) -> Column:
    return F.filter(_starts(phrase[rarest], rarest), lambda s: (s >= 0) & _words_at(s, phrase))


def _template_shares(template: list[str], key: list[str], places: list[int], agree: int) -> Column:
    """Share of matching words at each start on which enough rare words agree and the key phrase stands in place."""
    inside = next(k for k in range(len(template)) if template[k : k + len(key)] == key)
    starts = F.array_distinct(F.concat(*[_starts(template[k], k) for k in places]))
    good = F.filter(starts, lambda s: (s + inside >= 0) & (_matching(s, template, places) >= agree) & _words_at(s + inside, key))
    return F.transform(good, lambda s: _matching(s, template, range(len(template))) / F.lit(float(len(template))))


def scan_licenses(docs: DataFrame, base: Sequence[tuple[str, str]] = BASE, templates: Sequence[tuple[str, str, str]] = TEMPLATES,
                  rare: int = RARE, agree: int = AGREE, share: float = SHARE) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` per row of ``docs``.

    Base phrases count wherever their words stand consecutively. A template counts where at
    least ``agree`` of its ``rare`` rarest words agree on a start, the key phrase stands in its
    place and at least ``share`` of the words match; the best share is the score, and a base
    phrase scores 1. Null and empty texts have no words and score 0. Rows without doc_id and
    repeated rows are scanned like others. An empty table gives an empty result; other columns
    are ignored. Two scans of the texts, nothing but word counts is shuffled.
    """
    split = [(label, t.split(), key.split()) for label, t, key in templates]
    vocabulary = sorted({w for _, t, _ in split for w in t} | {w for p, _ in base for w in p.split()})
    seen = rarity(docs, vocabulary)
    places = [rare_places(t, seen, rare) for _, t, _ in split]
    base_place = [min(range(len(p.split())), key=lambda k, w=p.split(): (seen[w[k]], k)) for p, _ in base]
    index = sorted({t[k] for (_, t, _), at in zip(split, places) for k in at} | {p.split()[k] for (p, _), k in zip(base, base_place)})

    # only texts that hold enough index words, at least within others, are looked at word by word
    low = F.col("low")
    has = lambda words, n: reduce(add, [F.contains(low, F.lit(w)).cast("int") for w in words]) >= n
    maybe = reduce(or_, [has([t[k] for k in at], min(agree, len(at))) for (_, t, _), at in zip(split, places)] + [has(set(p.split()), len(set(p.split()))) for p, _ in base])
    own = F.array_remove(F.split(_text(), BETWEEN_RAW), "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text().alias("text"), F.explode(F.array(F.lower(_text()))).alias("low"))
    rows = rows.select("doc_id", F.explode(F.array(F.struct(own.alias("words"), maybe.alias("maybe")))).alias("t"))
    rows = rows.select("doc_id", F.size("t.words").cast("long").alias("n_words"), F.explode(F.array(
        F.when(F.col("t.maybe"), F.transform("t.words", lambda w: F.translate(w, _UPPER, _LOWER))))).alias("words"))
    hits = F.filter(F.transform("words", lambda w, k: F.struct(w.alias("word"), k.alias("place"))), lambda h: h.word.isin(index))
    rows = rows.withColumn("hits", F.explode(F.array(hits)))

    rows = rows.withColumn("base_at", F.explode(F.array(F.array(*[_phrase_places(p.split(), k) for (p, _), k in zip(base, base_place)]))))
    matches = [F.struct(F.lit(label).alias("label"), F.array_max(_template_shares(t, key, at, min(agree, len(at)))).alias("share"))
               for (label, t, key), at in zip(split, places)]
    rows = rows.withColumn("own", F.explode(F.array(F.filter(F.array(*matches), lambda m: m.share >= share))))

    places_all = F.flatten("base_at")
    base_labels = F.filter(F.array(*[F.when(F.size(F.col("base_at")[k]) > 0, F.lit(label)) for k, (_, label) in enumerate(base)]), lambda x: x.isNotNull())
    has = F.col("words").isNotNull()
    own_labels = F.transform("own", lambda m: m.label)
    joined = lambda labels: F.when(has, F.array_join(F.array_sort(F.array_distinct(labels)), ",")).otherwise("")
    n_base = F.when(has, F.size(places_all)).otherwise(0).cast("long")
    best = F.coalesce(F.array_max(F.transform("own", lambda m: m.share)), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", n_base.alias("n_base"), F.array_min(places_all).cast("long").alias("first_word"),
        F.array_max(places_all).cast("long").alias("last_word"), joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, own_labels)).alias("labels"), F.when(n_base > 0, F.lit(1.0)).otherwise(best).alias("score"))
