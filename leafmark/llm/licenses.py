"""Licence scans by a positional index of rare words, in built-in functions only.

Licence notices and phrases are templates. Each is indexed by its rarest words, by document counts
over all documents, with their places in it. A file's words that stand in the index are its rarest
licence words; each gives, for every posting, where the template would have to begin. Words of one
template that agree on that beginning are added up, and a template counts only where its key phrases
stand word for word. A phrase is found at every place, as its rarest word is always looked up and
the other words are then compared; a notice may have words put in, left out or replaced.

Files are read twice, once for the counts; there is no shuffle but that of the counts. What is sent
to the tasks grows with the templates, not with the files.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Wordings of licences (words in lower case, without punctuation).
#: Phrases, each found wherever its words stand next to each other.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Label, wording, phrases of it that must stand as they are.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "obtaining a copy of this software"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "with or without fee is hereby granted"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "with or without modification"]),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2 0", "in compliance with the license"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license as published by the free software foundation", "version 3 of the license"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license as published by the free software foundation", "version 2 of the license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ["gnu affero general public license", "version 3 of the license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license 2 0"]),
    ("boost", "distributed under the boost software license version 1 0", ["boost software license version 1 0"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rarest words of a notice in the index, of those that any document holds.
INDEXED = 8
#: Share of their weight that must agree on a beginning.
LEAST = 0.7
#: Words that a notice may be shifted by from one part to another.
SLACK = 8


def words_of(text: Column) -> Column:
    """Words with A-Z as a-z. Other letters are lowered too, which no word here can tell; the Kelvin sign is made another letter first, as it alone would become a letter of a-z by itself."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å"))), F.lit(WORD), F.lit(0))


def weights(words: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """A weight for each word of the templates, by the number of documents that hold it: a thousand times the logarithm of its rarity. And the weight of words that none holds."""
    held = words.select(F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary))).alias("held"), F.lit(1).alias("doc"))
    rows = held.select(F.explode(F.concat("held", F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()  # a row a word of the templates; "" counts all documents
    df = {r["w"]: r["count"] for r in rows}
    weight = lambda n: math.floor(1000 * math.log((2 * df.get("", 0) + 2) / (2 * n + 1)))
    return {w: weight(df.get(w, 0)) for w in vocabulary}, weight(0)


def _index(entries: list[tuple[str, Column]], kind: str) -> Column:
    """word -> postings of ``kind``, as a literal; null without any."""
    if not entries:
        return F.lit(None).cast(f"map<string,array<{kind}>>")
    by_word: dict[str, list[Column]] = {}
    for word, posting in entries:
        by_word.setdefault(word, []).append(posting)
    return F.create_map(*[x for w, postings in by_word.items() for x in (F.lit(w), F.array(*postings))])


def _struct(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str, list[str]]] = NOTICES, text: str = "text") -> DataFrame:
    """Every row with ``license_words`` (how many words it has), ``license_phrases`` (array of label, first word and number of words, in order) and ``license_notices`` (label and share, 0 to 1, of the notices found).

    Null texts are empty. Repeated rows and null ids are scanned each by itself; equal places stand in the order of labels; an
    empty table stays empty; other columns come along, and columns of these names are replaced.
    """
    own = [c for c in docs.columns if c not in ("license_words", "license_phrases", "license_notices")]
    rows = docs.select(F.struct(*own).alias("row"), words_of(F.col(text)).alias("words"))
    must = list(dict.fromkeys([p for _, p in phrases] + [k for _, _, keys in notices for k in keys]))
    vocabulary = sorted({w for p in must for w in p.split()} | {w for _, n, _ in notices for w in n.split()})
    weight, unseen = weights(rows, vocabulary)
    rarest = lambda words: max(range(len(words)), key=lambda i: (weight[words[i]], -i))

    spoken = [p.split() for p in must]
    exact = _index([(ws[rarest(ws)], _struct(phrase=F.lit(k), off=F.lit(rarest(ws)), said=F.array(*map(F.lit, ws)))) for k, ws in enumerate(spoken)], "struct<phrase:int,off:int,said:array<string>>")
    postings, keys, needed = [], [], []
    for t, (_, wording, held) in enumerate(notices):
        ws = wording.split()
        best = sorted((i for i in range(len(ws)) if weight[ws[i]] < unseen), key=lambda i: (-weight[ws[i]], i))[:INDEXED]
        postings += [(ws[i], _struct(template=F.lit(t), place=F.lit(i), weight=F.lit(weight[ws[i]]))) for i in best]
        keys += [(k, t, _place(ws, k.split())) for k in held]
        needed.append(_struct(template=F.lit(t), total=F.lit(max(1, sum(weight[ws[i]] for i in best))), keys=F.lit(len(held))))
    rare = _index(postings, "struct<template:int,place:int,weight:int>")
    of_phrase = F.create_map(*[x for k, p in enumerate(must) for x in (F.lit(k), F.array(*[_struct(template=F.lit(t), place=F.lit(at)) for name, t, at in keys if name == p]).cast("array<struct<template:int,place:int>>"))])

    looked_up = sorted({w for w, _ in postings} | {ws[rarest(ws)] for ws in spoken})
    spots = F.filter(F.transform("words", lambda w, i: F.when(w.isin(looked_up), i)), lambda i: i.isNotNull())
    rows = rows.select("row", "words", spots.alias("spots"))

    word = lambda i: F.element_at("words", i + 1)
    begun = F.flatten(F.transform("spots", lambda i: F.transform(F.coalesce(exact[word(i)], F.array().cast("array<struct<phrase:int,off:int,said:array<string>>>")), lambda p: _struct(first=i - p["off"], phrase=p["phrase"], said=p["said"]))))
    stands = F.filter(begun, lambda p: (p["first"] >= 0) & (F.slice("words", F.greatest(p["first"], F.lit(0)) + 1, F.size(p["said"])) == p["said"]))
    rows = rows.select("row", "words", "spots", F.transform(stands, lambda p: _struct(first=p["first"], phrase=p["phrase"], n=F.size(p["said"]))).alias("stands"))

    bins = lambda at: F.array(F.floor(at / SLACK).cast("int"), F.floor(at / SLACK).cast("int") + 1)  # noqa: E731  two beginnings at most SLACK apart share one
    entry = lambda template, begin, place, weight, key: F.transform(bins(begin), lambda b: _struct(template=template, bin=b, place=place, weight=weight, key=key))
    agree = F.flatten(F.flatten(F.transform("spots", lambda i: F.transform(F.coalesce(rare[word(i)], F.array().cast("array<struct<template:int,place:int,weight:int>>")), lambda p: entry(p["template"], i - p["place"], p["place"], p["weight"], F.lit(0))))))
    fixed = F.flatten(F.flatten(F.transform("stands", lambda s: F.transform(of_phrase[s["phrase"]], lambda p: entry(p["template"], s["first"] - p["place"], -1 - p["place"], F.lit(0), F.lit(1))))))
    rows = rows.select("row", "words", "stands", F.when(F.size("stands") > 0, F.array_sort(F.concat(agree, fixed))).alias("agree"))

    def summed(need: Column) -> Column:
        """The largest share of the template's weight in one bin that holds its key phrases; a place counts once."""
        start = _struct(bin=F.lit(None).cast("int"), place=F.lit(0), weight=F.lit(0), keys=F.lit(0), best=F.lit(0))

        def add(s: Column, e: Column) -> Column:
            same = F.coalesce(s["bin"] == e["bin"], F.lit(False))
            again = same & (s["place"] == e["place"])
            weight = F.when(again, s["weight"]).when(same, s["weight"] + e["weight"]).otherwise(e["weight"])
            found = F.when(again, s["keys"]).when(same, s["keys"] + e["key"]).otherwise(e["key"])
            return _struct(bin=e["bin"], place=e["place"], weight=weight, keys=found, best=F.when(found == need["keys"], F.greatest(s["best"], weight)).otherwise(s["best"]))

        return F.aggregate(F.filter("agree", lambda e: e["template"] == need["template"]), start, add, lambda s: s["best"])

    labels = F.array(*[F.lit(label) for label, _, _ in notices])
    shares = F.transform(F.array(*needed), lambda n: _struct(label=F.element_at(labels, n["template"] + 1), share=summed(n) / n["total"]))
    found = F.when(F.col("agree").isNotNull(), F.filter(shares, lambda s: s["share"] >= LEAST)).otherwise(F.array().cast("array<struct<label:string,share:double>>"))
    named = F.array(*[F.lit(label) for label, _ in phrases])
    places = F.array_sort(F.transform(F.filter("stands", lambda s: s["phrase"] < len(phrases)), lambda s: _struct(first=s["first"], label=F.element_at(named, s["phrase"] + 1), n=s["n"])))
    return rows.select("row.*", F.size("words").cast("long").alias("license_words"), places.alias("license_phrases"), found.alias("license_notices"))


def _place(words: list[str], part: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i:i + len(part)] == part)


def digest(scanned: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` of scanned rows; the score is 1 where a phrase stands, else the best share of a notice."""
    p, n = F.col("license_phrases"), F.col("license_notices")
    base = F.array_distinct(F.transform(p, lambda x: x["label"]))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    place = lambda f: f(F.transform(p, lambda x: x["first"])).cast("long")
    return scanned.select(
        "doc_id", F.col("license_words").alias("n_words"), F.size(p).cast("long").alias("n_base"), place(F.array_min).alias("first_word"), place(F.array_max).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform(n, lambda x: x["label"]))).alias("labels"),
        F.when(F.size(p) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(n, lambda x: x["share"])), F.lit(0.0))).alias("score"))
