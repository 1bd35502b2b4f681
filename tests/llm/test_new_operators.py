"""Ranked search, collocations and licence scans against plain code, and their edge cases."""

import math
import re
from collections import Counter, defaultdict

import pytest

from leafmark.llm import collocations, licenses, ranked_search
from leafmark.llm.queries import QUERIES

from . import brute

WIDE = "doc_id long, text string, lang string, words string, score string, license_words string"


def ranked(docs, items, k=10):
    """Every item with every document, by Python's integers."""
    held = [(i, Counter(ranked_search.terms_of(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for (i, c), n in zip(held, sizes):
            m = 25 + 75 * n * n_docs // n_terms if n else 0
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in Counter(ranked_search.terms_of(text)).items() if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def test_op11_against_every_pair(spark, small):
    docs, items = ([(r[key], r["text"]) for r in brute.rows(small, name)] for key, name in (("doc_id", "documents"), ("item_id", "benchmark")))
    assert sorted(map(tuple, QUERIES["op11_dual_tree_search"](spark, small).collect()), key=repr) == ranked(docs, items)


def test_bounds_lose_none(spark):
    docs = [(i, " ".join(f"w{(i * k) % 97}" for k in range(1, 30))) for i in range(1500)] + [(5000 + i, "rare words meet here") for i in range(40)]
    items = [(i, f"w{i % 97} w{i * 7 % 97} w1") for i in range(60)] + [(99, "rare words")]
    got = ranked_search.rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(docs, items)


def test_chunks_of_the_tree_equal_all_pairs():
    import numpy as np

    rng = np.random.default_rng(1)
    items = [Counter(rng.integers(0, 50, 6).tolist()) for _ in range(70)]
    weight = rng.integers(0, 9000, 50)
    tree = ranked_search.item_tree(items, weight)
    best = ranked_search.Best(3, np.zeros(70))
    every = []
    for _ in range(4):
        shares = rng.integers(0, 10**6, (300, 50)).astype(np.float32) * (rng.random((300, 50)) < 0.1)
        ids = rng.permutation(10**6)[:300].tolist()
        every.append((ids, shares))
        ranked_search.search_chunk(tree, ids, shares, np.arange(50), best)
    for item, count in enumerate(items):
        q = np.zeros(50)
        for t, n in count.items():
            q[t] = n * weight[t]
        want = sorted((-float(s), i) for ids, shares in every for s, i in zip(shares.astype(float) @ q, ids) if s >= 1)[:3]
        assert sorted((-s, i) for t, i, s in best.found() if t == item) == want


def test_op11_edges(spark):
    docs = [(2, "same text here"), (1, "same text here"), (1, "same text here"), (None, "same text here"), (3, None), (4, ""), (5, "other " * 60_000), (6, "É été same")]
    items = [(1, "same Text"), (1, "same Text"), (2, None), (None, "été"), (3, "absent")]
    d = spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in docs], WIDE).withColumnRenamed("words", "rank").withColumnRenamed("license_words", "item_id")
    got = ranked_search.rank_documents(d, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(docs, items)
    assert [r["doc_id"] for r in got.where("item_id = 1").orderBy("rank").collect()][::2] == [1, 1, 2, None, 6]
    assert ranked_search.rank_documents(d.limit(0), spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert ranked_search.rank_documents(d, spark.createDataFrame([], "item_id long, text string")).collect() == []


def mined(docs, least, longest, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        many = {p: a for p, a in counts.items() if a >= least}
        rows = []
        for p, a in many.items():
            if len(p) < 2 or any(b >= a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in many.items()):
                continue
            score, k = min((1000 * a * n[lang] // (many[p[:k]] * many[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), many[p[:k]], many[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def test_op12_against_every_phrase(spark, small):
    docs = [(r["lang"], r["text"]) for r in brute.rows(small, "documents")]
    assert sorted(map(tuple, QUERIES["op12_setm_collocations"](spark, small).collect())) == mined(docs, 100, 5, 2000)
    frame = spark.createDataFrame([(t, lang) for lang, t in docs], "text string, lang string").repartition(7)
    assert sorted(map(tuple, collocations.collocations(frame, least=6, top=50).collect())) == mined(docs, 6, 5, 50)


def test_op12_edges(spark):
    docs = [("en", "A b c. a b\tc d, " * 9), ("en", "a b c"), ("en", "a b c"), (None, "x y x y x y x y"), ("und", "x y"), ("de", None), ("de", ""), ("fr", "é É é É\x0bé É"), ("en", "long " * 80_000)]
    frame = spark.createDataFrame([(i, t, lang, "w", "s", "l") for i, (lang, t) in enumerate(docs)], WIDE).withColumnRenamed("words", "own")
    got = lambda **more: sorted(map(tuple, collocations.collocations(frame, least=3, top=20, **more).collect()))
    assert got() == mined(docs, 3, 5, 20)
    assert got(longest=3) == mined(docs, 3, 3, 20)
    assert collocations.collocations(frame.limit(0)).collect() == []
    texts = [(lang, (t or "").encode()) for lang, t in docs if lang]
    places, langs, words, counts = collocations.numbered(texts)
    assert [(langs[i - 1], words[i - 1]) for i in places if i][:4] == [("en", b"a"), ("en", b"b"), ("en", b"c"), ("en", b"a")]
    assert counts == [int((places == i).sum()) for i in range(1, len(words) + 1)]


def test_phrases_span_batches(spark):
    docs = [("en" if i % 3 else "fr", f"red green blue. number {i % 4} green blue") for i in range(90)]
    frame = spark.createDataFrame([(t, lang) for lang, t in docs], "text string, lang string").repartition(12)
    assert sorted(map(tuple, collocations.collocations(frame, least=20, top=20).collect())) == mined(docs, 20, 5, 20)


def places(text, phrase):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    said = phrase.split()
    return words, [i for i in range(len(words)) if words[i:i + len(said)] == said]


def test_op13_against_every_place(spark, small):
    docs = {r["doc_id"]: r["text"] for r in brute.rows(small, "documents")}
    got = {r["doc_id"]: r for r in QUERIES["op13_license_scan"](spark, small).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        found = sorted((at, label) for label, p in licenses.PHRASES for at in places(text, p)[1])
        r, base = got[i], sorted({label for _, label in found})
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(places(text, "")[0]), len(found), ",".join(base))
        assert (r["first_word"], r["last_word"]) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert set(base) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_op13_notices_and_edges(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    edited = "Permission is hereby granted, free of charge, to every person obtaining a copy of this software and its documentation files"
    texts = [gpl, edited, "Released under the MIT License. Under the MIT License! under the mitK license", None, "", "Apache License\n\nVersion 2.0; CC BY-NC 4.0", "gnu general public license any associated", "word " * 100_000 + gpl, "MİT license under the MİT license",
             "gnu license public this general version work " * 20, gpl, gpl]
    frame = spark.createDataFrame([(None if i == 10 else i, t, "en", "w", "s", "l") for i, t in enumerate(texts)], WIDE)
    scanned = licenses.scan(frame)
    rows = licenses.digest(scanned).collect()
    assert [r["labels"] for r in rows] == ["gpl-3", "mit", "mit", "", "", "apache-2,cc-by-nc", "", "gpl-3", "", "", "gpl-3", "gpl-3"]
    assert [r["n_base"] for r in rows] == [0, 0, 2, 0, 0, 2, 0, 0, 0, 0, 0, 0]
    assert rows[1]["score"] < 1 == rows[0]["score"] == rows[2]["score"]
    assert (rows[2]["first_word"], rows[2]["last_word"], rows[3]["first_word"]) == (1, 5, None)
    assert scanned.columns == ["doc_id", "text", "lang", "words", "score", "license_words", "license_phrases", "license_notices"]
    assert licenses.scan(frame.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op11_dual_tree_search", "op12_setm_collocations", "op13_license_scan"])
def test_sql_says_the_same(spark, small, name):
    from leafmark.llm.queries import ORACLE_SQL
    from tests.compare import differences

    assert differences(spark, QUERIES[name], ORACLE_SQL[name], small) == ""
