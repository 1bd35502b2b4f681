"""Deleted interpolation against plain counts and expectation-maximisation on every held-out token."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from leafmark.llm import language_model

from . import brute

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def plain_scores(documents: dict[int, str]) -> dict[int, float]:
    """The model word for word: one weight triple a context bucket, learned on each token of fold 4 by itself."""
    def counts(which):
        words, pairs, starts = Counter(), Counter(), 0
        for i, text in documents.items():
            if which(fold(i)):
                t = tokens(text)
                starts += 1
                words.update(t)
                pairs.update(zip(["start", *t], t))
        return words, pairs, starts

    bucket = lambda n: int(n).bit_length()
    counted, counted_pairs, counted_starts = counts(lambda f: f not in (1, 4))
    words, pairs, starts = counts(lambda f: f != 1)
    v = len(words)
    freq = lambda c, s, h: s if h == "start" else c[h]
    held = defaultdict(list)
    n_counted = sum(counted.values())
    for i, text in documents.items():
        if fold(i) == 4:
            t = tokens(text)
            for h, w in zip(["start", *t], t):
                ch = freq(counted, counted_starts, h)
                held[bucket(ch)].append((counted_pairs[h, w] / max(ch, 1), counted[w] / max(n_counted, 1), 1 / (v + 1)))
    weights, last = {}, [0.0, 0.9, 0.1]
    for b in range(64):
        if held[b]:
            w = [0.0, 0.5, 0.5] if b == 0 else [0.4, 0.4, 0.2]
            for _ in range(200):
                new = [0.0, 0.0, 0.0]
                for p in held[b]:
                    z = sum(a * x for a, x in zip(w, p))
                    new = [n + a * x / z for n, a, x in zip(new, w, p)]
                new = [n / len(held[b]) for n in new]
                done = max(abs(a - c) for a, c in zip(new, w)) < 1e-7
                w = new
                if done:
                    break
            last = [max(a, least) for a, least in zip(w, [0.0 if b == 0 else 1e-6, 1e-6, 1e-6])]
            last = [a / sum(last) for a in last]
        weights[b] = last
    n, out = sum(words.values()), {}
    for i, text in documents.items():
        t, score = tokens(text), 0.0
        for h, w in zip(["start", *t], t):
            ch = freq(words, starts, h)
            a, b, c = weights[bucket(ch)]
            score += math.log10(a * pairs[h, w] / max(ch, 1) + b * words[w] / max(n, 1) + c / (v + 1))
        out[i] = score
    return out


def test_scores_against_plain_counts(spark, small):
    documents = {r["doc_id"]: r["text"] for r in brute.rows(small, "documents")}
    want = plain_scores(documents)
    got = {r["doc_id"]: r["score"] for r in language_model.score_documents(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], rel=2e-4)
