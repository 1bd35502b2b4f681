"""The pipeline's near-duplicate stage against all pairs of five-word shingle sets."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafmark.llm import near_copies

from . import brute


def shingle_set(text) -> frozenset:
    words = (text or "").lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def staying(rows) -> set:
    """In the order of ids: a text stays if it is not similar to one that does."""
    kept: dict = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        s = shingle_set(t)
        if not any(s == k or 5 * len(s & k) >= 4 * len(s | k) for k in kept.values()):
            kept[i] = s
    return set(kept)


@pytest.mark.parametrize("common", [3, 10**9])
def test_stage_against_all_pairs(spark, monkeypatch, common):
    monkeypatch.setattr(near_copies, "COMMON", common)
    rng = random.Random(7)
    line = " ".join(f"licence{i}" for i in range(30))
    rows = [(None, "only the text has no id but many words of its own"), (1000, ""), (1001, None), (1002, "  "), (1003, "two words"), (1004, "Two  WORDS"), (1005, "two other")]
    for base in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 60, 120, 300]))]
        for copy in range(8):
            edited = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 30)):
                edited[rng.randrange(len(edited))] = f"x{rng.randrange(10**6)}"
            rows.append((rng.randrange(10**6) + 2000, " ".join(edited) + (f" {line}" if base % 3 == 0 else "")))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("a column")).withColumn("size", F.lit(1))
    got = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    found = [r["doc_id"] for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == staying(rows)
    assert corpus_pipeline.simhash_near_dedup(spark, docs.where("false"), "").count() == 0


def test_stage_on_documents(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in brute.rows(small, "documents")]
    got = corpus_pipeline.simhash_near_dedup(spark, spark.read.parquet(f"{small}/documents.parquet"), small)
    assert {r["doc_id"] for r in got.collect()} == staying(rows)


def test_shingles_of_all_texts_are_counted(spark):
    """Passages that a few of many texts share are told from what one text alone holds, so texts that share them don't meet."""
    rng = random.Random(3)
    passages = [" ".join(f"p{k}x{i}" for i in range(12)) for k in range(20)]
    rows = [(i, " ".join(f"u{rng.randrange(10**9)}" for _ in range(60)) + " " + passages[i % 20]) for i in range(100)]
    copy = rows[7][1].rsplit(" ", 1)[0] + " changed"
    nodes = near_copies._nodes(spark.createDataFrame([*rows, (100, copy)], "doc_id long, text string"), "doc_id", "text")
    shared = {r["rep"] for r in nodes.where(F.octet_length("prefix") > 0).collect()}
    met = [(r["low"], r["high"]) for r in near_copies._firsts_of(nodes).collect()]
    assert shared == {7, 100} and len(met) == 1
