"""Worked cases for what SQL cannot express, and streams against their batch forms."""

import math
import re

import pytest
from pyspark.sql import Row, functions as F

from leafmark import plans, registry  # noqa: F401
from leafmark.functions import text as T
from leafmark.operators import evaluation, hierarchy, packing
from leafmark.streaming import events


def one(spark, column, **row):
    return spark.createDataFrame([Row(**row)]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("url, video", [
    ("dQw4w9WgXcQ", "dQw4w9WgXcQ"), ("https://www.youtube.com/watch?list=a&v=dQw4w9WgXcQ", "dQw4w9WgXcQ"), ("https://youtu.be/dQw4w9WgXcQ?t=1", "dQw4w9WgXcQ"), ("https://youtube.com/shorts/dQw4w9WgXcQ", "dQw4w9WgXcQ"),
    ("https://example.com/watch?v=dQw4w9WgXcQ", None), ("short", None),
])
def test_video_ids(spark, url, video):
    assert one(spark, T.video_id("u"), u=url) == video


@pytest.mark.parametrize("source, target, flags", [("1,234 items", "1.234 mục", []), ("it was 0.5", "es war 0,5", []), ("12 and 3", "12 und drei", []), ("12", "13", ["numbers_changed"]), ("3 of them", "4 davon", ["numbers_changed"]), ("text", "  ", ["empty"])])
def test_translation_flags(spark, source, target, flags):
    assert one(spark, T.translation_flags("a", "b"), a=source, b=target) == flags


@pytest.mark.parametrize("claim, evidence, reason", [("it reached 97 %", "it reached 79 %", "number_not_in_evidence"), ("A is better than B", "A is non-inferior to B", "non_inferiority_overclaimed"), ("it is 3.097", "it is 3097", None)])
def test_claim_guard(spark, claim, evidence, reason):
    assert one(spark, T.claim_guard("a", "b"), a=claim, b=evidence) == reason


def test_leaves_follow_the_greedy_rule_and_offsets(spark):
    text = "  ".join(f"Sentence number {i} has {'many ' * (i % 7)}words." for i in range(60))
    rows = hierarchy.leaf_spans(spark.createDataFrame([(1, text), (2, ""), (3, "One. Two.")], "doc_id long, text string"), ["doc_id"], target=40).orderBy("doc_id", "position").collect()
    value = re.sub(r"\s+", " ", text).strip()
    parts = re.split(r"(?<=[.!?]) (?=[A-Z])", value)
    counts = [len(re.findall(r"\w+", p)) for p in parts]
    want, current = [], []
    for i, n in enumerate(counts):
        if current and math.ceil((sum(counts[j] for j in current) + n) * 1.25) > 40:
            want.append((current[0], current[-1]))
            current = current[-1:]
        current.append(i)
    want.append((current[0], current[-1]))
    got = [r for r in rows if r["doc_id"] == 1]
    assert [r["leaf"] for r in got] == [" ".join(parts[a:b + 1]) for a, b in want]
    assert all(value[r["char_start"]:r["char_end"]] == r["leaf"] for r in got)
    assert [r["leaf"] for r in rows if r["doc_id"] == 3] == ["One. Two."]


def test_knapsack_is_the_best_set():
    import itertools
    import random

    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 8)
        u, w, cap = [rng.choice([0.1, 0.2, 0.3, 0.5]) for _ in range(n)], [rng.randint(1, 6) for _ in range(n)], rng.randint(1, 12)
        best = max(round(sum(u[i] for i in s), 9) for k in range(n + 1) for s in itertools.combinations(range(n), k) if sum(w[i] for i in s) <= cap)
        got = packing.knapsack(u, w, cap)
        assert round(sum(u[i] for i in got), 9) == best and sum(w[i] for i in got) <= cap


def test_duplicates_in_a_pool():
    a, b = set("abcdefghij"), set("abcdefghijk")
    assert packing.without_duplicates([b, a, set("xyz"), set("xyz")]) == [0, 2]


def test_diversity_swaps_and_adds():
    blocks = [{"source": s, "utility": u, "tokens": 10} for s, u in (("a", 0.9), ("a", 0.8), ("a", 0.7), ("b", 0.1))]
    got = packing.diversified(blocks[:3], blocks[3:], 100, False)
    assert sorted(b["source"] for b in got) == ["a", "b"] or sum(b["source"] == "a" for b in got) / len(got) <= 0.67
    assert {b["source"] for b in packing.diversified(blocks[:2], blocks[3:], 100, True)} == {"a", "b"}


def test_packed_contexts_fit(spark, small):
    rows = registry.QUERIES["e04_assemble_context"](spark, small).groupBy("query_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()
    assert rows and all(r["t"] <= packing.BUDGET and r["n"] <= packing.BLOCKS for r in rows)


def test_character_error_rate(spark):
    pair = spark.createDataFrame([("Đi chợ!", "đi chơ")], "a string, b string")
    assert pair.select(F.levenshtein(T.normalize_transcript("a"), T.normalize_transcript("b"))).first()[0] == 1


def test_bootstrap_interval_holds_the_mean(spark):
    rows = spark.range(400).select(F.lit("g").alias("g"), (F.col("id") % 10).cast("double").alias("y"), F.col("id").alias("row_key"))
    r = evaluation.bootstrap_means(rows, ["g"], "y").first()
    assert 3.9 < r["low"] < 4.5 < r["high"] < 5.1


def stream(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/events.parquet").orderBy("ts", "event_id")
    rows.repartition(1).sortWithinPartitions("ts", "event_id").write.parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def finished(df, tmp_path, name):
    df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_suppression_stream_equals_batch(spark, small, tmp_path):
    rows, s = stream(spark, small, tmp_path)
    got = finished(events.suppress_stream(s, ["user_id", "event_type"], "ts", "event_id", 86400), tmp_path, "kept")
    want = events.suppress_batch(rows, ["user_id", "event_type"], "ts", "event_id", 86400)
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in want.collect())
    assert events.kept_events([0, 10, 59, 60, 100, 120], None)[0] == [True, False, False, True, False, True]


def test_sequence_stream_is_gap_free(spark, small, tmp_path):
    _, s = stream(spark, small, tmp_path)
    got = finished(events.sequence_stream(s, "user_id", ["ts", "event_id"]), tmp_path, "numbered")
    for r in got.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("d"), F.min("seq").alias("a"), F.max("seq").alias("b")).collect():
        assert r["n"] == r["d"] == r["b"] and r["a"] == 1


def test_ingestion_writes_each_batch_once(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs.write.parquet(str(tmp_path / "docs"))
    new = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))
    events.ingest(new, hierarchy.sections, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    events.ingest(new, hierarchy.sections, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == hierarchy.sections(docs).count()
