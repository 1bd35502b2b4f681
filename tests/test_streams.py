"""Streams in many micro-batches against their batch forms; state that ends with its keys."""

import pytest
from pyspark.sql import functions as F

from leafmark.operators import governance as G
from leafmark.streaming import events as S

RULES = {"click": (2, 600), "view": (5, 86_400), "purchase": (1, 864_000)}


def in_pieces(rows, tmp_path, pieces: int):
    """The rows as a stream of so many files in the order of time, one a micro-batch."""
    path = str(tmp_path / "in")
    listed = rows.orderBy("ts", "event_id").collect()
    for i in range(pieces):
        part = listed[len(listed) * i // pieces:len(listed) * (i + 1) // pieces]
        rows.sparkSession.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def finished(df, tmp_path, name):
    """The stream's rows, and how many keys hold state at its end."""
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return df.sparkSession.table(name), held


@pytest.fixture(scope="module")
def rows(spark, small):
    return spark.read.parquet(f"{small}/events.parquet").where("user_id % 5 = 0").cache()


def test_rates_in_pieces(spark, rows, tmp_path):
    hits = rows.select("event_id", F.col("event_type").alias("rule"), F.col("user_id").alias("subject"), "ts")
    got, held = finished(S.rate_stream(in_pieces(hits, tmp_path, 4), RULES), tmp_path, "rates")
    want = G.rate_rules(hits, G.rule_table(spark, RULES))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.where("not passes").count() > 0
    keys = hits.where(F.col("rule").isin(list(RULES))).select("rule", "subject").distinct().count()
    assert 0 < held[-1] < keys  # the keys of short windows are gone


def test_suppression_in_pieces(rows, tmp_path):
    got, held = finished(S.suppress_stream(in_pieces(rows, tmp_path, 4), ["user_id", "event_type"], "ts", "event_id", 3600), tmp_path, "kept_in_pieces")
    want = S.suppress_batch(rows, ["user_id", "event_type"], "ts", "event_id", 3600)
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in want.collect())
    assert held[-1] < rows.select("user_id", "event_type").distinct().count()


def test_runs_in_pieces(rows, tmp_path):
    narrow = rows.select("event_id", "user_id", "ts")
    got, held = finished(S.sequence_stream(in_pieces(narrow, tmp_path, 4), "user_id", ["event_id"], idle=86_400), tmp_path, "runs_in_pieces")
    want = S.sequence_batch(narrow, "user_id", "event_id", idle=86_400)
    pairs = lambda df: sorted((r["event_id"], r["seq"]) for r in df.collect())
    assert pairs(got) == pairs(want) and held[-1] < rows.select("user_id").distinct().count()


def test_hits_of_windows():
    found, after = S.window_hits([0, 5, 12, 9, 13, 35, 1], 10)
    assert found == [(1, 0), (2, 0), (1, 2), (3, 0), (2, 3), (1, 0), (1, 0)] and after == (3, 1, 0)
    assert S.window_hits([], 10, 4, 2, 1) == ([], (4, 2, 1))


def test_numbers_of_runs():
    assert S.run_numbers([0, 5, 15, 26, 27], idle=10) == ([1, 2, 3, 1, 2], 2, 27)
    assert S.run_numbers([3], 2, 5, idle=10) == ([3], 3, 5)


def test_verdicts(spark):
    """A limit of two a minute: the third hit waits for the window's end, and half of the window before still counts at half past."""
    hits = spark.createDataFrame([(i, "r", 1, t) for i, t in enumerate([0.0, 1.0, 2.5, 90.0, 119.5])], "event_id int, rule string, subject int, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long"))).drop("s")
    rules = G.rule_table(spark, {"r": (2, 60)})
    got = [(r["effective"], r["passes"], r["retry_seconds"]) for r in G.rate_rules(hits, rules).orderBy("event_id").collect()]
    assert got == [(1.0, True, None), (2.0, True, None), (3.0, False, 57), (2.5, False, 30), (2.025, False, 1)]
    assert [r["passes"] for r in G.rate_rules(hits, rules, scale=0.1).orderBy("event_id").collect()] == [True, False, False, False, False]  # one at least
    assert G.rate_rules(hits.limit(0), rules).count() == 0
