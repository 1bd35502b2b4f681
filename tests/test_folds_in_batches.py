"""Folds that read a group in batches: what they find does not hang on where a batch ends, and no group is one frame."""

import random

import pytest
from pyspark.sql import functions as F

from leafmark.functions import spoken
from leafmark.operators import lecture
from leafmark.streaming import events as S


@pytest.fixture
def short_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_boards_across_batches(spark, short_batches):
    rng, rows, want = random.Random(3), [], []
    for video in ("a", "b", None):
        before = set()
        for ts in range(40):
            text = rng.choice(["", "alpha beta gamma", "alpha beta gamma the", "delta epsilon", "the", None, "delta  epsilon zeta"])
            rows.append((video, ts, ts + 1, text))
            own = {w for w in (text or "").split() if w != "the"}
            if own and own == before:
                want[-1][2] = ts + 1
            elif text:
                want.append([video, ts, ts + 1, " ".join(text.split())])
                before = own
    random.Random(5).shuffle(rows)
    df = lecture.merge_repeat_frames(spark.createDataFrame(rows, "video_id string, ts_ms long, visible_to_ms long, text string"))
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(list, df.collect()), key=key) == sorted(want, key=key)


def test_suppression_across_batches(spark, short_batches):
    rows = [(u, None if u == 2 and i < 2 else i * 7 % 400, u * 100 + i) for u in range(4) for i in range(60)]
    events = spark.createDataFrame(rows, "user_id long, at long, event_id long").select("user_id", F.timestamp_seconds("at").alias("ts"), "event_id")
    df = S.suppress_batch(events, ["user_id"], "ts", "event_id", 30)
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()
    want = set()
    for u in range(4):
        last = None
        for second, i in sorted(((-1 if at is None else at), i) for w, at, i in rows if w == u):
            if second < 0 or last is None or second - last >= 30:
                want.add(i)
                last = None if second < 0 else second
    assert {r["event_id"] for r in df.collect()} == want


def test_word_edits_make_no_object_of_a_word(spark, short_batches):
    rows = [(["a", "b", "c"], ["a", "c"]), (None, ["a"]), ([], ["x", "y"]), (["a"], None), (["a", None], ["a", None]), (["é", "b"], ["b", "é"]), ([], [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<string>, b array<string>").coalesce(1)
    got = [r["n"] for r in df.select("i", spoken.word_edits(F.col("a"), F.col("b")).alias("n")).orderBy("i").collect()]
    assert got == [1, None, 2, None, 0, 2, 0]
    assert spoken._word_edits.evalType != F.pandas_udf(len, "int").evalType
