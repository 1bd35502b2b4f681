"""Selection of units and of frames against plain readings of their rules."""

import random

import numpy as np
import pytest

from leafmark.operators import lecture, packing


@pytest.mark.parametrize("method", ["top", "mmr", "coverage"])
def test_units_are_the_best_of_each_step(spark, method):
    rng, vocabulary = random.Random(9), [f"word{i}" for i in range(14)]
    units = [(q, f"u{i:02d}", rng.randint(0, 8) / 8, " ".join(rng.sample(vocabulary, rng.randint(1, 8)))) for q in range(5) for i in range(14)]
    groups = [(f"u{i:02d}", [f"u{j:02d}" for j in (i - 1, i, i + 1)]) for i in range(0, 14, 3)]  # members outside the pool too
    df = spark.createDataFrame(units, "query_id long, unit_id string, score double, text string")
    asked = spark.createDataFrame([(q, " ".join(vocabulary[:6])) for q in range(5)], "query_id long, query string")
    got = {}
    for r in packing.select_units(df, asked, 210, method, spark.createDataFrame(groups, "unit_id string, members array<string>"), most=6).orderBy("place").collect():
        got.setdefault(r["query_id"], []).append(r["unit_id"])
    for q in range(5):
        words = {u: set(t.split()) for q2, u, _, t in units if q2 == q}
        score = {u: s for q2, u, s, _ in units if q2 == q}
        cost = {u: max(1, -(-len(w) * 5 // 4)) + packing.OVERHEAD for u, w in words.items()}
        of, want = dict(groups), []

        def gain(u):
            new = [m for m in of.get(u, [u]) if m in words and m not in want]
            like = max((len(words[u] & words[m]) / len(words[u] | words[m]) for m in want), default=0.0)
            seen = set().union(*(words[m] for m in want)) if want else set()
            fresh = (set().union(*(words[m] for m in new)) & set(vocabulary[:6])) - seen
            total = sum(cost[m] for m in new)
            fits = u not in want and new and sum(cost[m] for m in want) + total <= 210 and len(want) + len(new) <= 6
            value = {"top": score[u], "mmr": 0.7 * score[u] - 0.3 * like, "coverage": (score[u] + 0.35 * len(fresh) / 6 - 0.15 * like) / max(1, total) ** 0.5}[method]
            return (round(value, 12), u, new) if fits else None

        while best := max(filter(None, map(gain, words)), default=None):
            want += best[2]
        assert got.get(q, []) == want


def test_long_still_stretches_between_frames(spark):
    rng = np.random.default_rng(2)
    now, rows, want = np.zeros(8), [], []
    for ts in range(400):
        if ts == 0 or (rng.random() < 0.02 and ts > 40):
            now = now + rng.choice([0.0, 1.0], 8, p=[0.4, 0.6])
        rows.append(("v", ts, (now + rng.uniform(-0.01, 0.01, 8)).tolist(), 400))
    last = None
    for _, ts, sig, _ in rows:
        if last is None or np.mean(np.abs(np.array(sig) - last) > 0.12) >= 0.4:
            want.append(ts)
            last = np.array(sig)
    frames = spark.createDataFrame(rows, "video_id string, ts_ms long, signature array<double>, duration_ms long").repartition(4)
    got, stopped = lecture.select_changed_frames(frames, 0.4, 10**6)
    assert [(r["ts_ms"], r["visible_to_ms"]) for r in got.orderBy("ts_ms").collect()] == list(zip(want, [*want[1:], 400])) and stopped.first()["unread_from_ms"] is None
    none, all_unread = lecture.select_changed_frames(frames, 0.4, 0)
    assert none.count() == 0 and all_unread.first()["unread_from_ms"] == 0


def test_repeated_boards_last_longer(spark):
    few, many = "river water bank", "alpha beta gamma delta epsilon zeta theta iota kappa lambda"
    rows = [("v", 0, 10, few), ("v", 10, 20, "bank  water river"), ("v", 20, 30, ""), ("v", 30, 40, many), ("v", 40, 50, many.replace(" lambda", "")), ("v", 50, 60, few), ("w", 0, 5, None), ("w", 5, 9, few)]
    got = lecture.merge_repeat_frames(spark.createDataFrame(rows, "video_id string, ts_ms long, visible_to_ms long, text string")).orderBy("video_id", "ts_ms").collect()
    assert [tuple(r) for r in got] == [("v", 0, 20, few), ("v", 30, 50, many), ("v", 50, 60, few), ("w", 5, 9, few)]
