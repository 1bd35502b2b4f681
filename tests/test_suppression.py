"""Suppressed repeats of a table against the plain fold, with keys of one run and of many."""

import pyarrow.parquet as pq
import pytest

from leafmark.streaming import events as S


@pytest.mark.parametrize("seconds", [3600, 86_400, 864_000])
def test_runs_end_at_gaps(spark, small, seconds):
    path, by, want = f"{small}/events.parquet", {}, set()
    for r in pq.read_table(path).to_pylist():
        by.setdefault((r["user_id"], r["event_type"]), []).append((r["ts"].timestamp(), r["event_id"]))
    for rows in by.values():
        last = None
        for second, i in sorted(rows):
            if last is None or second - last >= seconds:
                want.add(i)
                last = second
    got = S.suppress_batch(spark.read.parquet(path), ["user_id", "event_type"], "ts", "event_id", seconds).collect()
    assert {r["event_id"] for r in got} == want and len(got) == len(want)
