"""Stored tables of queries side by side."""

from concurrent.futures import ThreadPoolExecutor

from leafmark.llm import common


def test_a_run_leaves_tables_of_others_alone(spark):
    start = common.written()
    own = common.stored(spark.range(3), "own")
    with ThreadPoolExecutor(1) as beside:
        other = beside.submit(common.stored, spark.range(5), "other").result()
        mine = [p for p in common.written() if p not in start]
        assert len(mine) == 1
        common.release(spark, mine)
        assert other.count() == 5 and common.written() == start
        theirs = beside.submit(common.written).result()
        assert len(theirs) == 1
        common.release(spark, theirs)  # not this thread's
        assert other.count() == 5
        beside.submit(common.release, spark, theirs).result()
        assert beside.submit(common.written).result() == []
    assert own.columns == ["id"]
