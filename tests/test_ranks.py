"""Running sums of large groups over many tasks against plain windows."""

import pytest
from pyspark.sql import Window, functions as F

from leafmark.operators import evaluation as E


@pytest.fixture(scope="module")
def rows(spark):
    """A group of nearly all rows, a small one and a null one; few values, so most are tied; some nulls."""
    k = F.col("id")
    group = F.when(k % 97 == 0, "small").when(k % 101 == 0, None).otherwise("large")
    return spark.range(20_000).select(group.alias("g"), k.alias("key"), (F.when(k % 50 != 7, F.pmod(F.xxhash64("id"), F.lit(13)) / 4)).alias("v"), F.when(k % 77 != 5, (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2))).cast("int")).alias("y")).cache()


def test_running_sums(spark, rows):
    order = [F.col("v").desc(), F.col("key")]
    got = E.running_sums(rows, ["g"], order, {"i": F.lit(1), "s": F.col("key")}).collect()
    w = Window.partitionBy("g")
    run = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("*", F.count("*").over(run).alias("i"), F.sum("key").over(run).alias("s"), F.count("*").over(w).alias("i_all"), F.sum("key").over(w).alias("s_all")).collect()
    key = lambda r: (r["key"], r["g"], r["i"], r["s"], r["i_all"], r["s_all"])
    assert sorted(map(key, got), key=lambda x: x[0]) == sorted(map(key, want), key=lambda x: x[0])


def test_one_group_lies_over_all_tasks(spark, rows):
    spread = E.running_sums(rows.withColumn("one", F.lit(1)), ["one"], [F.col("v"), F.col("key")], {"i": F.lit(1)})
    held = sorted(r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect())
    assert len(held) > 1 and held[-1] < 0.8 * rows.count()


def test_curve_and_latency(rows):
    plain = rows.where("g = 'large'").orderBy(F.desc("v"), "key").collect()
    hits = known = 0
    risks = []
    for r in plain:
        known += r["y"] is not None
        hits += r["y"] or 0
        risks.append(1 - hits / known if known else None)
    got = E.risk_coverage(rows, ["g"], "y", "v", "key").where("g = 'large'").orderBy("i").collect()
    assert [r["risk"] for r in got] == pytest.approx(risks) and got[-1]["coverage"] == 1
    values = sorted((r["v"] for r in plain), key=lambda v: (v is not None, v))
    lat = {r["g"]: r for r in E.latency_stats(rows, ["g"], "v").collect()}
    n, seen = len(values), [v for v in values if v is not None]
    assert set(lat) == {"large", "small", None}
    assert lat["large"]["p50_ms"] == values[n // 2] and lat["large"]["p95_ms"] == values[-(-95 * n // 100) - 1]
    assert lat["large"]["mean_ms"] == pytest.approx(sum(seen) / len(seen)) and lat["large"]["max_ms"] == seen[-1]


def test_empty(rows):
    assert E.latency_stats(rows.limit(0), ["g"], "v").count() == 0
    assert E.selective(rows.limit(0), ["g"], "y", "v", "key").count() == 0
    assert E.calibration(rows.limit(0), ["g"], "v", "y").count() == 0
