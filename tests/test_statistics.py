"""Permutation tests against Python's integers, and that they behave as tests should."""

import random

import pytest

from leafmark.operators import evaluation as V


def sign(key, i, seed=42):
    z = (key * V.KEY_STEP + i * V.ROUND_STEP + seed) % 2**64
    z = ((z ^ (z >> 30)) * V.MIX) % 2**64
    z = ((z ^ (z >> 27)) * V.MIX) % 2**64
    return -1 if z >> 63 else 1


def test_row_form_against_plain_sums(spark):
    r = random.Random(1)
    rows = [(k, float(r.randrange(-5, 7))) for k in [*range(300), -4, 2**62, -(2**63)]]
    frame = spark.createDataFrame([*rows, (7_000, None), (None, 3.0)], "row_key long, diff double").repartition(5)
    known = spark.createDataFrame(rows, "row_key long, diff double").repartition(5)
    observed = abs(sum(v for _, v in rows))
    more = sum(abs(sum(v * sign(k, i) for k, v in rows)) >= observed - 1e-9 for i in range(1, 301))
    assert V.paired_permutation(known, iterations=300).first()["p_value"] == pytest.approx((more + 1) / 301)
    assert 0 < V.paired_permutation(frame, iterations=50).first()["p_value"] <= 1
    assert V.paired_permutation(frame.limit(0)).first()["p_value"] == 1.0


def test_no_difference_is_not_found_and_a_clear_one_is(spark):
    r = random.Random(2)
    none = spark.createDataFrame([(f"q{k}", r.gauss(0, 1)) for k in range(400)], "row_key string, diff double")
    some = spark.createDataFrame([(f"q{k}", r.gauss(0.5, 1)) for k in range(400)], "row_key string, diff double")
    assert V.paired_permutation(none, 2000).first()["p_value"] > 0.01 > V.paired_permutation(some, 2000).first()["p_value"]
    clusters = some.selectExpr("substr(row_key, 1, 3) as cluster", "diff")
    assert V.cluster_sign_flip(clusters, iterations=2000).first()["p_value"] < 0.01


def test_no_row_is_repeated_in_the_plan(spark):
    frame = spark.createDataFrame([(1, 1.0)], "row_key long, diff double")
    plan = V.sign_sums(frame, "row_key", "diff", 10, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("MapInArrow")  # what is taken apart is a task's sums
