"""A score that lies on the sum of two bars."""

from leafmark.operators import claims


def test_a_score_on_the_sum_of_two_bars_is_cited(spark):
    trace = spark.createDataFrame([("c", "c:0", 1, 0.6, False, False), ("d", "d:0", 1, 0.599999, False, False)], "claim_id string, child_id string, ordinal int, score double, retrieved boolean, selected boolean")
    policies = spark.createDataFrame([("strict", 0.4, 0.2)], "policy string, support double, outside double")
    assert {(r["claim_id"], r["cited"], r["rescued"]) for r in claims.replay(trace, policies).collect()} == {("c", "c:0", True), ("d", None, False)}
