"""Stored scores under other policies: worked cases of guards, bars, margins and runs without retrieval."""

import pytest

from leafmark.operators.claims import Policy, replay_runs

LEAF = "run_id string, claim_id string, child_id string, ordinal int, support double, contradiction double, coverage double, blocked boolean, retrieved boolean"
INF = float("inf")


@pytest.fixture(scope="module")
def replayed(spark):
    def run(rows, policy, status="accepted", free=False, gold=()):
        candidates = spark.createDataFrame([("r", "c", *row) for row in rows], LEAF)
        claims = spark.createDataFrame([("r", "c", status)], "run_id string, claim_id string, status string")
        runs = spark.createDataFrame([("r", free)], "run_id string, retrieval_free boolean")
        known = spark.createDataFrame([("r", g) for g in gold], "run_id string, child_id string")
        (got,) = replay_runs(candidates, claims, runs, candidates.where("retrieved"), known, [policy]).collect()
        return got["claims"], got["cited"], got["drift"], got["rescued"]

    return run


def test_guards(replayed):
    rows = [("worded", 1, 0.8, 0.1, 0.9, True, True), ("lifted", 2, 0.4, 0.1, 0.7, False, True), ("held", 3, 0.4, 0.1, 0.7, True, True), ("against", 4, 0.9, 0.6, 0.9, True, True)]
    assert replayed(rows, Policy("p", "legacy", coverage=0.6, margin=0.0)) == (1, ["lifted"], [], [])
    assert replayed(rows, Policy("p", "fixed", coverage=0.6, margin=0.0)) == (1, ["lifted", "worded"], [], [])
    assert replayed(rows, Policy("p", "fixed", margin=0.0)) == (1, ["worded"], [], [])


def test_bars(replayed):
    rows = [("in", 1, 0.55, 0.0, 0.0, False, True), ("near", 2, 0.55, 0.0, 0.0, False, False), ("far", 3, 0.7, 0.0, 0.0, False, False)]
    p = lambda **k: Policy("p", margin=0.0, **k)
    assert replayed(rows, p(), gold=["far"]) == (1, ["far", "in"], [], ["far"])
    assert replayed(rows, p(sibling=0.0), gold=["far"]) == (1, ["far", "in", "near"], ["near"], ["far"])
    assert replayed(rows, p(outside=INF)) == (1, ["in"], [], [])
    assert replayed(rows, p(outside=0.55)) == (1, ["far", "in", "near"], ["far", "near"], [])
    assert replayed(rows, p(outside=INF), free=True)[1] == ["far", "in", "near"]


def test_margins_and_ends(replayed):
    rows = [("b", 2, 0.7, 0.0, 0.0, False, True), ("a", 1, 0.7, 0.0, 0.0, False, True), ("c", 3, 0.6, 0.0, 0.0, False, True)]
    assert replayed(rows, Policy("p"))[1] == ["a"]  # too close: the first of them only
    assert replayed(rows, Policy("p", margin=0.0, most=2))[1] == ["a", "b"]
    assert replayed(rows, Policy("p", support=0.9)) == (0, [], [], [])
    assert replayed(rows, Policy("p"), status="below_claim_confidence_threshold") == (0, [], [], [])
