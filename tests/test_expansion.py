"""Expansion over a small tree: every reason to stop, and what the selection becomes."""

from pyspark.sql import functions as F

from leafmark.operators import merging as M

NODE = "node_id string, level string, parent_id string, section_id string, document_id string, text string, token_count int, child_ids array<string>, worth double"


def tree(spark):
    """Two sections of two parents of two leaves each; the parents of the first section are worth most."""
    rows = [("d", "document", None, None, "d", "", 80, ["s0", "s1"], 0.9)]
    for s in range(2):
        rows.append((f"s{s}", "section", "d", f"s{s}", "d", "", 40, [f"p{s}0", f"p{s}1"], 0.9))
        for p in range(2):
            rows.append((f"p{s}{p}", "parent", f"s{s}", f"s{s}", "d", "two words", 20, [f"c{s}{p}0", f"c{s}{p}1"], 0.9))
            rows += [(f"c{s}{p}{c}", "child", f"p{s}{p}", f"s{s}", "d", "two words", 10, [], 0.0) for c in range(2)]
    return spark.createDataFrame(rows, NODE)


def worth(pairs, nodes, queries):
    found = pairs.join(nodes.select(F.col("node_id").alias("candidate_id"), "token_count", F.size("child_ids").alias("slots"), F.col("worth").alias("candidate_score")), "candidate_id")
    return found.join(queries.select("query_id", "scale"), "query_id").withColumn("candidate_score", F.col("candidate_score") * F.col("scale")).drop("scale")


def test_reasons_to_stop(spark):
    leaves = {
        "whole": [f"c{s}{p}{c}" for s in range(2) for p in range(2) for c in range(2)],  # rises to the document
        "factoid": ["c000", "c001"],  # may rise to a parent only
        "alone": ["c000", "c010"],  # no two under one parent
        "poor": ["c000", "c001"],  # its parent is worth too little
        "half": ["c000", "c001", "c100"],  # one parent, then nothing that holds two
    }
    selected = spark.createDataFrame([(q, n, 0.5) for q, ns in leaves.items() for n in ns], "query_id string, node_id string, score double")
    kinds = {"factoid": "factoid"}
    queries = spark.createDataFrame([(q, "what is it", kinds.get(q, "global_synthesis"), 0.2 if q == "poor" else 1.0) for q in leaves], "query_id string, query string, query_type string, scale double")
    selection, trace = M.expand_selection(selected, tree(spark), queries, scorer=worth)
    got = {}
    for r in trace.orderBy("query_id", "round").collect():
        got.setdefault(r["query_id"], []).append((r["level"], r["candidates"], r["merged"], r["stopped"]))
    assert got["factoid"] == [("parent", 1, 1, None)]
    assert got["alone"] == [("parent", 0, 0, "no candidate with enough members")]
    assert got["poor"] == [("parent", 1, 0, "members favoured")]
    assert got["half"] == [("parent", 1, 1, None), ("section", 0, 0, "no candidate with enough members")]
    assert got["whole"][0] == ("parent", 4, 4, None)
    kept = {}
    for r in selection.collect():
        kept.setdefault(r["query_id"], {})[r["node_id"]] = r["score"]
    assert kept["factoid"] == {"p00": 0.9} and kept["half"] == {"p00": 0.9, "c100": 0.5}
    assert set(kept["alone"]) == {"c000", "c010"} and set(kept["poor"]) == {"c000", "c001"}
    full = M.expand_selection(selected.where("query_id = 'whole'"), tree(spark), queries, policy="static", scorer=worth)
    assert [(r["level"], r["merged"]) for r in full[1].orderBy("round").collect()] == [("parent", 4), ("section", 2), ("document", 1)]
    assert [r["node_id"] for r in full[0].collect()] == ["d"]
    tight = M.expand_selection(selected.where("query_id = 'whole'"), tree(spark), queries, budget=60, scorer=worth)[1].collect()
    assert [r["stopped"] for r in tight] == ["token headroom reached"]
    # a question that gains less than epsilon merges, then stops
    even = selected.where("query_id = 'factoid'").withColumn("score", F.lit(None).cast("double"))
    p = 1 / (1 + 2.718281828459045 ** -(1.55 * 0.9 + 0.90 + 0.45 + 1.05 - 0.95 - 0.28))
    near = even.withColumn("score", F.lit((p + 0.9) / 2 - 0.03))
    assert M.expand_selection(near, tree(spark), queries, scorer=worth)[1].collect()[0]["stopped"] == "members favoured"
    static = M.expand_selection(near.withColumn("score", F.lit(1.0)), tree(spark), queries, policy="static", scorer=worth)[1].collect()
    assert [(r["merged"], r["stopped"]) for r in static] == [(1, "gain below epsilon")]


def test_pairs_end_where_the_rounds_do(spark):
    """One round needs the candidates one level up only, so no pair with what stands further up is made."""
    seen = []

    def scorer(pairs, nodes, queries):
        seen.extend(r["candidate_id"] for r in pairs.collect())
        return worth(pairs, nodes, queries)

    nodes = tree(spark)
    leaves = nodes.where("level = 'child'").select(F.lit("q").alias("query_id"), "node_id", F.lit(0.5).alias("score"))
    queries = spark.createDataFrame([("q", "anything", "global_synthesis", 1.0)], "query_id string, query string, query_type string, scale double")
    M.expand_selection(leaves, nodes, queries, scorer=scorer, depth=1)
    assert seen and set(seen) <= {r["node_id"] for r in nodes.where("level = 'parent'").collect()}
