"""Few selected leaves meet a large tree without the tree's texts being moved."""

from leafmark.operators import merging as M
from leafmark.sources.files import Kept


def tree(spark):
    filler = " ".join(f"word{i}" for i in range(60))
    child = [(f"c{i}", "child", "d", "s", f"p{i // 4}", f"river {i} {filler} {i * 7919}", 70, []) for i in range(2000)]
    parent = [(f"p{g}", "parent", "d", "s", "s", f"river {g} {filler} {filler}", 280, [f"c{g * 4 + k}" for k in range(4)]) for g in range(500)]
    above = [("s", "section", "d", "s", "d", "river", 999, [f"p{g}" for g in range(500)]), ("d", "document", "d", None, None, "river", 999, ["s"])]
    rows = spark.createDataFrame(child + parent + above, "node_id string, level string, document_id string, section_id string, parent_id string, text string, token_count int, child_ids array<string>")
    return Kept().keep(rows.repartition(4), "tree")


def moved(spark, frame) -> list[str]:
    """The columns of what is shuffled by the numbers of nodes alone."""
    plan = spark._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
    by_node = [x for x in plan.split("\n\n") if ") Exchange" in x and ("hashpartitioning(node_id#" in x or "hashpartitioning(candidate_id#" in x)]
    return [x.split("Input")[1].split("\n")[0] for x in by_node]


def test_texts_stay_where_they_are(spark):
    nodes = tree(spark)
    selected = Kept().keep(spark.createDataFrame([(1, f"c{i}", 0.9) for i in (0, 1, 2, 9, 10)], "query_id long, node_id string, score double").coalesce(1), "few")
    queries = spark.createDataFrame([(1, "river word1 word2", "explanatory")], "query_id long, query string, query_type string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40k")
    try:
        found = M.decide_merges(selected, nodes, queries)
        assert not [m for m in moved(spark, found) if "text#" in m or "words#" in m]
        assert {r["candidate_id"] for r in found.collect()} == {"p0", "p2"}
        kept = Kept()
        own = kept.keep(M._reachable(nodes.join(selected.select("query_id", "node_id"), "node_id")), "own")
        reach = kept.keep(spark.createDataFrame([(1, 0, 3)], "query_id long, start int, top int"), "reach")
        play, pairs = M.closure(own, nodes, reach, kept)
        assert {r["node_id"] for r in play.collect()} == {"c0", "c1", "c2", "c9", "c10", "p0", "p2", "s", "d"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
