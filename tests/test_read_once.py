"""What fits many times or follows links in rounds reads its input once."""

import pandas as pd

from leafmark.operators import duplicates as D, retrieval as R


def counted(spark, rows, schema):
    """The rows, and how many of them have been made so far."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    return spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]), schema).mapInPandas(run, schema), made


def test_summary_tree_makes_its_leaves_once(spark):
    rows = [(str(i), f"Topic{i % 3} alpha{i % 3} beta{i % 3}. Other{i % 5} gamma{i % 3}.") for i in range(24)]
    leaves, made = counted(spark, rows, "node_id string, text string")
    tree = R.summary_tree_light(leaves, size=4, depth=2, most=8, features=64).collect()
    assert sum(len(r["members"]) for r in tree if r["depth"] == 0) == 24
    assert made.value == 24


def test_origin_groups_make_their_texts_once_for_pairs_and_once_for_classes(spark):
    words = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 2 : i * 2 + 120])) for i in range(20)] + [(100, " ".join(words[:120])), (101, "")]
    docs, made = counted(spark, rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["group_id"], r["first_match"]) for r in D.origin_groups(docs).collect()}
    assert made.value == 2 * len(rows)
    # a chain: each text is similar to the few before it, all the way to the first
    assert {got[i][0] for i in range(20)} == {0} and got[100] == (0, 0) and got[101] == (101, None) and got[1] == (0, 0)
