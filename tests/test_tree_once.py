"""Walks and checks of the passage tree make it once."""

import pytest

from leafmark.operators import tree
from leafmark.plans import node_queries as N

from .test_read_once import counted

ROWS = [(d, "src", " ".join(f"Word{d} w{i} ends." for i in range(400)) + "\nSecond part.") for d in range(26)]


@pytest.mark.parametrize("query", [N.validate_hierarchy, N.effective_members, N.tree_ancestors, N.members_at_level])
def test_queries_make_the_tree_once(spark, query, monkeypatch):
    docs, made = counted(spark, ROWS, "doc_id long, source string, text string")
    # sections come without their documents' rows being gathered: the part below documents is what is counted
    sections = N.sections(lambda _: docs)
    monkeypatch.setattr(N, "sections", lambda t: sections)
    assert query(lambda _: docs).count() > 0
    assert made.value == 2 * len(ROWS)  # nodes below documents, and documents


def test_write_tree_makes_the_tree_once(spark, tmp_path):
    docs, made = counted(spark, ROWS, "doc_id long, source string, text string")
    path = tree.write_tree(tree.build_hierarchy(N.sections(lambda _: docs)), f"{tmp_path}/tree", "r1")
    assert made.value == 2 * len(ROWS)
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    assert "text_sha256" in nodes.columns and "child_ids" not in nodes.columns
    assert edges.join(nodes, edges["child_id"] == nodes["node_id"], "left_anti").count() == 0 and edges.count() > 26 * 3
