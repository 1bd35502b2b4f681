"""Gold that is a whole label is counted, not laid out for each question."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leafmark.operators import evaluation as E

from .compare import differences


@pytest.mark.parametrize("name", ["g01_retrieval_metrics", "g03_citation_prf"])
def test_no_table_of_questions_times_label(spark, tmp_path, name):
    rng, n = np.random.default_rng(1), 3_000
    label = np.where(np.arange(n) % 7 == 0, np.arange(n), 0)  # one huge label; of those alone in theirs some ask
    pd.DataFrame({"vec_id": np.arange(n), "embedding": list(rng.normal(size=(n, 8)).astype(np.float32)), "label": label}).to_parquet(tmp_path / "embeddings.parquet")
    df = entry.queries()[name](spark, str(tmp_path))
    df.collect()

    def rows(node):
        metric = node.metrics().get("numOutputRows")
        children = [node.finalPhysicalPlan()] if "AdaptiveSparkPlan" in node.nodeName() else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
        return max([metric.get().value() if metric.isDefined() else 0, *map(rows, children)])

    assert rows(df._jdf.queryExecution().executedPlan()) <= 2 * n
    assert not differences(spark, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path))


def test_ideal_holds_as_many_as_are_asked_for(spark):
    runs = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id long, item long, rank int")
    gold = spark.range(1, 1_001).select(F.lit(1).cast("long").alias("query_id"), F.col("id").alias("item"), F.when(F.col("id") == 2, 3.0).otherwise(1.0).alias("relevance"))
    got = {r["k"]: r for r in E.retrieval_metrics(runs, gold, [1, 2]).collect()}
    assert got[1]["ndcg"] == pytest.approx(1 / 7) and got[2]["recall"] == pytest.approx(0.002)
    assert got[2]["ndcg"] == pytest.approx((1 + 7 / np.log2(3)) / (7 + 1 / np.log2(3)))
