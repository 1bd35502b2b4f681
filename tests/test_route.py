"""Routing by the size of a question's scope."""

from leafmark.operators import retrieval as R


def test_large_scopes_are_not_laid_out_for_each_question(spark):
    leaves = spark.range(0, 3000, 1, 2).selectExpr("id as doc_id", "cast(0 as int) as pos", "if(id < 2990, 'big', if(id < 2995, 'few', 'more')) as source")
    queries = spark.createDataFrame([(q, "big") for q in range(100)] + [(100, "few"), (101, "few"), (101, "more"), (102, None), (103, "none")], "query_id long, source string")
    fused = spark.createDataFrame([(q, d, 0, 1.0 / (d + 1)) for q in (0, 1, 100, 102) for d in (2999, 5, 3, 8)], "query_id long, doc_id long, pos int, score double")
    got = R.route(leaves, queries, fused, limit=10, pool=2)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(
        [(q, d, 0, "fused") for q in (0, 1) for d in (3, 5)] + [(100, d, 0, "all") for d in range(2990, 2995)] + [(101, d, 0, "all") for d in range(2990, 3000)]
    )


def test_scopes_over_the_limit_together(spark):
    leaves = spark.range(0, 20, 1, 2).selectExpr("id as doc_id", "cast(0 as int) as pos", "if(id < 10, 'a', 'b') as source")
    queries = spark.createDataFrame([(1, "a"), (1, "b")], "query_id long, source string")
    fused = spark.createDataFrame([(1, 12, 0, 0.5), (1, 3, 0, 0.4), (1, 99, 0, 0.9)], "query_id long, doc_id long, pos int, score double")
    assert sorted(map(tuple, R.route(leaves, queries, fused, limit=10).collect())) == [(1, 3, 0, "fused"), (1, 12, 0, "fused")]
