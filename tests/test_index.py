"""The inverted index: what a reader of its blocks holds at once, and the same ranking whatever the row groups."""

import math

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from leafmark.operators import retrieval as R


def test_blocks_are_bytes_in_small_row_groups(spark):
    text = F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(j)), F.lit(3000)).cast("string")) for j in range(24)])
    leaves = spark.range(0, 100_000, 1, 1).select(F.col("id").alias("doc_id"), F.lit(0).alias("pos"), F.lit("s").alias("source"), text.alias("text"))
    index = R.build_index(leaves, F.lower)
    try:
        wide = [f.name for f in index.blocks.schema if f.dataType.simpleString() in ("array<int>", "array<bigint>")]
        assert wide == []  # a list of postings is decoded with two levels of four bytes each
        meta = [pq.ParquetFile(p.removeprefix("file://").removeprefix("file:")).metadata for p in index.blocks.inputFiles()]
        sizes = [m.row_group(g).total_byte_size for m in meta for g in range(m.num_row_groups)]
        assert len(sizes) > 1 and max(sizes) <= 8 * R.GROUP_BYTES, sizes  # decoded
        queries = spark.createDataFrame([(1, "w7 w7 W2999 none"), (2, "none")], "query_id long, text string")
        got = {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 9)) for r in R.bm25(index, queries, 5).collect()}
    finally:
        index.drop()
    tf = leaves.select("doc_id", F.explode(F.split("text", " ")).alias("w")).where("w in ('w7', 'w2999')").groupBy("doc_id", "w").count()
    rows, df = tf.collect(), {r["w"]: r["count"] for r in tf.groupBy("w").count().collect()}
    scores: dict[int, float] = {}
    for r in rows:
        idf = math.log(1 + (100_000 - df[r["w"]] + 0.5) / (df[r["w"]] + 0.5))
        scores[r["doc_id"]] = scores.get(r["doc_id"], 0) + {"w7": 2, "w2999": 1}[r["w"]] * idf * r["count"] * 2.2 / (r["count"] + 1.2)
    best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:5]
    assert [got[1, i + 1] for i in range(5)] == [(d, round(s, 9)) for d, s in best]
    assert [got[2, i + 1] for i in range(5)] == [(d, 0.0) for d in range(5)]


def test_groups_and_leaves_without_words(spark):
    rows = [(1, 0, "a", "x y"), (1, 1, None, "x"), (2, 0, "b", ""), (3, 0, "a", "x x"), (4, 0, None, "é x")]
    leaves = spark.createDataFrame(rows, "doc_id long, pos int, source string, text string")
    queries = spark.createDataFrame([(5, "x É")], "query_id long, text string")
    found = R.bm25_found(leaves, queries, 1, "source").collect()
    best = {}
    for r in found:
        if r["group"] not in best or r["score"] > best[r["group"]][0]:
            best[r["group"]] = (r["score"], r["doc_id"], r["pos"])
    assert {g: v[1:] for g, v in best.items()} == {"a": (3, 0), None: (4, 0)}
