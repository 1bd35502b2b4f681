"""Trees of summaries: documents as papers, their sentences as leaves; searches on a tree of documents over their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import summary_trees as S, tables
from ..registry import query
from .retrieval_queries import BM25, bm25_list, leaves

TOKEN = r"greatest(1, CAST(ceil(length(regexp_extract_all(text, '[\p{L}\p{N}_]+')) * 1.25) AS BIGINT))"
HITS = BM25.replace("{k}", "80")


@query("d12_paper_trees")
def paper_trees(t):
    s = tables.sentence_spans(t("documents"), "doc_id", "text").select(F.col("doc_id").alias("paper_id"), F.format_string("%d:%05d", "doc_id", "pos").alias("node_id"), F.col("sentence").alias("text"))
    return S.soft_summary_trees(s).select("paper_id", "node_id", "layer", "tokens", "children", "members", F.sha2("text", 256).alias("text_sha256"))


def document_tree(t):
    """``(leaf hits, leaves, documents as summaries of their lines)``."""
    named = F.concat_ws(":", "doc_id", "pos").alias("leaf_id")
    held = leaves(t).select("doc_id", "pos", named, T.token_estimate("text").alias("tokens"))
    over = held.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "leaf_id"))), lambda x: x["leaf_id"]).alias("members"), F.sum("tokens").alias("tokens"))
    return bm25_list(t, 80).select("query_id", "doc_id", named, "score", "rank"), held, over.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("node_id"), "tokens", "members")


@query("d12_collapsed_search", "WITH RECURSIVE " + HITS + f""", tn AS (SELECT doc_id, pos, {TOKEN} AS tokens FROM lv), td AS (SELECT doc_id, CAST(sum(tokens) AS BIGINT) AS tokens FROM tn GROUP BY ALL),
nd AS (SELECT query_id, doc_id || ':' || pos AS node_id, doc_id, pos, score, tokens FROM bl JOIN tn USING (doc_id, pos) WHERE rank <= 80 UNION ALL SELECT query_id, 'd' || doc_id, doc_id, NULL, 0.9 * best, tokens FROM (SELECT query_id, doc_id, max(score) AS best FROM bl WHERE rank <= 80 GROUP BY ALL) JOIN td USING (doc_id)),
pl AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) AS place FROM nd) WHERE place <= 40),
fold AS (SELECT query_id, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS used, 0 AS n, false AS taken FROM (SELECT DISTINCT query_id FROM pl) UNION ALL SELECT query_id, place, used + CASE WHEN fits THEN tokens ELSE 0 END, n + CASE WHEN fits THEN 1 ELSE 0 END, fits FROM (SELECT f.query_id, pl.place, f.used, f.n, pl.tokens, f.n < 10 AND (f.n = 0 OR f.used + pl.tokens <= 300) AS fits FROM fold f JOIN pl ON pl.query_id = f.query_id AND pl.place = f.place + 1)),
op AS (SELECT pl.query_id, pl.place, pl.score, tn.doc_id, tn.pos FROM fold JOIN pl USING (query_id, place) JOIN tn ON tn.doc_id = pl.doc_id AND (pl.pos IS NULL OR tn.pos = pl.pos) WHERE taken),
fs AS (SELECT query_id, doc_id, pos, min(place) AS place, arg_min(score, place) AS score FROM op GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, pos) AS rank FROM fs)
SELECT query_id, doc_id || ':' || pos AS leaf_id, round(score, 6) AS score, rank FROM rk WHERE rank <= 20""")
def collapsed_search(t):
    """Lines by BM25 and documents by nine tenths of their best line, in one budget."""
    hits, held, docs = document_tree(t)
    scores = hits.select("query_id", F.col("leaf_id").alias("node_id"), "score").unionByName(hits.groupBy("query_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("node_id")).agg((0.9 * F.max("score")).alias("score")))
    nodes = held.select(F.col("leaf_id").alias("node_id"), F.col("tokens").cast("long").alias("tokens"), F.array("leaf_id").alias("members")).unionByName(docs)
    return S.collapsed_search(scores, nodes, 20, budget=300).withColumn("score", F.round("score", 6))


@query("d11_search", "WITH " + HITS + """, sm AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, 'd' || doc_id) AS place FROM (SELECT query_id, doc_id, sum(score) AS score FROM bl WHERE rank <= 80 GROUP BY ALL)),
op AS (SELECT query_id, doc_id, pos, place, count(*) OVER (PARTITION BY query_id ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sm JOIN lv USING (doc_id)),
th AS (SELECT query_id, doc_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY place, pos) AS b FROM op WHERE before < 100),
bo AS (SELECT query_id, doc_id, pos, rank AS a, b, coalesce(1 / (60 + rank), 0) + coalesce(1 / (60 + b), 0) AS score FROM (SELECT * FROM bl WHERE rank <= 80) FULL JOIN th USING (query_id, doc_id, pos)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, a NULLS LAST, b) AS rank FROM bo)
SELECT query_id, doc_id || ':' || pos AS leaf_id, round(score, 6) AS score, rank FROM rk WHERE rank <= 20""")
def summary_search(t):
    """Documents as summaries of their lines, scored by the sum of their lines' scores."""
    hits, _, docs = document_tree(t)
    scores = hits.groupBy("query_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("summary_id")).agg(F.sum("score").alias("score"))
    return S.summary_search(hits, scores, docs.withColumnRenamed("node_id", "summary_id"), 20).withColumn("score", F.round("score", 6))
