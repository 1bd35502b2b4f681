"""Retrieval: benchmark passages as questions against the lines of all documents, every hundredth vector against all vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R, tables
from ..registry import query
from .text_queries import TOKENS, put

LEAVES = r"lv AS (SELECT doc_id, source, CAST(i - 1 AS INTEGER) AS pos, line AS text FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(line, '[\p{L}\p{N}_]'))"
SPACED = r"list_filter(string_split(trim(regexp_replace(lower({c}), '\s+', ' ', 'g')), ' '), lambda x: x <> '')"
BM25 = LEAVES + f""", tk AS (SELECT doc_id, pos, unnest({put(SPACED, 'text')}) AS term FROM lv), tf AS (SELECT doc_id, pos, term, count(*) AS tf FROM tk GROUP BY ALL), ln AS (SELECT doc_id, pos, count(*) AS len FROM tk GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len) AS avgdl FROM ln), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL), qt AS (SELECT item_id AS query_id, unnest({put(SPACED, 'text')}) AS term FROM benchmark),
bm AS (SELECT query_id, doc_id, pos, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN ln USING (doc_id, pos), st GROUP BY ALL),
fz AS (SELECT query_id, doc_id, pos, max(score) AS score FROM (SELECT * FROM bm UNION ALL SELECT item_id, doc_id, pos, 0.0 FROM benchmark, (SELECT doc_id, pos FROM lv ORDER BY doc_id, pos LIMIT {{k}})) GROUP BY ALL),
bl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id, pos) AS rank FROM fz)"""
SPARSE = f""", sw AS (SELECT doc_id, pos, term, 1 + ln(count(*)) AS w FROM (SELECT doc_id, pos, unnest({put(TOKENS, 'text')}) AS term FROM lv) GROUP BY ALL), qw AS (SELECT query_id, term, 1 + ln(count(*)) AS q FROM (SELECT item_id AS query_id, unnest({put(TOKENS, 'text')}) AS term FROM benchmark) GROUP BY ALL),
sp AS (SELECT query_id, doc_id, pos, sum(w * q) AS score FROM sw JOIN qw USING (term) GROUP BY ALL), sl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id, pos) AS rank FROM sp)"""
LEXICAL = f"""lx AS (SELECT query_id, doc_id, pos, CASE WHEN length(q) = 0 THEN 0 ELSE length(list_intersect(q, t)) / length(q) END AS pair_score, CASE WHEN length(q) = 0 OR length(t) = 0 THEN 0 ELSE least(1.0, length(list_filter(t, lambda w: list_contains(q, w))) / greatest(1.0, sqrt(length(t)))) END AS similarity
FROM (SELECT p.query_id, p.doc_id, p.pos, list_distinct({put(TOKENS, 'b.text')}) AS q, {put(TOKENS, 'lv.text')} AS t FROM pool p JOIN lv USING (doc_id, pos) JOIN benchmark b ON b.item_id = p.query_id))"""
bm25_sql = lambda k: "WITH " + BM25.replace("{k}", str(k))
COS = "list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))"
DENSE = f"ds AS (SELECT q.vec_id AS query_id, q.label AS query_label, v.vec_id, v.label, {COS} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0), dl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM ds)"


def leaves(t):
    return tables.leaves(t("documents"))


def asked(t):
    return t("benchmark").select(F.col("item_id").alias("query_id"), "text")


def rounded(df, *keys):
    return df.select("query_id", *(keys or R.LEAF), F.round("score", 6).alias("score"), "rank")


def sparse_list(t, k):
    return R.sparse_topk(leaves(t), asked(t), k)


def bm25_list(t, k):
    return R.bm25(leaves(t), asked(t), k)


def hundredth(t):
    return t("embeddings").where("vec_id % 100 = 0")


@query("d01_bm25", bm25_sql(10) + " SELECT query_id, doc_id, pos, round(score, 6) AS score, rank FROM bl WHERE rank <= 10")
def bm25(t):
    return rounded(bm25_list(t, 10))


@query("d02_dense_topk", f"WITH {DENSE} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM dl WHERE rank <= 10")
def dense_topk(t):
    return rounded(R.dense_topk(t("embeddings"), hundredth(t), 10), "vec_id")


@query("d03_sparse_topk", bm25_sql(1) + SPARSE + " SELECT query_id, doc_id, pos, round(score, 6) AS score, rank FROM sl WHERE rank <= 10")
def sparse_topk(t):
    return rounded(sparse_list(t, 10))


@query("d04_maxsim", f"WITH {DENSE}, b AS (SELECT query_id, query_label, label, max(score) AS best FROM ds GROUP BY ALL) SELECT query_label AS query_group, label AS leaf_group, round(avg(best), 6) AS score FROM b GROUP BY ALL")
def maxsim(t):
    return R.maxsim(t("embeddings"), hundredth(t)).select("query_group", "leaf_group", F.round("score", 6).alias("score"))


@query("d05_weighted_fusion", bm25_sql(80) + SPARSE + f""", pool AS (SELECT query_id, doc_id, pos FROM bl WHERE rank <= 80 UNION SELECT query_id, doc_id, pos FROM sl WHERE rank <= 80), {LEXICAL},
c AS (SELECT pool.*, d.score AS d, coalesce(s.score, 0) AS s, coalesce(l.pair_score, 0) AS l FROM pool LEFT JOIN (SELECT * FROM bl WHERE rank <= 80) d USING (query_id, doc_id, pos) LEFT JOIN (SELECT * FROM sl WHERE rank <= 80) s USING (query_id, doc_id, pos) LEFT JOIN lx l USING (query_id, doc_id, pos)),
m AS (SELECT *, min(d) OVER w AS d0, max(d) OVER w AS d1, min(s) OVER w AS s0, max(s) OVER w AS s1, min(l) OVER w AS l0, max(l) OVER w AS l1 FROM c WINDOW w AS (PARTITION BY query_id))
SELECT query_id, doc_id, pos, round(0.40 * CASE WHEN d IS NULL THEN 0 WHEN d1 - d0 < 1e-9 THEN 1 ELSE (d - d0) / (d1 - d0) END + 0.25 * CASE WHEN s1 - s0 < 1e-9 THEN 1 ELSE (s - s0) / (s1 - s0) END + 0.35 * CASE WHEN l1 - l0 < 1e-9 THEN 1 ELSE (l - l0) / (l1 - l0) END, 6) AS score FROM m""")
def weighted_fusion(t):
    dense, sparse = bm25_list(t, 80), sparse_list(t, 80)
    keys = ["query_id", *R.LEAF]
    late = R.lexical_scores(dense.select(*keys).unionByName(sparse.select(*keys)).distinct(), leaves(t), asked(t)).withColumnRenamed("pair_score", "score")
    return R.weighted_fusion(dense, sparse, late).select(*keys, F.round("score", 6).alias("score"))


FUSED = ", fu AS (SELECT query_id, doc_id, pos, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, doc_id, pos, rank FROM bl WHERE rank <= 80 UNION ALL SELECT query_id, doc_id, pos, rank FROM sl WHERE rank <= 80) GROUP BY ALL), fl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id, pos) AS rank FROM fu)"


def fused(t):
    return R.rrf([bm25_list(t, 80), sparse_list(t, 80)])


@query("d06_rrf", bm25_sql(80) + SPARSE + FUSED + " SELECT query_id, doc_id, pos, round(score, 6) AS score, rank FROM fl WHERE rank <= 80")
def rrf(t):
    return rounded(R.ranked(fused(t), 80))


@query("d07_scoped_search", bm25_sql(1) + ", s AS (SELECT bm.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY round(score, 9) DESC, bm.doc_id, bm.pos) AS rank FROM bm JOIN (SELECT doc_id, source FROM documents) d USING (doc_id)) SELECT query_id, source, doc_id, pos, round(score, 6) AS score, rank FROM s WHERE rank <= 3")
def scoped_search(t):
    """The best leaves of every source for every question: the scope cuts before the ranking."""
    return rounded(R.scoped_bm25(leaves(t), asked(t), 3), "source", *R.LEAF)


@query("d08_route_candidates", bm25_sql(80) + SPARSE + FUSED + """, sc AS (SELECT item_id AS query_id, doc_id, pos FROM benchmark JOIN lv ON lv.source = 'src' || (item_id % 20)), n AS (SELECT query_id, count(*) AS n FROM sc GROUP BY ALL),
lr AS (SELECT fu.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id, pos) AS rank FROM fu JOIN sc USING (query_id, doc_id, pos))
SELECT query_id, doc_id, pos, 'all' AS route FROM sc JOIN n USING (query_id) WHERE n <= 600 UNION ALL SELECT query_id, doc_id, pos, 'fused' FROM lr JOIN n USING (query_id) WHERE n > 600 AND rank <= 80""")
def route_candidates(t):
    q = asked(t).withColumn("source", F.concat(F.lit("src"), F.pmod("query_id", F.lit(20))))
    return R.route(leaves(t), q, fused(t))


@query("d09_rerank", bm25_sql(24) + f", pool AS (SELECT * FROM bl WHERE rank <= 24), {LEXICAL} SELECT query_id, doc_id, pos, round(pair_score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(pair_score, 9) DESC, pool.rank) AS rank FROM lx JOIN pool USING (query_id, doc_id, pos)")
def rerank(t):
    return rounded(R.rerank(bm25_list(t, 24), leaves(t), asked(t)))


@query("d10_agreement_ranking", bm25_sql(24) + f""", pool AS (SELECT * FROM bl WHERE rank <= 24), {LEXICAL}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(pair_score, 9) DESC, doc_id, pos) AS a, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, doc_id, pos) AS b FROM lx),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1.0 / (60 + a) + 1.0 / (60 + b), 12) DESC, doc_id, pos) AS rank FROM o) SELECT f.query_id, f.doc_id, f.pos, f.rank, round(o.pair_score, 6) AS score FROM f JOIN o ON o.query_id = f.query_id AND o.a = f.rank""")
def agreement_ranking(t):
    pool = bm25_list(t, 24).select("query_id", *R.LEAF)
    return rounded(R.agreement(R.lexical_scores(pool, leaves(t), asked(t))))


@query("d13_section_units", bm25_sql(80) + """, h AS (SELECT query_id, doc_id, pos, score, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(score, 9) DESC, pos) AS place FROM bl WHERE rank <= 80), u AS (SELECT query_id, doc_id, avg(score) AS unit FROM h WHERE place <= 2 GROUP BY ALL)
SELECT query_id, doc_id, pos, round(unit + 1e-6 * score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(unit, 9) DESC, round(score, 9) DESC, doc_id, pos) AS rank FROM h JOIN u USING (query_id, doc_id)""")
def section_units(t):
    return rounded(R.section_units(bm25_list(t, 80)))
