"""Audits, merges and quotas over orders, line items, events and retrieved leaves."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import merging as M, timeline as L
from ..registry import query
from .retrieval_queries import bm25_list, bm25_sql


@query("a15_manifest_completeness", """WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), n AS (SELECT l_orderkey, max(l_linenumber) AS n FROM p GROUP BY ALL), e AS (SELECT l_orderkey, unnest(generate_series(1, n)) AS part FROM n)
SELECT e.l_orderkey, count(*) AS expected, count(*) FILTER (p.l_linenumber IS NULL) AS missing FROM e LEFT JOIN p ON p.l_orderkey = e.l_orderkey AND p.l_linenumber = e.part GROUP BY ALL""")
def manifest_completeness(t):
    return M.missing_parts(t("lineitem"), "l_orderkey", "l_linenumber")


@query("c14_order_offsets", "WITH f AS (SELECT o_orderpriority, o_orderkey, min(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000 AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) SELECT o_orderpriority, round(quantile_cont(abs(days), 0.5), 6) AS p50, round(max(abs(days)), 6) AS max, count(*) AS covered FROM f GROUP BY ALL")
def cue_offsets(t):
    """How far the earliest line of each order lies from the order."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    j = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    first = j.groupBy("o_orderpriority", "o_orderkey").agg((F.min(micros("l_shipdate") - micros("o_orderdate")) / 86400000000).alias("days"))
    return first.groupBy("o_orderpriority").agg(F.round(F.percentile(F.abs("days"), F.lit(0.5)), 6).alias("p50"), F.round(F.max(F.abs("days")), 6).alias("max"), F.count("*").alias("covered"))


FEATURES = bm25_sql(80) + """, h AS (SELECT query_id, doc_id, pos, score FROM bl WHERE rank <= 80 AND score > 0), n AS (SELECT doc_id, count(*) AS slots FROM lv GROUP BY ALL), s AS (SELECT query_id, doc_id, count(*) AS hits, avg(score) AS mean, sum(score) AS total, -sum(score * ln(score)) AS sl FROM h GROUP BY ALL),
f AS (SELECT query_id, doc_id, hits, least(1.0, hits / slots) AS coverage, least(1.0, hits / 8.0) AS members, CASE WHEN hits > 1 THEN least(1.0, (sl / total + ln(total)) / ln(hits)) ELSE 0 END AS entropy, mean FROM s JOIN n USING (doc_id) WHERE hits >= 2)"""


def features(t):
    from .retrieval_queries import leaves

    hits = bm25_list(t, 80).where("score > 0")
    slots = leaves(t).groupBy("doc_id").agg(F.count("*").alias("slots"))
    return M.features(hits, slots)


@query("d15_merge_features", FEATURES + " SELECT query_id, doc_id, hits, round(coverage, 6) AS coverage, round(members, 6) AS members, round(entropy, 6) AS entropy FROM f")
def merge_features(t):
    return features(t).select("query_id", "doc_id", "hits", *[F.round(c, 6).alias(c) for c in ("coverage", "members", "entropy")])


@query("d16_merge_probability", FEATURES + " SELECT query_id, doc_id, round(1 / (1 + exp(-(0.90 * coverage + 1.05 * members - 0.85 * (1 - members) - 0.95))), 6) AS p FROM f")
def merge_probability(t):
    return features(t).select("query_id", "doc_id", F.round(M.probability(relevance=F.lit(0.0), coverage=F.col("coverage"), coherence=F.lit(0.0), density=F.col("members"), cost=F.lit(0.0), kind=F.lit("comparative_multi_hop")), 6).alias("p"))


@query("f09_consensus_table", "SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS supporting, count(*) FILTER (l_returnflag = 'R') AS contradicting FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def consensus_table(t):
    g = t("lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("supporting"), F.count_if(F.col("l_returnflag") == "R").alias("contradicting"))
    return g.where(F.col("supporting") + F.col("contradicting") > 1)


@query("h06_source_status", "SELECT l_suppkey, CASE WHEN avg(CAST(l_returnflag = 'R' AS INT)) > 0.5 THEN 'review_required' WHEN bool_or(l_quantity > 49) THEN 'ready_limited' ELSE 'ready' END AS status FROM lineitem GROUP BY l_suppkey")
def source_status(t):
    g = t("lineitem").groupBy("l_suppkey").agg(F.avg((F.col("l_returnflag") == "R").cast("int")).alias("flagged"), F.bool_or(F.col("l_quantity") > 49).alias("missing"))
    return g.select("l_suppkey", L.source_status(F.col("flagged"), F.col("missing")).alias("status"))


@query("h08_media_quota", "SELECT c_nationkey, CAST(sum(CAST(round(v * 100) AS BIGINT)) AS BIGINT) AS used FROM (SELECT c_nationkey, o_totalprice AS v FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' UNION ALL SELECT c_nationkey, o_totalprice / 2 FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O') GROUP BY c_nationkey")
def media_quota(t):
    """Stored and reserved amounts of each workspace in one pass."""
    j = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    used = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).when(F.col("o_orderstatus") == "O", F.col("o_totalprice") / 2)
    return j.where("o_orderstatus in ('F', 'O')").groupBy("c_nationkey").agg(F.sum(F.round(used * 100).cast("long")).alias("used"))


@query("i08_user_attempts", "WITH a AS (SELECT user_id, event_type, count(*) AS attempts, max(ts) AS last FROM events GROUP BY ALL) SELECT user_id, event_type, attempts, attempts >= 12 AS exhausted, CAST(least(300, 5 * pow(2, attempts)) AS DOUBLE) AS retry_seconds FROM a")
def job_attempts(t):
    a = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("attempts"))
    return a.withColumn("exhausted", F.col("attempts") >= 12).withColumn("retry_seconds", F.least(F.lit(300.0), 5 * F.pow(F.lit(2.0), F.col("attempts"))))


@query("i10_generation_check", "SELECT l_suppkey, count(*) AS vectors, count(DISTINCT l_partkey) AS leaves, max(l_orderkey) AS generation, count(*) = count(DISTINCT l_partkey) AS complete FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_suppkey")
def generation_check(t):
    g = t("lineitem").where("l_linestatus = 'O'").groupBy("l_suppkey").agg(F.count("*").alias("vectors"), F.countDistinct("l_partkey").alias("leaves"), F.max("l_orderkey").alias("generation"))
    return g.withColumn("complete", F.col("vectors") == F.col("leaves"))


@query("h02_timeline_document", """WITH l AS (SELECT doc_id, i, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS item FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)), k AS (SELECT * FROM l WHERE item <> '')
SELECT doc_id, CAST(i - 1 AS INTEGER) AS item_pos, CAST(sum(length(item) + 1) OVER w - length(item) - 1 AS BIGINT) AS char_start, CAST(sum(length(item) + 1) OVER w - 1 AS BIGINT) AS char_end FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)""")
def timeline_document(t):
    """Where each item stands in the text that joins them all by a space."""
    from ..operators import hierarchy as H

    end = F.sum(F.length("text") + 1).over(Window.partitionBy("doc_id").orderBy("section_pos")) - 1
    return H.sections(t("documents")).select("doc_id", F.col("section_pos").alias("item_pos"), (end - F.length("text")).alias("char_start"), end.alias("char_end"))
