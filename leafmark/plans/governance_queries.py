"""Sources, jobs and events: suppliers are sources, orders their revisions and jobs, events what runs tell."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import governance as G, merging as M, retrieval as R
from ..registry import query
from ..sources.files import Kept, scratch
from ..streaming import events as E, ingest as I
from .retrieval_queries import DENSE, SPARSE, asked, bm25_list, bm25_sql, hundredth, leaves, sparse_list


@query("a15_upload_completeness", "WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) + 1 AS total, 20000 AS part FROM orders), e AS (SELECT o_orderkey, total, CAST(ceil(total / part) AS INTEGER) AS n, part FROM s), x AS (SELECT o_orderkey, total, n, unnest(generate_series(1, n)) AS k, part FROM e), y AS (SELECT x.*, CASE WHEN k < n THEN part ELSE total - (n - 1) * part END AS due, l_linenumber IS NOT NULL AS there, CASE WHEN l_linenumber % 3 = 2 THEN part + 1 WHEN k < n THEN part ELSE total - (n - 1) * part END AS got FROM x LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON l_orderkey = o_orderkey AND l_linenumber = k) SELECT o_orderkey AS session_id, n AS expected, coalesce(string_agg(CASE WHEN NOT there THEN CAST(k AS VARCHAR) END, ' ' ORDER BY k), '') AS missing, coalesce(string_agg(CASE WHEN there AND got <> due THEN CAST(k AS VARCHAR) END, ' ' ORDER BY k), '') AS wrong_size, count(*) FILTER (NOT there OR got <> due) = 0 AS complete FROM y GROUP BY o_orderkey, n")
def upload_completeness(t):
    sessions = t("orders").select(F.col("o_orderkey").alias("session_id"), (F.floor("o_totalprice") + 1).alias("total_bytes"), F.lit(20_000).cast("long").alias("part_bytes"))
    n = F.ceil(F.col("total_bytes") / F.col("part_bytes"))
    parts = t("lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("part_no")).distinct().join(sessions, "session_id")
    size = F.when(F.col("part_no") % 3 == 2, F.col("part_bytes") + 1).when(F.col("part_no") < n, F.col("part_bytes")).otherwise(F.col("total_bytes") - (n - 1) * F.col("part_bytes"))
    found = M.upload_completeness(sessions, parts.select("session_id", "part_no", size.alias("bytes")))
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return found.select("session_id", "expected", listed("missing").alias("missing"), listed("wrong_size").alias("wrong_size"), "complete")


@query("c15_source_revisions", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders), p AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC) AS k FROM lineitem WHERE l_linestatus = 'F'), j AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderpriority LIKE '1%') SELECT c_custkey AS source_id, r.o_orderkey AS revision_id, CAST(p.l_linenumber AS INTEGER) AS parse_id, j.o_orderkey AS job_id, j.o_orderstatus AS job_status FROM customer LEFT JOIN r ON r.o_custkey = c_custkey AND r.k = 1 LEFT JOIN p ON p.l_orderkey = r.o_orderkey AND p.k = 1 LEFT JOIN j ON j.o_custkey = c_custkey AND j.k = 1")
def source_revisions(t):
    o = t("orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("revision_id"), F.col("o_orderdate").alias("created"), "o_orderpriority", F.col("o_orderstatus").alias("status"))
    parses = t("lineitem").select(F.col("l_orderkey").alias("revision_id"), F.col("l_linenumber").alias("parse_id"), F.when(F.col("l_linestatus") == "F", "succeeded").otherwise("failed").alias("status"), F.col("l_shipdate").alias("created"))
    jobs = o.where("o_orderpriority like '1%'").withColumnRenamed("revision_id", "job_id")
    return G.latest_revision(t("customer").select(F.col("c_custkey").alias("source_id")), o, parses, jobs).select("source_id", "revision_id", F.col("parse_id").cast("int").alias("parse_id"), "job_id", "job_status")


def scope(t):
    sources = t("supplier").select((F.col("s_suppkey") % 3).alias("workspace_id"), F.col("s_suppkey").alias("source_id"), F.when(F.col("s_suppkey") % 5 == 0, "failed").otherwise("ready").alias("status"), F.when(F.col("s_acctbal") < 0, F.lit("now")).alias("deleted_at"))
    g = t("lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_orderkey").alias("generation_id"), F.when(F.col("l_returnflag") == "R", "p2").otherwise("p1").alias("profile"), F.when(F.col("l_linestatus") == "O", "active").otherwise("retired").alias("state"), F.col("l_shipdate").alias("created"))
    none = sources.select("workspace_id", "source_id").where("false")
    return G.scope_snapshot(none, sources, g, "p2")


SCOPE = "WITH g AS (SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC) AS k FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'), s AS (SELECT s_suppkey % 3 AS workspace_id, s_suppkey AS source_id, CASE WHEN s_suppkey % 5 = 0 OR s_acctbal < 0 THEN 'missing' WHEN l_orderkey IS NULL THEN 'unindexed' END AS reason, l_orderkey FROM supplier LEFT JOIN g ON l_suppkey = s_suppkey AND k = 1) "


@query("c16_scope", SCOPE + "SELECT workspace_id, source_id, l_orderkey AS generation_id FROM s WHERE reason IS NULL")
def scope_snapshot(t):
    return scope(t)[0]


@query("c16_scope_rejected", SCOPE + "SELECT workspace_id, source_id, reason FROM s WHERE reason IS NOT NULL")
def scope_rejected(t):
    return scope(t)[1]


def seen(t):
    nodes = t("part").select(F.col("p_partkey").alias("node_id"), (F.col("p_partkey") % 10 + 1).alias("source_id"), F.col("p_size").alias("page_start"), (F.col("p_size") + 1).alias("page_end"))
    sources = t("supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("alias"), F.when(F.col("s_acctbal") < 3000, F.lit("now")).alias("deleted_at"))
    return nodes, sources


SEEN = "WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_comment, s_name, s_acctbal < 3000 OR s_suppkey IS NULL AS gone, p_size FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus AS l_comment FROM lineitem) JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = p_partkey % 10 + 1) "


@query("c17_evidence_rows", SEEN + "SELECT l_orderkey AS claim_id, l_partkey AS node_id, CAST(CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS INTEGER) AS role_order, s_name AS alias, CASE WHEN gone THEN '' ELSE l_comment END AS quote, CASE WHEN NOT gone THEN p_size END AS page_start, gone AS source_deleted FROM v")
def evidence_rows(t):
    role = F.when(F.col("l_returnflag") == "N", "primary").when(F.col("l_returnflag") == "A", "corroborating").otherwise("contradicting")
    evidence = t("lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("node_id"), role.alias("role"), F.col("l_linestatus").alias("quote"))
    return G.evidence_view(evidence, *seen(t)).select("claim_id", "node_id", "role_order", "alias", "quote", "page_start", "source_deleted")


@query("c17_context_rows", SEEN + "SELECT l_orderkey AS run_id, l_linenumber AS context_id, l_partkey AS node_id, CASE WHEN gone THEN '' ELSE l_comment END AS text, gone AS source_deleted FROM v")
def context_rows(t):
    blocks = t("lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("context_id"), F.col("l_partkey").alias("node_id"), F.col("l_linestatus").alias("text"))
    return G.context_view(blocks, *seen(t)).drop("alias")


@query("c18_run_summaries", "SELECT o_custkey AS workspace_id, o_orderkey AS run_id, count(l_orderkey) AS claims, count(*) FILTER (l_returnflag <> 'R') AS accepted FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 4 <> 0 GROUP BY ALL")
def run_summaries(t):
    runs = t("orders").select(F.col("o_custkey").alias("workspace_id"), F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 4 == 0, F.lit(1)).alias("parent_run_id"))
    claims = t("lineitem").select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_returnflag") == "R", "rejected").otherwise("supported").alias("status"))
    return G.run_summaries(runs, claims)


def rate_sql(rules: dict[str, tuple[int, int]], rule: str) -> str:
    """Hits of a rule's window and of the one before, in whole microseconds."""
    values = ", ".join(f"('{name}', {window}, {most})" for name, (most, window) in rules.items())
    return f"""WITH r AS (SELECT rule, w::BIGINT AS w, lim FROM (VALUES {values}) x(rule, w, lim)), e AS (SELECT event_id, {rule} AS rule, user_id, epoch_us(ts) AS us FROM events), j AS (SELECT e.*, w, lim, us // (w * 1000000) AS bucket FROM e JOIN r USING (rule)), h AS (SELECT *, row_number() OVER (PARTITION BY rule, user_id, bucket ORDER BY us, event_id) AS here, w * 1000000 - us % (w * 1000000) AS rest FROM j),
c AS (SELECT rule, user_id, bucket + 1 AS bucket, count(*) AS n FROM j GROUP BY ALL), f AS (SELECT h.*, round(here + coalesce(n, 0) * (rest / (w * 1e6)), 6) AS effective FROM h LEFT JOIN c USING (rule, user_id, bucket))
SELECT event_id, rule, effective, effective <= lim AS passes, CASE WHEN effective > lim THEN CAST(greatest(1, rest // 1000000) AS BIGINT) END AS retry_seconds FROM f"""


FEW_RULES = {"click": (2, 60), "view": (5, 3600)}
#: Events as hits of all named rules, users in ten groups as subjects, and the clock ten thousand times as slow, so that windows fill.
NAMED = "list_extract([" + ", ".join(f"'{r}'" for r in G.RATE_RULES) + f"], CAST(event_id % {len(G.RATE_RULES)} AS INTEGER) + 1)"
NAMED_SQL = rate_sql(G.RATE_RULES, NAMED).replace("user_id, epoch_us(ts) AS us", "user_id % 10 AS user_id, epoch_us(ts) // 10000 AS us")


def named_hits(e):
    rule = F.element_at(F.array(*map(F.lit, G.RATE_RULES)), (F.col("event_id") % len(G.RATE_RULES) + 1).cast("int"))
    return e.select("event_id", rule.alias("rule"), (F.col("user_id") % 10).alias("subject"), F.timestamp_micros(F.expr("unix_micros(cast(ts as timestamp)) div 10000")).alias("ts"))


@query("i01_rate_rules", rate_sql(FEW_RULES, "event_type"))
def rate_rules(t):
    e = t("events")
    return G.rate_rules(e.select("event_id", F.col("event_type").alias("rule"), F.col("user_id").alias("subject"), "ts"), G.rule_table(e.sparkSession, FEW_RULES))


@query("i01_named_rules", NAMED_SQL)
def named_rules(t):
    e = t("events")
    return G.rate_rules(named_hits(e), G.rule_table(e.sparkSession))


@query("i05_sequence_runs", "WITH g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), r AS (SELECT *, count(*) FILTER (gap IS NULL OR gap > 86400000000) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS seq FROM r")
def sequence_runs(t):
    return E.sequence_batch(t("events"), "user_id", "event_id").select("event_id", "user_id", "seq")


@query("i04_retention_tables", "SELECT 'events' AS \"table\", count(*) FILTER (value < 20) AS due FROM events UNION ALL SELECT 'orders', count(*) FILTER (o_orderstatus = 'F') FROM orders UNION ALL SELECT 'lineitem', count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') FROM lineitem")
def retention_tables(t):
    names = ("events", "orders", "lineitem")
    return G.retention_sweep({n: t(n) for n in names}, {"events": F.col("value") < 20, "orders": F.col("o_orderstatus") == "F", "lineitem": (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")})


RUN = "CASE event_id % 7 WHEN 0 THEN 'stage' WHEN 1 THEN 'claim_verified' WHEN 2 THEN 'claim_verified' WHEN 3 THEN 'section' WHEN 4 THEN 'done' WHEN 5 THEN 'error' ELSE 'stage' END"


def run_events(t):
    k = F.element_at(F.array(*map(F.lit, ("stage", "claim_verified", "claim_verified", "section", "done", "error", "stage"))), (F.col("event_id") % 7 + 1).cast("int"))
    return t("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), k.alias("type"), (F.col("event_id") % 11).cast("string").alias("item_id"), F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("payload"))


@query("i06_replay_run", f"WITH e AS (SELECT user_id AS run_id, event_id AS seq, {RUN} AS type, event_id % 11 AS item, event_type || ':' || event_id AS p FROM events WHERE event_id > 100), c AS (SELECT run_id, type, item, min(seq) AS a, max(seq) AS b, max_by(p, seq) AS p FROM e WHERE type IN ('claim_verified', 'section') GROUP BY ALL) SELECT e.run_id, coalesce(string_agg(CASE WHEN type = 'stage' THEN p END, ' ' ORDER BY seq), '') AS stages, coalesce((SELECT string_agg(p, ' ' ORDER BY a) FROM c WHERE c.run_id = e.run_id AND type = 'claim_verified'), '') AS claims, coalesce((SELECT string_agg(p, ' ' ORDER BY b) FROM c WHERE c.run_id = e.run_id AND type = 'section'), '') AS sections, max_by(p, seq) FILTER (type = 'done') AS status, max_by(p, seq) FILTER (type = 'error') AS error FROM e GROUP BY e.run_id")
def replay_run(t):
    e = run_events(t)
    found = G.replay_run(e, e.select("run_id").distinct().withColumn("last_seq", F.lit(100)))
    return found.select("run_id", *[F.array_join(c, " ").alias(c) for c in ("stages", "claims", "sections")], "status", "error")


@query("i07_rehydrate_events", f"SELECT user_id AS run_id, event_id AS seq, CASE WHEN {RUN} = 'claim_verified' AND event_id % 11 > 5 THEN 'stage' ELSE {RUN} END AS type, CASE WHEN {RUN} = 'claim_verified' THEN CASE WHEN event_id % 11 > 5 THEN '' ELSE coalesce(r_name, '') END ELSE event_type || ':' || event_id END AS payload FROM events LEFT JOIN region ON r_regionkey = event_id % 11")
def rehydrate_events(t):
    claims = t("region").select(F.col("r_regionkey").cast("string").alias("claim_id"), F.col("r_name").alias("text")).unionByName(t("region").where("r_regionkey = 0").select(F.lit("5").alias("claim_id"), F.lit("").alias("text")))
    return G.rehydrate_events(run_events(t), claims).select("run_id", "seq", "type", "payload")


@query("i08_job_attempts", "WITH j AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'succeeded' END AS status, o_custkey % 6 AS attempts, o_orderkey % 9 = 0 AS cancel, o_orderdate < TIMESTAMP '1995-01-01' AS expired FROM orders), s AS (SELECT *, CASE WHEN status = 'failed' OR (status = 'running' AND expired) THEN CASE WHEN cancel THEN 'cancelled' WHEN attempts >= 4 THEN 'attempts_exhausted' ELSE 'retry' END ELSE status END AS state FROM j) SELECT o_orderkey AS job_id, state, CASE WHEN state = 'retry' THEN least(300.0, 5 * pow(2.0, attempts)) END AS retry_seconds FROM s")
def job_attempts(t):
    o = t("orders")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "running").otherwise("succeeded").alias("status"), F.col("o_orderdate").alias("lease_until"), (F.col("o_custkey") % 6).alias("attempts"), F.lit(4).alias("max_attempts"), (F.col("o_orderkey") % 9 == 0).alias("cancel_requested"))
    return G.job_attempt_report(jobs, F.lit("1995-01-01").cast("timestamp_ntz"))


@query("i10_published_generations", "WITH b AS (SELECT o_orderkey AS g, o_custkey AS s, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 0 GROUP BY ALL), st AS (SELECT g, s, CASE WHEN s % 4 = 0 THEN 'orphaned' WHEN n <> 4 THEN 'failed' ELSE 'active' END AS state FROM b), rep AS (SELECT DISTINCT s FROM st WHERE state = 'active') SELECT s AS source_id, g AS generation_id, state FROM st UNION ALL SELECT o_custkey, o_orderkey, CASE WHEN o_custkey IN (SELECT s FROM rep) THEN 'retired' ELSE 'active' END FROM orders WHERE o_orderkey % 2 = 1")
def published_generations(t):
    o = t("orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("generation_id"), F.lit("p").alias("profile"))
    built = o.where("generation_id % 2 = 0").withColumn("workspace_id", F.lit(1)).withColumn("expected", F.lit(4))
    vectors = t("lineitem").select(F.col("l_orderkey").alias("generation_id"), F.col("l_partkey").alias("node_id"))
    live = o.select("source_id").distinct().where("source_id % 4 <> 0")
    return G.publish_generation(o.where("generation_id % 2 = 1").withColumn("state", F.lit("active")), built, vectors, live, 10**12).drop("profile")


UPLOAD = "CASE WHEN bad THEN 'checksum_mismatch' WHEN regexp_matches(text, '[^\\s]') THEN 'active' ELSE 'empty' END"


@query("i09_ingest_increment", f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, text IS NULL OR doc_id % 5 = 0 AS bad, text IS NULL AS never, lang = 'en' AS early FROM documents WHERE source IS DISTINCT FROM 'src1'),
one AS (SELECT doc_id, {UPLOAD} AS state FROM d WHERE early) SELECT CAST(0 AS BIGINT) AS batch, doc_id, state FROM one
UNION ALL SELECT 1, doc_id, {UPLOAD.replace("bad", "never")} FROM d WHERE doc_id NOT IN (SELECT doc_id FROM one WHERE state = 'active')""")
def ingest_increment(t):
    """English documents come first, some with a wrong checksum; then all come with the right one, twice over. A source is deleted."""
    d = t("documents")
    shown = lambda rows: rows.select("doc_id", "source", "text", F.sha2("text", 256).alias("sha256"))
    uploads, broken = shown(d), shown(d.where("lang = 'en'")).withColumn("sha256", F.when(F.col("doc_id") % 5 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    path, gone = scratch(d.sparkSession, "ingested"), lambda: d.where("source = 'src1'").select("doc_id")
    for number, batch in ((0, broken), (1, uploads), (1, uploads)):
        I.ingest_batch(batch, number, path, gone, F.length)
    return I.published(d.sparkSession, path, "uploads", I.UPLOADS).select("batch", "doc_id", "state")


@query("i11_translation_progress", "SELECT lang AS translation_id, count(*) AS total, count(*) FILTER (doc_id % 3 = 0) AS done, count(*) FILTER (doc_id % 6 = 0) AS flagged FROM documents GROUP BY lang")
def translation_progress(t):
    d = t("documents").select(F.col("lang").alias("translation_id"), F.col("doc_id").alias("node_id"), "text")
    stored = d.where("node_id % 3 = 0").select("translation_id", "node_id", F.when(F.col("node_id") % 6 == 0, F.array(F.lit("numbers_changed"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    return G.translate_missing(d, stored)[1].drop("progress")


@query("i12_scrubbed_nodes", "SELECT doc_id AS node_id, source AS source_id, CASE WHEN source IN ('src1', 'src3') THEN 0 ELSE length(text) END AS chars FROM documents")
def scrubbed_nodes(t):
    d = t("documents").select(F.col("doc_id").alias("node_id"), F.col("source").alias("source_id"), "text")
    dead = d.select("source_id").distinct().where("source_id in ('src1', 'src3')")
    n, _, _ = G.scrub_source(dead, d, d.select(F.col("node_id").alias("claim_id"), "node_id", F.col("text").alias("quote")), d.select("node_id"))
    return n.select("node_id", "source_id", F.length("text").alias("chars"))


@query("i13_reindexed", "SELECT source || '@p2' AS generation_id, count(*) AS vectors FROM documents WHERE source IN (SELECT DISTINCT source FROM documents WHERE doc_id % 5 = 0) GROUP BY source")
def reindexed(t):
    d = t("documents").select(F.col("doc_id").alias("node_id"), F.col("source").alias("source_id"), F.lit("child").alias("level"), "text")
    active = d.where("node_id % 5 = 0").select("source_id", F.lit("active").alias("state")).distinct()
    vectors, _ = G.reindex_profile(d, active, "p2", lambda c: F.array(F.length(c).cast("double")))
    return vectors.groupBy("generation_id").agg(F.count("*").alias("vectors"))


@query("i16_fingerprints", "SELECT l_orderkey AS config_id, sha256(string_agg('n' || l_linenumber || '=' || l_returnflag, chr(10) ORDER BY 'n' || l_linenumber, l_returnflag)) AS fingerprint FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL")
def fingerprints(t):
    s = t("lineitem").select(F.col("l_orderkey").alias("config_id"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_returnflag").alias("value"))
    return G.config_fingerprint(s, ["n3"])


@query("h08_workspace_quota", "SELECT s_nationkey AS workspace_id, CAST(sum(b) AS BIGINT) AS used, sum(b) > 100000 AS over FROM (SELECT s_nationkey, CAST(floor(s_acctbal) AS BIGINT) AS b FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT c_nationkey, 1000 FROM customer WHERE c_acctbal > 5000) GROUP BY s_nationkey")
def workspace_quota(t):
    assets = t("supplier").select(F.col("s_nationkey").alias("workspace_id"), F.floor("s_acctbal").alias("bytes"), F.when(F.col("s_acctbal") > 0, "ready").otherwise("failed").alias("status"))
    sessions = t("customer").select(F.col("c_nationkey").alias("workspace_id"), F.lit(1000).cast("long").alias("total_bytes"), F.lit("open").alias("status"), F.col("c_acctbal").alias("expires_at"))
    return G.media_quota(assets, sessions, F.lit(5000.0), 100_000)


WEIGHTS = "WITH f AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS rel, l_tax * 10 AS cov, l_quantity / 50 AS coh, l_discount * 5 AS den, l_tax * 5 AS cost, l_linenumber % 4 AS kind, l_quantity / 60 AS um, l_quantity / 55 AS bm FROM lineitem), p AS (SELECT *, 1 / (1 + exp(-(1.55 * rel + 0.90 * cov + 0.45 * coh + 1.05 * den - 0.85 * (1 - den) - 0.75 * cost - 0.95 + CASE kind WHEN 0 THEN 0.40 WHEN 1 THEN 0.22 WHEN 2 THEN -0.28 ELSE 0 END))) AS p FROM f)"


def weighed(t):
    li, k = t("lineitem"), F.col("l_linenumber") % 4
    one = lambda i: (k == i).cast("double")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("relevance"), (F.col("l_tax") * 10).alias("coverage"), (F.col("l_quantity") / 50).alias("coherence"), (F.col("l_discount") * 5).alias("density"), (F.col("l_tax") * 5).alias("cost"), one(2).alias("query_factoid"), one(1).alias("query_explanatory"), one(3).alias("query_comparative"), one(0).alias("query_global"), (F.col("l_quantity") / 60).alias("u_members"), (F.col("l_quantity") / 55).alias("best_member"))


@query("d16_prior_weights", WEIGHTS + " SELECT l_orderkey, l_linenumber, round(p, 6) AS p FROM p")
def prior_weights(t):
    return weighed(t).select("l_orderkey", "l_linenumber", F.round(M.prior(), 6).alias("p"))


@query("d17_decisions", WEIGHTS + ", u AS (SELECT *, 0.5 * p + 0.5 * rel AS up FROM p), d AS (SELECT *, up + 0.35 * greatest(0, 1 - cov) * up - um - 0.5 * cost AS delta FROM u) SELECT l_orderkey, l_linenumber, round(delta, 6) AS delta, rel < 0.78 * bm AS rolled_back, round(delta, 9) >= 0.04 AND NOT rel < 0.78 * bm AS accepted FROM d")
def decisions(t):
    return M.decide(weighed(t)).select("l_orderkey", "l_linenumber", F.round("delta", 6).alias("delta"), "rolled_back", "accepted")


def tree_selection(t):
    """The benchmark's items with the leaves of the tree that hold most of their words, by the sparse list over leaves."""
    from .node_queries import nodes

    # what merging reads of a node; the text that embeds it is as long again
    n = Kept().keep(nodes(t).select("node_id", "level", "document_id", "section_id", "parent_id", "text", "token_count", "child_ids"), "nodes")
    numbered = n.where("level = 'child'").select(F.col("document_id").cast("long").alias("doc_id"), F.pmod(F.xxhash64("node_id"), F.lit(2**31 - 1)).cast("int").alias("pos"), "node_id", "text")
    hits = R.sparse_topk(numbered, asked(t), 24).join(numbered.select("doc_id", "pos", "node_id"), ["doc_id", "pos"])
    q = asked(t).select("query_id", F.col("text").alias("query"), F.element_at(F.array(*map(F.lit, ("factoid", "explanatory", "comparative_multi_hop", "global_synthesis"))), (F.col("query_id") % 4 + 1).cast("int")).alias("query_type"))
    return hits.select("query_id", "node_id", (F.col("score") / (F.col("score") + 10)).alias("score")), n, q


@query("d17_decide_merges")
def decide_merges(t):
    found = M.decide_merges(*tree_selection(t))
    return found.select("query_id", "candidate_id", *[F.round(c, 6).alias(c) for c in M.FEATURES], F.round("delta", 6).alias("delta"), "accepted")


@query("d18_expand_selection")
def expand_selection(t):
    """The benchmark's items over the tree, level by level until each stops."""
    return M.expand_selection(*tree_selection(t))[1].select("query_id", "round", "level", "tokens", "candidates", "merged", F.round("gain", 6).alias("gain"), "stopped")


ORDER_TREE = """WITH line AS (SELECT l_orderkey AS o, l_linenumber AS pos, max(l_quantity) AS quantity, max(l_discount) * 10 AS score, max(l_returnflag) AS flag, max(l_linestatus) AS status FROM lineitem GROUP BY ALL),
parent AS (SELECT o_custkey AS q, o_orderkey AS o, sum(CAST(quantity AS INT)) AS tokens, count(*) AS slots, least(1.0, any_value(o_totalprice) / 300000) AS rel, length(any_value(c_mktsegment)) % 4 AS kind FROM orders JOIN line ON o = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
mine AS (SELECT q, kind, o, pos, CAST(quantity AS INT) AS tok, score, ['flag' || lower(flag), 'status' || lower(status)] AS words FROM line JOIN parent USING (o) WHERE quantity >= 20),
used AS (SELECT q, sum(tok) AS tokens FROM mine GROUP BY q),
pair AS (SELECT *, lag(words) OVER (PARTITION BY o ORDER BY pos) AS last FROM mine),
cand AS (SELECT q, o, count(*) AS n, avg(score) AS um, max(score) AS bm, sum(tok) AS tok, coalesce(avg(len(list_intersect(words, last)) / len(list_distinct(list_concat(words, last)))) FILTER (last IS NOT NULL), 0) AS coh FROM pair GROUP BY ALL HAVING count(*) >= 2),
f AS (SELECT c.*, rel, least(1.0, n / slots) AS cov, least(1.0, c.tok / tokens) AS den, least(1.0, greatest(0, tokens - c.tok) / 600) AS cost, kind FROM cand c JOIN parent USING (q, o)),
p AS (SELECT *, 0.5 * rel + 0.5 / (1 + exp(-(1.55 * rel + 0.90 * cov + 0.45 * coh + 1.05 * den - 0.85 * (1 - den) - 0.75 * cost - 0.95 + CASE kind WHEN 3 THEN 0.40 WHEN 1 THEN 0.22 WHEN 0 THEN -0.28 ELSE 0 END))) AS up FROM f),
d AS (SELECT *, up + 0.35 * greatest(0, 1 - cov) * up - um - 0.5 * cost AS delta FROM p),
s AS (SELECT q, count(*) AS candidates, count(*) FILTER (ok) AS merged, coalesce(sum(greatest(0, delta)) FILTER (ok), 0) AS gain FROM (SELECT *, round(delta, 9) >= 0.04 AND NOT rel < 0.78 * bm AS ok FROM d) GROUP BY q)"""


def order_tree(t):
    """Lines of orders as leaves, orders, customers and nations over them; each customer asks, and has all lines of 20 pieces or more selected."""
    line = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_quantity", "l_discount", "l_returnflag", "l_linestatus")])
    order = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    name = lambda kind, *key: F.concat_ws("-", F.lit(kind), *key)
    leaf, parent, section, document = name("line", "l_orderkey", "l_linenumber"), name("order", "o_orderkey"), name("customer", "c_custkey"), name("nation", "c_nationkey")
    lines = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("c_custkey").alias("query_id"), leaf.alias("node_id"), parent.alias("parent_id"), section.alias("section_id"), document.alias("document_id"), "l_linenumber", F.concat(F.lit("flag"), "l_returnflag", F.lit(" status"), "l_linestatus").alias("text"), F.col("l_quantity").cast("int").alias("token_count"), (F.col("l_discount") * 10).alias("score"), "l_quantity", "o_totalprice")
    lines = Kept().keep(lines, "lines")  # joined once for the selection and all levels
    held = lambda at: F.transform(F.array_sort(F.collect_list(F.struct(at, "node_id"))), lambda x: x["node_id"])
    none = F.lit(None).cast("string")
    child = lines.select("node_id", F.lit("child").alias("level"), "parent_id", "section_id", "document_id", "text", "token_count", F.array().cast("array<string>").alias("child_ids"), F.lit(0.0).alias("worth"))
    parents = lines.groupBy(F.col("parent_id"), "section_id", "document_id", F.least(F.lit(1.0), F.col("o_totalprice") / 300000).alias("worth")).agg(held("l_linenumber").alias("child_ids"), F.sum("token_count").cast("int").alias("token_count")).select(F.col("parent_id").alias("node_id"), F.lit("parent").alias("level"), F.col("section_id").alias("parent_id"), "section_id", "document_id", F.lit("").alias("text"), "token_count", "child_ids", "worth")
    sections = parents.groupBy("section_id", "document_id").agg(F.array_sort(F.collect_list("node_id")).alias("child_ids"), F.sum("token_count").cast("int").alias("token_count"), F.avg("worth").alias("worth")).select(F.col("section_id").alias("node_id"), F.lit("section").alias("level"), F.col("document_id").alias("parent_id"), "section_id", "document_id", F.lit("").alias("text"), "token_count", "child_ids", "worth")
    tops = sections.groupBy("document_id").agg(F.array_sort(F.collect_list("node_id")).alias("child_ids"), F.sum("token_count").cast("int").alias("token_count"), F.avg("worth").alias("worth")).select(F.col("document_id").alias("node_id"), F.lit("document").alias("level"), none.alias("parent_id"), none.alias("section_id"), "document_id", F.lit("").alias("text"), "token_count", "child_ids", "worth")
    kinds = F.element_at(F.array(*map(F.lit, ("factoid", "explanatory", "comparative_multi_hop", "global_synthesis"))), F.length("c_mktsegment") % 4 + 1)
    asked_ = t("customer").select(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("query"), kinds.alias("query_type"))
    above = Kept().keep(parents.unionByName(sections).unionByName(tops), "above-lines")
    return lines.where("l_quantity >= 20").select("query_id", "node_id", "score"), child.unionByName(above), asked_


def worth(pairs, nodes, queries):
    return pairs.join(nodes.select(F.col("node_id").alias("candidate_id"), "token_count", F.size("child_ids").alias("slots"), F.col("worth").alias("candidate_score")), "candidate_id")


@query("d18_first_round", ORDER_TREE + """ SELECT q AS query_id, CAST(u.tokens AS BIGINT) AS tokens, CASE WHEN u.tokens > 690 THEN 0 ELSE coalesce(candidates, 0) END AS candidates, CASE WHEN u.tokens > 690 THEN 0 ELSE coalesce(merged, 0) END AS merged, CASE WHEN u.tokens > 690 THEN 0 ELSE coalesce(round(gain, 6), 0) END AS gain,
    CASE WHEN u.tokens > 690 THEN 'token headroom reached' WHEN candidates IS NULL THEN 'no candidate with enough members' WHEN merged = 0 THEN 'members favoured' WHEN gain < 0.02 THEN 'gain below epsilon' END AS stopped FROM used u LEFT JOIN s USING (q)""")
def first_round(t):
    """Orders with their lines as candidates: one round of all customers."""
    selected, n, q = order_tree(t)
    trace = M.expand_selection(selected, n, q, budget=600, scorer=worth, depth=1)[1]
    return trace.select("query_id", "tokens", F.col("candidates").cast("long").alias("candidates"), F.col("merged").cast("long").alias("merged"), F.round("gain", 6).alias("gain"), "stopped")


@query("d14_unit_maxsim", f"WITH {DENSE}, b AS (SELECT query_id, label, max(score) AS score FROM ds GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, label) AS k FROM b) SELECT r.query_id, CAST(r.label AS BIGINT) AS unit_id, embeddings.vec_id AS leaf_id, round(score, 6) AS score FROM r JOIN embeddings ON embeddings.label = r.label WHERE k <= 2")
def unit_maxsim(t):
    """Labels as units, vectors as their chunks: all leaves of the two best units."""
    return R.unit_maxsim(t("embeddings"), hundredth(t), "label", 2, t("embeddings").select(F.col("label").cast("long").alias("unit_id"), F.col("vec_id").alias("leaf_id"))).select("query_id", "unit_id", "leaf_id", F.round("score", 6).alias("score"))


@query("d14_document_units", r"WITH lv AS (SELECT doc_id, line, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(line, '[\p{L}\p{N}_]')) SELECT doc_id, CAST(count(*) AS INTEGER) AS leaves, sha256(string_agg(line, chr(10) || chr(10) ORDER BY i)) AS text_sha256 FROM lv GROUP BY doc_id")
def document_units(t):
    return R.document_units(leaves(t)).select("doc_id", F.size("members").alias("leaves"), F.sha2("text", 256).alias("text_sha256"))


@query("d19_fixed_context", r"WITH lv AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(line, '[\p{L}\p{N}_]')) SELECT item_id AS query_id, doc_id, pos, CAST(row_number() OVER (PARTITION BY item_id ORDER BY doc_id, pos) AS INTEGER) AS rank FROM benchmark JOIN lv ON doc_id = item_id")
def fixed_context(t):
    """The lines of the document with an item's number, in order, in the place of a ranking."""
    gold = asked(t).select("query_id", F.col("query_id").alias("doc_id")).join(leaves(t).select("doc_id", "pos"), "doc_id")
    return R.fixed_context(gold).select("query_id", "doc_id", "pos", "rank")


@query("d20_run_variants", bm25_sql(80) + SPARSE + ", va AS (SELECT * FROM (VALUES ('words', 1.0, 0.0), ('content', 0.0, 1.0), ('both', 1.0, 1.0)) x(variant, a, b)), l AS (SELECT query_id, doc_id, pos, rank, 0 AS s FROM bl WHERE rank <= 80 UNION ALL SELECT query_id, doc_id, pos, rank, 1 FROM sl WHERE rank <= 80), f AS (SELECT variant, query_id, doc_id, pos, sum(CASE s WHEN 0 THEN a ELSE b END / (60 + rank)) AS score FROM l, va WHERE CASE s WHEN 0 THEN a ELSE b END > 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY variant, query_id ORDER BY round(score, 9) DESC, doc_id, pos) AS rank FROM f) SELECT variant, query_id, doc_id, pos, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def run_variants(t):
    """Three systems over the same two lists: each alone, and fused."""
    lists = {"words": bm25_list(t, 80), "content": sparse_list(t, 80)}
    variants = t("documents").sparkSession.createDataFrame([("words", "words", 1.0), ("content", "content", 1.0), ("both", "words", 1.0), ("both", "content", 1.0)], "variant string, signal string, weight double")
    return R.run_variants(lists, variants, 10).select("variant", "query_id", *R.LEAF, F.round("score", 6).alias("score"), "rank")


@query("d11_summary_tree")
def summary_tree(t):
    """Leaves of the documents clustered twice, with sentences near the centres as summaries."""
    rows = leaves(t).select(F.concat_ws(":", "doc_id", "pos").alias("node_id"), "text")
    return R.summary_tree_light(rows, size=4, depth=2, most=8, features=128).select("depth", "summary_id", F.size("members").alias("members"), F.length("text").alias("chars"))


@query("d12_soft_tree")
def soft_tree(t):
    """Vectors in overlapping clusters of a mixture chosen by BIC."""
    return R.soft_clusters(t("embeddings").select(F.col("vec_id").alias("node_id"), "embedding"), dims=6, counts=(2, 4, 8))


