"""Time-ordered tables, governance and plain relational work over events, orders and line items."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import timeline as L
from ..registry import query
from ..streaming import events as S

#: Intervals: a line item from its shipping date for as many days as its quantity.
SEG = "seg AS (SELECT l_suppkey, l_orderkey, l_linenumber, CAST(epoch(l_shipdate) AS BIGINT) // 86400 AS s, CAST(epoch(l_shipdate) AS BIGINT) // 86400 + CAST(l_quantity AS BIGINT) AS e FROM lineitem)"


def segments(t):
    day = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 86400000000).cast("long")
    return t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", day.alias("s"), (day + F.col("l_quantity").cast("long")).alias("e"))


@query("h03_coverage", f"""WITH {SEG}, b AS (SELECT *, coalesce(max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s) AS before FROM seg) SELECT l_suppkey, CAST(sum(greatest(0, e - greatest(s, before))) AS BIGINT) AS covered, count(*) AS intervals FROM b GROUP BY l_suppkey""")
def coverage(t):
    return L.coverage(segments(t), "l_suppkey", "s", "e")


@query("a13_flag_cue_timing", f"""WITH {SEG}, o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, s, e) AS ordinal FROM seg), d AS (SELECT l_orderkey, max(e * 1000) - 5000 AS duration FROM seg GROUP BY ALL), c AS (SELECT o.*, s * 1000 AS start_ms, e * 1000 AS end_ms, duration FROM o JOIN d USING (l_orderkey)),
m AS (SELECT *, lag(end_ms) OVER (PARTITION BY l_orderkey ORDER BY start_ms, end_ms, ordinal) AS pe, start_ms < lag(start_ms) OVER (PARTITION BY l_orderkey ORDER BY ordinal) AS inv FROM c), i AS (SELECT l_orderkey, coalesce(bool_or(inv), false) AS any_inv FROM m GROUP BY ALL)
SELECT l_orderkey, ordinal, concat_ws(',', CASE WHEN end_ms > duration + 2000 OR any_inv THEN 'alignment_uncertain' END, CASE WHEN start_ms < pe - 1000 THEN 'overlapping_cue' END) AS flags FROM m JOIN i USING (l_orderkey)""")
def flag_cue_timing(t):
    ordinal = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "s", "e"))
    c = segments(t).select("l_orderkey", ordinal.alias("ordinal"), (F.col("s") * 1000).alias("start_ms"), (F.col("e") * 1000).alias("end_ms"))
    c = c.withColumn("duration", F.max("end_ms").over(Window.partitionBy("l_orderkey")) - 5000)
    return L.flag_cues(c, "l_orderkey").select("l_orderkey", "ordinal", F.array_join("flags", ",").alias("flags"))


@query("h01_islands", f"""WITH {SEG}, n AS (SELECT *, coalesce(CAST(s - max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 3 AS INT), 0) AS new FROM seg), i AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY s, e) AS island FROM n)
SELECT l_suppkey, CAST(island AS BIGINT) AS island, min(s) AS start, max(e) AS "end", count(*) AS n FROM i GROUP BY ALL""")
def islands(t):
    return L.islands(segments(t), "l_suppkey", "s", "e", 3)


@query("c12_alignment_edges", f"""WITH {SEG}, a AS (SELECT l_orderkey, l_linenumber AS seg_id, s AS s1, e AS e1 FROM seg WHERE l_linenumber % 2 = 0), b AS (SELECT l_orderkey, l_linenumber AS reg_id, s AS s2, e AS e2 FROM seg WHERE l_linenumber % 2 = 1)
SELECT a.l_orderkey, seg_id, reg_id, round((least(e1, e2) - greatest(s1, s2)) / greatest(1, e1 - s1), 4) AS share FROM a JOIN b USING (l_orderkey) WHERE s1 < e2 AND e1 > s2""")
def alignment_edges(t):
    s = segments(t)
    a = s.where("l_linenumber % 2 = 0").select("l_orderkey", F.col("l_linenumber").alias("seg_id"), F.col("s").alias("seg_start"), F.col("e").alias("seg_end"))
    b = s.where("l_linenumber % 2 = 1").select("l_orderkey", F.col("l_linenumber").alias("reg_id"), F.col("s").alias("reg_start"), F.col("e").alias("reg_end"))
    return L.alignment_edges(a, b, "l_orderkey")


@query("h07_apply_edits", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'edited' END, l_returnflag) AS l_returnflag, o_orderstatus = 'F' AS reviewed FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def apply_edits(t):
    edits = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("edited").alias("l_returnflag"))
    return L.apply_edits(t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), edits, ["l_orderkey"], "l_returnflag")


@query("i01_rate_limit", """WITH t AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS x FROM events), b AS (SELECT *, floor(x / 21600) AS bucket, (x - floor(x / 21600) * 21600) / 21600 AS elapsed FROM t), n AS (SELECT user_id, bucket + 1 AS bucket, count(*) AS before FROM b GROUP BY ALL),
h AS (SELECT b.event_id, b.user_id, row_number() OVER (PARTITION BY b.user_id, b.bucket ORDER BY x, event_id) AS here, coalesce(before, 0) AS before, elapsed FROM b LEFT JOIN n ON n.user_id = b.user_id AND n.bucket = b.bucket)
SELECT event_id, user_id, here, before, round(here + before * (1 - elapsed), 6) AS effective, round(here + before * (1 - elapsed), 6) <= 2 AS passes FROM h""")
def rate_limit(t):
    return L.rate_limit(t("events"), "user_id", "ts", 21600, 2)


@query("i02_suppress_repeats")
def suppress_repeats(t):
    return S.suppress_batch(t("events"), ["user_id", "event_type"], "ts", "event_id", 86400)


@query("i03_recent_events", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 30")
def recent_events(t):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return t("events").withColumn("r", F.row_number().over(w)).where("r <= 30").select("user_id", "event_id")


@query("i05_sequence_events", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def sequence_events(t):
    return L.sequence(t("events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "seq")


@query("i06_event_log", "WITH s AS (SELECT user_id, event_type, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) SELECT user_id, event_type, min(seq) AS first_seq, arg_max(props, seq) AS payload FROM s WHERE seq > 5 GROUP BY ALL")
def replay_run(t):
    s = L.sequence(t("events"), "user_id", ["ts", "event_id"]).select("user_id", "event_type", F.col("props").alias("payload"), "seq")
    return L.replay(s, "user_id", "event_type", 5)


@query("i04_retention_sweep", "SELECT user_id, count(*) AS kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY user_id")
def retention_sweep(t):
    now = t("events").agg(F.max("ts").alias("now"))
    return t("events").join(F.broadcast(now)).where(F.col("ts") >= F.col("now") - F.expr("INTERVAL 7 DAYS")).groupBy("user_id").agg(F.count("*").alias("kept"))


@query("i12_scrub_source", "SELECT l_orderkey, l_linenumber, CASE WHEN s_acctbal < 0 THEN '' ELSE l_linestatus || l_returnflag END AS text FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def scrub_source(t):
    gone = t("supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("gone"))
    return t("lineitem").join(gone, "l_suppkey", "left").select("l_orderkey", "l_linenumber", F.when(F.col("gone"), "").otherwise(F.concat("l_linestatus", "l_returnflag")).alias("text"))


@query("i11_missing_translations", "SELECT d.doc_id, d.lang FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id WHERE lang <> 'en'")
def missing_translations(t):
    return t("documents").where("lang <> 'en'").join(t("labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("i14_idempotent_requests", "WITH f AS (SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first_request, arg_min(props, (ts, event_id)) AS body FROM events GROUP BY ALL) SELECT ts, event_id, first_request, props <> body AS conflict FROM events JOIN f USING (user_id, event_type)")
def idempotent_requests(t):
    return L.idempotent(t("events"), ["user_id", "event_type"], "props", ["ts", "event_id"])


@query("i15_keyset_page", "SELECT event_id, event_type FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-02 00:00:00', 0) ORDER BY ts, event_id LIMIT 21")
def keyset_page(t):
    import datetime

    cursor = (datetime.datetime(2024, 1, 2), 0)
    rows = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return L.keyset_page(rows, "ts", "event_id", cursor, 20).select("event_id", "event_type")


@query("i16_config_fingerprint", "SELECT source, sha256(string_agg(lang || '=' || n, ',' ORDER BY lang)) AS fingerprint FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def config_fingerprint(t):
    n = t("documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "lang", "n"))), ","), 256).alias("fingerprint"))


@query("j01_left_join", "SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def left_join(t):
    return t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"), "left").select("c_custkey", "c_name", "n_name", "r_name")


@query("j02_semi_anti", "SELECT 'with' AS kind, count(*) AS n FROM customer SEMI JOIN orders ON o_custkey = c_custkey UNION ALL SELECT 'without', count(*) FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
def semi_anti(t):
    on = F.col("o_custkey") == F.col("c_custkey")
    count = lambda how, name: t("customer").join(t("orders"), on, how).agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    return count("left_semi", "with").unionByName(count("left_anti", "without"))


@query("j05_union_distinct", "SELECT s_nationkey AS nation FROM supplier UNION SELECT c_nationkey FROM customer")
def union_distinct(t):
    return t("supplier").select(F.col("s_nationkey").alias("nation")).union(t("customer").select("c_nationkey")).distinct()


@query("j06_set_operations", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer) UNION ALL SELECT 'only customers', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)")
def set_operations(t):
    s, c = t("supplier").select("s_nationkey"), t("customer").select("c_nationkey")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    return count(s.intersect(c), "both").unionByName(count(c.exceptAll(s), "only customers"))


@query("j07_aggregates", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, max(l_shipdate) AS last_ship, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL")
def aggregates(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.max("l_shipdate").alias("last_ship"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("j08_running_totals", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders")
def running_totals(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.lag("o_orderkey").over(w).alias("previous"))


@query("j09_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_k(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(50)


@query("j10_upsert", "SELECT user_id, max(value) AS value, count(*) AS n FROM (SELECT user_id, value FROM events WHERE event_type <> 'view' UNION ALL SELECT e.user_id, e.value FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase')) GROUP BY user_id")
def upsert(t):
    """Rows that are there stay; new ones come in only where their key has none yet."""
    e = t("events")
    have, new = e.where("event_type <> 'view'"), e.where("event_type = 'view'").join(e.where("event_type = 'purchase'").select("user_id").distinct(), "user_id", "left_anti")
    return have.select("user_id", "value").unionByName(new.select("user_id", "value")).groupBy("user_id").agg(F.max("value").alias("value"), F.count("*").alias("n"))


@query("j11_json", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY event_type")
def json_fields(t):
    return t("events").groupBy("event_type").agg(F.sum(F.from_json("props", "k bigint")["k"]).alias("k"), F.count("*").alias("n"))


@query("j12_row_visibility", "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 7 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def row_visibility(t):
    gone = t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    own = t("customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"))
    return t("orders").join(own, "o_custkey").join(gone, "o_custkey", "left_anti").select("o_orderkey")
