"""The passage tree over documents; joins and tables over regions, nations, customers and orders as a four-level tree."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as T
from ..operators import duplicates as D, hierarchy as H, tables, timeline as L
from ..registry import query
from .node_queries import LEAVES, R, SECTIONS as NODES_SECTIONS, TOKENS_OF
from .text_queries import SENTENCES, TOKENS, WS, put

WHOLE = f"sec AS (SELECT doc_id, source, 0 AS sp, '' AS section_id, {put(WS, 'text')} AS value FROM documents)"

SPANS = f"""ss AS (SELECT doc_id, unnest({SENTENCES}) AS sentence, generate_subscripts({SENTENCES}, 1) AS pos FROM documents),
sp AS (SELECT doc_id, pos, sentence, CAST(sum(length(sentence) + 1) OVER w - length(sentence) - 1 AS BIGINT) AS char_start, CAST(sum(length(sentence) + 1) OVER w - 1 AS BIGINT) AS char_end FROM ss WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""
PAGES = f"pg AS (SELECT doc_id, unnest(generate_series(1, greatest(1, CAST(ceil(length({put(WS, 'text')}) / 1000) AS BIGINT)))) AS page FROM documents)"


def spans(t):
    return tables.sentence_spans(t("documents"), "doc_id", "text")


def pages(t):
    """Pages of 1000 characters, each ending 50 early so that some spans lie on none."""
    n = F.greatest(F.lit(1), F.ceil(F.length(T.normalize_ws("text")) / 1000)).cast("int")
    p = t("documents").select("doc_id", F.explode(F.sequence(F.lit(1), n)).alias("page"))
    return p.select("doc_id", "page", ((F.col("page") - 1) * 1000).alias("page_start"), (F.col("page") * 1000 - 50).alias("page_end"))


@query("a10_markdown_sections", rf"""WITH l AS (SELECT doc_id, unnest(string_split('# First' || chr(10) || text || chr(10) || '## Last' || chr(10) || source, chr(10))) AS line, generate_subscripts(string_split('# First' || chr(10) || text || chr(10) || '## Last' || chr(10) || source, chr(10)), 1) AS i FROM documents), h AS (SELECT *, CAST(regexp_matches(line, '^#{{1,3}} ') AS INT) AS h FROM l),
s AS (SELECT *, sum(h) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM h), g AS (SELECT doc_id, section, coalesce(max(CASE WHEN h = 1 THEN regexp_replace(line, '^#+ +', '') END), 'Document') AS title, {put(WS, "string_agg(CASE WHEN h = 0 THEN line END, chr(10) ORDER BY i)")} AS body FROM s GROUP BY ALL)
SELECT doc_id, CAST(section AS INTEGER) AS section, title, body FROM g WHERE body <> ''""")
def markdown_sections(t):
    marked = t("documents").select("doc_id", F.concat(F.lit("# First\n"), "text", F.lit("\n## Last\n"), "source").alias("text"))
    return H.markdown_sections(marked).select("doc_id", "section", "title", T.normalize_ws("body").alias("body"))


@query("a19_group_folds", "SELECT source, CAST((row_number() OVER (ORDER BY source) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT source FROM documents)")
def group_folds(t):
    """Folds of whole groups: distinct sources in order, round-robin."""
    return t("documents").select("source").distinct().select("source", ((F.row_number().over(Window.orderBy("source")) - 1) % 5).cast("int").alias("fold"))


@query("a18_conversion_report", "SELECT lang, count(*) AS documents, count(*) FILTER (contains(text, chr(10))) AS with_lines, count(DISTINCT sha256(text)) AS texts, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def conversion_report(t):
    return t("documents").groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(F.contains("text", F.lit("\n"))).alias("with_lines"), F.countDistinct(F.sha2("text", 256)).alias("texts"), F.sum("n_chars").alias("chars"))


@query("c01_leaf_spans", R + LEAVES.replace(NODES_SECTIONS, WHOLE) + " SELECT doc_id, position, text AS leaf, a AS char_start, b AS char_end, " + put(TOKENS_OF, "text") + " AS tokens FROM leaf")
def leaf_spans(t):
    return H.leaf_spans(t("documents"), ["doc_id"])


@query("c02_parent_groups", f"""WITH {SPANS}, n AS (SELECT doc_id, count(*) AS n FROM sp GROUP BY ALL), g AS (SELECT doc_id, n, unnest(generate_series(0, greatest(0, CAST(ceil((n - 4) / 3) AS BIGINT)))) AS g FROM n)
SELECT doc_id, pos, CAST(max(g) AS INTEGER) AS parent_pos, count(*) AS groups FROM sp JOIN g USING (doc_id) WHERE pos - 1 BETWEEN g * 3 AND g * 3 + 3 GROUP BY ALL""")
def parent_groups(t):
    g = H.parent_groups(spans(t).withColumn("position", F.col("pos") - 1), ["doc_id"])
    return g.groupBy("doc_id", "pos").agg(F.max("group_pos").cast("int").alias("parent_pos"), F.count("*").alias("groups"))


@query("c03_attach_pages", f"""WITH {SPANS}, {PAGES}, p AS (SELECT doc_id, page, (page - 1) * 1000 AS a, page * 1000 - 50 AS b FROM pg), o AS (SELECT sp.doc_id, char_start, char_end, min(page) FILTER (a < char_end AND b > char_start) AS lo, max(page) FILTER (a < char_end AND b > char_start) AS hi, max(page) FILTER (a <= char_start) AS before FROM sp LEFT JOIN p USING (doc_id) GROUP BY ALL)
SELECT doc_id, char_start, char_end, CAST(coalesce(lo, before) AS INTEGER) AS first_page, CAST(coalesce(hi, before) AS INTEGER) AS last_page FROM o""")
def attach_pages(t):
    return H.attach_pages(spans(t).select("doc_id", "char_start", "char_end"), pages(t), ["doc_id"])


@query("c04_attach_paragraphs", f"""WITH {SPANS}, {PAGES}, p AS (SELECT doc_id, page, (page - 1) * 1000 AS a, page * 1000 - 50 AS b FROM pg) SELECT doc_id, pos, CAST(page AS INTEGER) AS page FROM sp JOIN p USING (doc_id) WHERE char_start < b AND char_end > a""")
def attach_paragraphs(t):
    return H.overlapping(spans(t), pages(t), ["doc_id"], ("char_start", "char_end"), ("page_start", "page_end")).select("doc_id", "pos", "page")


SECTIONS = rf"sc AS (SELECT doc_id, i - 1 AS section_pos, {put(WS, 'line')} AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE {put(WS, 'line')} <> '')"
OFFSETS = SECTIONS + ", co AS (SELECT *, CAST(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY section_pos) - length(text) - 2 AS BIGINT) AS canonical_start FROM sc)"


@query("c05_canonical_offsets", f"WITH {OFFSETS} SELECT doc_id, CAST(section_pos AS INTEGER) AS section_pos, canonical_start, length(text) AS chars FROM co")
def canonical_offsets(t):
    return H.canonical_offsets(H.sections(t("documents"))).select("doc_id", "section_pos", "canonical_start", F.length("text").cast("long").alias("chars"))


@query("c06_page_partition", f"""WITH {OFFSETS}, f AS (SELECT doc_id, section_pos // 3 AS page, min(canonical_start) AS s FROM co GROUP BY ALL), n AS (SELECT doc_id, max(canonical_start + length(text)) AS n FROM co GROUP BY ALL),
b AS (SELECT f.doc_id, page, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE s END AS char_start, coalesce(lead(s) OVER w, n) AS char_end FROM f JOIN n USING (doc_id) WINDOW w AS (PARTITION BY f.doc_id ORDER BY s, page))
SELECT doc_id, CAST(page AS BIGINT) AS page, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end FROM b WHERE char_end > char_start""")
def page_partition(t):
    c = H.canonical_offsets(H.sections(t("documents")))
    starts = c.select("doc_id", F.expr("cast(section_pos div 3 as bigint)").alias("page"), F.col("canonical_start").alias("start"))
    lengths = c.groupBy("doc_id").agg(F.max(F.col("canonical_start") + F.length("text")).alias("length"))
    return H.page_partition(starts, lengths, "doc_id")


@query("c07_validate_orders", "SELECT 'order without customer' AS violation, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'line before order', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate UNION ALL SELECT 'line without order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def validate_orders(t):
    o, c, li = t("orders"), t("customer"), t("lineitem")
    counted = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("violation"), "n")
    return (
        counted(o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti"), "order without customer")
        .unionByName(counted(li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate < o_orderdate"), "line before order"))
        .unionByName(counted(li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"), "line without order"))
    )


@query("c08_descendants", "SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY r_name")
def descendants(t):
    """Members of each level under a region; sums go up level by level, so no level multiplies another."""
    o = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    c = t("customer").join(o, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.sum("orders").alias("orders"))
    n = t("nation").join(c, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("nations"), F.sum("customers").alias("customers"), F.sum("orders").alias("orders"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return t("region").join(n, "r_regionkey", "left").select("r_name", zero("nations"), zero("customers"), zero("orders"))


@query("c09_group_by_ancestor", "SELECT n_name, count(*) AS selected, count(*) * 1.0 / max(k) AS share FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT c_nationkey AS nk, count(*) AS k FROM customer GROUP BY ALL) ON nk = n_nationkey WHERE c_acctbal > 5000 GROUP BY n_name")
def group_by_ancestor(t):
    """Selected members by ancestor, with their share of its slots."""
    c = t("customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 5000).alias("selected"), F.count("*").alias("slots")).where("selected > 0")
    return c.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "selected", F.round(F.col("selected") / F.col("slots"), 9).alias("share"))


@query("c15_latest_revision", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) ON o_custkey = c_custkey AND r = 1")
def latest_revision(t):
    last = L.latest(t("orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return t("customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query("c16_scope_snapshot", "SELECT s_suppkey, CASE WHEN s_acctbal <= 0 THEN 'rejected' WHEN k IS NULL THEN 'unindexed' ELSE 'ready' END AS state, k AS generation FROM supplier LEFT JOIN (SELECT l_suppkey, max(l_orderkey) AS k FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL) ON l_suppkey = s_suppkey")
def scope_snapshot(t):
    newest = t("lineitem").where("l_linestatus = 'O'").groupBy("l_suppkey").agg(F.max("l_orderkey").alias("generation"))
    j = t("supplier").join(newest, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return j.select("s_suppkey", F.when(F.col("s_acctbal") <= 0, "rejected").when(F.col("generation").isNull(), "unindexed").otherwise("ready").alias("state"), "generation")


@query("c17_evidence_view", """SELECT l_orderkey, l_linenumber, CASE WHEN s_acctbal < 0 THEN '' ELSE p_name END AS quote, s_name, n_name, CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS role_order
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey""")
def evidence_view(t):
    """Rows keep their place when their source is gone, but show nothing of it."""
    j = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return j.select("l_orderkey", "l_linenumber", F.when(F.col("s_acctbal") < 0, "").otherwise(F.col("p_name")).alias("quote"), "s_name", "n_name", F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3).alias("role_order"))


@query("c18_workspace_counts", "SELECT c_custkey, count(o_orderkey) AS runs, count(*) FILTER (o_orderstatus = 'F') AS finished FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def workspace_counts(t):
    o = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("runs"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    return t("customer").select("c_custkey").join(o, "c_custkey", "left").na.fill(0, ["runs", "finished"])


@query("c20_near_duplicates", f"""WITH w AS (SELECT doc_id, {put(TOKENS, 'text')} AS w FROM documents), s AS (SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, greatest(1, length(w) - 4)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE length(w) > 0),
d AS (SELECT doc_id, sha256(string_agg(s, chr(1) ORDER BY s)) AS k, count(*) AS n FROM s GROUP BY ALL), c AS (SELECT min(doc_id) AS id, max(n) AS n FROM d GROUP BY k), x AS (SELECT s.doc_id AS id, s.s FROM s SEMI JOIN c ON c.id = s.doc_id),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM x JOIN x y ON x.s = y.s AND x.id < y.id GROUP BY ALL) SELECT a, b, round(k / (ca.n + cb.n - k), 6) AS similarity FROM p JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b WHERE k / (ca.n + cb.n - k) >= 0.8""")
def near_duplicates(t):
    return D.near_duplicate_pairs(t("documents")).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("c20_origin_groups", f"""WITH RECURSIVE w AS (SELECT doc_id, {put(TOKENS, 'text')} AS w FROM documents), s AS (SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, greatest(1, length(w) - 4)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE length(w) > 0),
d AS (SELECT doc_id, sha256(string_agg(s, chr(1) ORDER BY s)) AS k, count(*) AS n FROM s GROUP BY ALL), c AS (SELECT min(doc_id) AS id, max(n) AS n FROM d GROUP BY k), x AS (SELECT s.doc_id AS id, s.s FROM s SEMI JOIN c ON c.id = s.doc_id),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM x JOIN x y ON x.s = y.s AND x.id < y.id GROUP BY ALL), m AS (SELECT a, b, k / (ca.n + cb.n - k) AS s FROM p JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b WHERE k / (ca.n + cb.n - k) >= 0.8), up AS (SELECT b, min(a) AS a FROM m GROUP BY b),
ro AS (SELECT c.id, c.id AS node FROM c UNION ALL SELECT ro.id, up.a FROM ro JOIN up ON up.b = ro.node), root AS (SELECT id, min(node) AS root FROM ro GROUP BY id), dc AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id FROM d)
SELECT documents.doc_id, coalesce(root, documents.doc_id) AS group_id, CASE WHEN class_id <> documents.doc_id THEN least(class_id, coalesce(up.a, class_id)) ELSE up.a END AS first_match FROM documents LEFT JOIN dc USING (doc_id) LEFT JOIN root ON root.id = class_id LEFT JOIN up ON up.b = class_id""")
def origin_groups(t):
    return D.origin_groups(t("documents")).drop("reason")


@query("c20_duplicate_classes", f"""WITH w AS (SELECT doc_id, {put(TOKENS, 'text')} AS w FROM documents), s AS (SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, greatest(1, length(w) - 4)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE length(w) > 0),
d AS (SELECT doc_id, sha256(string_agg(s, chr(1) ORDER BY s)) AS k FROM s GROUP BY ALL), g AS (SELECT k, min(doc_id) AS class_id FROM d GROUP BY k), m AS (SELECT doc_id, class_id FROM d JOIN g USING (k)) SELECT documents.doc_id, coalesce(class_id, documents.doc_id) AS class_id FROM documents LEFT JOIN m USING (doc_id)""")
def duplicate_classes(t):
    return D.class_of(t("documents"))
