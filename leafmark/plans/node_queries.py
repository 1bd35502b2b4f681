"""The whole passage tree over documents of two sections each: nodes, edges, walks, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


from ..operators import hierarchy as H, tree
from ..registry import query
from ..sources import files
from .text_queries import SENTENCES, WS, put

WORDS = r"length(regexp_extract_all({c}, '[\p{L}\p{N}_]+'))"
SECTIONS = f"""sec AS (SELECT doc_id, source, sp, substr(sha1(doc_id || '|section|' || sp || '|Part ' || sp), 1, 20) AS section_id, {put(WS, 't')} AS value FROM (SELECT doc_id, source, sp, CASE sp WHEN 0 THEN array_to_string(l[1:(length(l) + 1) // 2], chr(10)) ELSE array_to_string(l[(length(l) + 1) // 2 + 1:], chr(10)) END AS t FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents), (VALUES (0), (1)) v(sp)))"""
_S = SENTENCES.replace("text", "value")
LEAVES = f"""{SECTIONS}, ss AS (SELECT doc_id, sp, unnest({_S}) AS s, generate_subscripts({_S}, 1) AS pos FROM sec), sw AS (SELECT *, {put(WORDS, 's')} AS w, CAST(sum(length(s) + 1) OVER z - length(s) - 1 AS INTEGER) AS a, CAST(sum(length(s) + 1) OVER z - 1 AS INTEGER) AS b, count(*) OVER (PARTITION BY doc_id, sp) AS n FROM ss WINDOW z AS (PARTITION BY doc_id, sp ORDER BY pos)),
rec AS (SELECT doc_id, sp, pos AS i, pos AS f, w AS total, w, n, CAST(NULL AS BIGINT) AS cf, CAST(NULL AS BIGINT) AS cl FROM sw WHERE pos = 1
UNION ALL SELECT r.doc_id, r.sp, x.pos, CASE WHEN ceil((r.total + x.w) * 1.25) > 220 THEN r.i ELSE r.f END, CASE WHEN ceil((r.total + x.w) * 1.25) > 220 THEN r.w + x.w ELSE r.total + x.w END, x.w, r.n, CASE WHEN ceil((r.total + x.w) * 1.25) > 220 THEN r.f END, CASE WHEN ceil((r.total + x.w) * 1.25) > 220 THEN r.i END FROM rec r JOIN sw x ON x.doc_id = r.doc_id AND x.sp = r.sp AND x.pos = r.i + 1),
cut AS (SELECT doc_id, sp, cf AS f, cl AS l FROM rec WHERE cf IS NOT NULL UNION ALL SELECT doc_id, sp, f, i FROM rec WHERE i = n),
lv AS (SELECT cut.doc_id, cut.sp, CAST(row_number() OVER (PARTITION BY cut.doc_id, cut.sp ORDER BY f, l) - 1 AS INTEGER) AS position, x.a, y.b FROM cut JOIN sw x ON x.doc_id = cut.doc_id AND x.sp = cut.sp AND x.pos = f JOIN sw y ON y.doc_id = cut.doc_id AND y.sp = cut.sp AND y.pos = l),
lt AS (SELECT lv.*, section_id, source, substr(value, a + 1, b - a) AS text, CAST(greatest(0, ceil((count(*) OVER (PARTITION BY lv.doc_id, lv.sp) - 4) / 3)) AS INTEGER) AS top FROM lv JOIN sec USING (doc_id, sp)),
leaf AS (SELECT *, substr(sha1(section_id || '|child|' || position || '|' || substr(text, 1, 96)), 1, 20) AS node_id, substr(sha1(section_id || '|parent|' || least(top, position // 3)), 1, 20) AS parent_id FROM lt),
grp AS (SELECT DISTINCT doc_id, sp, section_id, top FROM leaf), gp AS (SELECT doc_id, sp, section_id, unnest(generate_series(0, top)) AS g FROM grp), mem AS (SELECT gp.*, substr(sha1(gp.section_id || '|parent|' || g), 1, 20) AS parent, leaf.node_id AS child, leaf.position, leaf.a, leaf.b, leaf.text FROM gp JOIN leaf ON leaf.doc_id = gp.doc_id AND leaf.sp = gp.sp AND leaf.position BETWEEN g * 3 AND g * 3 + 3),
par AS (SELECT doc_id, sp, section_id, CAST(g AS INTEGER) AS g, parent, min(a) AS a, max(b) AS b, {put(WS, "string_agg(text, ' ' ORDER BY position)")} AS text FROM mem GROUP BY ALL)"""
TOKENS_OF = f"CAST(greatest(1, ceil({WORDS} * 1.25)) AS INTEGER)"
R = "WITH RECURSIVE "


def sections(t) -> DataFrame:
    """The first and the second half of each document's lines as sections."""
    lines = t("documents").select(F.col("doc_id").cast("string").alias("document_id"), "source", F.split("text", "\n").alias("l")).withColumn("half", F.expr("(size(l) + 1) div 2"))
    part = F.posexplode(F.array(F.slice("l", F.lit(1), F.col("half").cast("int")), F.slice("l", (F.col("half") + 1).cast("int"), (F.size("l") - F.col("half")).cast("int"))))
    return lines.select("document_id", "source", part.alias("section_pos", "part")).select("document_id", "source", "section_pos", F.concat(F.lit("Part "), F.col("section_pos").cast("string")).alias("title"), F.array_join("part", "\n").alias("text"))


def nodes(t) -> DataFrame:
    return tree.build_hierarchy(sections(t))


def kept_nodes(t) -> DataFrame:
    """The nodes without their texts, made once and written down: walks and checks read them several times."""
    return files.Kept().keep(nodes(t).select("document_id", "node_id", "level", "section_id", "parent_id", "position", "token_count", "char_start", "char_end", "page_start", "page_end", "child_ids"), "nodes")


@query("c01_hierarchy_nodes", R + LEAVES + f""" SELECT node_id, 'child' AS level, parent_id, position, {put(TOKENS_OF, 'text')} AS token_count, a AS char_start, b AS char_end FROM leaf
UNION ALL SELECT parent, 'parent', section_id, g, {put(TOKENS_OF, 'text')}, a, b FROM par UNION ALL SELECT section_id, 'section', CAST(doc_id AS VARCHAR), CAST(sp AS INTEGER), {put(TOKENS_OF, 'value')}, 0, CAST(length(value) AS INTEGER) FROM sec
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'document', NULL, 0, {put(TOKENS_OF, 'text')}, 0, CAST(length(text) AS INTEGER) FROM (SELECT doc_id, {put(WS, "string_agg(value, chr(10) || chr(10) ORDER BY sp)")} AS text FROM sec GROUP BY doc_id)""")
def hierarchy_nodes(t):
    return nodes(t).select("node_id", "level", "parent_id", "position", "token_count", "char_start", "char_end")


@query("a20_write_tree", R + LEAVES + " SELECT parent AS parent_id, child AS child_id, CAST(position - g * 3 AS INTEGER) AS ordinal FROM mem UNION ALL SELECT section_id, parent, g FROM par UNION ALL SELECT CAST(doc_id AS VARCHAR), section_id, CAST(sp AS INTEGER) FROM sec")
def write_tree(t):
    """The tree written as a revision; the edges read back."""
    spark = t("documents").sparkSession
    path = tree.write_tree(nodes(t), files.scratch(spark, "tree"), "r1")
    return spark.read.parquet(f"{path}/edges").select("parent_id", "child_id", "ordinal")


@query("c07_validate_hierarchy", R + LEAVES + """, k AS (SELECT *, doc_id % 13 = 0 AND position = 0 AS gone FROM leaf) SELECT violation, count(*) AS n FROM (SELECT 'unknown section' AS violation FROM k WHERE doc_id % 11 = 0 AND NOT gone UNION ALL SELECT 'characters out of the parent' FROM k WHERE doc_id % 7 = 0 AND NOT gone UNION ALL SELECT 'missing leaf' FROM mem WHERE doc_id % 13 = 0 AND position = 0) GROUP BY violation""")
def validate_hierarchy(t):
    """A tree with leaves moved, without their sections, and missing."""
    n = kept_nodes(t)
    i, leaf = F.col("document_id").cast("long"), F.col("level") == "child"
    damaged = n.withColumn("char_end", F.when(leaf & (i % 7 == 0), F.col("char_end") + 10**6).otherwise(F.col("char_end"))).withColumn("section_id", F.when(leaf & (i % 11 == 0), F.lit("none")).otherwise(F.col("section_id")))
    damaged = damaged.where(~(leaf & (i % 13 == 0) & (F.col("position") == 0)))
    return tree.validate_hierarchy(damaged, tree.edges(damaged)).groupBy("violation").agg(F.count("*").alias("n"))


@query("c08_tree_descendants", R + LEAVES + " SELECT section_id AS ancestor_id, CAST(1 AS INTEGER) AS hops, count(*) AS n FROM par GROUP BY ALL UNION ALL SELECT section_id, 2, count(*) FROM leaf GROUP BY ALL UNION ALL SELECT parent_id, 1, count(*) FROM leaf GROUP BY ALL UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, count(*) FROM sec GROUP BY doc_id UNION ALL SELECT CAST(doc_id AS VARCHAR), 2, count(*) FROM par GROUP BY doc_id UNION ALL SELECT CAST(doc_id AS VARCHAR), 3, count(*) FROM leaf GROUP BY doc_id")
def tree_descendants(t):
    return tree.descendants(nodes(t)).groupBy("ancestor_id", "hops").agg(F.count("*").alias("n"))


@query("c08_members_at_level", R + LEAVES + " SELECT section_id AS candidate_id, node_id AS member_id FROM leaf UNION ALL SELECT parent, child FROM mem")
def members_at_level(t):
    n = kept_nodes(t)
    return tree.members_at_level(n, "section", "child").unionByName(tree.members_at_level(n, "parent", "child"))


def selection(t) -> tuple[DataFrame, DataFrame]:
    """Every second leaf and every third parent, scored by their lengths, as the selection of one question a language."""
    n = kept_nodes(t)
    picked = n.where("(level = 'child' and position % 2 = 0) or (level = 'parent' and position % 3 = 0)")
    return picked.select(F.lit(1).alias("query_id"), "node_id", (F.col("token_count") / 1000.0).alias("score")), n


@query("c09_effective_members", R + LEAVES + """, m AS (SELECT section_id, TRUE AS direct, g AS o, parent AS node_id FROM par WHERE g % 3 = 0 UNION ALL SELECT section_id, FALSE, NULL, node_id FROM leaf WHERE position % 2 = 0) SELECT section_id AS candidate_id, count(*) FILTER (direct) AS slots_taken, count(*) FILTER (NOT direct) AS stand_ins FROM m GROUP BY section_id""")
def effective_members(t):
    chosen, n = selection(t)
    members = tree.effective_members(chosen, n, "section").join(n.select("node_id", "level"), "node_id")
    return members.groupBy("candidate_id").agg(F.count_if(F.col("level") == "parent").alias("slots_taken"), F.count_if(F.col("level") == "child").alias("stand_ins"))


@query("c09_tree_ancestors", R + LEAVES + " SELECT CAST(doc_id AS VARCHAR) AS ancestor_id, count(*) AS selected, round(sum(score), 6) AS score FROM (SELECT doc_id, " + put(TOKENS_OF, "text") + " / 1000.0 AS score FROM leaf WHERE position % 2 = 0 UNION ALL SELECT doc_id, " + put(TOKENS_OF, "text") + " / 1000.0 FROM par WHERE g % 3 = 0) GROUP BY doc_id")
def tree_ancestors(t):
    chosen, n = selection(t)
    return tree.group_by_ancestor(chosen, n, "document").groupBy("ancestor_id").agg(F.count("*").alias("selected"), F.round(F.sum("score"), 6).alias("score"))


@query("a11_layout_sections", rf"""WITH i AS (SELECT doc_id, i, trim(regexp_replace(line, '[ \t]+', ' ', 'g')) AS x, line, CASE WHEN i % 6 = 3 THEN 1 ELSE 0 END AS head, (i - 1) // 4 + 1 AS page, (i % 10) / 10.0 AS conf FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
c AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS cut FROM i), g AS (SELECT doc_id, cut, max(CASE WHEN head = 1 THEN CASE WHEN {put(WS, 'line')} = '' THEN 'Untitled Section' ELSE regexp_replace(line, '^\s+|\s+$', '', 'g') END END) AS title, min(page) FILTER (head = 0 AND line <> '') AS page_start, max(page) FILTER (head = 0 AND line <> '') AS page_end, avg(conf) FILTER (head = 0 AND line <> '') AS conf, count(*) FILTER (head = 0 AND line <> '') AS items, string_agg(CASE WHEN head = 0 AND line <> '' THEN line END, '') AS body FROM c GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY title IS NOT NULL AND title <> 'Document', cut) - 1 AS INTEGER) AS section_pos, coalesce(title, 'Document') AS title, CAST(page_start AS INTEGER) AS page_start, CAST(page_end AS INTEGER) AS page_end, round(conf, 4) AS confidence, CAST(items AS INTEGER) AS items FROM g WHERE items > 0 AND {put(WS, 'body')} <> ''""")
def layout_sections(t):
    """Lines as layout items, every sixth a header, four to a page."""
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    i = F.col("ordinal") + 1
    items = lines.select("doc_id", "ordinal", F.when(i % 6 == 3, "section_header").otherwise("text").alias("label"), "text", (F.floor(F.col("ordinal") / 4) + 1).cast("int").alias("page"), ((i % 10) / 10.0).alias("confidence"))
    return H.layout_sections(items).select("doc_id", "section_pos", "title", "page_start", "page_end", "confidence", "items")


@query("a10_section_types", r"""WITH n AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '1. Introduction' WHEN 1 THEN '2.3 Related Work and ' || lang WHEN 2 THEN 'Our METHODS' WHEN 3 THEN lang WHEN 4 THEN '10 Results and discussion' ELSE 'Abstract' END AS title, CASE doc_id % 6 WHEN 0 THEN 'introduction' WHEN 1 THEN 'related_work' WHEN 2 THEN 'method' WHEN 3 THEN 'document' WHEN 4 THEN 'results' ELSE 'abstract' END AS section_type FROM documents) SELECT doc_id, title, section_type FROM n""")
def section_types(t):
    i, lang = F.col("doc_id") % 6, F.col("lang")
    title = F.when(i == 0, "1. Introduction").when(i == 1, F.concat(F.lit("2.3 Related Work and "), lang)).when(i == 2, "Our METHODS").when(i == 3, lang).when(i == 4, "10 Results and discussion").otherwise("Abstract")
    marked = t("documents").select("doc_id", F.concat(F.lit("## "), title, F.lit("\nbody")).alias("text"))
    return H.markdown_sections(marked).select("doc_id", "title", "section_type")
