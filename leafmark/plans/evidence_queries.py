"""Gold labels, evidence in its place, prompts and generations, guards, synthesis, rewards, statistics of paired runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..operators import claims as C, evaluation as V, evidence as E, hierarchy as H, packing as P, prompts, tables
from ..registry import query
from .claim_queries import CANDIDATES, decided
from .node_queries import LEAVES, R, SECTIONS, nodes
from .retrieval_queries import LEAVES as LINES, asked, bm25_list, leaves
from .text_queries import COMMON, EVEN, NUMBER_OF, NUMBER_VALUE, OVER, PAIRS, WS, pairs, put

WHOLE = LEAVES.replace(SECTIONS, f"sec AS (SELECT doc_id, source, 0 AS sp, '' AS section_id, {put(WS, 'text')} AS value FROM documents)")
SPLIT = "list_filter(string_split({c}, ' '), lambda x: x <> '')"


@query("c10_label_gold", f"""WITH {LINES}, q AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS source, unnest([text, array_to_string(({put(SPLIT, put(WS, 'text'))})[1:6], ' ')]) AS quote FROM benchmark), n AS (SELECT query_id, source, {put(WS, 'lower(quote)')} AS q FROM q), p AS (SELECT query_id, doc_id, pos, q, {put(WS, 'lower(lv.text)')} AS t FROM n JOIN lv USING (source) WHERE q <> ''),
m AS (SELECT *, {put(SPLIT, 'q')} AS a, {put(SPLIT, 't')} AS b FROM p) SELECT DISTINCT query_id, doc_id || ':' || pos AS node_id FROM m WHERE contains(t, q) OR (length(a) > 0 AND length(b) > 0 AND round(2.0 * {COMMON} / (length(a) + length(b)), 9) >= 0.5) UNION SELECT item_id, doc_id || ':' || pos FROM benchmark JOIN lv ON doc_id = item_id AND pos = 1""")
def label_gold(t):
    """Items of the benchmark, whole and by their first words, in the lines of one source each; a paragraph each is known."""
    empty = F.array().cast("array<string>")
    records = t("benchmark").select(F.col("item_id").alias("query_id"), F.array(F.concat(F.lit("src"), F.pmod("item_id", F.lit(20)))).alias("sources"), empty.alias("gold_child_ids"), F.array(F.concat(F.col("item_id").cast("string"), F.lit("/1"))).alias("gold_paragraph_ids"), F.array("text", F.array_join(F.slice(T.spaced_tokens("text"), 1, 6), " ")).alias("gold_quotes"))
    rows = leaves(t).select(F.concat_ws(":", "doc_id", "pos").alias("node_id"), "source", "text", F.array(F.concat_ws("/", "doc_id", "pos")).alias("paragraph_ids"))
    return E.label_gold(records, rows)[0]


@query("c21_visible_fragments", f"""WITH l AS (SELECT doc_id, line, i - 1 AS pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)), s AS (SELECT doc_id, line, min(pos) AS pos FROM l WHERE pos % 3 = 0 GROUP BY ALL), x AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM s GROUP BY doc_id),
p AS (SELECT doc_id, 'a' AS id, {put(WS, "coalesce(string_split(text, chr(10))[1], '')")} AS p FROM documents UNION ALL SELECT doc_id, 'b', {put(WS, "coalesce(string_split(text, chr(10))[3], '')")} FROM documents), k AS (SELECT p.doc_id, id FROM p JOIN s USING (doc_id) WHERE contains(p, {put(WS, 'line')}) OR contains({put(WS, 'line')}, p) GROUP BY ALL)
SELECT CAST(x.doc_id AS VARCHAR) AS node_id, text, coalesce((SELECT string_agg(id, ' ' ORDER BY id) FROM k WHERE k.doc_id = x.doc_id), '') AS paragraph_ids FROM x""")
def visible_fragments(t):
    line = F.split("text", "\n")
    item = lambda name, i: F.struct(F.lit(name).alias("paragraph_id"), F.coalesce(F.get(line, i), F.lit("")).alias("text"))
    rows = t("documents").select(F.col("doc_id").cast("string").alias("node_id"), F.array(item("a", 0), item("b", 2)).alias("paragraphs"))
    blocks = t("documents").select(F.col("doc_id").cast("string").alias("node_id"), F.posexplode(line).alias("char_start", "text")).where("char_start % 3 = 0").withColumn("char_end", F.col("char_start") + 1)
    return E.restrict_to_visible(rows, blocks).select("node_id", "text", F.array_join("paragraph_ids", " ").alias("paragraph_ids"))


@query("c22_evidence_span", f"WITH {LINES}, x AS (SELECT doc_id, pos, text, CASE WHEN pos % 7 = 6 THEN 'nowhere ' || pos ELSE substr(text, 5, 10) END AS quote FROM lv) SELECT doc_id, pos, CAST(CASE WHEN quote <> '' AND instr(text, quote) > 0 THEN 100 + instr(text, quote) - 1 END AS INTEGER) AS span_start, CAST(CASE WHEN quote <> '' AND instr(text, quote) > 0 THEN 100 + instr(text, quote) - 1 + length(quote) END AS INTEGER) AS span_end FROM x")
def evidence_span(t):
    rows = leaves(t).select("doc_id", "pos", F.when(F.col("pos") % 7 == 6, F.concat(F.lit("nowhere "), F.col("pos").cast("string"))).otherwise(F.substring("text", 5, 10)).alias("quote"), F.col("text").alias("block_text"), F.lit(100).alias("block_start"), (F.length("text") + 100).alias("block_end"), F.col("text").alias("leaf_text"), F.lit(100).alias("leaf_start"), (F.length("text") + 100).alias("leaf_end"))
    return E.evidence_span(rows, strict=False).select("doc_id", "pos", "span_start", "span_end")


@query("c23_sentence_units", R + WHOLE + " SELECT sw.doc_id, sw.a AS char_start, sw.b AS char_end, min(leaf.position) AS leaf FROM sw JOIN leaf ON leaf.doc_id = sw.doc_id AND sw.a >= leaf.a AND sw.b <= leaf.b GROUP BY ALL")
def sentence_units(t):
    lv = H.leaf_spans(t("documents"), ["doc_id"]).select(F.col("position").cast("string").alias("leaf_id"), F.col("position").alias("leaf_no"), F.col("doc_id").alias("section_id"), F.col("leaf").alias("text"), "char_start")
    return E.sentence_units(lv).select(F.col("section_id").alias("doc_id"), "char_start", "char_end", F.col("leaf_id").cast("int").alias("leaf"))


@query("c25_candidate_children", "WITH f AS (SELECT l_orderkey, l_partkey, min((l_linenumber, l_suppkey)) AS place FROM lineitem GROUP BY l_orderkey, l_partkey) SELECT * FROM (SELECT l_orderkey AS claim_id, l_partkey AS child_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY place, l_partkey) AS INTEGER) AS ordinal FROM f) WHERE ordinal <= 3")
def candidate_children(t):
    cited = t("lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("citation_no"), F.col("l_suppkey").alias("child_no"), F.col("l_partkey").alias("child_id"))
    return C.candidate_children(cited, 3)


@query("b27_context_header", """SELECT l_orderkey, l_linenumber, '[C' || l_linenumber || '] ' || l_returnflag || CASE WHEN l_linestatus = 'O' AND l_partkey % 3 < 2 THEN ', ' || CASE WHEN l_suppkey * 100 >= 3600 THEN (l_suppkey * 100 // 3600) || ':' || lpad(CAST(l_suppkey * 100 % 3600 // 60 AS VARCHAR), 2, '0') ELSE lpad(CAST(l_suppkey * 100 // 60 AS VARCHAR), 2, '0') END || ':' || lpad(CAST(l_suppkey * 100 % 60 AS VARCHAR), 2, '0')
|| '–' || CASE WHEN l_suppkey * 100 + 75 >= 3600 THEN ((l_suppkey * 100 + 75) // 3600) || ':' || lpad(CAST((l_suppkey * 100 + 75) % 3600 // 60 AS VARCHAR), 2, '0') ELSE lpad(CAST((l_suppkey * 100 + 75) // 60 AS VARCHAR), 2, '0') END || ':' || lpad(CAST((l_suppkey * 100 + 75) % 60 AS VARCHAR), 2, '0') || ', ' || CASE l_partkey % 3 WHEN 0 THEN 'lecture speech (automatic transcript)' ELSE 'board/slide text (OCR)' END
WHEN l_tax > 0.06 THEN '' WHEN l_linenumber > 3 THEN ', pages ' || l_linenumber || '-' || (l_linenumber + 1) ELSE ', pages ' || l_linenumber END AS header FROM lineitem""")
def context_header(t):
    n, ms = F.col("l_linenumber"), F.when(F.col("l_linestatus") == "O", F.col("l_suppkey") * 100_000)
    kind = F.when(F.col("l_partkey") % 3 == 0, "speech").when(F.col("l_partkey") % 3 == 1, "board").otherwise("text")
    first = F.when(F.col("l_tax") > 0.06, F.lit(None).cast("int")).otherwise(n)
    return t("lineitem").select("l_orderkey", "l_linenumber", prompts.context_header(F.concat(F.lit("C"), n.cast("string")), F.col("l_returnflag"), first, F.when(n > 3, n + 1).otherwise(n), kind, ms, ms + 75_000).alias("header"))


@query("b27_render_prompts")
def render_prompts(t):
    """Prompts for the benchmark's items with the three best lines of the corpus each."""
    blocks = bm25_list(t, 3).join(leaves(t).select("doc_id", "pos", "text", "source"), ["doc_id", "pos"]).select("query_id", "rank", F.concat(F.lit("C"), F.col("rank").cast("string")).alias("context_id"), F.col("source").alias("alias"), "text", F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"), F.lit("text").alias("modality"), F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"))
    return prompts.render_prompts(asked(t).withColumnRenamed("text", "query"), blocks, 120).select("query_id", F.array_join("context_ids", " ").alias("context_ids"), F.sha2("prompt", 256).alias("prompt_sha256"))


ANSWERS = [
    '{"answerable": true, "reason": "r", "claims": [{"text": "t", "citations": ["C1"], "confidence": 0.5}]}',
    '```json\n{"answerable": true, "claims": [{"text": "t", "citations": ["C1", "C2"], "confidence": "0.25"}]}\n```',
    'Sure: {"answerable": true, "claims": [{"text": "t", "citations": ["C2"], "confidence": 1}]} as asked',
    '{"answerable": true, "claims": "x"}',
    '{"answerable": true, "claims": [5, {"text": "t", "citations": ["C9"], "confidence": "high"}]}',
    '{"answerable": false, "claims": [{"text": "t", "citations": [], "confidence": 1}]}',
    "nothing at all",
    '{"answerable": true, "claims": [{"text": "t", "citations": "C1"}]}',
]
ERRORS = ["", "", "", "claims_not_array answerable_without_claims", "claim_0_not_object claim_1_invalid_citation:C9 claim_1_invalid_confidence", "claim_0_empty_citation refusal_with_claims", "provider_invalid_json", "claim_0_citations_not_array claim_0_empty_citation answerable_claim_without_citation"]


@query("b28_parse_generations", "SELECT conv_id, turn, CASE (conv_id + turn) % 8 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(ERRORS)) + " END AS errors, CAST(CASE WHEN (conv_id + turn) % 8 IN (3, 6) THEN 0 ELSE 1 END AS INTEGER) AS claims, CASE (conv_id + turn) % 8 WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 WHEN 2 THEN 1.0 WHEN 5 THEN 1.0 WHEN 3 THEN NULL WHEN 6 THEN NULL ELSE 0.0 END AS confidence FROM conversations")
def parse_generations(t):
    """Eight kinds of answers, by turn, from clean ones to none."""
    raw = t("conversations").select(F.struct("conv_id", "turn").alias("query_id"), F.element_at(F.array(*map(F.lit, ANSWERS)), ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int")).alias("response"), F.array(F.lit("C1"), F.lit("C2")).alias("context_ids"))
    found = prompts.parse_generations(raw)
    return found.select("query_id.conv_id", "query_id.turn", F.array_join("errors", " ").alias("errors"), F.size("claims").alias("claims"), F.get("claims", F.lit(0))["confidence"].alias("confidence"))


@query("b29_contextualize_leaves", R + LEAVES + " SELECT node_id, sha256('Paper: ' || source || chr(10) || 'Section: Part ' || sp || chr(10) || text) AS embedding_sha256 FROM leaf")
def contextualize_leaves(t):
    n = nodes(t)
    titles = t("documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("title"))
    return prompts.contextualize_leaves(n, "title", titles).where("level = 'child'").select("node_id", F.sha2("embedding_text", 256).alias("embedding_sha256"))


def units(t) -> DataFrame:
    found = bm25_list(t, 24).join(leaves(t).select("doc_id", "pos", "text"), ["doc_id", "pos"])
    return found.select("query_id", F.concat_ws(":", "doc_id", "pos").alias("unit_id"), "score", "text", F.concat_ws(":", "doc_id", "pos").alias("leaf_id"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"))


@query("e05_select_units")
def select_units(t):
    return P.select_units(units(t), asked(t).withColumnRenamed("text", "query"), 600, "coverage", most=6)


@query("e07_blocks_from_units")
def blocks_from_units(t):
    u = units(t).withColumn("text", F.substring("text", 1, 80))
    chosen = P.select_units(u, asked(t).withColumnRenamed("text", "query"), 400, "top")
    return P.blocks_from_units(chosen, u, leaves(t).select(F.concat_ws(":", "doc_id", "pos").alias("leaf_id"), F.col("text").alias("leaf_text")))


@query("e06_dependency_groups")
def dependency_groups(t):
    s = tables.sentence_spans(t("documents"), "doc_id", "text").select(F.col("doc_id").alias("section_id"), F.concat_ws(":", "doc_id", "pos").alias("unit_id"), F.col("char_start").alias("start"), F.col("char_end").alias("end"), F.col("sentence").alias("text"))
    return P.dependency_groups(s, "dependency").select("unit_id", F.array_join("members", " ").alias("members"))


@query("e08_insufficiency", "WITH b AS (SELECT conv_id, turn, role, sum(greatest(1, CAST(ceil(length(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) * 1.25) AS BIGINT)) + 24) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations), g AS (SELECT conv_id, count(DISTINCT role) AS scope, count(DISTINCT CASE WHEN used <= 150 THEN role END) AS shown FROM b GROUP BY conv_id) SELECT conv_id AS query_id, CASE WHEN conv_id % 2 = 0 AND scope < 2 THEN 'comparative_scope_too_narrow' WHEN shown = 0 THEN 'no_context_fits' WHEN conv_id % 2 = 0 AND shown < 2 THEN 'comparative_context_too_narrow' END AS code FROM g")
def insufficiency(t):
    blocks = t("conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text", F.col("role").alias("group_id"))
    queries = blocks.select("query_id").distinct().withColumn("query_type", F.when(F.col("query_id") % 2 == 0, "comparative_multi_hop").otherwise("factoid"))
    return P.insufficiency(blocks, P.fit_serialized(blocks, 150), queries)


@query("f02_verify_visible")
def verify_visible(t):
    """Assistant turns as claims that cite the turn before and the one before that."""
    p = pairs(t).select(F.col("conv_id").alias("query_id"), F.format_string("%d:%d", "conv_id", "turn").alias("claim_id"), F.col("turn").alias("claim_no"), F.col("claim").alias("text"), F.array(F.concat(F.lit("C"), (F.col("turn") - 1).cast("string")), F.concat(F.lit("C"), (F.col("turn") - 2).cast("string"))).alias("citations"), F.lit(0.9).alias("confidence"))
    blocks = t("conversations").select(F.col("conv_id").alias("query_id"), F.concat(F.lit("C"), F.col("turn").cast("string")).alias("context_id"), F.format_string("%d/%d", "conv_id", "turn").alias("node_id"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), "text")
    return C.verify_visible(p, blocks)[1]


@query("f04_post_guards", rf"""WITH {PAIRS}, b AS (SELECT conv_id, turn, 0 AS own, evidence AS text FROM pairs UNION ALL SELECT conv_id, turn, 1, claim FROM pairs), r AS (SELECT conv_id, turn, own, unnest(regexp_extract_all(text, '\d+(?:[.,]\d+)*')) AS r FROM b), v AS (SELECT conv_id, turn, own, {NUMBER_VALUE} AS v FROM r), n AS (SELECT conv_id, turn, own, {NUMBER_OF} AS number FROM v),
m AS (SELECT DISTINCT conv_id, turn FROM (SELECT conv_id, turn, number FROM n WHERE own = 1 EXCEPT SELECT conv_id, turn, number FROM n WHERE own = 0))
SELECT pairs.conv_id, pairs.turn, CASE WHEN m.turn IS NOT NULL THEN 'number_not_in_evidence' WHEN regexp_matches(claim, '{OVER}') AND regexp_matches(evidence, '{EVEN}') AND NOT regexp_matches(evidence, '{OVER}') AND NOT regexp_matches(claim, '{EVEN}') THEN 'non_inferiority_overclaimed' WHEN regexp_matches(claim, '[0-9]|[=+×÷^√∑∫%<>≤≥]') AND pairs.conv_id % 3 = 0 THEN 'extraction_quality_review_required' END AS rejected_reason,
CASE pairs.conv_id % 3 WHEN 0 THEN 'automatic' WHEN 1 THEN 'reviewed' ELSE 'not_applicable' END AS transcription_state FROM pairs LEFT JOIN m ON m.conv_id = pairs.conv_id AND m.turn = pairs.turn""")
def post_guards(t):
    p = pairs(t).withColumn("claim_id", F.struct("conv_id", "turn"))
    item = F.struct(F.array(F.lit("low_confidence")).alias("flags"), (F.col("conv_id") % 3 == 1).alias("reviewed"))
    evidence = p.select("claim_id", F.lit(1).alias("ordinal"), F.col("evidence").alias("quote"), F.when(F.col("conv_id") % 3 < 2, F.array(item)).alias("items"))
    return C.post_guards(p.select("claim_id", F.col("claim").alias("text")), evidence).select("claim_id.conv_id", "claim_id.turn", "rejected_reason", "transcription_state")


@query("f07_outcome_metrics", f"WITH {CANDIDATES}, c AS (SELECT split_part(claim_id, ':', 1) AS run_id, count(*) AS generated, count(*) FILTER (status = 'accepted') AS accepted, round(1 - avg(best), 6) AS risk_before, round(1 - avg(best) FILTER (status = 'accepted'), 6) AS risk_after FROM oc GROUP BY ALL) SELECT *, round(accepted / generated, 6) AS acceptance FROM c")
def outcome_metrics(t):
    trace, outcomes = decided(t)
    run = F.split_part("claim_id", F.lit(":"), F.lit(1)).alias("run_id")
    claims = outcomes.select(run, "claim_id", "status", "best_support")
    evidence = trace.where("selected").select(run, "claim_id", F.col("retrieved").cast("string").alias("origin"))
    blocks = t("conversations").select(F.col("conv_id").cast("string").alias("run_id"), T.token_estimate("text").alias("tokens"))
    found = C.outcome_metrics(claims, evidence, blocks)
    return found.select("run_id", "generated", "accepted", *[F.round(c, 6).alias(c) for c in ("risk_before", "risk_after", "acceptance")])


@query("f09_consensus_rows", "WITH e AS (SELECT l_orderkey, l_returnflag = 'R' AS against, CAST(l_partkey AS VARCHAR) AS c FROM lineitem), g AS (SELECT l_orderkey, count(*) AS n, coalesce(string_agg(CASE WHEN NOT against THEN c END, ' ' ORDER BY c), '') AS supporting, coalesce(string_agg(CASE WHEN against THEN c END, ' ' ORDER BY c), '') AS contradicting FROM e GROUP BY ALL) SELECT o_orderkey AS claim_id, CASE o_orderstatus WHEN 'F' THEN 'contested' ELSE 'supported' END AS status, coalesce(supporting, '') AS supporting, coalesce(contradicting, '') AS contradicting FROM orders LEFT JOIN g ON l_orderkey = o_orderkey WHERE n > 1 OR o_orderstatus = 'F'")
def consensus_rows(t):
    claims = t("orders").select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderstatus") == "F", "contested").otherwise("supported").alias("status"))
    evidence = t("lineitem").select(F.col("l_orderkey").alias("claim_id"), F.when(F.col("l_returnflag") == "R", "contradicting").otherwise("primary").alias("role"), F.col("l_partkey").cast("string").alias("citation"))
    return C.consensus_rows(claims, evidence).select("claim_id", "status", F.array_join("supporting", " ").alias("supporting"), F.array_join("contradicting", " ").alias("contradicting"))


def outline(t):
    c = t("conversations")
    items = c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("item_no"), F.col("role").alias("title"), (F.col("turn") % 11 == 10).alias("failed"))
    two = c.where("turn % 2 = 0").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("item_no"), F.explode(F.array(F.lit(2), F.lit(1))).alias("claim_no"))
    claims = two.withColumn("claim_id", F.concat_ws("-", "item_no", "claim_no")).withColumn("text", F.concat(F.lit("claim "), F.col("claim_no").cast("string")))
    contexts = two.select("run_id", "item_no", F.col("claim_no").alias("context_no"))
    return C.synthesis_sections(items, claims, contexts)


@query("f10_synthesis_sections", "SELECT conv_id AS run_id, turn AS item_no, CASE WHEN turn % 11 = 10 THEN 'failed' WHEN turn % 2 = 0 THEN 'complete' ELSE 'insufficient' END AS status, CASE WHEN turn % 11 <> 10 AND turn % 2 = 0 THEN 'claim 1 {{' || turn || '-1}} claim 2 {{' || turn || '-2}}' END AS template_text FROM conversations")
def synthesis_sections(t):
    return outline(t)[0].select("run_id", "item_no", "status", "template_text")


@query("f10_synthesis_contexts", "SELECT conv_id AS run_id, turn AS item_no, CAST(k AS INTEGER) AS context_no, 'C' || row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) AS context_id FROM conversations, (VALUES (1), (2)) v(k) WHERE turn % 2 = 0")
def synthesis_contexts(t):
    return outline(t)[1]


def branches(t) -> tuple[DataFrame, DataFrame]:
    """Line items of an order as a branch's evidence, by their numbers; parts of one kind are gold."""
    li = t("lineitem").select(F.col("l_orderkey").alias("query_id"), F.element_at(F.array(F.lit("keep"), F.lit("parent"), F.lit("section")), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("branch"), (F.col("l_partkey") % 7).cast("string").alias("id"), "l_tax", "l_quantity")
    b = li.groupBy("query_id", "branch").agg(F.collect_set("id").alias("verified_ids"), F.avg("l_tax").alias("answer_f1"), (F.sum("l_quantity") * 20).alias("tokens")).select("query_id", F.lit("g").alias("group_id"), "branch", "verified_ids", F.array(F.lit("0"), F.lit("1"), F.lit("2")).alias("retrieved_ids"), "answer_f1", F.lit(0.1).alias("ambiguous_rate"), "tokens", F.lit(100.0).alias("latency_ms"))
    gold = t("orders").select(F.col("o_orderkey").alias("query_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("annotator")).withColumn("gold_ids", F.when(F.col("annotator") == 1, F.array(F.lit("1"), F.lit("3"))).otherwise(F.array(F.lit("4"), F.lit("5"), F.lit("6"))))
    return b, gold


@query("f11_rollout_rewards", """WITH b AS (SELECT l_orderkey AS q, CASE l_linenumber % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'parent' ELSE 'section' END AS branch, list_distinct(list(CAST(l_partkey % 7 AS VARCHAR))) AS v, avg(l_tax) AS f1, sum(l_quantity) * 20 AS tokens FROM lineitem GROUP BY ALL), g AS (SELECT * FROM (VALUES (1, ['1', '3']), (2, ['4', '5', '6'])) x(an, g)),
s AS (SELECT b.*, an, g, length(list_intersect(v, g)) / length(v) AS p, length(list_intersect(v, g)) / length(g) AS r, list_filter(v, lambda x: NOT list_contains(['0', '1', '2'], x)) AS moved FROM b, g), f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS h FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY q, branch ORDER BY round(h, 9) DESC, an) AS z FROM f)
SELECT q AS query_id, branch, round(p, 6) AS "precision", round(r, 6) AS recall, round(0.5 * f1 + 0.5 * r + 0.7 * p + 0.5 * length(list_intersect(moved, g)) / length(g) - length(list_filter(moved, lambda x: NOT list_contains(g, x))) / length(v) - 0.03 - 0.3 * least(1.0, tokens / 7000.0) - 0.001, 6) AS reward FROM k WHERE z = 1""")
def rollout_rewards(t):
    return C.rollout_rewards(*branches(t)).select("query_id", "branch", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "reward")])


@query("f12_constrained_labels")
def constrained_labels(t):
    return C.rollout_labels(C.rollout_rewards(*branches(t)))


@query("f13_stage_diagnostics", f"WITH {LINES}, g AS (SELECT doc_id % 50 AS q, doc_id || ':' || pos AS n, pos FROM lv), k AS (SELECT q, count(*) FILTER (pos % 3 = 0) AS gold, count(*) FILTER (pos % 6 = 0) AS pool, count(*) FILTER (pos % 12 = 0) AS packed FROM g GROUP BY q) SELECT q AS query_id, round(pool / gold, 6) AS pool, round(packed / gold, 6) AS packed FROM k WHERE gold > 0")
def stage_diagnostics(t):
    n = leaves(t).select(F.pmod("doc_id", F.lit(50)).alias("query_id"), F.concat_ws(":", "doc_id", "pos").alias("node_id"), "pos")
    found = E.stage_diagnostics(n.where("pos % 3 = 0"), {"pool": n.where("pos % 2 = 0"), "packed": n.where("pos % 4 = 0")})
    return found.select("query_id", F.round("pool", 6).alias("pool"), F.round("packed", 6).alias("packed"))


@query("f13_paragraph_coverage")
def paragraph_coverage(t):
    """First and third lines as two annotators' paragraphs, sentences of the first as context."""
    line = F.split("text", "\n")
    refs = t("documents").select(F.col("doc_id").alias("query_id"), F.posexplode(F.array(F.get(line, 0), F.coalesce(F.get(line, 2), F.lit("")))).alias("annotator", "text")).withColumn("paragraph_no", F.lit(0)).where("text <> ''")
    shown = t("documents").select(F.col("doc_id").alias("query_id"), F.explode(F.slice(T.sentences(F.get(line, 0)), 1, 2)).alias("text"))
    return E.paragraph_coverage(refs, shown)


def diffs(t) -> DataFrame:
    """Prices of two halves of an order as two systems' scores; nations of customers are the clusters."""
    o = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 12).alias("cluster")), "o_custkey")
    return o.select("cluster", F.col("o_orderkey").alias("row_key"), (F.pmod("o_orderkey", F.lit(7)) - F.pmod("o_custkey", F.lit(7))).cast("double").alias("diff"))


FLIPS = "WITH d AS (SELECT c_nationkey % 12 AS cluster, CAST(o_orderkey % 7 - o_custkey % 7 AS DOUBLE) + {null} AS diff FROM orders JOIN customer ON c_custkey = o_custkey), s AS (SELECT row_number() OVER (ORDER BY cluster) - 1 AS bit, sum(diff) AS v, count(*) AS n FROM d GROUP BY cluster), t AS (SELECT sum(n) AS n, sum(v) / sum(n) AS o, count(*) AS m FROM s), x AS (SELECT p, sum(CASE WHEN (p >> bit) & 1 = 1 THEN -v ELSE v END) / max(t.n) AS x FROM s, t, (SELECT unnest(range(4096)) AS p) WHERE p < (1 << m) GROUP BY p)"


@query("g09_cluster_sums", FLIPS.replace("{null}", "0") + " SELECT count(*) FILTER (abs(x) >= abs(o) - 1e-12) / count(*) AS p_value FROM x, t")
def cluster_sums(t):
    return V.cluster_sign_flip(diffs(t))


def flipped(rows: str, iterations: int) -> str:
    """Sums of ``key, v`` of ``rows`` under hashed signs in SQL: products modulo 2**64 in 128 bits."""
    mod = "18446744073709551616::HUGEINT"
    fold = lambda z, by: f"(xor({z}, {z} >> {by}) * {V.MIX}::HUGEINT) % {mod}"
    return f"""r AS ({rows}), z0 AS (SELECT i, v, (((key::HUGEINT * {V.KEY_STEP}::HUGEINT) % {mod} + (i::HUGEINT * {V.ROUND_STEP}::HUGEINT) % {mod} + 42) % {mod} + {mod}) % {mod} AS z FROM r, (SELECT unnest(generate_series(1, {iterations})) AS i)),
z1 AS (SELECT i, v, {fold("z", 30)} AS z FROM z0), z2 AS (SELECT i, v, {fold("z", 27)} AS z FROM z1), x AS (SELECT i, sum(CASE WHEN z >= 9223372036854775808::HUGEINT THEN -v ELSE v END) / (SELECT sum(n) FROM r) AS x FROM z2 GROUP BY i), o AS (SELECT sum(v) / sum(n) AS o FROM r)
SELECT (count(*) FILTER (abs(x) >= abs(o) - 1e-12) + 1) / (count(*) + 1) AS p_value FROM x, o"""


@query("g09_sampled_sign_flip", "WITH " + flipped("SELECT conv_id AS key, sum(length(text) % 7 - 3)::DOUBLE AS v, count(*) AS n FROM conversations GROUP BY conv_id", 20_000))
def sampled_sign_flip(t):
    """Every conversation a cluster."""
    rows = t("conversations").select(F.col("conv_id").alias("cluster"), (F.length("text") % 7 - 3).cast("double").alias("diff"))
    return V.cluster_sign_flip(rows)


@query("g09_paired_permutation", "WITH " + flipped("SELECT conv_id * 1000 + turn AS key, (length(text) % 7 - 3)::DOUBLE AS v, 1 AS n FROM conversations", 10_000))
def paired_permutation(t):
    """Every turn a row of its own."""
    return V.paired_permutation(t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_key"), (F.length("text") % 7 - 3).cast("double").alias("diff")))


@query("g10_non_inferiority", FLIPS.replace("{null}", "0.1") + " SELECT 0.1 AS margin, count(*) FILTER (x >= o - 1e-12) / count(*) AS p_value, count(*) FILTER (x >= o - 1e-12) / count(*) < 0.05 AS non_inferior FROM x, t")
def non_inferiority(t):
    return V.non_inferiority(diffs(t), 0.1).select("margin", "p_value", "non_inferior")


@query("g08_cluster_bootstrap")
def cluster_bootstrap(t):
    return V.cluster_bootstrap(diffs(t))


@query("g03_provenance_accuracy", "WITH m AS (SELECT c.l_orderkey AS q, c.l_linenumber AS c, bool_or(g.l_suppkey % 10 BETWEEN c.l_partkey % 10 AND c.l_partkey % 10 + 2) AS ok FROM lineitem c LEFT JOIN lineitem g ON g.l_orderkey = c.l_orderkey AND g.l_returnflag = c.l_returnflag AND g.l_linenumber = 1 GROUP BY ALL) SELECT q AS query_id, round(avg(CAST(coalesce(ok, false) AS INT)), 6) AS provenance FROM m GROUP BY q")
def provenance_accuracy(t):
    li = t("lineitem")
    citations = li.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("citation_id"), F.col("l_returnflag").alias("source"), (F.col("l_partkey") % 10).alias("page_start"), (F.col("l_partkey") % 10 + 2).alias("page_end"))
    gold = li.where("l_linenumber = 1").select(F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("source"), (F.col("l_suppkey") % 10).alias("page"))
    return V.provenance_accuracy(citations, gold).withColumn("provenance", F.round("provenance", 6))


@query("g03_evidence_density", "SELECT l_orderkey AS query_id, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) / greatest(1, sum(l_quantity)), 6) AS density FROM lineitem GROUP BY ALL")
def evidence_density(t):
    li = t("lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_quantity").alias("tokens"), "l_returnflag")
    return V.evidence_density(li.where("l_returnflag = 'R'"), li).withColumn("density", F.round("density", 6))


@query("g12_benchmark_rows", "WITH r AS (SELECT o_orderkey, o_totalprice % 1 AS f1, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE 0.5 END AS recall, list_sort(list_distinct(list(l_partkey % 5))) AS cited FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) SELECT o_orderkey AS query_id, f1 >= 0.35 AND recall > 0 AS correct, array_to_string(list_filter(cited, lambda x: x < 2), ' ') AS kept, array_to_string(list_filter(cited, lambda x: x = 3), ' ') AS rescued, array_to_string(list_filter(cited, lambda x: x IN (2, 4)), ' ') AS drift, round(length(list_filter(cited, lambda x: x IN (1, 3))) / length(cited), 6) AS citation_precision FROM r")
def benchmark_rows(t):
    o = t("orders")
    answers = o.select(F.col("o_orderkey").alias("query_id"), F.lit("s").alias("system"), F.lit(0.0).alias("em"), (F.col("o_totalprice") % 1).alias("f1"))
    retrieval = o.select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_orderkey") % 3 == 0, 0.0).otherwise(0.5).alias("recall"))
    citations = t("lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.collect_set(F.col("l_partkey") % 5).alias("cited")).withColumn("retrieved", F.expr("array(0L, 1L)")).withColumn("gold", F.expr("array(1L, 3L)"))
    found = V.benchmark_rows(answers, retrieval, citations).where("cited is not null")
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return found.select("query_id", "correct", listed("kept_ids").alias("kept"), listed("rescued_ids").alias("rescued"), listed("drift_ids").alias("drift"), F.round("citation_precision", 6).alias("citation_precision"))


@query("g13_clustered_auc")
def clustered_auc(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("cluster"), (F.col("l_quantity") / 50).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return V.clustered_auc(rows, "cluster", "p", "y", iterations=100)


@query("g14_loss_curve", "WITH l AS (SELECT l_suppkey AS u, g, avg(CAST(l_quantity > g AS INT)) AS loss FROM lineitem, (SELECT unnest([10, 20, 30, 40]) AS g) GROUP BY ALL), m AS (SELECT g, avg(loss) AS mean FROM l GROUP BY g) SELECT CAST(g AS INTEGER) AS threshold, round(mean, 6) AS mean, coalesce(mean <= lag(mean) OVER (ORDER BY g) + 1e-12, TRUE) AS monotone FROM m")
def loss_curve(t):
    grid = F.explode(F.array(*map(F.lit, (10, 20, 30, 40))))
    losses = t("lineitem").select(F.col("l_suppkey").alias("unit"), "l_quantity", grid.alias("lambda")).groupBy("unit", "lambda").agg(F.avg((F.col("l_quantity") > F.col("lambda")).cast("double")).alias("loss"))
    return V.risk_curve_checks(losses).select(F.col("lambda").alias("threshold"), F.round("mean", 6).alias("mean"), "monotone")


@query("g17_merge_policy")
def merge_policy(t):
    """Rewards' gaps learned from tax, discount and quantity; suppliers are the papers."""
    rows = t("lineitem").select(F.col("l_suppkey").alias("paper"), (F.col("l_tax") * 10).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_quantity") / 50).alias("c"), (F.col("l_quantity") / 50 - 0.5 + F.col("l_tax")).alias("gap")).withColumn("label", (F.col("gap") > 0).cast("int"))
    return V.train_merge_policy(rows, ["a", "b", "c"])[1].select("rows", F.round("auc", 3).alias("auc"), "accepted")
