"""Claims of conversations verified against the turn before; context packing by prefix budgets."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as T
from ..operators import claims as C, packing as P, retrieval as R, tables
from ..registry import query
from .retrieval_queries import asked, bm25_list, bm25_sql, leaves
from .text_queries import CANONICAL, COMMON, FIGURES, NEGATED, PAIRS, SENTENCES, WS, put

CONFLICT = f"((list_has_any(string_split({put(WS, 'lower(claim)')}, ' '), {NEGATED}) <> list_has_any(string_split({put(WS, 'lower(s)')}, ' '), {NEGATED})) OR (length({put(FIGURES, 'claim')}) > 0 AND length({put(FIGURES, 's')}) > 0 AND NOT list_has_any({put(FIGURES, 'claim')}, {put(FIGURES, 's')})))"
CANDIDATES = f"""{PAIRS}, u AS (SELECT conv_id || ':' || turn AS claim_id, claim, unnest({SENTENCES.replace('text', 'evidence')}) AS s, generate_subscripts({SENTENCES.replace('text', 'evidence')}, 1) AS ordinal FROM pairs),
v AS (SELECT *, {put(CANONICAL, 'claim')} AS a, {put(CANONICAL, 's')} AS b, {CONFLICT} AS conflict FROM u WHERE ordinal <= 10),
w AS (SELECT claim_id, ordinal, conflict, CASE WHEN length(b) = 0 THEN 0 ELSE length(list_intersect(list_distinct(b), a)) / length(list_distinct(b)) END AS overlap, CASE WHEN length(a) = 0 THEN 0 ELSE {COMMON} / length(a) END AS coverage FROM v),
cand AS (SELECT claim_id, ordinal, claim_id || ':' || (ordinal - 1) AS child_id, round(CASE WHEN overlap < 0.25 AND coverage >= 0.8 AND NOT conflict THEN greatest(overlap, coverage) ELSE overlap END, 9) AS score, (ordinal - 1) % 2 = 0 AS retrieved FROM w),
cl AS (SELECT conv_id || ':' || turn AS claim_id, CASE WHEN turn % 4 = 3 THEN 0 ELSE 1 END AS valid_citations, 0.5 + (conv_id % 10) / 20.0 AS confidence FROM pairs),
live AS (SELECT cand.*, score >= 0.25 AS base, score >= 0.25 AND score >= CASE WHEN retrieved THEN 0.25 ELSE 0.35 END AS guard FROM cand JOIN cl USING (claim_id) WHERE valid_citations > 0 AND confidence >= 0.55),
rk AS (SELECT *, row_number() OVER p AS place, lead(score) OVER p AS ns, lead(guard) OVER p AS ng FROM live WINDOW p AS (PARTITION BY claim_id ORDER BY guard DESC, round(score, 9) DESC, ordinal)),
tr AS (SELECT *, guard AND place <= 1 AS selected FROM rk),
oc AS (SELECT cl.claim_id, CASE WHEN max(valid_citations) = 0 THEN 'invalid_or_missing_context_citation' WHEN max(confidence) < 0.55 THEN 'below_claim_confidence_threshold' WHEN count(tr.ordinal) = 0 THEN 'no_reachable_child' WHEN NOT bool_or(base) THEN 'below_support_threshold' WHEN NOT bool_or(guard) THEN 'sibling_guard_rejected_all' ELSE 'accepted' END AS status,
coalesce(max(score), 0) AS best, coalesce(bool_or(place = 1 AND guard AND coalesce(ng, false) AND round(score - ns, 9) < 0.05), false) AS ambiguous FROM cl LEFT JOIN tr USING (claim_id) GROUP BY cl.claim_id)"""


def claim_rows(t):
    return tables.claim_pairs(t("conversations")).select(F.concat_ws(":", "conv_id", "turn").alias("claim_id"), F.when(F.col("turn") % 4 == 3, 0).otherwise(1).alias("valid_citations"), (0.5 + (F.col("conv_id") % 10) / 20.0).alias("confidence"))


def decided(t):
    return C.decide(C.conversation_candidates(tables.claim_pairs(t("conversations"))), claim_rows(t))


@query("f01_verify_claims", f"WITH {CANDIDATES} SELECT claim_id, status, round(best, 6) AS best_support, ambiguous FROM oc")
def verify_claims(t):
    return decided(t)[1].withColumn("best_support", F.round("best_support", 6))


@query("f01_verification_trace", f"WITH {CANDIDATES} SELECT claim_id, child_id, round(score, 6) AS score, base AS passed_base, guard AS passed_guard, selected FROM tr")
def verification_trace(t):
    return decided(t)[0].select("claim_id", "child_id", F.round("score", 6).alias("score"), "passed_base", "passed_guard", "selected")


@query("f03_replay_policies", f"""WITH {CANDIDATES}, po AS (SELECT * FROM (VALUES ('loose', 0.15, 0.0), ('strict', 0.4, 0.2)) x(policy, support, outside)), b AS (SELECT policy, claim_id, child_id, row_number() OVER (PARTITION BY policy, claim_id ORDER BY round(score, 9) DESC, ordinal) AS k FROM tr, po WHERE score >= support + CASE WHEN retrieved THEN 0 ELSE outside END)
SELECT po.policy, c.claim_id, b.child_id AS cited, b.child_id IS NOT NULL AND s.child_id IS NOT NULL AND b.child_id <> s.child_id AS drift, b.child_id IS NOT NULL AND s.child_id IS NULL AS rescued
FROM (SELECT DISTINCT claim_id FROM tr) c, po LEFT JOIN b ON b.policy = po.policy AND b.claim_id = c.claim_id AND k = 1 LEFT JOIN tr s ON s.claim_id = c.claim_id AND s.selected""".replace("FROM (SELECT DISTINCT claim_id FROM tr) c, po", "FROM (SELECT DISTINCT claim_id FROM tr) c CROSS JOIN po"))
def replay_policies(t):
    trace, _ = decided(t)
    policies = trace.sparkSession.createDataFrame([("loose", 0.15, 0.0), ("strict", 0.4, 0.2)], "policy string, support double, outside double")
    return C.replay(trace, policies)


#: Policies of the replay: name, guard, support, contradiction, coverage, outside, sibling, margin, most.
POLICIES = [C.Policy("legacy", "legacy", 0.2, 0.8, 0.5, None, 0.1, 0.02, 2), C.Policy("fixed", "fixed", 0.2, 0.8, 0.5, None, 0.1, 0.02, 2), C.Policy("retrieved_only", "fixed", 0.2, 0.8, 0.0, float("inf"), 0.1, 0.0, 0), C.Policy("calibrated", "fixed", 0.3, 0.9, 0.4, 0.35, 0.0, 0.05, 1)]
POLICY_ROWS = ", ".join(f"('{p.name}', '{p.guard}', {p.support}::DOUBLE, {p.contradiction}::DOUBLE, {p.coverage}::DOUBLE, {'NULL' if p.outside is None else repr(str(p.outside))}::DOUBLE, {p.sibling}::DOUBLE, {p.margin}::DOUBLE, {p.most})" for p in POLICIES)


@query("f03_replay_runs", f"""WITH {CANDIDATES}, policy_list AS (SELECT * FROM (VALUES {POLICY_ROWS}) x(policy, rule, sup, con, cov, outside, sibling, margin, most)),
stored_c AS (SELECT split_part(claim_id, ':', 1) AS run_id, *, (ordinal * 37 % 100) / 100.0::DOUBLE AS contradiction, round(1 - score, 9) AS coverage FROM tr JOIN (SELECT claim_id, status FROM oc) USING (claim_id)),
run_list AS (SELECT run_id, CAST(regexp_replace(run_id, '[^0-9]', '', 'g') AS BIGINT) % 5 = 0 OR NOT bool_or(retrieved) AS free FROM stored_c GROUP BY run_id),
met_s AS (SELECT c.*, po.*, free, contradiction >= con AS against, ordinal % 3 = 0 AND contradiction < con AS wording, score < sup AND cov > 0 AND coverage >= cov AS lifts FROM stored_c c JOIN run_list USING (run_id) CROSS JOIN policy_list po WHERE status NOT IN ('invalid_or_missing_context_citation', 'below_claim_confidence_threshold')),
valued AS (SELECT *, CASE WHEN against OR (wording AND rule = 'legacy') THEN 0 WHEN lifts AND NOT wording THEN greatest(score, coverage) ELSE score END AS value, CASE WHEN free THEN NULL WHEN outside IS NOT NULL THEN outside WHEN sibling > 0 THEN sup + sibling END AS bar FROM met_s),
placed AS (SELECT *, row_number() OVER w AS nth, value - lead(value) OVER w < margin AS near FROM valued WHERE value >= sup AND (retrieved OR bar IS NULL OR value >= bar) WINDOW w AS (PARTITION BY policy, run_id, claim_id ORDER BY value DESC, ordinal)),
top_t AS (SELECT *, bool_or(coalesce(near, false) AND nth = 1) OVER (PARTITION BY policy, run_id, claim_id) AS one FROM placed), was_in AS (SELECT DISTINCT run_id, child_id, true AS was FROM stored_c WHERE retrieved), gold_in AS (SELECT DISTINCT run_id, child_id, true AS gold FROM stored_c WHERE ordinal % 4 = 0),
marked AS (SELECT * FROM top_t LEFT JOIN was_in USING (run_id, child_id) LEFT JOIN gold_in USING (run_id, child_id) WHERE nth = 1 OR (NOT one AND (most <= 0 OR nth <= most)))
SELECT po.policy, r.run_id, count(DISTINCT claim_id) AS claims, coalesce(string_agg(DISTINCT child_id::VARCHAR, ' ' ORDER BY child_id::VARCHAR), '') AS cited, coalesce(string_agg(DISTINCT child_id::VARCHAR, ' ' ORDER BY child_id::VARCHAR) FILTER (was IS NULL AND gold IS NULL), '') AS drift, coalesce(string_agg(DISTINCT child_id::VARCHAR, ' ' ORDER BY child_id::VARCHAR) FILTER (was IS NULL AND gold), '') AS rescued
FROM run_list r CROSS JOIN policy_list po LEFT JOIN marked m ON m.policy = po.policy AND m.run_id = r.run_id GROUP BY ALL""")
def replay_runs(t):
    """Contradictions and conflicts of wording follow the candidates' places, coverage the scores; runs whose number five divides had no retrieval."""
    trace, outcomes = decided(t)
    of = F.split_part("claim_id", F.lit(":"), F.lit(1))
    rows = trace.select(of.alias("run_id"), "claim_id", F.col("child_id").cast("string").alias("child_id"), "ordinal", "retrieved", F.round("score", 9).alias("support"), (F.col("ordinal") * 37 % 100 / 100.0).alias("contradiction"), F.round(1 - F.round("score", 9), 9).alias("coverage"), (F.col("ordinal") % 3 == 0).alias("blocked"))
    runs = rows.select("run_id").distinct().withColumn("retrieval_free", F.regexp_replace("run_id", "[^0-9]", "").cast("long") % 5 == 0)
    claims = outcomes.select(of.alias("run_id"), "claim_id", "status")
    found = C.replay_runs(rows, claims, runs, rows.where("retrieved"), rows.where("ordinal % 4 = 0"), POLICIES)
    return found.select("policy", "run_id", "claims", *[F.array_join(c, " ").alias(c) for c in ("cited", "drift", "rescued")])


@query("f05_answer_status", f"WITH {CANDIDATES}, r AS (SELECT split_part(claim_id, ':', 1) AS run, count(*) FILTER (status = 'accepted') AS accepted, bool_or(status = 'invalid_or_missing_context_citation') AS errors FROM oc GROUP BY ALL) SELECT run, CASE WHEN errors THEN 'model_output_invalid' WHEN accepted > 0 THEN 'answered' ELSE 'insufficient_evidence' END AS status FROM r")
def answer_status(t):
    runs = decided(t)[1].groupBy(F.split_part("claim_id", F.lit(":"), F.lit(1)).alias("run")).agg(F.count_if(F.col("status") == "accepted").alias("accepted"), F.bool_or(F.col("status") == "invalid_or_missing_context_citation").alias("errors"))
    return runs.select("run", C.answer_status(F.lit(False), F.lit(False), F.col("errors"), F.col("accepted")).alias("status"))


@query("f06_attribution", f"WITH {CANDIDATES} SELECT split_part(claim_id, ':', 1) AS run, round(1 - avg(best), 6) AS risk, round(avg(CAST(best < 0.25 AS INT)), 6) AS unsupported, round(count(*) FILTER (status = 'accepted') / count(*), 6) AS survival FROM oc GROUP BY ALL")
def attribution(t):
    a = C.attribution(decided(t)[1].withColumn("run", F.split_part("claim_id", F.lit(":"), F.lit(1))), "run")
    return a.select("run", *[F.round(c, 6).alias(c) for c in ("risk", "unsupported", "survival")])


@query("f07_run_metrics", f"""WITH {CANDIDATES}, c AS (SELECT split_part(claim_id, ':', 1) AS run, count(*) AS generated, count(*) FILTER (status = 'accepted') AS accepted FROM oc GROUP BY ALL), e AS (SELECT split_part(claim_id, ':', 1) AS run, ordinal % 3 AS origin, count(*) AS n FROM tr WHERE selected GROUP BY ALL), g AS (SELECT run, max(n) AS largest, count(*) AS origins FROM e GROUP BY run)
SELECT run, generated, accepted, round(accepted / generated, 6) AS acceptance, round(largest / nullif(accepted, 0), 6) AS concentration, coalesce(origins, 0) AS origins FROM c LEFT JOIN g USING (run)""")
def run_metrics(t):
    trace, outcomes = decided(t)
    run = F.split_part("claim_id", F.lit(":"), F.lit(1))
    m = C.run_metrics(outcomes.withColumn("run", run), trace.where("selected").select(run.alias("run"), (F.col("ordinal") % 3).alias("origin")), "run")
    return m.withColumn("acceptance", F.round("acceptance", 6)).withColumn("concentration", F.round("concentration", 6))


@query("f08_cross_source_status", """WITH c AS (SELECT o_orderkey AS claim_id, o_custkey % 5 AS origin FROM orders), e AS (SELECT l_orderkey AS claim_id, l_suppkey % 5 AS other, CASE l_returnflag WHEN 'R' THEN 'contradicting' ELSE 'corroborating' END AS role FROM lineitem), i AS (SELECT * FROM (VALUES (0, 1), (1, 2), (2, 4)) x(a, b)),
s AS (SELECT e.claim_id, bool_or(role = 'contradicting') AS against, bool_or(role = 'corroborating' AND i.a IS NOT NULL) AS agrees FROM e JOIN c USING (claim_id) LEFT JOIN i ON i.a = least(origin, other) AND i.b = greatest(origin, other) WHERE other <> origin GROUP BY ALL)
SELECT c.claim_id, CASE WHEN coalesce(against, false) THEN 'contested' WHEN coalesce(agrees, false) THEN 'corroborated' ELSE 'supported' END AS status FROM c LEFT JOIN s USING (claim_id)""")
def cross_source_status(t):
    c = t("orders").select(F.col("o_orderkey").alias("claim_id"), (F.col("o_custkey") % 5).alias("origin"))
    e = t("lineitem").select(F.col("l_orderkey").alias("claim_id"), (F.col("l_suppkey") % 5).alias("origin"), F.when(F.col("l_returnflag") == "R", "contradicting").otherwise("corroborating").alias("role"))
    return C.cross_source_status(c, e, c.sparkSession.createDataFrame([(0, 1), (1, 2), (2, 4)], "origin_a long, origin_b long"))


@query("e06_dependency_window", f"WITH {PAIRS}, u AS (SELECT doc_id, unnest({SENTENCES}) AS s, generate_subscripts({SENTENCES}, 1) AS pos FROM documents) SELECT doc_id, pos, coalesce(lag(pos) OVER w, pos) AS from_pos, coalesce(lead(pos) OVER w, pos) AS to_pos FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY pos)")
def dependency_window(t):
    w = Window.partitionBy("doc_id").orderBy("pos")
    return tables.sentence_spans(t("documents"), "doc_id", "text").select("doc_id", "pos", F.coalesce(F.lag("pos").over(w), "pos").alias("from_pos"), F.coalesce(F.lead("pos").over(w), "pos").alias("to_pos"))


TOKEN = r"greatest(1, CAST(ceil(length(regexp_extract_all(text, '[\p{L}\p{N}_]+')) * 1.25) AS BIGINT))"


@query("e08_fit_serialized", bm25_sql(24) + f", s AS (SELECT query_id, doc_id, pos, rank, sum({TOKEN} + 24) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM bl JOIN lv USING (doc_id, pos) WHERE rank <= 24) SELECT query_id, doc_id, pos, rank, CAST(used AS BIGINT) AS used FROM s WHERE used <= 512")
def fit_serialized(t):
    blocks = bm25_list(t, 24).join(leaves(t).select(*R.LEAF, "text"), R.LEAF)
    return P.fit_serialized(blocks, 512).select("query_id", *R.LEAF, "rank", "used")


@query("e04_assemble_context")
def assemble_context(t):
    blocks = bm25_list(t, 24).join(leaves(t), R.LEAF).select("query_id", F.concat_ws(":", *R.LEAF).alias("node_id"), F.col("score").alias("utility"), "source", "text", T.token_estimate("text").alias("tokens"))
    return P.assemble(blocks, asked(t).select("query_id", T.classify_query("text").alias("query_type")))


@query("e09_section_context", bm25_sql(80) + " SELECT query_id, doc_id, round(max(score), 6) AS score, count(*) AS leaves FROM bl WHERE rank <= 80 GROUP BY ALL")
def section_context(t):
    return bm25_list(t, 80).groupBy("query_id", "doc_id").agg(F.round(F.max("score"), 6).alias("score"), F.count("*").alias("leaves"))
