"""Claim verification as tables: candidates, decisions, statuses, metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

SUPPORT, CONTRADICTION, CONFIDENCE, PER_CLAIM, MARGIN, OUTSIDE, LEXICAL = 0.25, 0.5, 0.55, 10, 0.05, 0.10, 0.8


def candidate_children(cited: DataFrame, limit: int = PER_CLAIM) -> DataFrame:
    """Leaves reachable from the cited blocks in reading order, the first ``limit`` of a claim.

    ``cited``: claim_id, citation_no, child_no, child_id; a leaf counts where it stands first.
    """
    first = cited.groupBy("claim_id", "child_id").agg(F.min(F.struct("citation_no", "child_no")).alias("at"))
    return first.withColumn("ordinal", F.row_number().over(Window.partitionBy("claim_id").orderBy("at", "child_id"))).where(F.col("ordinal") <= limit).drop("at")


def effective_support(support: Column, contradiction: Column, coverage: Column, conflict: Column, lexical: float = LEXICAL) -> tuple[Column, Column]:
    """``(score, blocked)``: contradiction forces 0; weak support may rise to the lexical coverage unless the wording conflicts."""
    rescue = (support < SUPPORT) & (F.lit(lexical) > 0) & (coverage >= lexical)
    blocked = (contradiction >= CONTRADICTION) | (rescue & conflict)
    return F.when(contradiction >= CONTRADICTION, 0.0).when(rescue & ~conflict, F.greatest(support, coverage)).otherwise(support), blocked


def decide(candidates: DataFrame, claims: DataFrame, keep: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(trace, outcomes)``.

    ``candidates``: claim_id, child_id, ordinal, score, retrieved; ``claims``: claim_id, valid_citations, confidence.
    Leaves outside the retrieved set must clear a higher bar; of those left the best ``keep``
    are cited, only the best one if the second is within the margin.
    """
    bar = F.when(F.col("retrieved"), SUPPORT).otherwise(SUPPORT + OUTSIDE)
    live = claims.where((F.col("valid_citations") > 0) & (F.col("confidence") >= CONFIDENCE)).select("claim_id")
    base = candidates.join(live, "claim_id").withColumn("passed_base", F.col("score") >= SUPPORT).withColumn("passed_guard", F.col("passed_base") & (F.col("score") >= bar))
    w = Window.partitionBy("claim_id").orderBy(F.col("passed_guard").desc(), F.round("score", 9).desc(), "ordinal")
    ranked = base.withColumn("place", F.row_number().over(w)).withColumn("next_score", F.lead("score").over(w)).withColumn("next_ok", F.lead("passed_guard").over(w))
    top = Window.partitionBy("claim_id")
    ambiguous = F.max(F.when((F.col("place") == 1) & F.col("passed_guard") & F.coalesce("next_ok", F.lit(False)), F.round(F.col("score") - F.col("next_score"), 9) < MARGIN)).over(top)
    trace = ranked.withColumn("ambiguous", F.coalesce(ambiguous, F.lit(False))).withColumn("selected", F.col("passed_guard") & (F.col("place") <= F.when(F.col("ambiguous"), 1).otherwise(keep))).drop("next_score", "next_ok")
    sums = trace.groupBy("claim_id").agg(F.count("*").alias("n"), F.bool_or("passed_base").alias("base"), F.bool_or("passed_guard").alias("guard"), F.max("score").alias("best"), F.bool_or("ambiguous").alias("ambiguous"))
    status = (
        F.when(F.col("valid_citations") == 0, "invalid_or_missing_context_citation").when(F.col("confidence") < CONFIDENCE, "below_claim_confidence_threshold").when(F.col("n").isNull(), "no_reachable_child")
        .when(~F.col("base"), "below_support_threshold").when(~F.col("guard"), "sibling_guard_rejected_all").otherwise("accepted")
    )
    outcomes = claims.join(sums, "claim_id", "left").select("claim_id", status.alias("status"), F.coalesce("best", F.lit(0.0)).alias("best_support"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))
    return trace.drop("ambiguous"), outcomes


def replay(trace: DataFrame, policies: DataFrame) -> DataFrame:
    """Cited leaves of stored scores under other thresholds: ``policy, claim_id, cited, drift, rescued``. Scores and bars meet at nine places.

    ``trace``: claim_id, child_id, ordinal, score, retrieved, selected; ``policies`` (a handful of rows): policy, support, outside.
    """
    met = trace.join(F.broadcast(policies))
    # in doubles 0.4 + 0.2 lies over 0.6
    ok = met.where(F.round("score", 9) >= F.round(F.col("support") + F.when(F.col("retrieved"), 0.0).otherwise(F.col("outside")), 9))
    best = ok.withColumn("place", F.row_number().over(Window.partitionBy("policy", "claim_id").orderBy(F.round("score", 9).desc(), "ordinal"))).where("place = 1")
    before = trace.where("selected").select("claim_id", F.col("child_id").alias("was"))
    every = trace.select("claim_id").distinct().join(F.broadcast(policies.select("policy")))
    j = every.join(best.select("policy", "claim_id", F.col("child_id").alias("cited")), ["policy", "claim_id"], "left").join(before, "claim_id", "left")
    return j.select("policy", "claim_id", "cited", (F.col("cited").isNotNull() & F.col("was").isNotNull() & (F.col("cited") != F.col("was"))).alias("drift"), (F.col("cited").isNotNull() & F.col("was").isNull()).alias("rescued"))


@dataclass(frozen=True)
class Policy:
    """How stored scores are decided again. ``outside``: the least score of a leaf that was not retrieved; infinite: none of them; absent: ``support`` and ``sibling``."""

    name: str
    guard: str = "fixed"
    support: float = 0.5
    contradiction: float = 0.5
    coverage: float = 0.0
    outside: float | None = None
    sibling: float = 0.1
    margin: float = 0.05
    most: int = 0


#: Claims that no policy can save.
LOST = ("invalid_or_missing_context_citation", "below_claim_confidence_threshold")


def replay_runs(candidates: DataFrame, claims: DataFrame, runs: DataFrame, retrieved: DataFrame, gold: DataFrame, policies: list[Policy]) -> DataFrame:
    """``policy, run_id, claims, cited, drift, rescued``: accepted claims and cited leaves of whole runs under each policy, none scored again.

    ``candidates``: run_id, claim_id, child_id, ordinal, support, contradiction, coverage, blocked (by contradiction or wording), retrieved; ``claims``: run_id,
    claim_id, status; ``runs``: run_id, retrieval_free; ``retrieved``, ``gold``: run_id, child_id. Under the legacy guard a conflict of wording costs
    a leaf its score; under the fixed one only what coverage would have added. Runs without retrieval ask no more of any leaf. Cited leaves that were
    not retrieved are rescued if they are gold, else drift. Every run has a row for each policy.
    """
    fields = ("name", "guard", "support", "contradiction", "coverage", "outside", "sibling", "margin", "most")
    kinds = {"name": "string", "guard": "string", "most": "int"}
    listed = F.array(*[F.struct(*[F.lit(getattr(p, f)).cast(kinds.get(f, "double")).alias(f) for f in fields]) for p in policies])
    has = retrieved.select("run_id").distinct().withColumn("__some", F.lit(True))
    free = runs.join(has, "run_id", "left").select("run_id", (F.col("retrieval_free") | F.col("__some").isNull()).alias("free"))
    met = candidates.join(claims.where(~F.col("status").isin(*LOST)).select("run_id", "claim_id"), ["run_id", "claim_id"], "left_semi").join(free, "run_id").withColumn("p", F.explode(listed))
    p, support, coverage = F.col("p"), F.col("support"), F.col("coverage")
    against = F.col("contradiction") >= p["contradiction"]
    wording = F.col("blocked") & ~against
    lifts = (support < p["support"]) & (p["coverage"] > 0) & (coverage >= p["coverage"])
    legacy = F.when(against | wording, 0.0).when(lifts, F.greatest(support, coverage)).otherwise(support)
    fixed = F.when(against, 0.0).when(lifts & ~wording, F.greatest(support, coverage)).otherwise(support)
    bar = F.when(F.col("free"), None).when(p["outside"].isNotNull(), p["outside"]).when(p["sibling"] > 0, p["support"] + p["sibling"])
    scored = met.withColumn("score", F.when(p["guard"] == "legacy", legacy).otherwise(fixed)).where(F.col("score") >= p["support"]).where(F.col("retrieved") | bar.isNull() | (F.col("score") >= bar))
    claim = Window.partitionBy("p.name", "run_id", "claim_id")
    order = claim.orderBy(F.col("score").desc(), "ordinal")
    close = (F.col("score") - F.lead("score").over(order)) < p["margin"]
    placed = scored.withColumn("place", F.row_number().over(order)).withColumn("close", close)
    one = F.max(F.when(F.col("place") == 1, F.coalesce("close", F.lit(False)))).over(claim)
    taken = placed.withColumn("one", one).where((F.col("place") == 1) | (~F.col("one") & ((p["most"] <= 0) | (F.col("place") <= p["most"])))).select(F.col("p.name").alias("policy"), "run_id", "claim_id", "child_id")
    mark = lambda df, name: df.select("run_id", "child_id").distinct().withColumn(name, F.lit(True))
    marked = taken.join(mark(retrieved, "__was"), ["run_id", "child_id"], "left").join(mark(gold, "__gold"), ["run_id", "child_id"], "left")
    sets = lambda when: F.sort_array(F.collect_set(F.when(when, F.col("child_id"))))
    new, right = F.col("__was").isNull(), F.col("__gold").isNotNull()
    found = marked.groupBy("policy", "run_id").agg(F.count_distinct("claim_id").alias("claims"), sets(F.lit(True)).alias("cited"), sets(new & ~right).alias("drift"), sets(new & right).alias("rescued"))
    every = runs.select("run_id", F.explode(F.array(*[F.lit(p.name) for p in policies])).alias("policy"))
    none = F.array().cast(found.schema["cited"].dataType)
    whole = every.join(found, ["policy", "run_id"], "left")
    return whole.select("policy", "run_id", F.coalesce("claims", F.lit(0)).alias("claims"), *[F.coalesce(c, none).alias(c) for c in ("cited", "drift", "rescued")])


def answer_status(down: Column, insufficient: Column, errors: Column, accepted: Column) -> Column:
    return F.when(down, "verification_unavailable").when(insufficient, "insufficient_evidence").when(errors, "model_output_invalid").when(accepted > 0, "answered").otherwise("insufficient_evidence")


def attribution(outcomes: DataFrame, run: str) -> DataFrame:
    """Risk (1 - mean best support, 1 without claims), share without support, share accepted."""
    ok = F.count_if(F.col("status") == "accepted")
    return outcomes.groupBy(run).agg(
        F.coalesce(1 - F.avg("best_support"), F.lit(1.0)).alias("risk"), F.coalesce(F.try_divide(F.count_if(F.col("best_support") < SUPPORT), F.count("*")), F.lit(0.0)).alias("unsupported"),
        F.least(F.lit(1.0), F.try_divide(ok, F.count("*"))).alias("survival"),
    )


def run_metrics(claims: DataFrame, evidence: DataFrame, run: str) -> DataFrame:
    """Counts, rates that are null without claims, and the share of the largest source group among accepted claims' evidence."""
    c = claims.groupBy(run).agg(F.count("*").alias("generated"), F.count_if(F.col("status") == "accepted").alias("accepted"))
    g = evidence.groupBy(run, "origin").agg(F.count("*").alias("n")).groupBy(run).agg(F.max("n").alias("largest"), F.count("*").alias("origins"))
    return c.join(g, run, "left").select(run, "generated", "accepted", F.try_divide("accepted", "generated").alias("acceptance"), F.try_divide("largest", "accepted").alias("concentration"), F.coalesce("origins", F.lit(0)).alias("origins"))


def cross_source_status(claims: DataFrame, evidence: DataFrame, independent: DataFrame) -> DataFrame:
    """contested if other groups' evidence contradicts, corroborated if it supports from a reviewed independent group, else supported.

    ``claims``: claim_id, origin; ``evidence``: claim_id, origin, role; ``independent``: origin_a < origin_b.
    """
    other = evidence.withColumnRenamed("origin", "other").join(claims, "claim_id").where("other <> origin")
    pair = other.withColumn("origin_a", F.least("origin", "other")).withColumn("origin_b", F.greatest("origin", "other")).join(independent.withColumn("independent", F.lit(True)), ["origin_a", "origin_b"], "left")
    seen = pair.groupBy("claim_id").agg(F.bool_or(F.col("role") == "contradicting").alias("against"), F.bool_or((F.col("role") == "corroborating") & F.coalesce("independent", F.lit(False))).alias("agrees"))
    return claims.join(seen, "claim_id", "left").select("claim_id", F.when(F.coalesce("against", F.lit(False)), "contested").when(F.coalesce("agrees", F.lit(False)), "corroborated").otherwise("supported").alias("status"))


def conversation_candidates(pairs: DataFrame) -> DataFrame:
    """Each claim with the sentences of the turn before as leaves; overlap as the pair scorer, the lexical guards as conflict."""
    s = pairs.select(F.concat_ws(":", "conv_id", "turn").alias("claim_id"), "claim", F.posexplode(T.sentences("evidence")).alias("p", "sentence"))
    c, e = T.canonical_tokens("claim"), T.canonical_tokens("sentence")
    coverage = T.claim_coverage(c, e)
    score, blocked = effective_support(T.overlap(F.array_distinct(e), c), F.lit(0.0), coverage, T.lexical_conflict("claim", "sentence"))
    cut = s.select("claim_id", (F.col("p") + 1).alias("ordinal"), F.concat_ws(":", "claim_id", "p").alias("child_id"), F.round(score, 9).alias("score"), blocked.alias("blocked"), (F.col("p") % 2 == 0).alias("retrieved"))
    return cut.where(F.col("ordinal") <= PER_CLAIM)


# Flags of an extraction that make figures drawn from it doubtful, and what counts as figures.
RISKY = ["low_confidence", "possible_repetition", "possible_non_speech", "alignment_uncertain", "overlapping_cue"]
FIGURES = r"[0-9]|[=+×÷^√∑∫%<>≤≥]"


def transcription_state(items: Column) -> Column:
    """not_applicable without items (flags, reviewed), reviewed if all are, else automatic."""
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, "not_applicable").when(F.forall(items, lambda i: i["reviewed"]), "reviewed").otherwise("automatic")


def post_guards(claims: DataFrame, evidence: DataFrame, multilingual: bool = True) -> DataFrame:
    """``claim_id, rejected_reason, transcription_state`` of supported claims.

    In the ``multilingual`` profile a claim needs its numbers in the evidence and must not turn non-inferiority into superiority. A claim with
    figures from an unreviewed passage with a risky flag is to be reviewed first. ``claims``: claim_id, text; ``evidence``: claim_id,
    ordinal, quote, items array<struct<flags array<string>, reviewed boolean>>.
    """
    quotes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "quote"))), lambda q: q["quote"]), " ")
    g = evidence.groupBy("claim_id").agg(quotes.alias("quotes"), F.flatten(F.collect_list(F.coalesce("items", F.array().cast("array<struct<flags: array<string>, reviewed: boolean>>")))).alias("items"))
    j = claims.select("claim_id", "text").join(g, "claim_id", "left").withColumn("quotes", F.coalesce("quotes", F.lit("")))
    guard = T.claim_guard("text", "quotes") if multilingual else F.lit(None).cast("string")
    risky = F.exists("items", lambda i: F.arrays_overlap(i["flags"], F.array(*map(F.lit, RISKY))) & ~i["reviewed"])
    review = F.when(F.col("text").rlike(FIGURES) & F.coalesce(risky, F.lit(False)), "extraction_quality_review_required")
    return j.withColumn("guard", guard).select("claim_id", F.coalesce("guard", review).alias("rejected_reason"), transcription_state(F.col("items")).alias("transcription_state"))


def visible_candidates(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """``claim_id, node_id, text``: what each claim may be held against, its own cited fragments only, one text a leaf.

    ``claims``: query_id, claim_id, citations array<string>; ``blocks``: query_id, context_id, node_id, char_start, char_end, text.
    """
    cited = claims.select("query_id", "claim_id", F.explode(F.array_distinct("citations")).alias("context_id")).join(blocks, ["query_id", "context_id"])
    shown = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("char_start", "char_end", "text"))), lambda b: b["text"]))
    return cited.groupBy("claim_id", "node_id").agg(F.array_join(shown, "\n").alias("text"))


def verify_visible(claims: DataFrame, blocks: DataFrame, scorer=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(trace, outcomes, evidence)``: :func:`decide` with each claim seeing its own fragments only; evidence ids count through a question.

    ``claims``: query_id, claim_id, claim_no, text, citations, confidence. ``scorer`` maps (claim, text) columns to (support, contradiction); the default is lexical.
    """
    seen = visible_candidates(claims, blocks).join(claims.select("query_id", "claim_id", "claim_no", F.col("text").alias("claim")), "claim_id")
    c, e = T.canonical_tokens("claim"), T.canonical_tokens("text")
    support, against = scorer(F.col("claim"), F.col("text")) if scorer else (T.overlap(F.array_distinct(c), e), F.lit(0.0))
    score, blocked = effective_support(support, against, T.claim_coverage(c, e), T.lexical_conflict("claim", "text"))
    order = F.row_number().over(Window.partitionBy("claim_id").orderBy("node_id"))
    candidates = seen.select("claim_id", F.col("node_id").alias("child_id"), order.alias("ordinal"), F.round(score, 9).alias("score"), blocked.alias("blocked"), F.lit(True).alias("retrieved")).where(F.col("ordinal") <= PER_CLAIM)
    valid = blocks.groupBy("query_id").agg(F.collect_set("context_id").alias("ids"))
    rows = claims.join(valid, "query_id", "left").select("claim_id", F.size(F.array_intersect("citations", F.coalesce("ids", F.array().cast("array<string>")))).alias("valid_citations"), "confidence")
    trace, outcomes = decide(candidates, rows)
    chosen = trace.where("selected").join(claims.select("query_id", "claim_id", "claim_no"), "claim_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("claim_no", "child_id"))
    return trace, outcomes, chosen.select("query_id", "claim_id", "child_id", "score", F.concat(F.lit("E"), place.cast("string")).alias("evidence_id"))


def outcome_metrics(claims: DataFrame, evidence: DataFrame, blocks: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: claims made and kept, risk before and after the filter, rates that are null without claims, the share of the largest group, groups, tokens shown.

    ``claims``: run, claim_id, status, best_support; ``evidence``: run, claim_id, origin; ``blocks``: run, tokens.
    """
    ok = F.col("status") == "accepted"
    c = claims.groupBy(run).agg(F.count("*").alias("generated"), F.count_if(ok).alias("accepted"), (1 - F.avg("best_support")).alias("risk_before"), (1 - F.avg(F.when(ok, F.col("best_support")))).alias("risk_after"))
    g = evidence.groupBy(run, "origin").agg(F.count("*").alias("n")).groupBy(run).agg(F.max("n").alias("largest"), F.count("*").alias("groups_cited"))
    b = blocks.groupBy(run).agg(F.sum("tokens").alias("context_tokens"))
    j = c.join(g, run, "left").join(b, run, "left")
    return j.select(run, "generated", "accepted", "risk_before", "risk_after", F.try_divide("accepted", "generated").alias("acceptance"), F.try_divide("largest", "accepted").alias("concentration"), F.coalesce("groups_cited", F.lit(0)).alias("groups_cited"), F.coalesce("context_tokens", F.lit(0)).alias("context_tokens"))


def consensus_rows(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``claim_id, status, supporting, contradicting`` (sorted citations) of claims with more than one piece of evidence, or not just supported.

    ``claims``: claim_id, status; ``evidence``: claim_id, role, citation.
    """
    of = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("citation"))))
    g = evidence.groupBy("claim_id").agg(of(F.col("role") != "contradicting").alias("supporting"), of(F.col("role") == "contradicting").alias("contradicting"), F.count("*").alias("n"))
    return claims.join(g, "claim_id", "left").where((F.col("n") > 1) | (F.col("status") != "supported")).select("claim_id", "status", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("supporting", "contradicting")])


def synthesis_sections(outline: DataFrame, claims: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(sections, contexts, runs)``: each outline item failed, complete with its template and claims, or insufficient; context ids count on through the run.

    ``outline``: run_id, item_no, title, failed; ``claims``: run_id, item_no, claim_no, claim_id, text; ``contexts``: run_id, item_no, context_no.
    """
    held = claims.groupBy("run_id", "item_no").agg(F.array_sort(F.collect_list(F.struct("claim_no", "claim_id", "text"))).alias("c"))
    j = outline.join(held, ["run_id", "item_no"], "left")
    status = F.when(F.col("failed"), "failed").when(F.col("c").isNotNull(), "complete").otherwise("insufficient")
    ids = F.transform("c", lambda c: c["claim_id"])
    template = F.array_join(F.transform("c", lambda c: F.concat(c["text"], F.lit(" {{"), c["claim_id"], F.lit("}}"))), " ")
    done = F.col("status") == "complete"
    sections = j.withColumn("status", status).select("run_id", "item_no", "title", "status", F.when(done, template).alias("template_text"), F.when(done, ids).otherwise(F.array().cast("array<string>")).alias("claim_ids"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("item_no", "context_no"))
    numbered = contexts.withColumn("context_id", F.concat(F.lit("C"), place.cast("string")))
    runs = sections.groupBy("run_id").agg(F.when(F.bool_or(F.col("status") == "failed"), "partial").otherwise("succeeded").alias("status"))
    return sections, numbered, runs


# Weights of a branch's reward.
RECALL_W, PRECISION_W, RESCUE_W, ANSWER_W, HARMFUL, AMBIGUITY, EMPTY, TOKENS_W, LATENCY_W, GAIN, PRECISION_EPSILON, HARMFUL_DELTA = 0.5, 0.7, 0.5, 0.5, 1.0, 0.3, 0.4, 0.3, 0.05, 0.02, 0.02, 0.05


def rollout_rewards(branches: DataFrame, gold: DataFrame, budget: int = 7000) -> DataFrame:
    """``query_id, group_id, branch, precision, recall, rescue, harmful, reward`` of each branch, against the annotator whose set agrees with it best.

    ``branches``: query_id, group_id, branch (keep, parent, section), verified_ids array, retrieved_ids array, answer_f1, ambiguous_rate, tokens,
    latency_ms; ``gold``: query_id, annotator, gold_ids array. Rescued is gold that was not retrieved, harmful what was neither gold nor retrieved.
    """
    j = branches.join(gold, "query_id", "left").withColumn("gold_ids", F.coalesce("gold_ids", F.array().cast("array<string>")))
    got, hit = F.size(F.array_distinct("verified_ids")), F.size(F.array_intersect("verified_ids", "gold_ids"))
    p, r = F.coalesce(F.try_divide(hit, got), F.lit(0.0)), F.coalesce(F.try_divide(hit, F.size(F.array_distinct("gold_ids"))), F.lit(0.0))
    moved = F.array_except("verified_ids", "retrieved_ids")
    j = j.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    j = j.withColumn("rescue", F.coalesce(F.try_divide(F.size(F.array_intersect(moved, "gold_ids")), F.size(F.array_distinct("gold_ids"))), F.lit(0.0))).withColumn("harmful", F.coalesce(F.try_divide(F.size(F.array_except(moved, "gold_ids")), got), F.lit(0.0)))
    best = F.row_number().over(Window.partitionBy("query_id", "group_id", "branch").orderBy(F.round("f1", 9).desc(), "annotator"))
    j = j.withColumn("__best", best).where("__best = 1")
    reward = (
        ANSWER_W * F.col("answer_f1") + RECALL_W * F.col("recall") + PRECISION_W * F.col("precision") + RESCUE_W * F.col("rescue") - HARMFUL * F.col("harmful") - AMBIGUITY * F.col("ambiguous_rate")
        - EMPTY * (got == 0).cast("double") - TOKENS_W * F.least(F.lit(1.0), F.col("tokens") / F.lit(float(max(1, budget)))) - LATENCY_W * F.least(F.lit(1.0), F.col("latency_ms") / 5000.0)
    )
    return j.select("query_id", "group_id", "branch", "precision", "recall", "rescue", "harmful", (got == 0).alias("empty"), reward.alias("reward"))


def rollout_labels(rewards: DataFrame, constrained: bool = True, epsilon: float = PRECISION_EPSILON, delta: float = HARMFUL_DELTA, gain: float = GAIN) -> DataFrame:
    """``query_id, group_id, label_parent, label_section``: 1 where the branch's reward is better than keeping by more than ``gain``.

    ``constrained``: and neither precision nor recall falls by more than ``epsilon``, harm stays within ``delta``, and evidence doesn't vanish.
    """
    one = lambda b: F.max(F.when(F.col("branch") == b, F.struct("reward", "precision", "recall", "harmful", "empty")))
    g = rewards.groupBy("query_id", "group_id").agg(one("keep").alias("keep"), one("parent").alias("parent"), one("section").alias("section"))

    def label(b: str) -> Column:
        x, keep = F.col(b), F.col("keep")
        ok = F.round(x["reward"] - keep["reward"], 9) > gain
        if constrained:
            ok = ok & (x["precision"] >= keep["precision"] - epsilon) & (x["recall"] >= keep["recall"] - epsilon) & (x["harmful"] <= delta) & ~(x["empty"] & ~keep["empty"])
        return F.coalesce(ok, F.lit(False)).cast("int").alias(f"label_{b}")

    return g.select("query_id", "group_id", label("parent"), label("section"))
