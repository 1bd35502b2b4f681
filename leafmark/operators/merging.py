"""Merging retrieved leaves upward: features of candidates, the fixed prior, decisions, and expansion level by level over all questions at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..sources.files import Kept
from .tree import LEVELS, ancestor_at_level, effective_members, rank_of

MARGIN, THRESHOLD, ROLLBACK, LEAST_HITS, GAIN_WEIGHT, COST_PENALTY, BUDGET = 0.04, 0.56, 0.78, 2, 0.35, 0.5, 7000
DEPTH, EPSILON, HEADROOM = 3, 0.02, 1.15
#: The highest level that a question of each type may rise to.
CEILING = {"factoid": "parent", "explanatory": "section", "comparative_multi_hop": "document", "global_synthesis": "document"}
FEATURES = "relevance coverage coherence density noise cost query_factoid query_explanatory query_comparative query_global member_count_norm member_score_entropy query_length_norm".split()


def features(hits: DataFrame, slots: DataFrame, unit: str = "doc_id", least: int = 2) -> DataFrame:
    """Per question and unit with ``least`` hits or more: hits, coverage of its slots, members (hits / 8) and entropy of the scores, each 1 at most.

    ``hits``: query_id, unit, score > 0; ``slots``: unit, slots. The entropy comes from two sums, so rows are combined before they move.
    """
    g = hits.groupBy("query_id", unit).agg(F.count("*").alias("hits"), F.avg("score").alias("mean"), F.sum("score").alias("total"), F.sum(-F.col("score") * F.log("score")).alias("sl"))
    entropy = F.when(F.col("hits") > 1, F.least(F.lit(1.0), (F.col("sl") / F.col("total") + F.log("total")) / F.log("hits"))).otherwise(0.0)
    return g.where(F.col("hits") >= least).join(slots, unit).select("query_id", unit, "hits", "mean", F.least(F.lit(1.0), F.col("hits") / F.col("slots")).alias("coverage"), F.least(F.lit(1.0), F.col("hits") / 8.0).alias("members"), entropy.alias("entropy"))


def merge_features(members: DataFrame, candidates: DataFrame, queries: DataFrame, budget: int = BUDGET, least: int = LEAST_HITS) -> DataFrame:
    """``query_id, candidate_id``, the thirteen features, and what deciding needs: mean and best member score, member tokens, members.

    ``members``: query_id, candidate_id, node_id, place, score, text (or its ``words``), token_count; ``candidates``: query_id, candidate_id, text,
    token_count, slots, candidate_score; ``queries``: query_id, query, query_type. A candidate's members are no more than the question's hits, so they fit in its row.
    """
    one = members.select("query_id", "candidate_id", F.struct("place", "node_id", "score", "token_count", (F.col("words") if "words" in members.columns else T.token_set("text")).alias("words")).alias("m"))
    held = one.groupBy("query_id", "candidate_id").agg(F.array_sort(F.collect_list("m")).alias("m")).where(F.size("m") >= least)
    of = lambda c: F.transform("m", lambda x: x[c])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    steps = F.zip_with(F.expr("slice(m, 1, size(m) - 1)"), F.expr("slice(m, 2, size(m) - 1)"), lambda a, b: F.when((F.size(a["words"]) > 0) | (F.size(b["words"]) > 0), T.jaccard(a["words"], b["words"])))
    j = held.withColumn("steps", F.filter(steps, lambda x: x.isNotNull())).withColumn("scores", of("score")).withColumn("member_tokens", total(of("token_count"))).join(candidates, ["query_id", "candidate_id"]).join(queries.select("query_id", "query", "query_type"), "query_id")
    n, sum_ = F.size("m"), total(F.col("scores"))
    shares = F.filter("scores", lambda x: x > 0)
    entropy = F.when((n > 1) & (sum_ > 0), F.least(F.lit(1.0), -F.aggregate(shares, F.lit(0.0), lambda s, x: s + x / sum_ * F.log(x / sum_)) / F.log(n.cast("double")))).otherwise(0.0)
    density = F.least(F.lit(1.0), F.col("member_tokens") / F.greatest(F.lit(1), "token_count"))
    is_ = lambda kind: (F.col("query_type") == kind).cast("double")
    return j.select(
        "query_id", "candidate_id", F.col("candidate_score").alias("relevance"), F.least(F.lit(1.0), n / F.greatest(F.lit(1), "slots")).alias("coverage"), F.coalesce(total(F.col("steps")) / F.nullif(F.size("steps"), F.lit(0)), F.lit(0.0)).alias("coherence"), density.alias("density"), F.greatest(F.lit(0.0), 1 - density).alias("noise"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("token_count") - F.col("member_tokens")) / F.lit(max(1, budget))).alias("cost"), is_("factoid").alias("query_factoid"), is_("explanatory").alias("query_explanatory"), is_("comparative_multi_hop").alias("query_comparative"), is_("global_synthesis").alias("query_global"),
        F.least(F.lit(1.0), n / 8.0).alias("member_count_norm"), entropy.alias("member_score_entropy"), F.least(F.lit(1.0), F.size(T.spaced_tokens("query")) / 25.0).alias("query_length_norm"), (sum_ / n).alias("u_members"), F.array_max("scores").alias("best_member"), of("node_id").alias("member_ids"),
    )


def probability(relevance: Column, coverage: Column, coherence: Column, density: Column, cost: Column, kind: Column) -> Column:
    """The fixed logistic prior of a merge; noise is what the members leave of the candidate."""
    x = 1.55 * relevance + 0.90 * coverage + 0.45 * coherence + 1.05 * density - 0.85 * (1 - density) - 0.75 * cost - 0.95
    x = x + F.when(kind == "global_synthesis", 0.40).when(kind == "explanatory", 0.22).when(kind == "factoid", -0.28).otherwise(0.0)
    return 1 / (1 + F.exp(-x))


def prior(policy: str = "adaptive") -> Column:
    """A policy's probability over columns of features: the fixed prior, ``static`` (always) or ``never``."""
    if policy != "adaptive":
        return F.lit({"static": 1.0, "never": 0.0}[policy])
    kind = F.when(F.col("query_global") > 0, "global_synthesis").when(F.col("query_explanatory") > 0, "explanatory").when(F.col("query_factoid") > 0, "factoid").otherwise("comparative_multi_hop")
    return probability(*[F.col(c) for c in ("relevance", "coverage", "coherence", "density", "cost")], kind)


def decide(found: DataFrame, policy: str = "adaptive", learned: Column | None = None) -> DataFrame:
    """Adds ``probability, u_parent, delta, rolled_back, accepted`` to features.

    Accepted is what gains the margin over its members and isn't much worse than the best of them; with a ``learned``
    probability, what reaches the threshold; ``static`` takes all.
    """
    p = learned if learned is not None else prior(policy)
    d = found.withColumn("probability", p).withColumn("u_parent", 0.5 * F.col("probability") + 0.5 * F.col("relevance"))
    d = d.withColumn("delta", F.col("u_parent") + GAIN_WEIGHT * F.greatest(F.lit(0.0), 1 - F.col("coverage")) * F.col("u_parent") - F.col("u_members") - COST_PENALTY * F.col("cost"))
    forced = F.lit(policy == "static")
    d = d.withColumn("rolled_back", (F.col("relevance") < ROLLBACK * F.col("best_member")) & ~forced)
    wins = F.col("probability") >= THRESHOLD if learned is not None else F.round("delta", 9) >= MARGIN
    return d.withColumn("accepted", (wins & ~F.col("rolled_back")) | forced)


def lexical_candidate_scores(pairs: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """The default scorer: the share of a question's words in the candidate; adds the candidate's ``text, token_count, slots, candidate_score``."""
    text = nodes.select(F.col("node_id").alias("candidate_id"), "text", "token_count", F.size("child_ids").alias("slots"))
    j = pairs.join(text, "candidate_id").join(queries.select("query_id", "query"), "query_id")
    return j.select("query_id", "candidate_id", "text", "token_count", "slots", T.overlap(T.token_set("query"), T.content_tokens("text")).alias("candidate_score"))


def decide_merges(selected: DataFrame, nodes: DataFrame, queries: DataFrame, level: str = "parent", policy: str = "adaptive", budget: int = BUDGET, scorer=lexical_candidate_scores) -> DataFrame:
    """Decisions on all nodes of ``level`` with two selected members or more; ``selected``: query_id, node_id, score."""
    kept = Kept()
    # written down first, so that their sizes tell how they meet the nodes' texts: where they are few, no text moves
    members = kept.keep(effective_members(kept.keep(selected.select("query_id", "node_id", "score"), "selected"), nodes, level), "members")
    full = members.join(nodes.select("node_id", "text", "token_count"), "node_id")
    pairs = kept.keep(members.groupBy("query_id", "candidate_id").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_HITS).select("query_id", "candidate_id"), "pairs")
    return decide(merge_features(full, scorer(pairs, nodes, queries), queries, budget), policy)


def _reachable(nodes: DataFrame) -> DataFrame:
    """``query_id, node_id, rank, token_count, words, over``: what deciding needs of a question's nodes, and all that stands over them."""
    ranked = nodes.withColumn("rank", rank_of(F.col("level")).cast("int"))
    over = F.array(*[F.struct(F.lit(i).alias("candidate_rank"), ancestor_at_level(name).alias("candidate_id")) for i, name in enumerate(LEVELS)])
    over = F.filter(over, lambda x: x["candidate_id"].isNotNull() & (x["candidate_rank"] > F.col("rank")))
    return ranked.select("query_id", "node_id", "rank", "token_count", T.token_set("text").alias("words"), over.alias("over"))


def closure(own: DataFrame, nodes: DataFrame, reach: DataFrame, kept: Kept) -> tuple[DataFrame, DataFrame]:
    """What a question can reach from its selection, as stored tables: ``(play, pairs)``.

    ``own``: query_id and the columns of :func:`_reachable`, of what is selected; ``reach``: query_id, start, top, the ranks between which the question's
    candidates lie. ``play``: query_id, node_id, rank, token_count, words, of what is selected and what stands over it up to the top. ``pairs``: query_id,
    candidate_id, candidate_rank, node_id, rank, slot (null unless the node is a slot of the candidate), linked (the candidate stands over it by parent links).
    """
    within = (F.col("candidate_rank") > F.col("start")) & (F.col("candidate_rank") <= F.col("top"))
    above = own.join(reach, "query_id").select("query_id", F.explode("over").alias("c"), "top").where(F.col("c.candidate_rank") <= F.col("top")).select("query_id", F.col("c.candidate_id").alias("node_id")).distinct()
    missing = kept.keep(above.join(own.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti"), "missing")  # its size tells how it meets the nodes
    added = _reachable(nodes.where(F.col("level") != LEVELS[0]).join(missing, "node_id"))
    play = kept.keep(own.unionByName(added).join(reach, "query_id"), "play")
    linked = play.select("query_id", "node_id", "rank", F.explode("over").alias("c"), "start", "top").select("query_id", "c.candidate_id", "c.candidate_rank", "node_id", "rank", "start", "top").where(within).select("query_id", "candidate_id", "candidate_rank", "node_id", "rank", F.lit(None).cast("int").alias("slot"), F.lit(True).alias("linked"))
    candidates = play.where((F.col("rank") > F.col("start")) & (F.col("rank") <= F.col("top"))).select("query_id", F.col("node_id").alias("candidate_id"), F.col("rank").alias("candidate_rank"))
    slots = candidates.join(nodes.where(F.size("child_ids") > 0).select(F.col("node_id").alias("candidate_id"), "child_ids"), "candidate_id").select("query_id", "candidate_id", "candidate_rank", F.posexplode("child_ids").alias("slot", "node_id"))
    direct = play.select("query_id", "node_id", "rank").join(slots, ["query_id", "node_id"]).select("query_id", "candidate_id", "candidate_rank", "node_id", "rank", "slot")
    both = linked.unionByName(direct.withColumn("linked", F.lit(False)))
    pairs = both.groupBy("query_id", "candidate_id", "candidate_rank", "node_id", "rank").agg(F.max("slot").alias("slot"), F.max("linked").alias("linked"))
    return play.select("query_id", "node_id", "rank", "token_count", "words"), kept.keep(pairs, "pairs")


def expand_selection(selected: DataFrame, nodes: DataFrame, queries: DataFrame, policy: str = "adaptive", budget: int = BUDGET, scorer=lexical_candidate_scores, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """``(selection, trace)``: members give way to accepted candidates, one level a round, until a question's ceiling, budget, or gain stops it.

    ``selected``: query_id, node_id, score, of leaves or what leaves were merged into. All questions move at once, each at its own
    level: what they can reach and how candidates score is worked out before the first round, and a round joins only these small
    tables. The trace has a row for each question and round: how many merged, or why it stopped. Both results read what the rounds left in the shared folder.
    """
    kept = Kept()
    selection = selected = kept.keep(selected.select("query_id", "node_id", "score"), "selected")
    own = kept.keep(_reachable(nodes.join(selected.select("query_id", "node_id").distinct(), "node_id")), "own")
    rank = lambda level: F.array_position(F.array(*map(F.lit, LEVELS)), level).cast("int") - 1
    ceiling = rank(F.element_at(F.create_map(*[F.lit(x) for kv in CEILING.items() for x in kv]), F.col("query_type")))
    begin = own.groupBy("query_id").agg(F.min("rank").alias("lowest")).join(queries.select("query_id", ceiling.alias("ceiling")), "query_id")
    state = kept.keep(begin.select("query_id", F.greatest(F.lit(0), F.least("lowest", F.col("ceiling") - 1)).alias("start"), "ceiling"), "state")
    play, pairs = closure(own, nodes, state.select("query_id", "start", F.least("ceiling", F.col("start") + depth).alias("top")).distinct(), kept)
    scores = kept.keep(scorer(pairs.select("query_id", "candidate_id").distinct(), nodes, queries).select("query_id", "candidate_id", "token_count", "slots", "candidate_score"), "scores")
    rounds, decisions = [], []
    for round_ in range(depth):
        live = state.where(F.col("start") + round_ < F.col("ceiling")).select("query_id", (F.col("start") + round_ + 1).alias("candidate_rank"))
        for before in rounds:
            live = live.join(before.where("stopped is not null").select("query_id"), "query_id", "left_anti")
        here = selection.join(live, "query_id").join(play, ["query_id", "node_id"])
        used = here.groupBy("query_id").agg(F.sum("token_count").alias("tokens"))
        fits = used.where(F.col("tokens") <= budget * HEADROOM).select("query_id")
        met = here.join(fits, "query_id", "left_semi").join(pairs.drop("rank"), ["query_id", "node_id", "candidate_rank"])
        wanted = met.where("linked").groupBy("query_id", "candidate_id").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_HITS).select("query_id", "candidate_id")
        place = F.row_number().over(Window.partitionBy("query_id", "candidate_id").orderBy(F.asc_nulls_last("slot"), F.desc("score"), "node_id"))
        members = met.where("slot is not null or rank < candidate_rank - 1").join(wanted, ["query_id", "candidate_id"], "left_semi").withColumn("place", place)
        decided = kept.keep(decide(merge_features(members, scores, queries, budget), policy), "decided")
        decisions.append(decided)
        taken = decided.where("accepted")
        sums = decided.groupBy("query_id").agg(F.count("*").alias("candidates"), F.count_if("accepted").alias("merged"), F.sum(F.when(F.col("accepted"), F.greatest(F.lit(0.0), "delta"))).alias("gain"))
        outcome = live.join(used, "query_id").join(sums, "query_id", "left")
        why = F.when(F.col("tokens") > budget * HEADROOM, "token headroom reached").when(F.col("candidates").isNull(), "no candidate with enough members").when(F.col("merged") == 0, "members favoured").when(F.col("gain") < EPSILON, "gain below epsilon")
        rounds.append(kept.keep(outcome.select("query_id", F.lit(round_).alias("round"), F.element_at(F.array(*map(F.lit, LEVELS)), F.col("candidate_rank") + 1).alias("level"), "tokens", F.coalesce("candidates", F.lit(0)).cast("int").alias("candidates"), F.coalesce("merged", F.lit(0)).cast("int").alias("merged"), F.coalesce("gain", F.lit(0.0)).alias("gain"), why.alias("stopped")), "round"))
        gone = taken.select("query_id", F.explode("member_ids").alias("node_id")).unionByName(taken.select("query_id", F.col("candidate_id").alias("node_id"))).distinct()
        selection = selection.join(gone, ["query_id", "node_id"], "left_anti").unionByName(taken.select("query_id", F.col("candidate_id").alias("node_id"), F.col("relevance").alias("score")))
    kept.drop_all_but(selected, *decisions, *rounds)
    return selection, reduce(DataFrame.unionByName, rounds)


def missing_parts(parts: DataFrame, key: str, number: str) -> DataFrame:
    """Expected and missing part numbers from 1 to the largest of each key."""
    have = parts.select(key, number).distinct()
    return have.groupBy(key).agg(F.max(number).cast("long").alias("expected"), (F.max(number) - F.count("*")).cast("long").alias("missing"))


def upload_completeness(sessions: DataFrame, parts: DataFrame) -> DataFrame:
    """``session_id, expected, missing, wrong_size, received_bytes, complete`` of multi-part uploads.

    ``sessions``: session_id, total_bytes, part_bytes; ``parts``: session_id, part_no (from 1), bytes. The last part is what the others leave.
    """
    n = F.ceil(F.col("total_bytes") / F.col("part_bytes")).cast("int")
    each = sessions.withColumn("expected", n).select("session_id", "total_bytes", "expected", F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).alias("part_no"), "part_bytes")
    size = F.when(F.col("part_no") < F.col("expected"), F.col("part_bytes")).otherwise(F.col("total_bytes") - (F.col("expected") - 1) * F.col("part_bytes"))
    met = each.withColumn("due", size).join(parts, ["session_id", "part_no"], "left")
    list_of = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("part_no"))))
    g = met.groupBy("session_id", "total_bytes", "expected").agg(list_of(F.col("bytes").isNull()).alias("missing"), list_of(F.col("bytes") != F.col("due")).alias("wrong_size"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("received_bytes"))
    return g.select("session_id", "expected", "missing", "wrong_size", "received_bytes", ((F.size("missing") == 0) & (F.size("wrong_size") == 0) & (F.col("received_bytes") == F.col("total_bytes"))).alias("complete"))
