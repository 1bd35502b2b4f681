"""Summary trees: layers of overlapping clusters in each paper, and searches over summaries and leaves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..sources.files import Kept, spread_by

DIMS, LEAST, LIMIT, LAYERS, MOST_CLUSTERS = 10, 0.1, 3500, 5, 50


def hashed_vector(c: str | Column, dims: int = 64) -> Column:
    """Content tokens counted by hash: the vector of a text where no encoder is given."""
    at = F.transform(T.content_tokens(c), lambda w: F.pmod(F.xxhash64(w), F.lit(dims)))
    # as a lambda's argument the tokens are found once, not once a dimension
    return F.get(F.transform(F.array(at), lambda a: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (F.size(a) - F.size(F.array_remove(a, i.cast("long")))).cast("double"))), F.lit(0))


def first_sentences(texts: Column, words: int = 220) -> Column:
    """The first sentence of each text, as many whole ones as ``words`` allow, the first one always: the summary where no generator is given."""
    first = F.filter(F.transform(texts, lambda x: F.get(T.sentences(x), F.lit(0))), lambda s: s.isNotNull())
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("said"))

    def add(acc: Column, s: Column) -> Column:
        n = acc["n"] + F.size(T.spaced_tokens(s))
        fits = (F.size(acc["said"]) == 0) | (n <= words)
        return F.struct(F.when(fits, n).otherwise(acc["n"]).alias("n"), F.when(fits, F.array_append(acc["said"], s)).otherwise(acc["said"]).alias("said"))

    return F.array_join(F.aggregate(first, start, add, lambda acc: acc["said"]), " ")


def _principal(x: np.ndarray, dims: int) -> np.ndarray:
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    keep = max(1, min(dims, len(x) - 2, int((s > 1e-9 * max(s[0], 1e-300)).sum())))
    return u[:, :keep] * s[:keep]


def _mixture(x: np.ndarray, centres: list[int], rounds: int = 50, tolerance: float = 1e-4) -> tuple[float, np.ndarray]:
    """``(BIC, probabilities)`` of Gaussians that share their variances, one a dimension, so that none can shrink to a point; begun at the given rows."""
    (n, d), k = x.shape, len(centres)
    spread, square = x.var(axis=0), (x ** 2).mean(axis=0)
    floor = 1e-9 + 1e-2 * spread.mean()
    mean, var, share, before = x[centres], spread + floor, np.full(k, 1 / k), -np.inf
    for _ in range(rounds):
        # what a row's clusters have in common, its own square, is added to the likelihood only
        m = mean / var
        logs = x @ m.T
        logs += np.log(share) - 0.5 * (m * mean).sum(axis=1)
        top = logs.max(axis=1, keepdims=True)
        logs -= top
        p = np.exp(logs, out=logs)
        total = p.sum(axis=1, keepdims=True)
        p /= total
        likelihood = float(top.sum() + np.log(total).sum()) - 0.5 * n * float((np.log(2 * np.pi * var) + square / var).sum())
        if likelihood - before < tolerance * n:
            break
        weight, before = p.sum(axis=0) + 1e-9, likelihood
        share, mean = weight / weight.sum(), p.T @ x / weight[:, None]
        var = np.maximum(square - share @ mean ** 2, floor)
    return -2 * likelihood + (k * d + d + k - 1) * np.log(n), p


def _far_apart(x: np.ndarray, k: int) -> Iterator[list[int]]:
    """One, two and up to ``k`` different rows: that nearest to the mean, then each time the one farthest from those taken."""
    taken = [int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())]
    away = ((x - x[taken[0]]) ** 2).sum(axis=1)
    yield taken
    while len(taken) < k and away.max() > 0:
        taken = [*taken, int(away.argmax())]
        away = np.minimum(away, ((x - x[taken[-1]]) ** 2).sum(axis=1))
        yield taken


def _clusters(x: np.ndarray, dims: int, least: float) -> list[np.ndarray]:
    """Places in each cluster, on principal components; the number of clusters by the least BIC, looked for until it has risen three times running."""
    if len(x) <= 2:
        return [np.arange(len(x))]
    small, best, worse = _principal(x, dims), None, 0
    for starts in _far_apart(small, min(MOST_CLUSTERS, len(x) - 1)):
        bic, p = _mixture(small, starts)
        best, worse = ((bic, p), 0) if best is None or bic < best[0] else (best, worse + 1)
        if worse == 3:
            break
    p = best[1]
    member = (p > least) | (np.arange(p.shape[1]) == p.argmax(axis=1)[:, None])
    return [np.flatnonzero(c) for c in member.T if c.any()]


def soft_groups(x: np.ndarray, tokens: np.ndarray, dims: int = DIMS, least: float = LEAST, limit: int = LIMIT) -> list[np.ndarray]:
    """Overlapping groups in two stages, those over ``limit`` tokens cut again; where clusters no longer part a group, its halves along the first component do."""
    groups, open_ = [], [c[inner] for c in _clusters(x, dims, least) for inner in _clusters(x[c], dims, least)]
    while open_:
        g = open_.pop()
        if tokens[g].sum() <= limit or len(g) == 1:
            groups.append(g)
            continue
        parts = [g[c] for c in _clusters(x[g], dims, least)]
        if max(map(len, parts)) == len(g):
            parts = np.array_split(g[np.argsort(_principal(x[g], 1)[:, 0], kind="stable")], 2)
        open_ += parts
    return [np.array(g) for g in sorted({tuple(sorted(g.tolist())) for g in groups})]


def soft_summary_trees(leaves: DataFrame, encoder: Callable[[Column], Column] = hashed_vector, generator: Callable[[Column], Column] = first_sentences, dims: int = DIMS, least: float = LEAST, limit: int = LIMIT, layers: int = LAYERS) -> DataFrame:
    """``paper_id, node_id, layer, text, tokens, vector, children, members``: for all papers at once, layer upon layer of summaries of overlapping clusters.

    ``leaves``: paper_id, node_id, text. A paper whose layer has no more than ``dims + 1`` nodes gets no further one, nor does one whose layer
    would not be smaller; there are ``layers`` at most. Vectors and token counts of one paper's layer are what a task holds; texts are
    summarized by ``generator`` (of an array of texts in the order of node ids) and encoded by Spark. ``members`` are leaves.
    """
    kept = Kept()
    shaped = lambda df: df.withColumn("tokens", T.token_estimate("text")).withColumn("vector", encoder(F.col("text")))
    kind = leaves.schema["paper_id"].dataType.simpleString()

    def grouped(table: pa.Table) -> pa.Table:
        table = table.sort_by("node_id").combine_chunks()
        vectors = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        found = soft_groups(vectors.reshape(table.num_rows, -1), table.column("tokens").to_numpy(), dims, least, limit) if table.num_rows > dims + 1 else []
        if len(found) >= table.num_rows:
            found = []
        at = np.concatenate([np.zeros(0, np.int64), *found])
        cluster = np.repeat(np.arange(len(found), dtype=np.int32), [len(g) for g in found])
        return pa.table({"paper_id": table.column("paper_id").take(at), "cluster": pa.array(cluster, pa.int32()), "node_id": table.column("node_id").take(at)})

    base = spread_by(leaves, "paper_id", "node_id").select("paper_id", F.col("node_id").cast("string").alias("node_id"), F.lit(0).alias("layer"), F.coalesce("text", F.lit("")).alias("text"))
    level = kept.keep(shaped(base).withColumn("children", F.array().cast("array<string>")).withColumn("members", F.array("node_id")), "layer")
    all_ = [level]
    for layer in range(1, layers + 1):
        held = spread_by(level.select("paper_id", "node_id", "tokens", "vector"), "paper_id").groupBy("paper_id").applyInArrow(grouped, f"paper_id {kind}, cluster int, node_id string")
        of = F.array_sort(F.collect_list(F.struct("node_id", "text", "members")))
        made = spread_by(held.join(level.select("paper_id", "node_id", "text", "members"), ["paper_id", "node_id"]), "paper_id", "cluster").groupBy("paper_id", "cluster").agg(of.alias("of"))
        summary = made.select(
            "paper_id", F.concat_ws("/", "paper_id", F.lit(f"s{layer}"), "cluster").alias("node_id"), F.lit(layer).alias("layer"), generator(F.col("of.text")).alias("text"), F.col("of.node_id").alias("children"),
            F.array_sort(F.array_distinct(F.flatten("of.members"))).alias("members"),
        )
        level = kept.keep(shaped(summary).select(*level.columns), "layer")
        if level.isEmpty():
            break
        all_.append(level)
    out = all_[0]
    for more in all_[1:]:
        out = out.unionByName(more)
    return out


def collapsed_search(scores: DataFrame, nodes: DataFrame, k: int, budget: int = LIMIT, most: int = 10) -> DataFrame:
    """``query_id, leaf_id, score, rank``: of all nodes of a tree by score, those that fit the budget, ``most`` at most, opened to their leaves; the first ``k`` leaves as first seen.

    ``scores``: query_id, node_id, score; ``nodes``: node_id, tokens, members in order. The first node is taken whatever its size; one that
    doesn't fit is passed over, and of the best ``max(4 * most, 20)`` none comes later.
    """
    by_score = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "node_id")
    top = scores.select("query_id", "node_id", "score", F.row_number().over(by_score).alias("place")).where(F.col("place") <= max(4 * most, 20)).join(nodes.select("node_id", "tokens", "members"), "node_id")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("taken"))

    def take(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["taken"]) < most) & ((F.size(acc["taken"]) == 0) | (acc["used"] + x["tokens"] <= budget))
        return F.struct((acc["used"] + F.when(fits, x["tokens"].cast("long")).otherwise(0)).alias("used"), F.when(fits, F.array_append(acc["taken"], x["place"])).otherwise(acc["taken"]).alias("taken"))

    sizes = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "tokens"))).alias("by_place"))
    picked = sizes.select("query_id", F.explode(F.aggregate("by_place", start, take, lambda acc: acc["taken"])).alias("place"))
    opened = top.join(picked, ["query_id", "place"]).select("query_id", "place", "score", F.posexplode("members").alias("pos", "leaf_id"))
    first = opened.groupBy("query_id", "leaf_id").agg(F.min(F.struct("place", "pos", "score")).alias("seen"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("seen")))
    return ranked.where(F.col("rank") <= k).select("query_id", "leaf_id", F.col("seen.score").alias("score"), "rank")


def summary_search(leaf_hits: DataFrame, scores: DataFrame, summaries: DataFrame, k: int, damp: int = 60, scope: DataFrame | None = None) -> DataFrame:
    """``query_id, leaf_id, score, rank``: the ranked leaves fused with the leaves of the best summaries, as first seen, by reciprocal ranks.

    ``leaf_hits``: query_id, leaf_id, rank; ``scores``: query_id, summary_id, score; ``summaries``: summary_id, members in order; ``scope``: query_id,
    leaf_id that may be found. Summaries are opened until ``max(k, 100)`` leaves are seen; as many ranked ones take part. Ties go to the ranked leaf, then to the earlier one.
    """
    depth = max(k, 100)
    of_query = Window.partitionBy("query_id")
    placed = scores.withColumn("place", F.row_number().over(of_query.orderBy(F.round("score", 9).desc(), "summary_id")))
    opened = placed.join(summaries.select("summary_id", F.posexplode("members").alias("pos", "leaf_id")), "summary_id").select("query_id", "leaf_id", "place", "pos")
    hits = leaf_hits.select("query_id", "leaf_id", F.col("rank").alias("a"))
    if scope is not None:
        opened, hits = (x.join(scope.select("query_id", "leaf_id").distinct(), ["query_id", "leaf_id"], "left_semi") for x in (opened, hits))
        hits = hits.withColumn("a", F.row_number().over(of_query.orderBy("a")))
    first = opened.groupBy("query_id", "leaf_id").agg(F.min(F.struct("place", "pos")).alias("seen"))
    order = of_query.orderBy("seen.place")
    seen_before = F.coalesce(F.count("*").over(order.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    through = first.withColumn("before", seen_before).where(F.col("before") < depth).select("query_id", "leaf_id", F.row_number().over(of_query.orderBy("seen")).alias("b"))
    both = hits.where(F.col("a") <= depth).join(through, ["query_id", "leaf_id"], "full")
    score = F.coalesce(1 / (damp + F.col("a")), F.lit(0.0)) + F.coalesce(1 / (damp + F.col("b")), F.lit(0.0))
    best = of_query.orderBy(F.round("score", 12).desc(), F.col("a").asc_nulls_last(), "b")
    return both.withColumn("score", score).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "leaf_id", "score", "rank")
