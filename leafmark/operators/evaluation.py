"""Retrieval, answer, calibration and paired statistics over tables of runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..sources.files import Kept


def retrieval_metrics(runs: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """Per question and k: recall, precision, hit rate, and nDCG; and the reciprocal rank.

    ``runs``: query_id, item, rank; ``gold``: query_id, item, relevance > 0. Precision divides by
    the items returned if fewer than k; zero denominators give 0.
    """
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("relevance").desc()))
    ideal = gold.withColumn("place", best).where(F.col("place") <= max(ks)).groupBy("query_id").agg(F.sort_array(F.collect_list("relevance"), asc=False).alias("ideal"))
    graded = gold.groupBy("query_id").agg(F.count("*").alias("n_gold")).join(ideal, "query_id")
    return judged_metrics(runs.join(gold, ["query_id", "item"], "left"), graded, ks)


def judged_metrics(judged: DataFrame, graded: DataFrame, ks: list[int]) -> DataFrame:
    """The same from what was retrieved and counts: nothing of a large gold has to be gathered.

    ``judged``: query_id, item, rank, relevance (null: not gold); ``graded``: query_id, n_gold, ideal (the highest relevances in order, as many as the largest k at least if there are).
    """
    joined = judged.join(graded, "query_id", "left")
    gain = lambda rel, rank: (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)
    at_k = joined.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("rank") <= F.col("k"))
    sums = at_k.groupBy("query_id", "k").agg(
        F.count("*").alias("n"), F.count("relevance").alias("hits"), F.sum(gain(F.coalesce("relevance", F.lit(0.0)), F.col("rank"))).alias("dcg"), F.first("n_gold").alias("n_gold"), F.first("ideal").alias("ideal")
    )
    first = joined.where("relevance is not null").groupBy("query_id").agg((1 / F.min("rank")).alias("rr"))
    ideal = F.aggregate(F.transform(F.expr("slice(ideal, 1, k)"), lambda r, i: gain(r, i + 1)), F.lit(0.0), lambda s, x: s + x)
    return sums.join(first, "query_id", "left").select(
        "query_id", "k", (F.col("hits") / F.greatest(F.lit(1), F.coalesce("n_gold", F.lit(0)))).alias("recall"), (F.col("hits") / F.greatest(F.lit(1), "n")).alias("precision"),
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit"), F.coalesce(F.try_divide(F.col("dcg"), ideal), F.lit(0.0)).alias("ndcg"), F.coalesce("rr", F.lit(0.0)).alias("rr"),
    )


def citation_prf(predicted: DataFrame, supported: DataFrame, key: str = "query_id", item: str = "item") -> DataFrame:
    """Precision, recall and F1 on the sets of cited and supported items."""
    p, s = predicted.select(key, item).distinct().withColumn("p", F.lit(1)), supported.select(key, item).distinct().withColumn("s", F.lit(1))
    n = p.join(s, [key, item], "full").groupBy(key).agg(F.count("p").alias("np"), F.count("s").alias("ns"), F.count(F.when(F.col("p").isNotNull() & F.col("s").isNotNull(), 1)).alias("both"))
    return prf_of_counts(n, key)


def prf_of_counts(n: DataFrame, key: str = "query_id") -> DataFrame:
    """The same from the numbers of cited, supported and shared items ``np, ns, both``."""
    precision, recall = F.col("both") / F.greatest(F.lit(1), "np"), F.col("both") / F.greatest(F.lit(1), "ns")
    return n.select(key, precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))


def paragraph_evidence_f1(predicted: Column, reference: Column) -> Column:
    """Overlap of two lists as sets, divided by the lists' lengths; 1 if both are empty."""
    return f1_of_counts(F.size(F.array_intersect(predicted, reference)), F.size(predicted), F.size(reference))


def f1_of_counts(both: Column, predicted: Column, reference: Column) -> Column:
    """The same from the numbers of shared, predicted and reference items: nothing of a large reference has to be gathered."""
    return F.when((predicted == 0) & (reference == 0), 1.0).when(both == 0, 0.0).otherwise(2.0 * (both / predicted) * (both / reference) / (both / predicted + both / reference))


def answer_scores(pairs: DataFrame, key: list[str], prediction: str, reference: str) -> DataFrame:
    """Exact match and token F1 of normalized answers, the best over a key's references."""
    p, r = T.normalize_squad_answer(prediction), T.normalize_squad_answer(reference)
    return pairs.groupBy(*key).agg(F.max((p == r).cast("double")).alias("em"), F.max(T.token_f1(T.spaced_tokens(p), T.spaced_tokens(r))).alias("f1"))


def running_sums(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds for each name the running sum within the group, the own row included, and ``<name>_all``, the group's total.

    Rows are dealt by ranges of group and order and written down, so a group of any size lies over many tasks: each range sums
    by itself and starts from what the ranges before it hold. ``order`` should leave no ties. Null groups are groups.
    """
    spark, names = df.sparkSession, list(sums)
    rows = df.select("*", *[c.alias(f"__own_{n}") for n, c in sums.items()])
    spread = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *group, *order).withColumn("__range", F.spark_partition_id())
    kept = Kept().keep(spread, "ranges")
    per = kept.groupBy(*group, "__range").agg(*[F.sum(f"__own_{n}").alias(n) for n in names])
    whole = Window.partitionBy(*group)
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(*[F.col(g).alias(f"__of_{g}") for g in group], F.col("__range").alias("__at"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__start_{n}") for n in names], *[F.sum(n).over(whole).alias(f"{n}_all") for n in names])
    here = Window.partitionBy(*group, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = kept.select("*", *[F.sum(f"__own_{n}").over(here).alias(f"__here_{n}") for n in names])
    same = F.col("__range") == F.col("__at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    return own.join(starts, same).select(*df.columns, *[(F.col(f"__start_{n}") + F.col(f"__here_{n}")).alias(n) for n in names], *[f"{n}_all" for n in names])


def _curve(df: DataFrame, group: list[str], correct: str, order: list[Column]) -> DataFrame:
    """The rows with ``i`` from 1, ``i_all`` and ``risk`` = 1 - running mean of ``correct``."""
    hits = {"i": F.lit(1), "__hits": F.coalesce(F.col(correct), F.lit(0)), "__known": F.col(correct).isNotNull().cast("int")}
    return running_sums(df, group, order, hits).withColumn("risk", 1 - F.try_divide(F.col("__hits"), F.col("__known")))


def risk_coverage(df: DataFrame, group: list[str], correct: str, confidence: str, tie: str) -> DataFrame:
    """Points of the risk-coverage curve: rows by falling confidence, risk = 1 - running mean of ``correct``."""
    rows = df.select(*dict.fromkeys([*group, correct, confidence, tie]))
    return _curve(rows, group, correct, [F.col(confidence).desc(), F.col(tie)]).select(*group, "i", (F.col("i") / F.col("i_all")).alias("coverage"), "risk")


def selective(df: DataFrame, group: list[str], correct: str, confidence: str, tie: str, target: float = 0.5) -> DataFrame:
    """Area under the risk-coverage curve, its excess over the best order, and accuracy at the target coverage."""
    rows = df.select(*dict.fromkeys([*group, correct, confidence, tie]))
    taken = F.col("i") <= F.greatest(F.lit(1), F.bround(F.lit(min(1.0, max(0.01, target))) * F.col("i_all")))
    own = _curve(rows, group, correct, [F.col(confidence).desc(), F.col(tie)]).groupBy(*group).agg(F.avg("risk").alias("aurc"), F.avg(F.when(taken, F.col(correct))).alias("selective_accuracy"))
    best = _curve(rows.drop(confidence) if confidence not in (correct, tie, *group) else rows, group, correct, [F.col(correct).desc(), F.col(tie)]).groupBy(*group).agg(F.avg("risk").alias("best"))
    return own.join(best, group).select(*group, "aurc", (F.col("aurc") - F.col("best")).alias("e_aurc"), "selective_accuracy")


def latency_stats(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean, upper median, 95th percentile by nearest rank, and maximum. Null values rank first and count as rows."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("__m"))
    r = running_sums(counts, group, [F.col(value)], {"__upto": F.col("__m")})
    at = lambda k: F.max(F.when((F.col("__upto") >= k) & (F.col("__upto") - F.col("__m") < k), F.col(value)))
    n = F.col("__upto_all")
    return r.groupBy(*group).agg(
        (F.sum(F.col(value) * F.col("__m")) / F.sum(F.when(F.col(value).isNotNull(), F.col("__m")))).alias("mean_ms"), at(F.floor(n / 2) + 1).alias("p50_ms"),
        at(F.greatest(F.lit(1), F.ceil(0.95 * n))).alias("p95_ms"), F.max(value).alias("max_ms"),
    )


def adaptive_utility(score: Column, tokens: Column, latency_ms: Column) -> Column:
    return score - 0.00002 * tokens - 0.00001 * latency_ms


def macro_average(df: DataFrame, group: list[str]) -> DataFrame:
    """Mean of each numeric and boolean column, nulls left out."""
    plain = {"int", "bigint", "smallint", "tinyint", "double", "float", "boolean"}
    columns = [c for c, kind in df.dtypes if c not in group and (kind in plain or kind.startswith("decimal"))]
    return df.groupBy(*group).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])


def calibration(df: DataFrame, group: list[str], p: str, y: str, bins: int = 10) -> DataFrame:
    """Brier score, expected calibration error over equal bins, and rank AUC with half weight for ties."""
    b = df.withColumn("bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)))
    total = Window.partitionBy(*group)
    per = b.groupBy(*group, "bin").agg(F.count("*").alias("m"), F.avg(F.col(y).cast("double")).alias("acc"), F.avg(p).alias("conf"), F.sum(F.pow(F.col(p) - F.col(y), 2)).alias("sq"))
    per = per.withColumn("n", F.sum("m").over(total))
    scores = per.groupBy(*group).agg((F.sum("sq") / F.first("n")).alias("brier"), F.sum(F.col("m") / F.col("n") * F.abs(F.col("acc") - F.col("conf"))).alias("ece"))
    # average ranks from counts by value: rows with one value never meet in one place
    values = df.groupBy(*group, p).agg(F.count("*").alias("m"), F.sum(F.col(y).cast("long")).alias("pos"))
    upto = running_sums(values, group, [F.col(p)], {"__upto": F.col("m")})
    ranks = upto.withColumn("rank", F.col("__upto") - F.col("m") + (F.col("m") + 1) / 2).groupBy(*group).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("n1"), (F.sum("m") - F.sum("pos")).alias("n0"))
    auc = ranks.select(*group, F.try_divide(F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n0")).alias("auc"))
    return scores.join(auc, group)


def crc_threshold(losses: DataFrame, alpha: float, bound: float = 1.0) -> DataFrame:
    """The smallest threshold whose corrected mean loss is at most ``alpha``, infinity if none; ``losses``: unit, lambda, loss."""
    by = losses.groupBy("lambda").agg(F.avg("loss").alias("mean"), F.count("loss").alias("n"))
    fine = (F.col("n") / (F.col("n") + 1) * F.col("mean") + bound / (F.col("n") + 1)) <= alpha
    return by.agg(F.coalesce(F.min(F.when(fine, F.col("lambda"))), F.lit(float("inf"))).alias("threshold"))


def threshold_report(pairs: DataFrame, grid: list[float], p: str, y: str) -> DataFrame:
    """Precision and recall at each threshold."""
    g = pairs.withColumn("threshold", F.explode(F.array(*map(F.lit, grid)))).withColumn("yes", F.col(p) >= F.col("threshold"))
    tp, said, true = F.count_if(F.col("yes") & (F.col(y) == 1)), F.count_if("yes"), F.count_if(F.col(y) == 1)
    return g.groupBy("threshold").agg(tp.alias("true_positives"), F.try_divide(tp, said).alias("precision"), F.try_divide(tp, true).alias("recall"))


def pivot_report(df: DataFrame, system: str, metric: str, value: str, metrics: list[str], places: int = 4) -> DataFrame:
    """One row a system, one rounded column a metric."""
    return df.groupBy(system).pivot(metric, metrics).agg(F.round(F.avg(value), places))


def pair_runs(a: DataFrame, b: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Inner join of two systems' rows where both metrics are there: keys, cluster, diff."""
    left = a.where(F.col(metric).isNotNull()).select(*keys, "cluster", F.col(metric).alias("first"))
    right = b.where(F.col(metric).isNotNull()).select(*keys, F.col(metric).alias("second"))
    return left.join(right, keys).withColumn("diff", F.col("first") - F.col("second"))


def cluster_means(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("cluster").agg(F.avg("diff").alias("mean"), F.count("*").alias("n"))


def effect_size(diffs: DataFrame) -> DataFrame:
    """Mean of the cluster means and its ratio to their sample deviation."""
    m = cluster_means(diffs)
    return m.agg(F.avg("mean").alias("mean"), F.coalesce(F.try_divide(F.avg("mean"), F.stddev_samp("mean")), F.lit(0.0)).alias("d_z"))


def sign_flip(diffs: DataFrame, exact_clusters: int = 16) -> DataFrame:
    """Exact two-sided sign-flip test on cluster means: every sign pattern of at most ``exact_clusters`` clusters.

    Each pattern is a number whose bits are the signs; patterns and clusters meet in one small join.
    """
    m = cluster_means(diffs).withColumn("bit", F.row_number().over(Window.orderBy("cluster")) - 1)
    n = m.count()
    if n > exact_clusters:
        raise ValueError(f"{n} clusters: use sampled signs")
    signs = diffs.sparkSession.range(1 << n).withColumnRenamed("id", "pattern")
    flipped = signs.join(F.broadcast(m)).groupBy("pattern").agg(F.avg(F.when(F.expr("(shiftright(pattern, cast(bit as int)) & 1) = 1"), -F.col("mean")).otherwise(F.col("mean"))).alias("x"))
    seen = m.agg(F.avg("mean").alias("observed"))
    return flipped.join(F.broadcast(seen)).agg((F.count_if(F.abs("x") >= F.abs("observed") - 1e-12) / F.count("*")).alias("p_value"))


def cluster_sign_flip(diffs: DataFrame, null: float = 0.0, alternative: str = "two-sided", iterations: int = 20_000, seed: int = 42, exact_clusters: int = 16) -> DataFrame:
    """``p_value`` of the paired sign-flip test over clusters' sums: all patterns of up to ``exact_clusters`` clusters, else ``iterations`` of hashed signs and the observed one.

    ``diffs``: cluster, diff. A pattern's bits, or a hash of iteration and cluster, are the signs; tasks hand on
    sums by pattern.
    """
    sums = diffs.groupBy("cluster").agg(F.sum(F.col("diff") - null).alias("v"), F.count("*").alias("n"))
    total = sums.agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    if not total["n"]:
        return diffs.sparkSession.createDataFrame([(1.0,)], "p_value double")
    observed, exact = total["v"] / total["n"], total["m"] <= exact_clusters
    if exact:
        # at most 16 rows
        bits = {r["cluster"]: i for i, r in enumerate(sums.select("cluster").orderBy("cluster").collect())}
        bit = F.element_at(F.create_map(*[F.lit(x) for kv in bits.items() for x in kv]), F.col("cluster"))
        patterns = F.sequence(F.lit(0), F.lit((1 << total["m"]) - 1))
        flipped = sums.withColumn("bit", bit).select("v", "bit", F.explode(patterns).alias("pattern")).withColumn("s", F.expr("if((shiftright(pattern, bit) & 1) = 1, -v, v)"))
    else:
        flipped = sign_sums(sums, "cluster", "v", iterations, seed)
    x = flipped.groupBy("pattern").agg((F.sum("s") / F.lit(float(total["n"]))).alias("x"))
    far = F.col("x") >= observed - 1e-12 if alternative == "greater" else F.abs("x") >= abs(observed) - 1e-12
    more = 0 if exact else 1
    return x.agg(((F.count_if(far) + more) / (F.count("*") + more)).alias("p_value"))


# Odd multipliers under 2**63 of the counter hash, so that SQL can take the same products in 128 bits.
KEY_STEP, ROUND_STEP, MIX = 0x1E3779B97F4A7C15, 0x3F58476D1CE4E5B9, 0x14D049BB133111EB


def counter_hash(keys: np.ndarray, rounds: np.ndarray, seed: int) -> np.ndarray:
    """64 mixed bits for each round and key: a product, a fold and a product, modulo 2**64."""
    z = keys.astype(np.int64).view(np.uint64)[None, :] * np.uint64(KEY_STEP) + (rounds.astype(np.uint64) * np.uint64(ROUND_STEP) + np.uint64(seed))[:, None]
    z ^= z >> np.uint64(30)
    z *= np.uint64(MIX)
    z ^= z >> np.uint64(27)
    z *= np.uint64(MIX)
    return z


def sign_sums(rows: DataFrame, key: str, value: str, iterations: int, seed: int) -> DataFrame:
    """``pattern, s``: parts of the sum of ``value`` under each iteration's signs; a sign is the top bit of a hash of iteration and ``key`` (of its own hash, unless it is an integer).

    A task makes the signs of its rows for all iterations as matrices and hands on one row with its sums, so that no row is ever repeated; parts
    of one pattern are to be added.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rounds = np.zeros(iterations), np.arange(1, iterations + 1)
        for batch in batches:
            keys, values = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for at in range(0, len(keys), 128):
                up = counter_hash(keys[at:at + 128], rounds, seed) >> np.uint64(63)
                total += (1.0 - 2.0 * up) @ values[at:at + 128]
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

    number = F.col(key).cast("long") if rows.schema[key].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64(key)
    known = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(number, F.col(value).cast("double"))
    return known.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("pattern", "s"))


def paired_permutation(diffs: DataFrame, iterations: int = 10_000, seed: int = 42) -> DataFrame:
    """``p_value`` of the row form: hashed signs for every row in every iteration, the observed one included. ``diffs``: row_key, diff; 1 without rows."""
    seen = diffs.agg(F.count("diff").alias("n"), F.sum("diff").alias("v")).first()
    if not seen["n"]:
        return diffs.sparkSession.createDataFrame([(1.0,)], "p_value double")
    x = sign_sums(diffs, "row_key", "diff", iterations, seed).groupBy("pattern").agg((F.sum("s") / seen["n"]).alias("x"))
    return x.agg(((F.count_if(F.abs("x") >= abs(seen["v"] / seen["n"]) - 1e-12) + 1) / (F.count("*") + 1)).alias("p_value"))


def cluster_bootstrap(diffs: DataFrame, iterations: int = 2000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """``low, high``: percentile interval of the mean where whole clusters are drawn, each weighed by its rows.

    A draw of an iteration is a hashed number of a cluster; clusters are numbered by their order. ``diffs``: cluster, diff.
    """
    sums = diffs.groupBy("cluster").agg(F.sum("diff").alias("v"), F.count("*").alias("n"))
    m = sums.count()
    if not m:
        return diffs.sparkSession.createDataFrame([(0.0, 0.0)], "low double, high double")
    numbered = _numbered(sums)
    draws = diffs.sparkSession.range(iterations * m).select(F.expr(f"id div {m}").alias("iteration"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(m)).alias("i"))
    times = draws.groupBy("iteration", "i").agg(F.count("*").alias("times"))
    means = times.join(numbered, "i").groupBy("iteration").agg((F.sum(F.col("v") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("mean"))
    return means.agg(F.percentile("mean", alpha / 2).alias("low"), F.percentile("mean", 1 - alpha / 2).alias("high"))


def _numbered(sums: DataFrame) -> DataFrame:
    """Rows of ``cluster, v, n`` with numbers ``i`` from 0 in the order of clusters: partitions of a sorted table, and their sizes before them."""
    rows = sums.orderBy("cluster").withColumn("__id", F.monotonically_increasing_id())
    part = F.expr("shiftright(__id, 33)")
    sizes = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    before, at = [], 0
    for p in sorted(sizes):
        before.append((int(p), at))
        at += sizes[p]
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for pb in before for x in pb]), part)
    return rows.select((offset + F.expr("__id & 8589934591")).alias("i"), "v", "n")


def split_by_group(df: DataFrame, key: str, ratios: tuple[float, float, float] = (0.7, 0.1, 0.2), seed: int = 42) -> DataFrame:
    """Adds ``split``: train, calibration or test, so that no group straddles two; groups lie in the order of a hash of seed and name.

    Numbers of groups are the ratios' shares of all, rounded half to even, the rest is test. Groups are numbered by partitions of a
    sorted table, in no single task. Rows without a group have no split.
    """
    groups = df.select(F.col(key).alias("cluster_name")).where("cluster_name is not null").distinct()
    numbered = _numbered(groups.select(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("cluster_name").cast("string"))).alias("cluster"), F.col("cluster_name").alias("v"), F.lit(1).alias("n")))
    total = groups.count()
    train = round(total * ratios[0])
    split = F.when(F.col("i") < train, "train").when(F.col("i") < train + round(total * ratios[1]), "calibration").otherwise("test")
    return df.join(numbered.select(F.col("v").alias(key), split.alias("split")), key, "left")


def non_inferiority(diffs: DataFrame, margin: float, alpha: float = 0.05, iterations: int = 2000, seed: int = 42) -> DataFrame:
    """``margin, p_value, one_sided_lower, non_inferior``: the sign-flip test against a loss of ``margin``, and the lower end of the interval."""
    p = cluster_sign_flip(diffs, null=-margin, alternative="greater", seed=seed)
    low = cluster_bootstrap(diffs, iterations, seed, 2 * alpha).select(F.col("low").alias("one_sided_lower"))
    return p.join(low).select(F.lit(margin).alias("margin"), "p_value", "one_sided_lower", (F.col("p_value") < alpha).alias("non_inferior"))  # one row each


def compare(a: DataFrame, b: DataFrame, keys: list[str], metric: str, margin: float | None = None, seed: int = 42) -> DataFrame:
    """One row on two systems: questions, clusters, mean difference, interval, p-value, effect size, and non-inferiority if a margin is given."""
    diffs = pair_runs(a, b, keys, metric)
    whole = diffs.agg(F.count("*").alias("questions"), F.count_distinct("cluster").alias("clusters"), F.coalesce(F.avg("diff"), F.lit(0.0)).alias("mean_diff"))
    out = whole.join(cluster_bootstrap(diffs, seed=seed)).join(cluster_sign_flip(diffs, seed=seed)).join(effect_size(diffs).select("d_z"))  # one row each
    if margin is None:
        return out
    return out.join(non_inferiority(diffs, margin, seed=seed).select("margin", F.col("p_value").alias("non_inferiority_p"), "one_sided_lower", "non_inferior"))


def holm(tests: DataFrame, name: str = "test", p: str = "p") -> DataFrame:
    """Step-down adjusted p-values."""
    w = Window.orderBy(p, name)
    n = tests.count()
    step = tests.withColumn("i", F.row_number().over(w)).withColumn("raw", F.least(F.lit(1.0), F.col(p) * (n - F.col("i") + 1)))
    return step.select(name, p, F.max("raw").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("adjusted"))


def bootstrap_means(values: DataFrame, group: list[str], value: str, iterations: int = 200, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the mean by the Poisson bootstrap: each row gets a hashed Poisson(1) weight in each iteration.

    One pass with partial sums, whatever the number of rows; a row needs no index and no group is gathered.
    """
    u = F.pmod(F.xxhash64(F.lit(seed), "iteration", F.col("row_key")), F.lit(1 << 30)) / float(1 << 30)
    cuts, p, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += p
        cuts.append(total)
        p /= k + 1
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    w = values.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(iterations)))).withColumn("w", weight)
    means = w.groupBy(*group, "iteration").agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("mean"))
    return means.groupBy(*group).agg(F.percentile("mean", F.lit(alpha / 2)).alias("low"), F.percentile("mean", F.lit(1 - alpha / 2)).alias("high"))


def provenance_accuracy(citations: DataFrame, gold_pages: DataFrame) -> DataFrame:
    """``query_id, provenance``: the share of citations whose source and pages meet a gold page; null without citations.

    ``citations``: query_id, citation_id, source, page_start, page_end; ``gold_pages``: query_id, source, page.
    """
    met = citations.join(gold_pages, ["query_id", "source"], "left").groupBy("query_id", "citation_id").agg(F.coalesce(F.bool_or(F.col("page").between(F.col("page_start"), F.col("page_end"))), F.lit(False)).alias("ok"))
    return met.groupBy("query_id").agg(F.avg(F.col("ok").cast("double")).alias("provenance"))


def evidence_density(evidence: DataFrame, context: DataFrame) -> DataFrame:
    """``query_id, density``: tokens of the cited evidence over those of the whole context."""
    e = evidence.groupBy("query_id").agg(F.sum("tokens").alias("cited"))
    c = context.groupBy("query_id").agg(F.sum("tokens").alias("shown"))
    return c.join(e, "query_id", "left").select("query_id", F.coalesce(F.col("cited") / F.greatest(F.lit(1), "shown"), F.lit(0.0)).alias("density"))


def risk_curve_checks(losses: DataFrame) -> DataFrame:
    """``lambda, mean, monotone``: whether the mean loss never rises with the threshold; ``losses``: unit, lambda, loss (NaN counts as none)."""
    by = losses.where(~F.isnan("loss")).groupBy("lambda").agg(F.avg("loss").alias("mean"))
    return by.withColumn("monotone", F.coalesce(F.col("mean") <= F.lag("mean").over(Window.orderBy("lambda")) + 1e-12, F.lit(True)))  # a grid's rows


def clustered_auc(df: DataFrame, cluster: str, p: str, y: str, iterations: int = 200, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """``low, high`` of the rank AUC where whole clusters are drawn: Poisson weights a cluster and iteration, one pass over counts by value."""
    counts = df.groupBy(cluster, p).agg(F.count("*").alias("m"), F.sum(F.col(y).cast("long")).alias("pos"))
    u = F.pmod(F.xxhash64(F.lit(seed), "iteration", F.col(cluster)), F.lit(1 << 30)) / float(1 << 30)
    cuts, term, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += term
        cuts.append(total)
        term /= k + 1
    drawn = counts.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(iterations)))).withColumn("w", sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))).where("w > 0")
    v = drawn.groupBy("iteration", p).agg(F.sum(F.col("m") * F.col("w")).alias("m"), F.sum(F.col("pos") * F.col("w")).alias("pos"))
    below = F.sum("m").over(Window.partitionBy("iteration").orderBy(p)) - F.col("m")
    r = v.withColumn("rank", below + (F.col("m") + 1) / 2).groupBy("iteration").agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("n1"), (F.sum("m") - F.sum("pos")).alias("n0"))
    auc = r.select(F.try_divide(F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n0")).alias("auc")).where("auc is not null")
    return auc.agg(F.percentile("auc", alpha / 2).alias("low"), F.percentile("auc", 1 - alpha / 2).alias("high"))


def benchmark_rows(answers: DataFrame, retrieval: DataFrame, citations: DataFrame) -> DataFrame:
    """One row a question: answer, retrieval and citation metrics side by side, correct where F1 is 0.35 or more and some gold was found, and the leaf sets.

    ``answers``: query_id, system, em, f1, latency_ms, tokens; ``retrieval``: query_id, recall, precision, mrr, ndcg; ``citations``: query_id,
    cited array, retrieved array, gold array.
    """
    j = answers.join(retrieval, "query_id", "left").join(citations, "query_id", "left")
    size = lambda c: F.size(F.array_distinct(c))
    hit = F.size(F.array_intersect("cited", "gold"))
    p, r = F.try_divide(hit, F.nullif(size("cited"), F.lit(0))), F.try_divide(hit, F.nullif(size("gold"), F.lit(0)))
    j = j.withColumn("citation_precision", p).withColumn("citation_recall", r)
    return j.withColumn("citation_f1", F.try_divide(2 * p * r, p + r)).withColumn("correct", (F.col("f1") >= 0.35) & (F.coalesce("recall", F.lit(0.0)) > 0)).withColumn("kept_ids", F.array_sort(F.array_intersect("cited", "retrieved"))).withColumn("rescued_ids", F.array_sort(F.array_intersect(F.array_except("cited", "retrieved"), "gold"))).withColumn("drift_ids", F.array_sort(F.array_except(F.array_except("cited", "retrieved"), "gold")))


def train_merge_policy(rollouts: DataFrame, features: list[str], label: str = "label", gap: str = "gap", group: str = "paper", margin: float = 0.02, seed: int = 42, least_auc: float = 0.60) -> tuple[object, DataFrame]:
    """``(model, manifest)``: a small network on rollouts whose gap is clear, held against papers left out; accepted if its AUC and the interval's low end pass.

    ``rollouts``: features as doubles, label 0 or 1, gap, group. A fifth of the groups, by hash, is left out. One row of manifest: rows, AUC, interval, accepted, a hash of what it learned from.
    """
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    clear = rollouts.where(F.abs(gap) > margin)
    rows = VectorAssembler(inputCols=features, outputCol="__x").transform(clear.withColumn("label", F.col(label).cast("double")))
    aside = F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(5)) == 0
    model = MultilayerPerceptronClassifier(layers=[len(features), 16, 2], featuresCol="__x", labelCol="label", seed=seed, maxIter=60).fit(rows.where(~aside))
    scored = model.transform(rows.where(aside)).select(group, F.col("label").cast("int").alias("y"), vector_to_array("probability")[1].alias("p"))
    auc = calibration(scored.withColumn("one", F.lit(1)), ["one"], "p", "y").select("auc", "brier", "ece")
    ci = clustered_auc(scored, group, "p", "y", seed=seed)
    digest = clear.agg(F.count("*").alias("rows"), F.sha2(F.sum(F.xxhash64(*features, label).cast("decimal(38,0)")).cast("string"), 256).alias("data_sha256"))
    manifest = digest.join(auc, F.lit(True), "left").join(ci, F.lit(True), "left").withColumn("accepted", F.coalesce((F.col("auc") > least_auc) & (F.col("low") > 0.5), F.lit(False)))  # one row each
    return model, manifest
