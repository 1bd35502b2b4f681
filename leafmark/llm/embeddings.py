"""Embedding near-duplicates with a pivot-permutation index.

A vector is described by its nearest pivots in the order of nearness, as long a prefix of
that permutation as it takes for linked vectors to share pivots. The inverted lists are
kept by pairs of pivots: a vector stands in the list of each pair of its prefix, so two
vectors that share two pivots or more meet in a list. There their exact cosine is taken; a pair
that meets in several lists counts in its first only.

Pivots and nearness are taken beside the vectors' mean. The order tells where the prefix ends; inside it
two vectors are compared by the pivots that they share, not by their places, which gave less recall for equal work.

The number of pivots grows with the square root of the number of vectors, so that the lists
don't; the length of the prefix is fitted to the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, dealt, stored

#: Pivots: half the root of the number of different vectors, within these bounds.
PIVOTS, MOST_PIVOTS = 128, 4096
#: Vectors that pivots are drawn from, at most, for each pivot; every vector is indexed.
SAMPLE = 4
LEAST_SAMPLE = 4096
#: The prefix is the shortest with which sampled pairs and pairs made of sampled vectors, just linked, share two pivots so often.
RECALL, TRIED, PREFIXES = 0.985, 1024, range(3, 25)
#: Pairs of the sample less than this over the threshold count as just linked, if there are so many.
JUST, FEW = 0.02, 50
#: Cosine from which a vector is too like a pivot to be one, below the least that links.
APART = 0.05
BLOCK = 2048
LIST_SCHEMA = "rep long, copies long, vector binary, near binary, lists array<struct<list: long, low: long>>"


def _unit(rows: list[list[float]]) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither squares of large nor of small components leave the doubles
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(vectors: np.ndarray, count: int, alike: float) -> np.ndarray:
    """Spread pivots: each next one is the sampled vector least like those chosen, until all are ``alike`` one of them.

    Vectors close enough to link so have hardly more than one pivot among them, and agree on the others' order.
    """
    chosen = [0]
    like = vectors @ vectors[0]
    while len(chosen) < min(count, len(vectors)) and (len(chosen) < 2 or like.min() < alike):
        chosen.append(int(like.argmin()))
        like = np.maximum(like, vectors @ vectors[chosen[-1]])
    return vectors[chosen]


def nearest(unit: np.ndarray, pivots: np.ndarray, prefix: int, mean: np.ndarray | float = 0.0) -> np.ndarray:
    """The numbers of the ``prefix`` nearest pivots to ``unit - mean``, nearest first, ties by number."""
    d = min(unit.shape[1], pivots.shape[1])
    aside = unit[:, :d] - (mean[:d] if isinstance(mean, np.ndarray) else mean)
    return np.argsort(-(aside @ pivots[:, :d].T), axis=1, kind="stable")[:, :prefix].astype(np.int32)


def centred(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What vectors have beside their mean, as unit vectors, and the mean: what all share tells none of them apart. The cosines that link are of the vectors themselves."""
    mean = vectors.mean(axis=0)
    rest = vectors - mean
    return rest / np.maximum(np.sqrt((rest * rest).sum(axis=1, keepdims=True)), 1e-300), mean


def just_linked(vectors: np.ndarray, least: float, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that just link: made in any direction, made towards other vectors (where real ones lie when the vectors fill few directions), and those that the sample holds."""
    x = vectors[rng.permutation(len(vectors))[:TRIED]]
    for aside in (rng.normal(size=x.shape), vectors[rng.permutation(len(vectors))[:len(x)]] - x):
        aside = aside - (aside * x).sum(axis=1, keepdims=True) * x
        norm = np.sqrt((aside * aside).sum(axis=1, keepdims=True))
        there = norm[:, 0] > 1e-9
        yield x[there], least * x[there] + np.sqrt(max(0.0, 1 - least * least)) * aside[there] / norm[there]
    i, j = np.nonzero(np.triu((near := vectors[:LEAST_SAMPLE] @ vectors[:LEAST_SAMPLE].T) >= least, 1) & (near < least + JUST))
    some = rng.permutation(len(i))[:TRIED]
    if len(some) >= FEW:
        yield vectors[i[some]], vectors[j[some]]


def fit_prefix(vectors: np.ndarray, pivots: np.ndarray, least: float, recall: float = RECALL, mean: np.ndarray | float = 0.0) -> int:
    """The shortest prefix by which every kind of pairs that just link share two pivots in a share ``recall`` of cases, or the longest allowed."""
    longest = min(max(PREFIXES), len(pivots))
    take = min(PREFIXES)
    for x, y in just_linked(vectors, least, np.random.default_rng(0)):
        a, b = nearest(x, pivots, longest, mean), nearest(y, pivots, longest, mean)
        while take < longest and len(a) and ((a[:, :take, None] == b[:, None, :take]).any(axis=2).sum(axis=1) >= 2).mean() < recall:
            take += 1
    return min(take, longest)


def _describe(pivots: np.ndarray, prefix: int, mean: np.ndarray):
    pairs = np.array(list(combinations(range(prefix), 2)), dtype=np.int64).reshape(-1, 2)
    # of each pair: which pivots of the prefix, in ascending order, are below its second, without its first
    below = np.array([[k < j and k != i for k in range(prefix)] for i, j in pairs], bool).reshape(-1, prefix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, copies, rows = (c.to_pylist() for c in batch.columns)
            for width in sorted({len(r) for r in rows}):
                at = [i for i, r in enumerate(rows) if len(r) == width]
                unit = _unit([rows[i] for i in at])
                near = nearest(unit, pivots, prefix, mean)
                low_first = np.sort(near, axis=1).astype(np.int64)
                # vectors of another width never share a list
                lists = (width * len(pivots) + low_first[:, pairs[:, 0]]) * len(pivots) + low_first[:, pairs[:, 1]]
                mixed = (low_first + 1) * np.int64(-7046029254386353131)
                mixed = (mixed ^ (mixed >> 29)) * np.int64(-4658895280553007687)
                low = np.where(below.any(axis=1), mixed @ below.T.astype(np.int64) | 1, 0)
                nested = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * len(pairs), pa.int32()), pa.StructArray.from_arrays([pa.array(lists.ravel()), pa.array(low.ravel())], ["list", "low"]))
                yield pa.RecordBatch.from_arrays([pa.array([reps[i] for i in at], pa.int64()), pa.array([copies[i] for i in at], pa.int64()), pa.array([v.tobytes() for v in unit], pa.binary()), pa.array([n.tobytes() for n in near], pa.binary()), nested], names=["rep", "copies", "vector", "near", "lists"])

    return run


def _met(listed: DataFrame, block: int) -> DataFrame:
    """Rows of ``list, low, rep, ...`` in blocks ``list, lo, hi`` of about ``block`` rows, ``own`` the row's; see :func:`dealt`.

    ``low`` stands for the shared pivots of a list that come before its own (0: none). Rows
    with the same ones have their first common list elsewhere and needn't meet here. The
    most frequent ``low`` of a list, other than 0, so only meets the others: a tight group, which has
    all its lists in common, is compared within itself in the first of them alone.
    """
    each = listed.groupBy("list", "low").agg(F.count("*").alias("n"))
    sizes = each.groupBy("list").agg(F.sum("n").alias("all"), F.max(F.when(F.col("low") != 0, F.struct("n", "low"))).alias("most"))
    most = F.coalesce(F.col("most.n"), F.lit(0))
    sizes = sizes.select("list", (F.col("all") - most).alias("others"), F.col("most.low").alias("same"), F.ceil((F.col("all") - most) / block).cast("int").alias("a"), F.ceil(most / block).cast("int").alias("b")).where("others > 0 and others + b > 1")
    rows = listed.join(sizes, "list").withColumn("is_same", F.coalesce(F.col("low") == F.col("same"), F.lit(False)))
    spread = F.xxhash64("rep")
    own = F.when(F.col("is_same"), F.col("a") + F.pmod(spread, F.greatest("b", F.lit(1)))).otherwise(F.pmod(spread, F.col("a"))).cast("int")
    last = F.when(F.col("is_same"), F.col("a")).otherwise(F.col("a") + F.col("b")) - 1
    blocks = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return blocks.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(least: float, pivots: int):
    """Links within blocks of ``list, lo, hi, rows``; ``pivots`` 0: a list of all vectors, where every pair is first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, lo, hi, rows in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(rows)
                x = np.frombuffer(b"".join(r["vector"] for r in rows)).reshape(n, -1)
                own = np.array([r["own"] for r in rows])
                copies = np.array([r["copies"] for r in rows])
                counted = np.zeros(n, np.int64)
                ii, jj = [], []
                for a in range(0, n, 512):
                    i, j = np.nonzero(x[a:a + 512] @ x.T >= least)
                    i += a
                    keep = (i < j) & ((own[i] != own[j]) if lo != hi else True)
                    ii.append(i[keep])
                    jj.append(j[keep])
                i, j = np.concatenate(ii), np.concatenate(jj)
                first = np.ones(len(i), bool)
                if pivots:
                    # the pair's first common list is this one: of the common pivots only one is below the list's second
                    near = np.frombuffer(b"".join(r["near"] for r in rows), np.int32).reshape(n, -1)
                    for a in range(0, len(i), 100_000):
                        p, q = near[i[a:a + 100_000]], near[j[a:a + 100_000]]
                        common = (p[:, :, None] == q[:, None, :]).any(axis=2)
                        first[a:a + 100_000] = (common & (p < key % pivots)).sum(axis=1) == 1
                np.add.at(counted, i[first], copies[j[first]])
                np.add.at(counted, j[first], copies[i[first]])
                root = _roots(n, i, j)
                linked = np.zeros(n, bool)
                linked[i] = linked[j] = True
                reps = np.array([r["rep"] for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array(reps[linked]), pa.array(reps[root[linked]]), pa.array(counted[linked])], names=["rep", "root", "links"])

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None, prefix: int | None = None, exact: bool = False) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors link at a cosine of ``least`` or more in double precision. Null, empty and zero
    vectors and those with null or non-finite components link with nothing; nor do vectors of
    different widths. Equal vectors are one node with their number of copies, and link with one
    another. Component and kept are by the smallest id; a row with a null id counts as a link of others and has a null component only if all are null.
    An empty table gives no rows.

    ``pivots`` and ``prefix`` are chosen by the vectors unless they are given. With ``exact`` there is no
    index: every block of vectors is compared with every other, so nothing is missed, at a cost that
    grows with the square of their number.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    fine = F.coalesce((F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(fine, F.col("v")))
    # a class without an id is named by its vector's hash, which names no component: see below
    classes = stored(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies")).withColumn("rep", F.coalesce("least_id", F.xxhash64("v"))), "vector-classes")
    known = classes.agg(F.count("*").alias("n"), F.count_if(F.col("least_id").isNull()).alias("nameless")).first()
    count = pivots or min(MOST_PIVOTS, max(PIVOTS, int(known["n"] ** 0.5 / 2)))
    sample = [] if known["n"] < 2 else classes.orderBy(F.xxhash64("v"), "rep").limit(max(LEAST_SAMPLE, SAMPLE * count)).select("v").collect()
    result = rows.join(classes, "v", "left")
    if not sample:  # fewer than two different vectors
        result = result.withColumn("links", F.lit(0)).withColumn("component", F.col("least_id"))
    else:
        width = max(set(lengths := [len(r["v"]) for r in sample]), key=lengths.count)
        unit = _unit([r["v"] for r in sample if len(r["v"]) == width])
        rest, mean = centred(unit)
        chosen = choose_pivots(rest, count, max(0.0, least - APART))
        take = prefix or fit_prefix(unit, chosen, least, mean=mean)
        if exact or len(chosen) < 2:
            described = classes.select("rep", "copies", "v").mapInArrow(_describe(chosen, 1, mean), LIST_SCHEMA)
            blocks = dealt(described.select("rep", "copies", "vector", "near", F.octet_length("vector").cast("long").alias("list")), "list", "rep", BLOCK)
            last = 0
        else:
            described = classes.select("rep", "copies", "v").mapInArrow(_describe(chosen, min(take, len(chosen)), mean), LIST_SCHEMA)
            blocks = _met(described.select("rep", "copies", "vector", "near", F.inline("lists")), BLOCK)
            last = len(chosen)
        groups = blocks.groupBy("list", "lo", "hi").agg(F.collect_list(F.struct("rep", "copies", "vector", "near", "own")).alias("rows"))
        met = stored(groups.mapInArrow(_verify(least, last), "rep long, root long, links long"), "vector-links")
        counts = met.groupBy("rep").agg(F.sum("links").alias("links"))
        found = components(met.select(F.col("rep").alias("a"), F.col("root").alias("b")))
        if known["nameless"]:  # the smallest id of a component, whatever names its nodes
            named = found.join(classes.select(F.col("rep").alias("node"), "least_id"), "node")
            found = named.select("node", F.col("component").alias("root")).join(named.groupBy(F.col("component").alias("root")).agg(F.min("least_id").alias("component")), "root").drop("root")
        result = result.join(counts, "rep", "left").join(found, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "least_id", "vec_id")
    return result.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
