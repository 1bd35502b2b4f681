"""Ranking leaves for a whole table of questions.

Scores are rounded to nine places before they rank, and ties go to the smaller leaf, so
that the order of sums across partitions never shows. A scope filters before any top-k.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..sources.files import Kept

LEAF = ["doc_id", "pos"]
#: Question vectors held by a task at once.
BLOCK_QUERIES = 2_000


#: Questions whose terms a task holds at once, leaves of a block of the index, blocks after which a task compares what it has found.
TERM_QUERIES, BLOCK_LEAVES, MERGE_EVERY = 500, 512, 8
#: Found rows that a task holds before it keeps the best of them only.
HELD = 2_000_000


def ranked(scores: DataFrame, k: int | None, query: str = "query_id", by: list[str] | None = None, score: str = "score") -> DataFrame:
    """Adds ``rank`` within each question and keeps the first ``k``."""
    w = Window.partitionBy(query).orderBy(F.round(score, 9).desc(), *(by or LEAF))
    out = scores.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k else out


def _best(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of ``query, group, score, doc_id, pos`` the first ``k`` rows of each query and group."""
    query, group, score, doc, pos = found
    order = np.lexsort((pos, doc, -np.round(score, 9), group, query))
    query, group = query[order], group[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(query)), bool), (query[1:] != query[:-1]) | (group[1:] != group[:-1])]))
    place = np.arange(len(query)) - np.repeat(new, np.diff(np.concatenate([new, [len(query)]])))
    order = order[place < k]
    return [x[order] for x in found]


class Index(NamedTuple):
    """An inverted index over leaves, in the shared folder: a row a block of leaves, with the postings of every word of the block.

    A block's numbers are columns of bytes and a file's row groups are small, so that a reader holds some blocks at a time and no list of postings as rows.
    """

    blocks: DataFrame
    n: int
    mean: float
    kept: Kept

    def drop(self) -> None:
        self.kept.drop_all_but()


BLOCK = "doc binary, pos binary, length binary, names array<string>, group binary, starts binary, words binary, held binary, leaf binary, tf binary, n_leaves long, n_words long"
#: Kinds of the numbers in the columns of bytes.
KINDS = {"doc": np.int64, "pos": np.int32, "length": np.int32, "group": np.int32, "starts": np.int64, "held": np.int32, "leaf": np.uint16, "tf": np.int32}
#: Bytes of a row group of an index, compressed, from 100 blocks on: what a reader decodes at once.
GROUP_BYTES = 4 << 20
FOUND = "query_id long, group string, doc_id long, pos int, score double"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of ``BLOCK_LEAVES`` leaves at a time: words, how many leaves hold each, and for each of these the leaf and the times."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_LEAVES):
            some = batch.slice(at, BLOCK_LEAVES)
            lists = some.column(2)
            if pa.types.is_string(lists.type):  # still to be parted at white space
                words = [(t or "").encode().split() for t in lists.to_pylist()]
                length = np.fromiter(map(len, words), np.int64, len(words))
                coded = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode()
            else:
                length = np.diff(lists.offsets.to_numpy())
                coded = lists.flatten().dictionary_encode()
            key, times = np.unique(coded.indices.to_numpy().astype(np.int64) * len(length) + np.repeat(np.arange(len(length)), length), return_counts=True)
            own = coded.dictionary.cast(pa.binary()).to_pylist()
            groups = some.column(3).dictionary_encode(null_encoding="encode")
            numbers = {"doc": some.column(0).to_numpy(), "pos": some.column(1).to_numpy(), "length": length, "group": groups.indices.to_numpy(), "starts": np.cumsum([0, *map(len, own)])}
            numbers |= {"held": np.bincount(key // max(1, len(length)), minlength=len(own)), "leaf": key % max(1, len(length)), "tf": times}
            row = {c: x.astype(KINDS[c]).tobytes() for c, x in numbers.items()} | {"names": groups.dictionary.to_pylist(), "words": b"".join(own), "n_leaves": len(length), "n_words": int(length.sum())}
            kinds = {"names": pa.list_(pa.string()), "n_leaves": pa.int64(), "n_words": pa.int64()}
            names = [c.split()[0] for c in BLOCK.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([row[c]], kinds.get(c, pa.binary())) for c in names], names=names)


def _numbers(batch: pa.RecordBatch, row: int, column: str) -> np.ndarray:
    return np.frombuffer(batch.column(column)[row].as_buffer(), KINDS[column])


def _terms(batch: pa.RecordBatch, row: int, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The number of each word of a block in the vocabulary, -1 for others."""
    starts, words = _numbers(batch, row, "starts").tolist(), batch.column("words")[row].as_py()
    return np.fromiter((vocabulary.get(words[a:b], -1) for a, b in pairwise(starts)), np.int64, len(starts) - 1)


def _frequencies(vocabulary):
    """How many leaves hold each word of the vocabulary: a row a word and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary.value), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                term = _terms(batch, row, vocabulary.value)
                df[term[term >= 0]] += _numbers(batch, row, "held")[term >= 0]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], names=["term", "n"])

    return run


def build_index(leaves: DataFrame, tokens, group: str | None = None) -> Index:
    """Reads the leaves once; any number of questions can be asked afterwards. ``tokens`` gives the words of a text column, or a text that white space parts."""
    kept = Kept()
    rows = leaves.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("pos").cast("int").alias("pos"), tokens("text").alias("tokens"), (F.col(group) if group else F.lit(None)).cast("string").alias("group"))
    blocks = kept.keep(rows.mapInArrow(_blocks, BLOCK), "index", GROUP_BYTES)
    sums = blocks.agg(F.coalesce(F.sum("n_leaves"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).first()
    return Index(blocks, sums["n"], max(1.0, sums["words"] / max(1, sums["n"])), kept)


def _searched(words, block, part, k: int, zeros: bool, grouped: bool):
    """Each task's best ``k`` leaves of every question (and group). A block whose best possible score for a question lies under the question's k-th so far is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, (ids, weights) = words.value, block.value
        least = np.zeros(len(ids))
        groups: dict[str | None, int] = {}
        held: list[list[np.ndarray]] = []
        size = merges = 0
        for batch in batches:
            for row in range(batch.num_rows):
                of = lambda c: _numbers(batch, row, c)  # noqa: B023, E731
                length, counts, term = of("length"), of("held"), _terms(batch, row, vocabulary)
                entry = np.flatnonzero(np.repeat(term >= 0, counts))
                own = term[term >= 0]
                leaf, column = of("leaf")[entry], np.repeat(np.arange(len(own)), counts[term >= 0])
                table = np.zeros((len(length), len(own)))
                table[leaf, column] = part(of("tf")[entry].astype(float), length[leaf])
                asked = np.flatnonzero(table.max(axis=0, initial=0) @ weights[own] + 1e-9 >= least)
                if not len(asked):
                    continue
                scores = table @ weights[np.ix_(own, asked)]
                if grouped:
                    rows, query = np.nonzero(scores > 0)
                    code = np.array([groups.setdefault(g, len(groups)) for g in batch.column("names")[row].as_py()])[of("group")[rows]]
                else:
                    near = np.round(scores, 9)
                    keep = near >= least[asked]
                    if k < len(near):
                        keep &= near >= np.partition(near, len(near) - k, axis=0)[len(near) - k]
                    rows, query = np.nonzero(keep if zeros else keep & (scores > 0))
                    code = np.zeros(len(rows), np.int64)
                held.append(_best([asked[query], code, scores[rows, query], of("doc")[rows], of("pos")[rows].astype(np.int64)], k))
                size, merges = size + len(held[-1][0]), merges + 1
                if size > HELD or merges % MERGE_EVERY == 0:
                    held = [_best([np.concatenate(x) for x in zip(*held)], k)]
                    size = len(held[0][0])
                    if not grouped and size:
                        full, last = np.unique(held[0][0][::-1], return_index=True)
                        enough = np.bincount(held[0][0], minlength=len(ids))[full] == k
                        least[full[enough]] = np.round(held[0][2][::-1][last[enough]], 9)
        if held:
            query, code, score, doc, pos = _best([np.concatenate(x) for x in zip(*held)], k)
            names = list(groups) or [None]
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array([names[c] for c in code], pa.string()), pa.array(doc, pa.int64()), pa.array(pos.astype(np.int32)), pa.array(score)], names=["query_id", "group", "doc_id", "pos", "score"])

    return run


def search_index(index: Index, queries: DataFrame, tokens, weigh, part, k: int, zeros: bool, grouped: bool) -> DataFrame:
    """``query_id, group, doc_id, pos, score``: each task's best ``k`` leaves of every question, in each group if ``grouped``.

    ``weigh(asked, df)`` gives the weights of a block's terms (terms x questions) from how often the questions hold them and how many
    leaves do; ``part(times, length)`` a term's share in a leaf. Questions go in blocks of a bounded number.
    """
    spark = queries.sparkSession
    rows = queries.select("query_id", tokens("text").alias("tokens"))
    blocks, found = -(-rows.count() // TERM_QUERIES), []
    for b in range(blocks):
        some = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").collect()
        vocabulary = {w: i for i, w in enumerate(sorted({w for r in some for w in r["tokens"]}))}
        asked = np.zeros((len(vocabulary), len(some)))
        for q, r in enumerate(some):
            for w in r["tokens"]:
                asked[vocabulary[w], q] += 1
        words = spark.sparkContext.broadcast({w.encode(): i for w, i in vocabulary.items()})
        df = np.zeros(len(vocabulary))
        for r in index.blocks.select("starts", "words", "held").mapInArrow(_frequencies(words), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row a term of the block's questions
            df[r["term"]] = r["n"]
        weighed = spark.sparkContext.broadcast((np.array([r["query_id"] for r in some], np.int64), weigh(asked, df[:, None])))
        found.append(index.blocks.mapInArrow(_searched(words, weighed, part, k, zeros, grouped), FOUND))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], FOUND)


def bm25_tokens(c: str | Column) -> Column:
    return T.spaced_tokens(F.lower(c))


def _asked(leaves: DataFrame | Index, tokens, group: str | None, search) -> DataFrame:
    """What ``search`` finds in an index; one that is built for these questions goes when they are answered."""
    if isinstance(leaves, Index):
        return search(leaves)
    index = build_index(leaves, F.lower if tokens is bm25_tokens else tokens, group)
    found = Kept().keep(search(index), "found")
    index.drop()
    return found


def bm25_found(leaves: DataFrame | Index, queries: DataFrame, k: int, group: str | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``query_id, group, doc_id, pos, score``: each task's best ``k`` leaves for each question, in each group if one is named.

    Document frequency, number and mean length are of all leaves, whatever a scope keeps. A term that a
    question repeats counts as often. Takes leaves, or an index over their texts in lower case.
    """

    def search(index: Index) -> DataFrame:
        weigh = lambda asked, df: asked * (k1 + 1) * np.log(1 + (index.n - df + 0.5) / (df + 0.5))
        mean = index.mean
        return search_index(index, queries, bm25_tokens, weigh, lambda tf, length: tf / (tf + k1 * (1 - b + b * length / mean)), k, group is None, group is not None)

    return _asked(leaves, bm25_tokens, group, search)


def bm25(leaves: DataFrame | Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """The best ``k`` leaves of all for each question; those without a common term fill a short list in their order."""
    return ranked(bm25_found(leaves, queries, k).select("query_id", *LEAF, "score"), k)


def scoped_bm25(leaves: DataFrame, queries: DataFrame, k: int, scope: str = "source") -> DataFrame:
    """The best ``k`` leaves with a common term in every scope for each question: a scope cuts before the ranking."""
    found = bm25_found(leaves, queries, k, scope).withColumnRenamed("group", scope)
    return ranked(found.withColumn("__of", F.struct("query_id", scope)), k, query="__of").drop("__of")


def sparse_topk(leaves: DataFrame | Index, queries: DataFrame, k: int) -> DataFrame:
    """The best ``k`` leaves by the sum over shared content words of (1 + ln times) in both; only leaves with one. Takes leaves, or an index over them by ``content_tokens``."""
    weigh = lambda asked, df: np.where(asked > 0, 1 + np.log(np.maximum(asked, 1)), 0)
    search = lambda index: search_index(index, queries, T.content_tokens, weigh, lambda tf, length: 1 + np.log(tf), k, False, False)
    return ranked(_asked(leaves, T.content_tokens, None, search).select("query_id", *LEAF, "score"), k)


def sparse_weights(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, term, weight``: 1 + ln(times) over content tokens."""
    t = df.select(*keys, F.explode(T.content_tokens("text")).alias("term"))
    return t.groupBy(*keys, "term").agg((1 + F.log(F.count("*"))).alias("weight"))


def sparse_scores(leaf_weights: DataFrame, query_weights: DataFrame) -> DataFrame:
    """Sum over shared terms of the products of stored weights; the questions' weights are the smaller side of the join."""
    q = query_weights.select("query_id", "term", F.col("weight").alias("asked"))
    return leaf_weights.join(q, "term").groupBy("query_id", *LEAF).agg(F.sum(F.col("weight") * F.col("asked")).alias("score"))


def _dense(block, k: int | None, group: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = block.value
        for batch in batches:
            rows = batch.column(1).to_pylist()
            fit = [i for i, r in enumerate(rows) if r and len(r) == q.shape[1] and None not in r]
            if not fit:
                continue
            x = np.array([rows[i] for i in fit], np.float64)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            scores = q @ (x / np.where(norm > 0, norm, 1)).T
            keys = np.array([batch.column(0)[i].as_py() for i in fit])
            if group:  # the best of each group for each question
                kinds, at = np.unique(keys, return_inverse=True)
                best = np.full((len(q), len(kinds)), -np.inf)
                for g in range(len(kinds)):
                    best[:, g] = scores[:, at == g].max(axis=1)
                scores, keys = best, kinds
                top = np.broadcast_to(np.arange(len(kinds)), scores.shape)
            else:
                top = np.lexsort((np.broadcast_to(keys, scores.shape), -np.round(scores, 9)), axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, top.shape[1])), pa.array(keys[top].ravel(), pa.int64()), pa.array(np.take_along_axis(scores, top, axis=1).ravel())], names=["query_id", "vec_id", "score"])

    return run


def _against(vectors: DataFrame, queries: DataFrame, k: int | None, key: str) -> DataFrame:
    """Each question's best rows of every batch of ``vectors``: a stated set of questions against all rows, in blocks of a bounded size."""
    spark = vectors.sparkSession
    rows = queries.where("embedding is not null").select(F.col("vec_id").alias("query_id"), "embedding")
    blocks = -(-rows.count() // BLOCK_QUERIES)
    found = []
    for b in range(blocks):
        some = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").collect()
        q = np.array([r["embedding"] for r in some], np.float64)
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        block = spark.sparkContext.broadcast((np.array([r["query_id"] for r in some], np.int64), q / np.where(norm > 0, norm, 1)))
        found.append(vectors.select(F.col(key).cast("long").alias("vec_id"), "embedding").mapInArrow(_dense(block, k, key != "vec_id"), "query_id long, vec_id long, score double"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, vec_id long, score double")


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Exact cosine top-k: ``query_id, vec_id, score, rank``; each task hands on k rows a question and batch."""
    return ranked(_against(vectors, queries, k, "vec_id"), k, by=["vec_id"])


def maxsim(vectors: DataFrame, queries: DataFrame, group: str = "label") -> DataFrame:
    """Late interaction between groups of vectors: mean over a question group's vectors of the best product with the leaf group's."""
    best = _against(vectors, queries, None, group).groupBy("query_id", "vec_id").agg(F.max("score").alias("best"))
    owner = queries.select(F.col("vec_id").alias("query_id"), F.col(group).alias("query_group"))
    return best.join(owner, "query_id").groupBy("query_group", F.col("vec_id").alias("leaf_group")).agg(F.avg("best").alias("score"))


def min_max(value: Column, w) -> Column:
    """Scaled to 0..1 over the window; 1 for all if constant."""
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(value.isNull(), 0.0).when(hi - lo < 1e-9, 1.0).otherwise((value - lo) / (hi - lo))


def weighted_fusion(dense: DataFrame, sparse: DataFrame, late: DataFrame, weights: tuple[float, float, float] = (0.40, 0.25, 0.35)) -> DataFrame:
    """Weighted sum of scaled signals; dense over its hits only (0 elsewhere), the others over all candidates."""
    keys, total = ["query_id", *LEAF], sum(weights)
    cand = dense.select(*keys).unionByName(sparse.select(*keys)).distinct()
    named = lambda df, n: df.select(*keys, F.col("score").alias(n))
    all_ = cand.join(named(dense, "d"), keys, "left").join(named(sparse, "s"), keys, "left").join(named(late, "l"), keys, "left")
    w = Window.partitionBy("query_id")
    score = (weights[0] * min_max(F.col("d"), w) + weights[1] * min_max(F.coalesce("s", F.lit(0.0)), w) + weights[2] * min_max(F.coalesce("l", F.lit(0.0)), w)) / total
    return all_.select(*keys, score.alias("score"))


def rrf(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists."""
    both = reduce(DataFrame.unionByName, [x.select("query_id", *LEAF, "rank") for x in lists])
    return both.groupBy("query_id", *LEAF).agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def agreement(pairs: DataFrame, k: int = 60) -> DataFrame:
    """Fuses the order by pair score with that by similarity; the i-th leaf takes the i-th highest pair score.

    ``pairs``: query_id, leaf, pair_score, similarity; a missing similarity is an error.
    """
    checked = pairs.withColumn("similarity", F.when(F.col("similarity").isNull(), F.raise_error(F.lit("no similarity for a leaf")).cast("double")).otherwise(F.col("similarity")))
    w = lambda *o: Window.partitionBy("query_id").orderBy(*o, *LEAF)
    both = checked.withColumn("by_pair", F.row_number().over(w(F.round("pair_score", 9).desc()))).withColumn("by_similarity", F.row_number().over(w(F.round("similarity", 9).desc())))
    fused = both.withColumn("fused", F.round(1 / (k + F.col("by_pair")) + 1 / (k + F.col("by_similarity")), 12)).withColumn("rank", F.row_number().over(w(F.col("fused").desc())))
    scores = fused.select("query_id", F.col("by_pair").alias("rank"), F.col("pair_score").alias("score"))
    return fused.select("query_id", *LEAF, "rank").join(scores, ["query_id", "rank"])


def route(leaves: DataFrame, queries: DataFrame, fused: DataFrame, scope: str = "source", limit: int = 600, pool: int = 80) -> DataFrame:
    """All leaves of a question's scopes if they are at most ``limit``, else the first ``pool`` of the fused list in them; ``queries``: query_id and scope.

    Scopes are counted by themselves, so that no large one is laid out for each of its questions.
    """
    sizes = leaves.groupBy(scope).agg(F.count("*").alias("size"))
    scoped = queries.select("query_id", scope).distinct().join(sizes, scope).withColumn("n", F.sum("size").over(Window.partitionBy("query_id")))
    small = leaves.join(scoped.where(F.col("n") <= limit).select("query_id", scope), scope).select("query_id", *LEAF, F.lit("all").alias("route"))
    within = fused.join(scoped.where(F.col("n") > limit).select("query_id", scope), "query_id").join(leaves.select(*LEAF, scope), [*LEAF, scope], "left_semi")
    large = ranked(within, pool).select("query_id", *LEAF, F.lit("fused").alias("route"))
    return small.unionByName(large)


def lexical_scores(pool: DataFrame, leaves: DataFrame, queries: DataFrame) -> DataFrame:
    """The default pair scorer, token overlap, and density as ``similarity``, for the leaves of a pool."""
    q = queries.select("query_id", T.token_set("text").alias("q"))
    held = pool.join(leaves.select(*LEAF, "text"), LEAF).withColumn("t", T.content_tokens("text")).drop("text")  # words of the pool's leaves only
    return held.join(q, "query_id").select("query_id", *LEAF, T.overlap(F.col("q"), F.col("t")).alias("pair_score"), T.density(F.col("q"), F.col("t")).alias("similarity"))


def rerank(hits: DataFrame, leaves: DataFrame, queries: DataFrame, k: int = 24) -> DataFrame:
    """The first ``k`` hits in the order of the pair scorer, earlier rank first on ties."""
    pool = hits.where(F.col("rank") <= k)
    scored = lexical_scores(pool.select("query_id", *LEAF), leaves, queries).join(pool.select("query_id", *LEAF, F.col("rank").alias("before")), ["query_id", *LEAF])
    w = Window.partitionBy("query_id").orderBy(F.round("pair_score", 9).desc(), "before")
    return scored.select("query_id", *LEAF, F.col("pair_score").alias("score"), F.row_number().over(w).alias("rank"))


def section_units(hits: DataFrame, unit: str = "doc_id", best: int = 2) -> DataFrame:
    """Leaves in the order of their units' means of the best ``best`` leaf scores, then their own."""
    w = Window.partitionBy("query_id", unit).orderBy(F.round("score", 9).desc(), *LEAF)
    top = hits.withColumn("place", F.row_number().over(w))
    mean = top.where(F.col("place") <= best).groupBy("query_id", unit).agg(F.avg("score").alias("unit_score"))
    out = hits.join(mean, ["query_id", unit]).withColumn("emitted", F.col("unit_score") + 1e-6 * F.col("score"))
    order = Window.partitionBy("query_id").orderBy(F.round("unit_score", 9).desc(), F.round("score", 9).desc(), *LEAF)
    return out.select("query_id", *LEAF, F.col("emitted").alias("score"), F.row_number().over(order).alias("rank"))


def document_units(leaves: DataFrame, unit: str = "doc_id") -> DataFrame:
    """``unit, text, members``: one long unit a document, its leaves in order and parted by blank lines."""
    held = leaves.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("l"))
    return held.select(unit, F.array_join(F.transform("l", lambda x: x["text"]), "\n\n").alias("text"), F.transform("l", lambda x: x["pos"]).alias("members"))


def unit_maxsim(chunks: DataFrame, queries: DataFrame, unit: str, k: int, members: DataFrame) -> DataFrame:
    """``query_id, unit_id, leaf_id, score``: all leaves of the ``k`` units whose best chunk is nearest to the question. ``members``: unit_id, leaf_id."""
    best = _against(chunks, queries, None, unit).groupBy("query_id", F.col("vec_id").alias("unit_id")).agg(F.max("score").alias("score"))
    return ranked(best, k, by=["unit_id"]).join(members, "unit_id").select("query_id", "unit_id", "leaf_id", "score")


def fixed_context(gold: DataFrame) -> DataFrame:
    """Given leaves in document order as a ranking: ``rank`` and a ``utility`` that falls with it; no retrieval metric applies to it."""
    w = Window.partitionBy("query_id")
    placed = gold.withColumn("rank", F.row_number().over(w.orderBy(*LEAF)))
    return placed.withColumn("utility", F.count("*").over(w) - F.col("rank") + 1)


def run_variants(lists: dict[str, DataFrame], variants: DataFrame, k: int, damp: int = 60) -> DataFrame:
    """``variant, query_id, leaf, score, rank``: systems that switch shared ranked lists on and off and fuse what is on.

    ``variants`` (some rows): variant, signal, weight. The lists are made once, whatever the number of variants.
    """
    shared = reduce(DataFrame.unionByName, [x.select(F.lit(name).alias("signal"), "query_id", *LEAF, "rank") for name, x in lists.items()])
    on = shared.join(F.broadcast(variants.where("weight > 0")), "signal")
    fused = on.groupBy("variant", "query_id", *LEAF).agg(F.sum(F.col("weight") / (damp + F.col("rank"))).alias("score"))
    return ranked(fused.withColumn("__of", F.struct("variant", "query_id")), k, query="__of").drop("__of")


def _nearness(centres):
    """``cluster, sentence, near``: the cosine of each sentence's vector and its cluster's centre, 0 where either has no length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v, c = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1), centres.value[batch.column(0).to_numpy()]
                length = np.sqrt((v * v).sum(axis=1) * (c * c).sum(axis=1))
                near = np.divide((v * c).sum(axis=1), length, out=np.zeros(len(v)), where=length > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], names=["cluster", "sentence", "near"])

    return run


def summary_tree_light(leaves: DataFrame, size: int = 4, depth: int = 3, most: int = 256, features: int = 1024, sentences: int = 5, words: int = 220, seed: int = 42) -> DataFrame:
    """``depth, summary_id, text, members``: clusters of texts by TF-IDF and k-means, level by level, each with its sentences nearest to the centre.

    There are as many clusters as give ``size`` texts each, ``most`` at most, so that a level's cost grows with its texts only.
    ``leaves``: node_id, text; members are leaves.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF
    from pyspark.ml.functions import vector_to_array

    kept = Kept()
    tf = HashingTF(inputCol="words", outputCol="tf", numFeatures=features)
    counted = lambda df, text: tf.transform(df.withColumn("words", T.content_tokens(text))).drop("words")
    items = leaves.select("text", F.array("node_id").alias("members"))
    levels: list[DataFrame] = []
    for level in range(depth):
        items = kept.keep(counted(items, "text"), "texts")  # fitting reads the counts many times
        n = items.count()
        if n <= size:
            break
        weigh = IDF(inputCol="tf", outputCol="x").fit(items)
        model = KMeans(k=max(1, min(most, -(-n // size))), featuresCol="x", predictionCol="cluster", seed=seed + level, maxIter=10).fit(weigh.transform(items.select("tf")))
        labelled = kept.keep(model.transform(weigh.transform(items)).select("text", "members", "cluster"), "labelled")
        parts = labelled.select("cluster", F.explode(T.sentences("text")).alias("sentence"))
        # at most ``most`` centres
        centres = leaves.sparkSession.sparkContext.broadcast(np.array([c.tolist() for c in model.clusterCenters()]))
        near = weigh.transform(counted(parts, "sentence")).select("cluster", "sentence", vector_to_array("x").alias("v"))
        scored = near.mapInArrow(_nearness(centres), "cluster int, sentence string, near double").select("cluster", "sentence", F.round("near", 9).alias("near"), F.size(T.spaced_tokens("sentence")).alias("n"))
        first = scored.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("near").desc(), "sentence"))).where(F.col("place") <= 2 * sentences)
        held = first.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("place", "sentence", "n"))).alias("s"))
        start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("picked"))

        def pick(acc: Column, x: Column) -> Column:
            fits = (F.size(acc["picked"]) < sentences) & ((F.size(acc["picked"]) == 0) | (acc["used"] + x["n"] <= words))
            return F.struct((acc["used"] + F.when(fits, x["n"]).otherwise(0)).alias("used"), F.when(fits, F.array_append(acc["picked"], x["sentence"])).otherwise(acc["picked"]).alias("picked"))

        text = F.array_join(F.aggregate("s", start, pick, lambda acc: acc["picked"]), " ")
        members = labelled.groupBy("cluster").agg(F.flatten(F.collect_list("members")).alias("members"))
        made = members.join(held, "cluster", "left").select(F.lit(level).alias("depth"), F.format_string(f"d{level}-c%d", "cluster").alias("summary_id"), F.coalesce(text, F.lit("")).alias("text"), "members")
        made = kept.keep(made, "summaries")
        levels.append(made)
        items = made.select("text", "members")
    return reduce(DataFrame.unionByName, levels) if levels else leaves.sparkSession.createDataFrame([], "depth int, summary_id string, text string, members array<string>")


def soft_clusters(vectors: DataFrame, dims: int = 10, counts: tuple[int, ...] = (2, 4, 8, 16, 32), least: float = 0.1, seed: int = 224) -> DataFrame:
    """``node_id, cluster, probability``: overlapping clusters of a Gaussian mixture on ``dims`` principal components; the number of clusters by the least BIC.

    A node is in every cluster with more than ``least`` of its probability, or in the most probable one.
    """
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.where("embedding is not null").select("node_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    small = PCA(k=dims, inputCol="v", outputCol="x").fit(rows).transform(rows).select("node_id", "x")
    n, best = small.count(), None
    for k in counts:
        model = GaussianMixture(k=k, featuresCol="x", seed=seed, maxIter=30).fit(small)
        bic = -2 * model.summary.logLikelihood + k * (1 + dims + dims * (dims + 1) / 2) * float(np.log(max(n, 2)))
        if best is None or bic < best[0]:
            best = (bic, model)
    found = best[1].transform(small).select("node_id", "prediction", F.posexplode(vector_to_array("probability")).alias("cluster", "probability"))
    return found.where((F.col("probability") > least) | (F.col("cluster") == F.col("prediction"))).select("node_id", "cluster", F.round("probability", 6).alias("probability"))
