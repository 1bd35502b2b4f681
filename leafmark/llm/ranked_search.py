"""Ranked lexical search by two trees: the best documents of each item, exactly.

A first pass over the documents keeps what items can see of them: their length and how often they
hold each of the items' terms. The search then takes documents in chunks. A chunk is a tree of
documents (chunk, groups of leaves, leaves, documents) and the items are a tree of their own (root,
groups, leaves, items); each node holds the maximum of every coordinate below it: of a term's
weight among items, of a term's share among documents. The product of two nodes' maxima is a bound
for all their pairs. Where it lies under the weakest k-th score of the item node, the whole batch of
pairs is left out, which loses nothing. A sixteenth of the documents goes first, so that the rest
meets k-th scores that are good already.

All figures are integers under 2**53, so that sums in doubles are exact in any order.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Tables, union

#: Items that are searched together; more go in blocks, each against all documents.
BLOCK_ITEMS = 10_000
#: Documents of a chunk and entries (document, term) of a chunk; one document may have more.
CHUNK_DOCS, CHUNK_ENTRIES = 512, 65_536
LEAF_DOCS, GROUP_DOCS, LEAF_ITEMS, GROUP_ITEMS = 16, 128, 16, 8
#: Documents whose hash is 0 modulo this go first.
FIRST_OF = 16
#: A-Z to a-z; ASCII other than letters and digits parts terms, other characters belong to them.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

SEEN = "doc_id long, n long, terms array<int>, tfs array<int>"
HITS = "item int, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


class Node(NamedTuple):
    """A node of the item tree: maxima of weights over its items, by term; a leaf holds its items' weights as a matrix."""

    terms: np.ndarray
    most: np.ndarray
    items: np.ndarray
    below: tuple
    weights: np.ndarray | None


def item_tree(items: list[Counter], weight: np.ndarray) -> Node:
    """Items next to each other share their heaviest term, so that maxima stay close to what each item has."""
    vectors = [{t: n * int(weight[t]) for t, n in c.items()} for c in items]
    order = sorted(range(len(items)), key=lambda i: (max(vectors[i], key=lambda t: (vectors[i][t], t), default=-1), i))
    nodes = []
    for at in range(0, len(order), LEAF_ITEMS):
        own = order[at:at + LEAF_ITEMS]
        terms = np.array(sorted(set().union(*(vectors[i] for i in own))), np.int64)
        place = {int(t): k for k, t in enumerate(terms)}
        weights = np.zeros((len(terms), len(own)))
        for j, i in enumerate(own):
            for t, w in vectors[i].items():
                weights[place[t], j] = w
        nodes.append(Node(terms, weights.max(axis=1, initial=0), np.array(own, np.int64), (), weights))
    while len(nodes) > 1:
        nodes = [_over(nodes[at:at + GROUP_ITEMS]) for at in range(0, len(nodes), GROUP_ITEMS)]
    return nodes[0]


def _over(nodes: list[Node]) -> Node:
    terms, where = np.unique(np.concatenate([n.terms for n in nodes]), return_inverse=True)
    most = np.zeros(len(terms))
    np.maximum.at(most, where, np.concatenate([n.most for n in nodes]))
    return Node(terms, most, np.concatenate([n.items for n in nodes]), tuple(nodes), None)


class Best:
    """The k best documents of each item so far, and the scores under which nothing counts."""

    def __init__(self, k: int, least: np.ndarray) -> None:
        self.k, self.least, self.heaps = k, least.astype(np.float64), [[] for _ in least]

    def offer(self, item: int, scores: np.ndarray, ids: list) -> None:
        heap = self.heaps[item]
        for s, i in zip(scores.tolist(), ids):
            entry = (s, i is not None, -(i or 0))  # of equal scores the smallest id is best, none at all is worst
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.least[item] = max(self.least[item], heap[0][0])

    def found(self) -> list[tuple[int, int | None, int]]:
        return [(item, -i if named else None, int(s)) for item, heap in enumerate(self.heaps) for s, named, i in heap]


def search_chunk(tree: Node, ids: list, shares: np.ndarray, columns: np.ndarray, best: Best) -> None:
    """Offer every pair whose bounds reach the item's k-th score. ``shares``: documents x the terms ``columns``."""
    starts = [np.arange(0, len(ids), LEAF_DOCS), np.arange(0, len(ids), GROUP_DOCS)]
    maxima = [np.maximum.reduceat(shares, at, axis=0) for at in starts]
    column = lambda terms: np.searchsorted(columns, terms).clip(0, len(columns) - 1)

    def visit(node: Node, level: int, members: np.ndarray) -> None:
        at = column(node.terms)
        there = columns[at] == node.terms
        at, most = at[there], node.most[there]
        bounds = maxima[level][np.ix_(members, at)] @ most
        alive = bounds >= max(1.0, best.least[node.items].min())
        if not alive.any():
            return
        members = members[alive][np.argsort(-bounds[alive], kind="stable")]
        if node.below:
            for child in node.below:
                visit(child, level, members)
        elif level:
            for group in members:  # best first: what it gives bounds the next ones
                first = group * (GROUP_DOCS // LEAF_DOCS)
                visit(node, 0, np.arange(first, min(first + GROUP_DOCS // LEAF_DOCS, len(starts[0]))))
        else:
            rows = np.concatenate([np.arange(m * LEAF_DOCS, min((m + 1) * LEAF_DOCS, len(ids))) for m in members])
            scores = shares[np.ix_(rows, at)].astype(np.float64) @ node.weights[there]
            for j, item in enumerate(node.items):
                good = np.flatnonzero(scores[:, j] >= max(1.0, best.least[item]))
                if len(good):
                    best.offer(item, scores[good, j], [ids[r] for r in rows[good]])

    visit(tree, 1, np.arange(len(starts[1])))


def _chunks(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int, weight: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Ids, shares (documents x terms) and terms of a chunk; documents that share their heaviest term stand together."""
    held, entries = [], 0

    def chunk():
        terms, tfs, heavy = [], [], []
        for _, n, t, f in held:
            m = 25 + (75 * n * n_docs) // n_terms
            share = (1_000_000_000 * f) // (1000 * f + 8 * m)
            terms.append(t)
            tfs.append(share)
            heavy.append(int(t[np.argmax(share * weight[t])]))
        order = sorted(range(len(held)), key=lambda i: (heavy[i], held[i][1]))
        columns = np.unique(np.concatenate(terms))
        shares = np.zeros((len(held), len(columns)), np.float32)  # shares are a million at most: exact
        for row, i in enumerate(order):
            shares[row, np.searchsorted(columns, terms[i])] = tfs[i]
        return [held[i][0] for i in order], shares, columns

    for batch in batches:
        ids, ns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        t, f = batch.column(2), batch.column(3)
        at = t.offsets.to_numpy() - t.offsets[0].as_py()
        terms, tfs = t.flatten().to_numpy().astype(np.int64), f.flatten().to_numpy().astype(np.int64)
        for i, n, lo, hi in zip(ids, ns, at[:-1], at[1:]):
            if lo == hi:
                continue
            if held and (len(held) == CHUNK_DOCS or entries + hi - lo > CHUNK_ENTRIES):
                yield chunk()
                held, entries = [], 0
            held.append((i, n, terms[lo:hi], tfs[lo:hi]))
            entries += hi - lo
    if held:
        yield chunk()


def _searched(items: list[Counter], weight: np.ndarray, n_docs: int, n_terms: int, k: int, least: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, best = item_tree(items, weight), Best(k, least)
        for ids, shares, columns in _chunks(batches, n_docs, n_terms, weight):
            search_chunk(tree, ids, shares, columns, best)
        found = best.found()
        columns = list(zip(*found)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["item", "doc_id", "score"])

    return run


def _looked_at(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ns, terms, tfs = [], [], []
                for text in part.column(1).to_pylist():
                    words = terms_of(text)
                    counts = sorted((vocabulary[t], n) for t, n in Counter(words).items() if t in vocabulary)
                    ns.append(len(words))
                    terms.append([t for t, _ in counts])
                    tfs.append([n for _, n in counts])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])

    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each item, of equal scores those with smaller ids.

    A term counts by its rarity among documents and its share of the document, in integers. Every row of ``items`` is
    ranked by itself, repeated ones too, and every row of ``docs`` is a document of its own; a null id comes after all
    others. Null and empty texts have no terms: such documents are never found and don't count, such items get no rows.
    Empty tables give an empty result. Other columns are left behind, whatever their names.
    """
    spark, tables = docs.sparkSession, Tables()
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = []
    for block in range(blocks):
        rows = items.where(part == block).collect()  # BLOCK_ITEMS on average
        counts = [Counter(terms_of(r["text"])) for r in rows]
        rows, counts = [r for r, c in zip(rows, counts) if c], [c for c in counts if c]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        if not counts:
            continue
        own = [Counter({vocabulary[t]: n for t, n in c.items()}) for c in counts]
        seen = tables.stored(docs.mapInArrow(_looked_at(vocabulary), SEEN), "seen")
        sums = seen.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        if not sums["docs"]:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for r in seen.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # a row a term of the block's items
            df[r["t"]] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * sums["docs"] + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        first = F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST_OF)) == 0
        search = lambda side, least: tables.stored(seen.where(side).mapInArrow(_searched(own, weight, sums["docs"], sums["terms"], k, least), HITS), "hits")
        early = search(first, np.zeros(len(own)))
        least = np.zeros(len(own))
        for r in _best(early, k).where(F.col("rank") == k).toLocalIterator():  # a row an item of the block
            least[r["item"]] = r["score"]
        late = search(~first, least)
        tables.drop(seen)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        out.append(_best(early.unionByName(late), k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return union(out) if out else spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
