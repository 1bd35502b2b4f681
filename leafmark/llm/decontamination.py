"""Benchmark decontamination: seeds of word pairs, then Smith-Waterman alignment.

Each test item is a query against all documents. An alignment of score ``least`` matches so many
words with so few edits that between most matched words that follow each other there is one
edit at most: those are pairs of the item's words, next to each other or one apart, that are so
in the document too. The pairs that the documents hold seldom are seeds, all but so few that an
alignment always keeps some of them; where enough seeds lie within the reach of one alignment,
the item is aligned with the passage around them, so that no alignment is missed. An item of fewer
than ``SHORT`` words is too short to be told from chance after an edit, and must stand in the document word for word. Two passes
read the documents: one counts the items' pairs, one aligns. Items are taken in blocks of a bounded number, so that what the tasks hold doesn't
grow with the benchmark; each block is held against all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import union

#: Zeros after each text, so that no pair crosses its end.
APART = 2
BLOCK_ITEMS = 10_000
#: Items of fewer words match as whole sequences of words only.
SHORT = 8
#: Cells of an alignment's matrix row that are held together.
CELLS = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST = 0.5
WORD_BYTES = bytes.maketrans(bytes(range(65, 91)) + bytes(c for c in range(33, 127) if not chr(c).isalnum()), bytes(range(97, 123)) + b" " * 32)
#: Characters of scripts without spaces between words; each is a word.
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff])")
HITS = "doc_id long, item_id long, similarity double, first_word int, last_word int"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words; ASCII punctuation is white space, and a character of a script without spaces a word."""
    if text and not text.isascii():
        text = UNSPACED.sub(r" \1 ", text)
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Items:
    """A block of test items, their word pairs and, once chosen, their seeds."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        texts = [(i, words_of(t)) for i, t in rows]
        self.ids = [i for i, w in texts if w]
        self.words = [w for _, w in texts if w]
        vocabulary = sorted({w for item in self.words for w in item})
        self.vocabulary = {w: k + 1 for k, w in enumerate(vocabulary)}
        self.coded = [np.array([self.vocabulary[w] for w in item], np.int64) for item in self.words]
        # words that are an item by themselves are seeds of their own
        self.alone = np.zeros(len(vocabulary) + 1, bool)
        self.alone[[int(c[0]) for c in self.coded if len(c) == 1]] = True
        pairs = [p for c in self.coded for p in self.pairs(c)]
        self.keys = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.keys = self.keys[self.keys >= 0]

    def pairs(self, coded: np.ndarray) -> list[np.ndarray]:
        """The pair of the word at each place and the next one, and that with the one after it, as one number; -1 where a word is not of the items.

        Where there are items of one word, their words too, as pairs with nothing.
        """
        base = len(self.vocabulary) + 1
        after = np.concatenate([coded, np.zeros(APART, np.int64)])
        single = [np.where(self.alone[coded], coded * base, -1)] if self.alone.any() else []
        return single + [np.where((coded > 0) & (after[k:k + len(coded)] > 0), coded * base + after[k:k + len(coded)], -1) for k in range(1, APART + 1)]

    def code(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts as numbers (0: not of the items), with zeros after each text, and where texts begin."""
        get = self.vocabulary.get
        parts, begins, at = [], [], 0
        for t in texts:
            w = words_of(t)
            parts.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
            parts.append(np.zeros(APART, np.int64))
            begins.append(at)
            at += len(w) + APART
        return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(begins + [at], np.int64)

    def find(self, keys: np.ndarray, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the given (sorted) pairs, and which they are."""
        found = []
        for pairs in self.pairs(coded):
            places = np.flatnonzero(pairs >= 0)
            if not len(keys) or not len(places):
                continue
            p = pairs[places]
            at = np.minimum(np.searchsorted(keys, p), len(keys) - 1)
            hit = keys[at] == p
            found.append((places[hit], at[hit]))
        return tuple(np.concatenate(f) for f in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def choose_seeds(self, frequency: dict[int, int], least: float) -> None:
        """Seeds of each item, and how many of them an alignment of score ``least`` holds.

        With m words matched and x edits, 2 m - x >= 2 least L; at most x / 2 of the m - 1 steps from one
        matched word to the next have two edits or more, so least L - 1 steps have fewer, and each of them begins
        at a place of its own. Of that many the half may be places that are no seeds: those whose pairs are the most frequent.
        """
        count = np.array([frequency.get(k, 0) for k in range(len(self.keys))], np.int64)
        self.least = np.array([1.0 if len(c) < SHORT else least for c in self.coded])
        seeds, needed = [], []
        for item, coded in enumerate(self.coded):
            of = [(np.searchsorted(self.keys, p[p >= 0]), np.flatnonzero(p >= 0)) for p in self.pairs(coded)[-APART if len(coded) > 1 else 0:]]
            cost = np.zeros(max(1, len(coded) - 1), np.int64)
            for which, place in of:
                cost[place] += count[which]
            steps = max(1, int(np.ceil(self.least[item] * len(coded) - 1 - 1e-9)))
            need = -(-steps // 2)
            seed = np.ones(len(cost), bool)
            seed[np.argsort(cost, kind="stable")[len(cost) - (steps - need):]] = False
            needed.append(need)
            # a pair that no document holds finds nothing
            seeds += {(int(w), item) for which, place in of for w, p in zip(which, place) if seed[p] and count[w]}
        table = np.array(sorted(seeds), np.int64).reshape(-1, 2)
        self.seed_keys, first = np.unique(table[:, 0], return_index=True)
        self.seed_keys = self.keys[self.seed_keys]
        self.seed_from = np.concatenate([first, [len(table)]])
        self.seed_item = table[:, 1]
        self.needed = np.array(needed, np.int64)
        # an alignment's passage is no longer than all words of the item and the edits that its score allows
        self.reach = np.array([int(np.floor((3 - 2 * t) * len(c) + 1e-9)) for c, t in zip(self.coded, self.least)], np.int64)


def align(item: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of one item with each row of ``passages``: best scores, and where in the passage the best alignment begins and ends.

    All passages advance together, a row of the matrix at a time; gaps along the
    passage by a running maximum. Beginnings are carried along with the scores.
    """
    rows, width = passages.shape
    slope = np.arange(width + 1) * -GAP
    score = np.zeros((rows, width + 1), np.int64)
    origin = np.broadcast_to(np.arange(width + 1), score.shape).copy()
    best, begin, end = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    # score and origin in one number, so that the maxima carry both along; a later beginning wins a tie
    pack = width + 2
    for w in item:
        diagonal = (score[:, :-1] + np.where(passages == w, MATCH, MISMATCH)) * pack + origin[:, :-1]
        above = (score[:, 1:] + GAP) * pack + origin[:, 1:]
        fresh = np.arange(1, width + 1)[None, :]
        both = np.maximum(np.maximum(diagonal, above), fresh)
        both = np.concatenate([np.zeros((rows, 1), np.int64), both], axis=1)
        both = np.maximum.accumulate(both + slope * pack, axis=1) - slope * pack
        both[:, 1:] = np.maximum(both[:, 1:], fresh)
        score, origin = both // pack, both % pack
        at = score.argmax(axis=1)
        top = score[np.arange(rows), at]
        better = top > best
        best = np.where(better, top, best)
        begin = np.where(better, origin[np.arange(rows), at], begin)
        end = np.where(better, at, end)
    return best, begin, end


def matches(items: Items, texts: list[str | None]) -> list[tuple[int, int, float, int, int]]:
    """``(text, item, similarity, first word, last word)`` of all texts that hold an item to the index's least score or more."""
    coded, begins = items.code(texts)
    place, seed = items.find(items.seed_keys, coded)
    if not len(place):
        return []
    times = items.seed_from[seed + 1] - items.seed_from[seed]
    of = np.repeat(items.seed_from[seed], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    item, place = items.seed_item[of], np.repeat(place, times)
    # places by item, enough of them within one alignment's reach; both pairs of a place count once
    item, place = np.unique(np.stack([item, place], axis=1), axis=0).T
    doc = np.searchsorted(begins, place, side="right") - 1
    last = np.arange(len(place)) + items.needed[item] - 1
    inside = np.flatnonzero(last < len(place))
    last = last[inside]
    inside = inside[(item[last] == item[inside]) & (doc[last] == doc[inside]) & (place[last] - place[inside] < items.reach[item[inside]])]
    if not len(inside):
        return []
    item, doc, place = item[inside], doc[inside], place[inside]
    # first seeds in the same stretch of an item's length are one passage
    near = np.unique(np.stack([item, doc, place // np.array([len(c) for c in items.coded])[item]], axis=1), axis=0)
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    cut = np.flatnonzero(np.concatenate([[True], near[1:, 0] != near[:-1, 0], [True]]))
    for a, b in zip(cut, cut[1:]):
        k = int(near[a, 0])
        length = len(items.coded[k])
        margin = int(items.reach[k])
        together = max(1, min(256, CELLS // (length + 2 * margin)))
        for c in range(a, b, together):
            some = near[c:min(b, c + together)]
            left = some[:, 2] * length - margin
            at = left[:, None] + np.arange(length + 2 * margin)
            inside = (at >= begins[some[:, 1]][:, None]) & (at < begins[some[:, 1] + 1][:, None])
            passages = np.where(inside, coded[np.clip(at, 0, len(coded) - 1)], 0)
            best, first, last = align(items.coded[k], passages)
            similarity = best / (MATCH * length)
            for r in np.flatnonzero(similarity >= items.least[k]):
                key, offset = (int(some[r, 1]), k), int(left[r] - begins[some[r, 1]])
                value = (float(similarity[r]), offset + int(first[r]), offset + int(last[r]) - 1)
                if value > found.get(key, (0.0, 0, 0)):
                    found[key] = value
    return [(d, k, *v) for (d, k), v in sorted(found.items())]


def _count(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = index.value
        total = np.zeros(len(items.keys), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                total += np.bincount(items.find(items.keys, items.code(batch.column(0)[at:at + 512].to_pylist())[0])[1], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["pair", "n"])

    return run


def indexes(docs: DataFrame, benchmark: DataFrame, least: float, id_col: str, text_col: str):
    """One broadcast index a block of test items, with seeds chosen by the documents' pair counts."""
    spark = docs.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text is not null")
    blocks = -(-rows.count() // BLOCK_ITEMS)
    for b in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text")
        items = Items([(r["item_id"], r["text"]) for r in block.collect()])
        counting = spark.sparkContext.broadcast(items)
        counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_count(counting), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        items.choose_seeds({r["pair"]: r["n"] for r in counted.collect()}, least)
        yield spark.sparkContext.broadcast(items)


def _find(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = index.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                ids = some.column(0).to_pylist()
                rows = matches(items, some.column(1).to_pylist())
                columns = list(zip(*[(ids[d], items.ids[k], s, a, b) for d, k, s, a, b in rows])) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "similarity", "first_word", "last_word"])

    return run


def _clean(index, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                some = batch.slice(a, 512)
                keep = np.ones(some.num_rows, bool)
                keep[[m[0] for m in matches(index.value, some.column(at).to_pylist())]] = False
                yield some.filter(pa.array(keep))

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, similarity, first_word, last_word`` of each document row and test item aligned to ``least`` of the item's best score or more.

    Words are counted from 0 within the document. Null texts match nothing; repeated
    rows of either table are each reported. Items under ``SHORT`` words match word for word only, items
    without words and null ones nothing; empty tables give no rows. Each block of 10,000 items reads the documents twice.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = [texts.mapInArrow(_find(index), HITS) for index in indexes(docs, benchmark, least, id_col, text_col)]
    return union(found) if found else docs.sparkSession.createDataFrame([], HITS)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whatever their names, that hold no test item to ``least`` or more.

    Rows with a null or empty text stay, repeated rows share their fate, and an empty benchmark drops nothing.
    """
    kept = docs
    for index in indexes(docs, benchmark, least, id_col, text_col):
        kept = kept.mapInArrow(_clean(index, docs.columns.index(text_col)), docs.schema)
    return kept
