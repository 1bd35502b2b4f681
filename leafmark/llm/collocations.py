"""Phrase collocations by set-oriented relational mining.

The corpus is written once as batches of word numbers. From then on the occurrences of the frequent
phrases of one length are a relation ``(batch, place, group)``, stored in the order of places, one
row a batch. To extend it, each batch merges its relation with itself at the next place of the same
piece (both parts of a frequent phrase are frequent), counts the pairs of groups that it holds, and
only those counts are shuffled: one row a pair and batch, so that no phrase weighs more than the
number of batches. What is frequent over all batches goes back to the batches that hold it, and the
merged relation is semi-joined with it there before the next length.

A group is named by the first batch that holds it and its number there, so names are exact: no
phrase is told apart by a hash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import Tables, union

#: Bytes of text in a batch; single documents may be longer. Twice as much is held, to put a language into few batches.
BATCH_BYTES = 14_000_000
#: Stands between pieces; never part of UTF-8.
CUT = b"\xff"
#: A-Z to a-z, tabs to spaces, ends of pieces to CUT.
WORD_BYTES = bytes(0xFF if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Bits of a name: number inside a batch, batch inside a partition, partition.
NUMBER_BITS, SERIAL_BITS, PARTITION_BITS = 30, 11, 22

ENCODED = "batch long, places binary, langs array<string>, words array<binary>, counts array<int>"
RELATION = "batch long, places binary, names array<long>"
PAIRS = "own long, head long, tail long, n int"


def packed(places: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(places.tobytes())


def unpacked(places: pa.Scalar) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(places.as_buffer()), np.int32)


def numbered(texts: list[tuple[str, bytes]]) -> tuple[np.ndarray, list[str], list[bytes], list[int]]:
    """The words of ``(lang, text)`` as numbers from 1, 0 between pieces; language, word and count of each number."""
    number = count(1)
    by_lang: dict[str, defaultdict] = {}
    parts = []
    for lang, text in texts:
        own = by_lang.get(lang)
        if own is None:
            own = by_lang[lang] = defaultdict(number.__next__)
            own[CUT] = 0
        words = text.translate(WORD_BYTES).replace(CUT, b" \xff ").split()
        words.append(CUT)
        parts.append(np.fromiter(map(own.__getitem__, words), np.int32, len(words)))
    places = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    size = next(number) - 1
    langs, names = [""] * size, [b""] * size
    for lang, own in by_lang.items():
        for word, i in own.items():
            if i:
                langs[i - 1], names[i - 1] = lang, word
    return places, langs, names, np.bincount(places, minlength=len(names) + 1)[1:].tolist()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    partition, serial = TaskContext.get().partitionId(), count()

    def batch(texts: list[tuple[str, bytes]]) -> pa.RecordBatch:
        places, langs, words, counts = numbered(texts)
        own = next(serial)
        if own >> SERIAL_BITS or partition >> PARTITION_BITS or len(words) >> NUMBER_BITS:
            raise OverflowError("a partition has too many batches, or a document too many words, for a name of 63 bits")
        values = [pa.array([partition << SERIAL_BITS | own], pa.int64()), pa.array([packed(places)], pa.binary()), pa.array([langs], pa.list_(pa.string())), pa.array([words], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(values, ["batch", "places", "langs", "words", "counts"])

    def whole(texts: list[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
        """In order of languages, as even parts as there have to be."""
        texts.sort(key=lambda x: x[0], reverse=True)
        parts = -(-sum(len(t) for _, t in texts) // BATCH_BYTES)
        for left in range(parts, 0, -1):
            part, room = [], sum(len(t) for _, t in texts) / left
            while texts and (left == 1 or room > 0):
                part.append(texts.pop())
                room -= len(part[-1][1])
            yield batch(part)

    held, size = [], 0
    for rows in batches:
        for at in range(0, rows.num_rows, 256):
            part = rows.slice(at, 256)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                held.append((lang, (text or "").encode("utf-8", "surrogatepass")))
                size += len(held[-1][1])
                if size >= 2 * BATCH_BYTES:
                    yield from whole(held)
                    held, size = [], 0
    yield from whole(held)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for rows in batches:
        for at in range(rows.num_rows):
            row = rows.slice(at, 1)
            yield {name: row.column(name)[0] for name in rows.schema.names}


def merged(places: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a group and another at the next place stand, and which two, as one number."""
    at = np.flatnonzero((places[:-1] > 0) & (places[1:] > 0)).astype(np.int32)
    keys = places[at].astype(np.int64)
    keys -= 1
    keys *= groups
    keys += places[at + 1]
    keys -= 1
    return at, keys


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order and how often each occurs; ``keys`` is sorted in place."""
    keys.sort()
    ends = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) if len(keys) else np.zeros(0, np.int64)
    return keys[ends], np.diff(ends, prepend=-1).astype(np.int32)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        places, names = unpacked(row["places"]), row["names"].values.to_numpy()
        pairs, n = counted(merged(places, len(names))[1])
        for at in range(0, len(pairs), 50_000):
            head, tail = np.divmod(pairs[at:at + 50_000], len(names))
            own = (row["batch"].as_py() << NUMBER_BITS) + np.arange(at, at + len(head))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(names[head]), pa.array(names[tail]), pa.array(n[at:at + 50_000])], ["own", "head", "tail", "n"])


def _kept(first: bool):
    """The relation of what is kept: of the words (``first``), or of pairs of neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            places = unpacked(row["places"])
            kept = row["kept"].values
            numbers, names = kept.field("number").to_numpy(), kept.field("name").to_numpy()
            numbers, names = numbers[order := np.argsort(names)], names[order]  # pairs then lie in the order of names, and pack well
            if first:
                new = np.zeros(max(places.max(initial=0), numbers.max(initial=0)) + 1, np.int32)
                new[numbers] = np.arange(1, len(numbers) + 1)
                out = new[places]
            else:
                at, keys = merged(places, row["groups"].as_py())
                wanted = counted(keys.copy())[0][numbers]
                order = np.argsort(wanted)
                found = np.searchsorted(wanted, keys, sorter=order).clip(0, len(wanted) - 1)
                out = np.zeros(len(places), np.int32)
                out[at] = np.where(wanted[order[found]] == keys, order[found] + 1, 0)
            yield pa.RecordBatch.from_arrays([pa.array([row["batch"].as_py()], pa.int64()), pa.array([packed(out)], pa.binary()), pa.array([names], pa.list_(pa.int64()))], ["batch", "places", "names"])

    return run


def _frequent(rows: DataFrame, key: list[str], least: int) -> DataFrame:
    """Rows of groups that all batches together hold ``least`` times, with the group's name and count."""
    group = Window.partitionBy(*key)
    return rows.withColumn("name", F.min("own").over(group)).withColumn("a", F.sum(F.col("n").cast("long")).over(group)).where(F.col("a") >= least)


def _semi_joined(relation: DataFrame, frequent: DataFrame, first: bool) -> DataFrame:
    number = F.col("own").bitwiseAND(F.lit((1 << NUMBER_BITS) - 1)).cast("int")
    kept = frequent.groupBy(F.shiftright("own", NUMBER_BITS).alias("batch")).agg(F.collect_list(F.struct(number.alias("number"), "name")).alias("kept"))
    groups = F.lit(0) if first else F.size("names")
    return relation.select("batch", "places", groups.alias("groups")).join(kept, "batch").mapInArrow(_kept(first), RELATION)


def phrases(docs: DataFrame, tables: Tables, least: int, longest: int, text: str = "text", lang: str = "lang") -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of 1, 2, ... words, and ``(lang, n)``, the number of all words.

    Phrases: ``(name, head, tail, lang, phrase, last, a, heads, tails)``; ``head`` and ``tail`` name the phrase without its last and
    first word, ``last`` is its last word, ``heads`` and ``tails`` count its first and last 1, 2, ... words.
    """
    stored = tables.stored
    encoded = stored(docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).mapInArrow(_encode, ENCODED), "encoded")
    words = encoded.select("batch", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("at", "w"))
    own = F.shiftleft("batch", NUMBER_BITS) + F.col("at") + 1
    words = words.select(own.alias("own"), F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    sizes = stored(words.groupBy("lang").agg(F.sum(F.col("n").cast("long")).alias("n")), "sizes")
    frequent = stored(_frequent(words, ["lang", "word"], least).select("own", "name", *[F.when(F.col("own") == F.col("name"), F.col(c)).alias(c) for c in ("lang", "word", "a")]), "frequent")
    none = F.array().cast("array<long>")
    word = F.col("word").cast("string")
    found = [stored(frequent.where("own = name").select("name", F.lit(None).cast("long").alias("head"), F.lit(None).cast("long").alias("tail"), "lang", word.alias("phrase"), word.alias("last"), "a", none.alias("heads"), none.alias("tails")), "phrases")]
    relation = encoded
    for _ in range(longest - 1):
        wider = stored(_semi_joined(relation, frequent, relation is encoded), "relation")
        tables.drop(relation, frequent)
        relation = wider
        frequent = stored(_frequent(relation.mapInArrow(_pairs, PAIRS), ["head", "tail"], least).select("own", "name", *[F.when(F.col("own") == F.col("name"), F.col(c)).alias(c) for c in ("head", "tail", "a")]), "frequent")
        of = lambda side: found[-1].select(F.col("name").alias(side), "lang", "phrase", "last", F.col("a").alias("own_a"), "heads", "tails")
        new = frequent.where("own = name").select("name", "head", "tail", "a")
        head, tail = of("head").alias("h"), of("tail").alias("t")
        new = new.join(head, "head").join(tail, "tail").select(
            "name", "head", "tail", "h.lang", F.concat_ws(" ", "h.phrase", "t.last").alias("phrase"), "t.last", "a",
            F.concat("h.heads", F.array("h.own_a")).alias("heads"), F.concat("t.tails", F.array("t.own_a")).alias("tails"))
        found.append(stored(new, "phrases"))
    tables.drop(relation, frequent)
    return found, sizes


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, share: int = 100, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of 2 to ``longest`` words of each language.

    Phrases occur ``least`` times or more inside pieces between punctuation and line ends. The score is the smallest
    over all cuts in two of a thousand times how much more often both parts meet than chance would have it, rounded down. A phrase
    goes when a longer frequent one holds it and occurs in ``share`` hundredths of its places or more. Null texts have no
    words, a null language is ``und``; repeated rows count each; empty tables give an empty result; other columns are left
    behind, whatever their names. Equal scores stand by count, then by the phrase's bytes.
    """
    tables = Tables()
    found, sizes = phrases(docs, tables, least, longest, text, lang)
    big = lambda c: F.col(c).cast("decimal(20,0)")
    out = []
    for words, own in enumerate(found[1:], 2):
        if words < longest:
            longer = found[words].select(F.explode(F.array("head", "tail")).alias("name"), F.col("a").alias("of_longer")).groupBy("name").agg(F.max("of_longer").alias("of_longer"))
            own = own.join(longer, "name", "left").where(F.coalesce(100 * big("of_longer") < F.lit(share) * big("a"), F.lit(True)))
        own = own.join(sizes, "lang")
        cuts = F.array_min(F.array(*[F.struct(F.expr(f"(1000 * cast(a as decimal(20,0)) * cast(n as decimal(20,0))) div (cast(heads[{k - 1}] as decimal(19,0)) * cast(tails[{words - k - 1}] as decimal(19,0)))").alias("score"), F.lit(k).alias("k"), F.expr(f"heads[{k - 1}]").alias("l"), F.expr(f"tails[{words - k - 1}]").alias("r")) for k in range(1, words)]))
        out.append(own.select("lang", "phrase", "a", "n", cuts.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = tables.stored(union(out).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top), "collocations")
    tables.drop(*found, sizes)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
