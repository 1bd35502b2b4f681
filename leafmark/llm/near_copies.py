"""Near copies: Jaccard similarity of five-word shingle sets of 0.8 or more, none missed.

In the order of ids a document goes if one that stays is similar, so no two that stay are similar
and each that goes is similar to one that stays. Equal sets are one node.

SimHash (see ``simhash``) groups the nodes by fingerprints of few differing bits, and most
copies go by one comparison with the first of their group. What similarity 0.8 puts beyond
such a radius is found by the sets themselves: two of them share a shingle among the first fifth of
each, in any order that is the same for all; with the shingles that many documents hold last, such a
meeting is seldom chance. Shingles of all texts are counted, in buckets that batches of texts tell of theirs and that
answer them; those of one text alone meet nothing and stay out. A node that comes first wherever it meets others stays for sure, and
everything that it meets is compared with it; so a group of copies costs as many comparisons as it
has members. What is left after some such rounds is compared pair by pair, but for pairs that sizes and
places in the order rule out. All comparisons are of the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .batches import batched, bound, bound2, rows_of, slices, unpacked
from .common import components, release, shuffle_partitions, stored, written
from .simhash import links, majority

SHINGLE = 5
SEED = 42
#: Shingles that fewer texts hold come first in the order, in that of their hashes. The counts decide an order only, not what is found.
COMMON = 2
#: Bytes of text whose shingles a bucket counts.
COUNTED_BYTES = 8_000_000
#: Bits of a shingle's hash that a bucket counts by, beside the bucket's own number; where two agree both count as more common.
SHORT = np.uint64(32)
#: Prefix entries of a bucket.
BUCKET_ENTRIES = 300_000
#: Pairs held before repeated ones are put together.
HELD_PAIRS = 1_000_000
#: Differing bits up to which fingerprints make a group.
RADIUS = 4
#: Rounds of comparisons with what comes first.
ROUNDS = 3
#: Open pairs that are compared at once: one for so many sets, or these if that is less. A matter of the number of jobs; what is found is the same.
PAIRS_SHARE, LEAST_PAIRS = 10, 1_000
#: Columns' names that no table has.
NODE, ROW, KEEP_NODE, KEEP_ID = "__leafmark_node", "__leafmark_row", "__leafmark_keep_node", "__leafmark_keep_id"


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of the text's shingles as XXH64; all words where they are under five; empty without words."""
    return shingles_of((text or "").encode("utf-8", "surrogatepass"))


def shingles_of(text: bytes) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in parts], np.uint64))


def node_of(found: np.ndarray) -> int:
    """The set's hash, as a long."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def prefix_length(size: int) -> int:
    """Of the first so many shingles of a set, one is among those of any set of similarity 0.8."""
    return size - (4 * size + 4) // 5 + 1 if size else 0


def _codes(found: np.ndarray, buckets: int) -> np.ndarray:
    """A shingle's bucket, and what stands for it there."""
    return found % np.uint64(buckets) << SHORT | (found // np.uint64(buckets)).astype(np.uint32)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * shared >= 4 * (len(a) + len(b) - shared)


TOLD = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("keys", pa.binary()), ("times", pa.binary())])
NODES = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("prefix", pa.binary()), ("places", pa.binary()), ("fp", pa.int64())])


def _told(table: pa.Table, buckets: int) -> pa.Table:
    """A batch's shingles, and how many of its texts hold each, to each bucket."""
    batch, texts = table.column("batch")[0].as_py(), unpacked(table)[1]
    found, times = np.unique(_codes(np.concatenate([np.zeros(0, np.uint64), *map(shingles_of, texts)]), buckets), return_counts=True)
    bucket = found >> SHORT
    cut = np.flatnonzero(np.concatenate([np.ones(min(1, len(found)), bool), bucket[1:] != bucket[:-1], np.ones(min(1, len(found)), bool)]))
    parts = list(pairwise(cut))
    keys, times = found.astype(np.uint32), times.astype(np.int32)
    return rows_of(TOLD, [bucket[cut[:-1]].astype(np.int32), np.full(len(parts), batch, np.int32), [keys[a:b].tobytes() for a, b in parts], [times[a:b].tobytes() for a, b in parts]])


def _counted(table: pa.Table) -> pa.Table:
    """Answers each batch with its shingles that two texts or more of all hold, and how many do."""
    keys = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
    kinds, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(at, np.concatenate([np.frombuffer(x, np.int32) for x in table.column("times").to_pylist()]), len(kinds)).astype(np.int32)
    shared = []
    for own in keys:
        held = n[np.searchsorted(kinds, own)]
        shared.append((own[held > 1].tobytes(), held[held > 1].tobytes()))
    return rows_of(TOLD, [table.column("bucket").to_numpy(), table.column("batch").to_numpy(), [k for k, _ in shared], [t for _, t in shared]])


def _prefixes(rows: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """Of each text the set's hash and size, and of its prefix what another text holds too, with the places there."""
    parts = [(np.uint64(b) << SHORT | np.frombuffer(k, np.uint32).astype(np.uint64), np.frombuffer(t, np.int32)) for b, k, t in zip(*(answers.column(c).to_pylist() for c in ("bucket", "keys", "times")))]
    keys, n = (np.concatenate(x) for x in zip((np.zeros(0, np.uint64), np.zeros(0, np.int32)), *parts))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    ids, texts = unpacked(rows)
    out: list[list] = [[] for _ in NODES]
    for i, t in zip(ids, texts):
        found = shingles_of(t)
        held = np.ones(len(found), np.int64)
        if len(keys) and len(found):
            code = _codes(found, buckets)
            at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
            held = np.where(keys[at] == code, n[at], 1)
        order = np.lexsort((found, np.where(held >= COMMON, held, 0)))[:prefix_length(len(found))]
        shared = held[order] > 1
        for column, value in zip(out, (i, node_of(found), len(found), found[order[shared]].tobytes(), np.flatnonzero(shared).astype(np.int32).tobytes(), int(np.uint64(majority(found)).astype(np.int64)))):
            column.append(value)
    return rows_of(NODES, out)


ENTRY = np.dtype([("key", "<u8"), ("node", "<i8"), ("size", "<i4"), ("place", "<i4")])


def _spread(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
            lengths = np.array([len(p) for p in parts], np.int64)
            entries = np.zeros(lengths.sum(), ENTRY)
            if not len(entries):
                continue
            entries["key"] = np.concatenate(parts)
            entries["node"] = np.repeat(batch.column(0).to_numpy(), lengths)
            entries["size"] = np.repeat(batch.column(1).to_numpy(), lengths)
            entries["place"] = np.concatenate([np.frombuffer(x, np.int32) for x in batch.column(3).to_pylist()])
            bucket = (entries["key"] % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            entries, bucket = entries[order], bucket[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]]), pa.array([entries[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["bucket", "entries"])

    return run


PAIRS = pa.schema([("low", pa.int64()), ("high", pa.int64())])
FIRST = pa.schema([("low", pa.int64()), ("high", pa.int64()), ("maybe", pa.bool_())])


def _firsts(table: pa.Table) -> pa.Table:
    """Of each shingle in a bucket: the node that comes first, each other node, and whether sizes and places let them be similar."""
    entries = np.concatenate([np.frombuffer(x, ENTRY) for x in table.column("entries").to_pylist()])
    entries = entries[np.lexsort((entries["node"], entries["key"]))]
    key, node, size, place = (np.ascontiguousarray(entries[c]) for c in ("key", "node", "size", "place"))
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    first = np.repeat(begin, np.diff(np.concatenate([begin, [len(key)]])))
    other = np.flatnonzero(first != np.arange(len(key)))
    first, size, place = first[other], size.astype(np.int64), place.astype(np.int64)
    most = np.minimum(size[first] - place[first], size[other] - place[other])
    maybe = (9 * most >= 4 * (size[first] + size[other])) & (5 * np.minimum(size[first], size[other]) >= 4 * np.maximum(size[first], size[other]))
    order = np.lexsort((~maybe, node[other], node[first]))
    low, high, maybe = node[first][order], node[other][order], maybe[order]
    new = np.concatenate([np.ones(min(1, len(low)), bool), (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    return rows_of(FIRST, [low[new], high[new], maybe[new]])


def _meetings(table: pa.Table) -> pa.Table:
    """Pairs of nodes, the first one first, that meet in a bucket and that sizes and places don't rule out."""
    entries = np.concatenate([np.frombuffer(x, ENTRY) for x in table.column("entries").to_pylist()])
    entries = entries[np.lexsort((entries["node"], entries["size"], entries["key"]))]
    key, node, size, place = (np.ascontiguousarray(entries[c]) for c in ("key", "node", "size", "place"))
    size, place = size.astype(np.int64), place.astype(np.int64)
    pairs, held = [np.zeros((0, 2), np.int64)], 0
    left, step = np.arange(len(key)), 1
    while True:
        # sizes grow within a key: a row whose partner is too large has none further on
        left = left[left + step < len(key)]
        left = left[(key[left] == key[left + step]) & (5 * size[left] >= 4 * size[left + step])]
        if not len(left):
            break
        right = left + step
        most = np.minimum(size[left] - place[left], size[right] - place[right])
        some = 9 * most >= 4 * (size[left] + size[right])
        found = np.stack([node[left[some]], node[right[some]]], axis=1)
        pairs.append(np.sort(found, axis=1))
        held += len(found)
        if held > HELD_PAIRS:
            pairs = [np.unique(np.concatenate(pairs), axis=0)]
            held = len(pairs[0]) // 2
        step += 1
    out = np.unique(np.concatenate(pairs), axis=0)
    return rows_of(PAIRS, [out[:, 0], out[:, 1]])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [shingles(t) for t in batch.column(0).to_pylist()]
        mine = pa.array([node_of(s) == n for s, n in zip(found, batch.column(2).to_pylist())])
        yield pa.RecordBatch.from_arrays([batch.column(1).filter(mine), pa.array([s.tobytes() for s in found], pa.binary()).filter(mine)], names=["no", "shingles"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        hit = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))


def _nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``no, node, rep`` (smallest id, null if there is none)``, size, prefix, places, fp`` of each distinct set; the numbers go by id, nulls last."""
    rows, _, size = batched(docs, id_col, text_col)
    buckets = max(shuffle_partitions(docs.sparkSession), -(-size // COUNTED_BYTES))
    told = rows.groupBy("batch").applyInArrow(bound(_told, buckets=buckets), "bucket int, batch int, keys binary, times binary")
    answers = told.groupBy("bucket").applyInArrow(bound(_counted), "bucket int, batch int, keys binary, times binary")
    made = rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(bound2(_prefixes, buckets=buckets), "doc_id long, node long, size int, prefix binary, places binary, fp long")
    sets = made.groupBy("node").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("size", "prefix", "places", "fp")])
    # partitions of a sorted table are in order, and so are the numbers; written down they stay as they are
    return stored(sets.orderBy(F.col("rep").isNull(), "rep", "node").withColumn("no", F.monotonically_increasing_id()), "shingle-sets")


def _in_buckets(nodes: DataFrame) -> DataFrame:
    """``bucket, entries``: the prefixes' shingles in hashed buckets of a bounded number of entries."""
    entries = nodes.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0)).alias("n")).first()["n"] // 8
    buckets = max(shuffle_partitions(nodes.sparkSession), -(-entries // BUCKET_ENTRIES))
    return nodes.select("no", "size", "prefix", "places").where(F.octet_length("prefix") > 0).mapInArrow(_spread(buckets), "bucket int, entries binary")


def _firsts_of(nodes: DataFrame) -> DataFrame:
    """``low, high, maybe``: each node that meets one before it, with the first that it meets."""
    met = _in_buckets(nodes).groupBy("bucket").applyInArrow(_firsts, "low long, high long, maybe boolean")
    return stored(met.groupBy("low", "high").agg(F.max("maybe").alias("maybe")), "first-met")


def grouped(nodes: DataFrame) -> DataFrame:
    """``low, high``: each node of a SimHash group and the first of the group."""
    fps = stored(nodes.groupBy("fp").agg(F.min("no").alias("rep")), "fingerprint-reps")
    found = components(links(fps, RADIUS))
    of_fp = fps.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("low"))
    return nodes.select(F.col("no").alias("high"), "fp").join(of_fp, "fp").where("low <> high").select("low", "high")


def dropped_nodes(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The numbers of the nodes that go: what comes first wherever it meets others stays, and what is similar to it goes; in rounds."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gone = docs.sparkSession.createDataFrame([], "no long")

    def alike(pairs: DataFrame) -> DataFrame:
        """``low, high``: the pairs whose sets are similar."""
        members = pairs.select(F.col("low").alias("no")).unionByName(pairs.select(F.col("high").alias("no"))).distinct()
        # written down first, so that its size tells how it is joined with the texts
        wanted = stored(nodes.select("no", "node", "rep").join(members, "no"), "compared")
        met = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", "no", "node")
        sets = stored(met.mapInArrow(_sets, "no long, shingles binary").dropDuplicates(["no"]), "compared-sets")
        of = lambda n: sets.select(F.col("no").alias(n), F.col("shingles").alias(f"{n}_shingles"))
        both = pairs.select("low", "high").join(of("low"), "low").join(of("high"), "high").select("low", "high", "low_shingles", "high_shingles")
        return both.mapInArrow(_verified, "low long, high long")

    def gone_by(pairs: DataFrame) -> DataFrame:
        """``no``: the high ones of similar pairs, written down until the end."""
        found = stored(pairs.select(F.col("high").alias("no")).distinct(), "similar")
        similar_ones.append(written()[-1])
        return found

    def similar_to(pairs: DataFrame) -> DataFrame:
        return gone_by(alike(pairs))

    def first_ones(pairs: DataFrame) -> DataFrame:
        """``low``: what no pair has after another; it stays for sure."""
        return stored(pairs.select("low").distinct().join(pairs.select(F.col("high").alias("low")), "low", "left_anti"), "staying")

    def without(pairs: DataFrame, stay: DataFrame, found: DataFrame) -> DataFrame:
        """The pairs that neither what stays for sure nor what has gone decides."""
        rest = pairs.join(stay, "low", "left_anti")
        for n in ("low", "high"):
            rest = rest.join(found.select(F.col("no").alias(n)), n, "left_anti")
        return rest.select("low", "high")

    def clear(since: list[str], keep: list[str]) -> None:
        """What a turn wrote and no later one reads."""
        release(docs.sparkSession, [p for p in written() if p not in since and p not in keep and p not in similar_ones])

    similar_ones: list[str] = []
    pool, start = nodes.where("size > 0"), written()
    for turn in range(1 + ROUNDS):
        met = _firsts_of(pool)
        if met.isEmpty():
            return gone
        later = met.select(F.col("high").alias("no")).distinct()
        surely = lambda pairs: stored(pairs.join(later, F.col("low") == F.col("no"), "left_anti").select("low", "high"), "sure-pairs")
        if turn == 0:  # what meets others at all, by groups of fingerprints
            pool = stored(pool.join(met.select(F.col("low").alias("no")).unionByName(later).distinct(), "no", "left_semi"), "open-nodes")
            at = written()[-1:]
            found = similar_to(surely(grouped(pool)))
            pool = pool.join(found, "no", "left_anti")
            clear(start, at)
        else:  # what stays for sure has met all that it can
            found = similar_to(surely(met.where("maybe")))
            pool = stored(pool.join(later, "no", "left_semi").join(found, "no", "left_anti"), "open-nodes")
            clear(start, written()[-1:])
        gone = gone.unionByName(found)
    open_pairs = stored(_in_buckets(pool).groupBy("bucket").applyInArrow(_meetings, "low long, high long").distinct(), "candidates")
    # as many pairs as a share of the sets are compared at once; of more, those whose first one stays for sure
    at_once = max(LEAST_PAIRS, nodes.count() // PAIRS_SHARE)
    while open_pairs.count() > at_once:
        stay = first_ones(open_pairs)
        found = similar_to(open_pairs.join(stay, "low", "left_semi"))
        gone = gone.unionByName(found)
        open_pairs = stored(without(open_pairs, stay, found), "candidates")
        clear(start, written()[-1:])
    left = stored(alike(open_pairs), "similar-pairs")
    while not left.isEmpty():
        clear(start, written()[-1:])
        stay = first_ones(left)
        found = gone_by(left.join(stay, "low", "left_semi"))
        gone = gone.unionByName(found)
        left = stored(without(left, stay, found), "similar-pairs")
    return gone


def _with_node(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.append_column(NODE, pa.array([node_of(shingles(t)) for t in batch.column(at).to_pylist()], pa.int64()))

    return run


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those similar to a row with a smaller id that stays (null ids come last).

    Texts without words are equal to each other. Of several rows with that id and set
    the one whose text has the smallest hash stays. Columns may have any names; an empty table stays empty.
    """
    start = written()
    nodes = _nodes(docs, id_col, text_col)
    gone = dropped_nodes(docs, nodes, id_col, text_col)
    keep = stored(nodes.join(gone, "no", "left_anti").select(F.col("node").alias(KEEP_NODE), F.col("rep").alias(KEEP_ID)), "kept-sets")
    release(docs.sparkSession, [p for p in written()[:-1] if p not in start])
    marked = docs.mapInArrow(_with_node(docs.columns.index(text_col)), T.StructType([*docs.schema.fields, T.StructField(NODE, T.LongType())]))
    kept = marked.join(keep, (F.col(NODE) == F.col(KEEP_NODE)) & F.col(id_col).eqNullSafe(F.col(KEEP_ID))).drop(KEEP_NODE, KEEP_ID)
    if docs.groupBy(id_col).agg(F.count("*").alias(ROW)).where(F.col(ROW) > 1).isEmpty():
        return kept.select(*docs.columns)
    first = F.row_number().over(Window.partitionBy(NODE, id_col).orderBy(F.xxhash64(text_col)))
    return kept.withColumn(ROW, first).where(F.col(ROW) == 1).select(*docs.columns)
