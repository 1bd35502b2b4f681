"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most ``radius`` bits agree in some ``p - radius`` of p
pieces; each choice of pieces is a table of buckets, so every link is met in a
bucket. Inside a bucket the fingerprints are stored as 64 bit planes; a block
of queries is compared with all of them plane by plane, the distances counted by
carry-save adders on whole words, and given up once all lanes exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .batches import slices
from .common import components, dealt, stored

SHINGLE = 4
SEED = 42
#: Rows of a bucket that are compared in one task.
BLOCK = 4096
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Pairs of buckets up to this size are compared together, lane by lane.
SMALL = 12


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, SEED) for s in parts], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 if there are none."""
    if not len(hashes):
        return 0
    set_in = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a long) of every whole text; null, empty and blank texts have 0."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Plane b holds bit b of all fingerprints, 64 to a word; (64, words)."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view("<u8")


def within(planes: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """Bit (q, lane) is set if the lane's fingerprint differs from query q in at most ``radius`` (under 8) bits."""
    shape = (len(queries), planes.shape[1])
    ones, twos, fours, over = (np.zeros(shape, np.uint64) for _ in range(4))
    beyond = over
    for b in range(64):
        flip = np.where((queries >> np.uint64(b)) & np.uint64(1), ONES, np.uint64(0))[:, None]
        carry = planes[b][None, :] ^ flip
        ones, carry = ones ^ carry, ones & carry
        twos, carry = twos ^ carry, twos & carry
        fours, carry = fours ^ carry, fours & carry
        over = over | carry
        if b % 8 == 7 and b > 2 * radius:
            beyond, equal = over, ~over
            for weight, plane in ((4, fours), (2, twos), (1, ones)):
                if radius & weight:
                    equal = equal & plane
                else:
                    beyond = beyond | (equal & plane)
                    equal = equal & ~plane
            if b < 63 and (beyond == ONES).all():
                break
    return ~beyond


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def spanning_links(fps: np.ndarray, radius: int, queries_a_block: int = 64) -> list[tuple[int, int]]:
    """Links (i, j) that connect what is connected within the radius: each found fingerprint leaves the rest and queries it once."""
    links: list[tuple[int, int]] = []
    rest = np.arange(len(fps))
    while len(rest):
        waiting, rest = [int(rest[0])], rest[1:]
        while waiting and len(rest):
            some, waiting = np.array(waiting[:queries_a_block]), waiting[queries_a_block:]
            hit = _lanes(within(bit_planes(fps[rest]), fps[some], radius), len(rest))
            got = hit.any(axis=0)
            if got.any():
                links += zip(some[hit[:, got].argmax(axis=0)].tolist(), rest[got].tolist())
                waiting += rest[got].tolist()
                rest = rest[~got]
    return links


def _bucket_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            column = column if isinstance(column, pa.ListArray) else column.cast(pa.list_(column.type.value_type))
            offsets = column.offsets.to_numpy()
            rows = column.values
            fps = rows.field("fp").to_numpy().view(np.uint64)
            reps = rows.field("rep").to_numpy(zero_copy_only=False)
            sizes = np.diff(offsets)
            a, b = [], []
            # small buckets: all their pairs side by side, one lane a pair
            stop = np.repeat(np.where(sizes <= SMALL, offsets[1:], offsets[:-1]), sizes)
            at = np.arange(offsets[0], offsets[0] + len(stop))
            for step in range(1, min(SMALL, int(sizes.max(initial=1)))):
                left = at[at + step < stop]
                for i in range(0, len(left), 1 << 16):
                    some = left[i:i + (1 << 16)]
                    near = _lanes(within(bit_planes(fps[some] ^ fps[some + step]), np.zeros(1, np.uint64), radius), len(some))[0]
                    a.append(reps[some[near]])
                    b.append(reps[some[near] + step])
            for g in np.flatnonzero(sizes > SMALL):
                lo, hi = offsets[g], offsets[g + 1]
                links = np.array(spanning_links(fps[lo:hi], radius), dtype=np.int64).reshape(-1, 2)
                a.append(reps[lo:hi][links[:, 0]])
                b.append(reps[lo:hi][links[:, 1]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])

    return run


def _masks(pieces: int, radius: int) -> list[int]:
    cuts = [round(64 * i / pieces) for i in range(pieces + 1)]
    piece = [sum(1 << b for b in range(x, y)) for x, y in zip(cuts, cuts[1:])]
    return [sum(piece[i] for i in chosen) for chosen in combinations(range(pieces), pieces - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(reps: DataFrame, radius: int = 4) -> DataFrame:
    """From distinct ``fp`` with ``rep``: links ``a, b`` between reps that connect all within the radius."""
    n = reps.count()
    # more pieces give longer keys, so that buckets stay small as the table grows; each number of pieces finds every link
    pieces = radius + 1
    while pieces < radius + 4 and n >> int(64 * (pieces - radius) / pieces):
        pieces += 1
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(_masks(pieces, radius))])
    buckets = reps.where("rep is not null").select("fp", "rep", F.explode(keys).alias("key"))
    groups = dealt(buckets, "key", "fp", BLOCK).groupBy("key", "lo", "hi").agg(F.collect_list(F.struct("fp", "rep")).alias("rows"))
    return groups.select("rows").mapInArrow(_bucket_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row.

    component_id is the smallest id reachable over links of at most ``radius``
    differing bits, its own included. Equal fingerprints are one node (the smallest id of theirs);
    rows with the same id are one node too. Null, empty and blank texts have the fingerprint 0 and
    link like any other. A null id takes part through an equal fingerprint only; among nulls alone the component is null.
    """
    fps = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    reps = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-reps")
    found = components(links(reps, radius))
    of_fp = reps.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def _with_fingerprint(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t) for t in batch.column(at).to_pylist()], dtype=np.uint64)
            yield batch.append_column(FP, pa.array(found.view(np.int64)))

    return run


#: A column's name that no table has.
FP = "__leafmark_fp"


def drop_near_duplicates(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns: one of each component, that with the component's smallest id (null ids last).

    Of several rows with that id and fingerprint the one whose text has the smallest hash stays.
    Null, empty and blank texts have the fingerprint 0 and are one group. An empty table stays empty.
    """
    fps = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    reps = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-reps")
    found = components(links(reps, radius))
    keep = reps.join(found, F.col("rep") == F.col("node"), "left").where("component is null or component = rep").groupBy("rep").agg(F.min("fp").alias("__leafmark_keep_fp")).withColumnRenamed("rep", "__leafmark_keep_id")
    # rows without any id among their equals stand for their own fingerprint
    nameless = reps.where("rep is null").select(F.col("fp").alias("__leafmark_keep_fp"), F.lit(None).cast("long").alias("__leafmark_keep_id"))
    keep = keep.where(F.col("__leafmark_keep_id").isNotNull()).unionByName(nameless)
    marked = docs.mapInArrow(_with_fingerprint(docs.columns.index(text_col)), T.StructType([*docs.schema.fields, T.StructField(FP, T.LongType())]))
    kept = marked.join(keep, (F.col(FP) == F.col("__leafmark_keep_fp")) & F.col(id_col).eqNullSafe(F.col("__leafmark_keep_id"))).drop("__leafmark_keep_fp", "__leafmark_keep_id")
    first = F.row_number().over(Window.partitionBy(FP, id_col).orderBy(F.xxhash64(text_col)))
    return kept.withColumn("__leafmark_row", first).where(F.col("__leafmark_row") == 1).select(*docs.columns)
