"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

Which lengths share a sequence depends only on how many pieces there are of each
length from 1 to the capacity: that histogram (at most ``capacity`` rows) is planned
on the driver. The plan says, for each length, which run of its pieces goes to
which run of sequences; pieces are numbered within their length by Spark and look
their place up.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import shuffle_partitions, stored
from .tokens import crc, encoder

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[list[tuple[int, int]], int]], dict[int, int]]:
    """Martello-Toth reduction on ``{length: count}``: ``(fixed sequences, what is left)``.

    For a length j with room r = capacity - j, let k be the largest other length that fits. A
    set with j is dominated by {j} if nothing fits, and by {j, k} if k fills the
    room, if no two pieces fit into the room together, or if only two fit and no
    two of them fill more than k. Such sets are fixed for as many pieces as there are.
    Sets are ``([(length, copies)...], times)``.
    """
    left = {n: c for n, c in counts.items() if c}
    lengths = sorted(left)
    fixed: list[tuple[list[tuple[int, int]], int]] = []

    def take(n: int, times: int) -> None:
        left[n] -= times
        if not left[n]:
            del left[n]
            lengths.remove(n)

    def smallest(k: int, without: int) -> list[int]:
        out: list[int] = []
        for n in lengths:
            have = left[n] - (n == without)
            out += [n] * min(have, k - len(out))
            if len(out) == k:
                break
        return out

    def best_two(room: int, without: int) -> int:
        """The most that two pieces besides one of ``without`` fill of the room."""
        best, i, j = 0, 0, len(lengths) - 1
        while i <= j:
            a, b = lengths[i], lengths[j]
            if a + b > room or (i == j and left[a] - (a == without) < 2) or (b == without and left[b] < 2):
                j -= 1
            elif a == without and left[a] < 2:
                i += 1
            else:
                best = max(best, a + b)
                i += 1
        return best

    for j in sorted(lengths, reverse=True):
        while j in left:
            room = capacity - j
            at = bisect_right(lengths, room)
            if at and lengths[at - 1] == j and left[j] < 2:
                at -= 1
            if not at:
                fixed.append(([(j, 1)], left[j]))
                take(j, left[j])
                break
            k = lengths[at - 1]
            few = smallest(3, j)
            if not (k == room or len(few) < 2 or few[0] + few[1] > room or ((len(few) < 3 or sum(few) > room) and k >= best_two(room, j))):
                break
            if k == j:
                times = left[j] // 2
                fixed.append(([(j, 2)], times))
                take(j, 2 * times)
            else:
                times = min(left[j], left[k])
                fixed.append(([(j, 1), (k, 1)], times))
                take(j, times)
                take(k, times)
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing on ``{length: count}``; sets as in :func:`reduce_dominated`."""
    rooms: list[int] = []  # ascending
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}

    def add(room: int, items: list[tuple[int, int]], times: int) -> None:
        if times:
            if room not in open_:
                insort(rooms, room)
            open_.setdefault(room, []).append((items, times))

    for n in sorted(counts, reverse=True):
        todo = counts[n]
        while todo:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                each = capacity // n
                bins, rest = divmod(todo, each)
                add(capacity - each * n, [(n, each)], bins)
                if rest:
                    add(capacity - rest * n, [(n, rest)], 1)
                break
            room = rooms[at]
            items, times = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            each = room // n
            bins = min(times, todo // each)
            add(room - each * n, items + [(n, each)], bins)
            todo -= bins * each
            times -= bins
            if times and todo:  # todo < each
                add(room - todo * n, items + [(n, todo)], 1)
                times, todo = times - 1, 0
            add(room, items, times)
    return [x for sets in open_.values() for x in sets]


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: ``(length, rank_from, rank_to, copies, sequence_from, offset)``.

    The piece of rank r in [rank_from, rank_to) goes to sequence
    ``sequence_from + (r - rank_from) // copies`` at ``offset + (r - rank_from) % copies * length``.
    """
    fixed, left = reduce_dominated(counts, capacity)
    ranks: dict[int, int] = {}
    slots, sequence = [], 0
    for items, times in fixed + best_fit(left, capacity):
        offset = 0
        for n, copies in items:
            a = ranks.get(n, 0)
            ranks[n] = a + times * copies
            slots.append((n, a, ranks[n], copies, sequence, offset))
            offset += n * copies
        sequence += times
    return slots


def _pieces(vocabulary: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                out: list[list] = [[], [], [], [], []]
                for i, raw in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist())):
                    ids = np.concatenate([np.frombuffer(raw, "<u4"), end])
                    for piece, a in enumerate(range(0, len(ids), capacity)):
                        part = ids[a:a + capacity]
                        for column, value in zip(out, (i, piece, a, len(part), crc(part))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=[c.split()[0] for c in PIECE_SCHEMA.split(", ")])

    return run


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts (null: empty) as ids and ``end_id``, cut into pieces of at most ``capacity`` ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_pieces(vocabulary, end_id, capacity), PIECE_SCHEMA)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``doc_id, piece, length`` (1 to capacity).

    Every piece is placed, whatever its id (null and repeated ids too); an empty table gives no
    rows. Pieces of one length are numbered in salted groups whose sizes are summed
    first, so a length that a third of all pieces share is still dealt to many tasks.
    """
    spark = pieces.sparkSession
    salts = 4 * shuffle_partitions(spark)
    pieces = stored(pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")), "pieces")
    sizes = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # at most one row a length
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan_packing(counts, capacity)
    slots_df = spark.createDataFrame(slots, "slot_length long, rank_from long, rank_to long, copies long, sequence_from long, slot_offset long")
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).select("length", "salt", "before")
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("local", local).join(before, ["length", "salt"]).withColumn("rank", F.col("local") + F.col("before"))
    # the plan's rows are bounded by the capacity, not by the data
    placed = ranked.join(F.broadcast(slots_df), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    t = F.col("rank") - F.col("rank_from")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence_from") + F.floor(t / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("slot_offset") + F.pmod(t, F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )
