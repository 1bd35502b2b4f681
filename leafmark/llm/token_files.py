"""Token-ID output: one long id array in blocks, document boundaries in Elias-Fano form.

The format is a Parquet table ``blocks`` (one row a block, so that Spark commits,
retries and reads it from any store) and a table ``parts`` with the ids before each
part. A block holds the ids of consecutive documents in ascending ``doc_id`` order
(nulls first) as unsigned 16- or 32-bit integers, and two Elias-Fano sequences: the
document ids less the block's smallest, and the ends of the documents. ``select``
finds the values at given places from a sample of every 256th set bit, and all reading
goes through it; no table of 64-bit offsets is kept.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .tokens import crc, encoder

SAMPLE = 256
#: Bytes that select looks at together.
WINDOW = 96
BLOCK_SCHEMA = "part int, block int, part_start long, n_docs int, n_null int, n_tokens long, first_id long, width int, ids binary, doc_ids binary, ends binary"


class EliasFano:
    """A non-decreasing sequence of unsigned integers in n * (2 + log2(u / n)) bits, and a sample for select.

    Values go up to the largest of 64 bits; what is stored is the last one, not the bound above it.
    """

    HEAD = struct.Struct("<QQBQ")

    def __init__(self, raw: bytes):
        self.n, self.last, self.low_bits, high_bytes = self.HEAD.unpack_from(raw)
        at = self.HEAD.size
        low_bytes = (self.n * self.low_bits + 7) // 8
        self.low = np.frombuffer(raw, np.uint8, low_bytes, at)
        self.high = np.frombuffer(raw, np.uint8, high_bytes, at + low_bytes)
        self.samples = np.frombuffer(raw, "<u4", -(-self.n // SAMPLE), at + low_bytes + high_bytes)

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        last = int(v[-1]) if n else 0
        low_bits = min(63, max(0, ((last + 1) // n).bit_length() - 1)) if n else 0
        high = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
        bits[high] = 1
        lows = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        packed = np.packbits(bits, bitorder="little")
        return cls.HEAD.pack(n, last, low_bits, len(packed)) + np.packbits(lows.ravel(), bitorder="little").tobytes() + packed.tobytes() + high[::SAMPLE].astype("<u4").tobytes()

    def _lows(self, at: np.ndarray) -> np.ndarray:
        """The low parts of the values at these places, bit by bit from the packed ones."""
        out = np.zeros(len(at), np.uint64)
        for k in range(self.low_bits):
            bit = at * self.low_bits + k
            out |= ((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(k)
        return out

    def select(self, at) -> np.ndarray:
        """The values at these places; each is looked for from the sampled set bit before it, a window of bytes at a time."""
        at = np.atleast_1d(np.asarray(at, dtype=np.int64))
        if len(at) and not (0 <= at.min() and at.max() < self.n):
            raise IndexError(f"{at.min()} to {at.max()} of {self.n}")
        return np.concatenate([self._select(at[i:i + 4096]) for i in range(0, len(at), 4096)]) if len(at) else np.zeros(0, np.uint64)

    def _select(self, at: np.ndarray) -> np.ndarray:
        place = np.zeros(len(at), np.int64)
        start = self.samples[at // SAMPLE].astype(np.int64)
        byte, skip, left = start >> 3, start & 7, at % SAMPLE
        todo = np.arange(len(at))
        while len(todo):
            window = byte[todo, None] + np.arange(WINDOW)
            bits = np.unpackbits(np.where(window < len(self.high), self.high[np.minimum(window, len(self.high) - 1)], 0).astype(np.uint8), axis=1, bitorder="little")
            bits[:, :8][np.arange(8) < skip[todo, None]] = 0  # set bits before the sampled one
            ones = np.cumsum(bits, axis=1, dtype=np.int32)
            here = ones[:, -1] > left[todo]
            place[todo[here]] = byte[todo[here]] * 8 + (ones[here] > left[todo[here], None]).argmax(axis=1)
            rest = todo[~here]
            left[rest] -= ones[~here, -1]
            byte[rest] += WINDOW
            skip[rest] = 0
            todo = rest
        return ((place - at).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(at)

    def find(self, value: int) -> int:
        """The first place with this value or a larger one, by select alone; n if there is none."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            if int(self.select(mid)[0]) < value:
                lo = mid + 1
            else:
                hi = mid
        return lo


def _blocks(vocabulary: str, end_id: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        held: list[tuple] = []
        size = block = start = 0

        def flush():
            nonlocal held, size, block, start
            raw = np.frombuffer(b"".join(x for _, x in held), dtype="<u4")
            known = np.array([i for i, _ in held if i is not None], dtype=np.int64)
            first = int(known[0]) if len(known) else 0
            width = 2 if not len(raw) or raw.max() < 1 << 16 else 4
            ends = np.cumsum([len(x) // 4 for _, x in held])
            # differences of 64-bit ids fit in unsigned 64 bits
            offsets = known.astype(np.uint64) - np.array(first, np.int64).astype(np.uint64)
            row = (part, block, start, len(held), len(held) - len(known), len(raw), first, width, raw.astype(f"<u{width}").tobytes(), EliasFano.encode(offsets), EliasFano.encode(ends))
            out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])
            held, size, block, start = [], 0, block + 1, start + len(raw)
            return out

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 512):
                for i, raw in zip(ids[at:at + 512], enc.encode(texts[at:at + 512].to_pylist())):
                    held.append((i, raw + end))
                    size += len(raw) // 4 + 1
                    if size >= block_tokens:
                        yield flush()
        if held:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, block_tokens: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts (null: empty), add ``end_id`` to each, write ids and boundaries under ``path`` in ascending id order.

    Rows with the same id stay apart, in the order of their texts' hashes; a null id
    comes first. An empty table gives an empty file. A document longer than
    ``block_tokens`` has a block of its own size.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # ranges also run over the texts' hashes, so a repeated id can be dealt to several tasks
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(_blocks(vocabulary, end_id, block_tokens), BLOCK_SCHEMA).write.parquet(os.path.join(path, "blocks"))
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(os.path.join(path, "blocks"))
    # one row a task of the writing stage: their number is set by the session, not by the data
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_docs").alias("n_docs")).orderBy("part").collect()
    total, before = 0, []
    for p in parts:
        before.append((p["part"], total))
        total += p["n_tokens"]
    spark.createDataFrame(before, "part int, start long").coalesce(1).write.parquet(os.path.join(path, "parts"))


def _bounds(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's known ids, and where each of its documents starts and ends, through select."""
    doc_ids, ends = EliasFano(r["doc_ids"]), EliasFano(r["ends"])
    stop = ends.select(np.arange(ends.n)).astype(np.int64)
    known = (doc_ids.select(np.arange(doc_ids.n)) + np.array(r["first_id"], np.int64).astype(np.uint64)).astype(np.int64)
    return known, np.concatenate([np.zeros(1, np.int64), stop])[:ends.n], stop


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.frombuffer(r["ids"], dtype=f"<u{r['width']}").astype("<u4")
            known, starts, ends = _bounds(r)
            doc_ids = pa.array([None] * r["n_null"] + known.tolist(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(starts + r["base"]), pa.array(ends - starts), pa.array([crc(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def _looked_up(wanted: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                doc_ids, ends = EliasFano(r["doc_ids"]), EliasFano(r["ends"])
                out: list[tuple[int, list[int]]] = []
                for w in wanted:
                    if not r["first_id"] <= w <= r["first_id"] + doc_ids.last or not doc_ids.n:
                        continue
                    for i in range(doc_ids.find(w - r["first_id"]), doc_ids.n):
                        if int(doc_ids.select(i)[0]) != w - r["first_id"]:
                            break
                        at = i + r["n_null"]  # documents without an id come first
                        a = int(ends.select(at - 1)[0]) if at else 0
                        out.append((w, np.frombuffer(r["ids"], f"<u{r['width']}")[a:int(ends.select(at)[0])].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([x for _, x in out], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return run


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id, ids`` of a few documents of a written file: blocks of their ranges, places in them by select; a repeated id comes once a document."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(os.path.join(path, "blocks"))
    return blocks.where(F.col("first_id") <= max(doc_ids, default=0)).mapInArrow(_looked_up(sorted(set(doc_ids))), "doc_id long, ids array<long>")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a written file: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids_crc32``, from the stored ids."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(os.path.join(path, "blocks"))
    parts = spark.read.schema("part int, start long").parquet(os.path.join(path, "parts"))
    rows = blocks.join(F.broadcast(parts), "part").select((F.col("start") + F.col("part_start")).alias("base"), "n_null", "first_id", "width", "ids", "doc_ids", "ends")
    return rows.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
