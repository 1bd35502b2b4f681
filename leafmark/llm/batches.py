"""Documents in batches of a few megabytes, for exchanges between whole batches and hashed buckets.

Operators that look every n-gram up in the whole corpus don't send one row an
n-gram: a batch sends each bucket one array of its keys, the bucket merges the
arrays of all batches, and answers each with an array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Bytes of text in a batch; single documents may be longer.
BATCH_BYTES = 4_000_000


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows a few at a time, so that a worker's Python objects stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in slices(batches):
        text = pa.array([pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()], pa.binary())
        yield batch.set_column(1, "packed", text)


def batched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, apart: Callable[[Column], Column] | None = None, carry: bool = False) -> tuple[DataFrame, int, int]:
    """``(doc_id, packed, batch)``, the number of batches and of bytes; null texts are empty.

    The batch is a hash of the id and text, so it is the same whenever the rows are read again.
    Documents for whose id ``apart`` is true have batches of their own, with numbers below 0.
    With ``carry`` the other columns of a row come along in the struct ``rest``.
    """
    rest = [F.struct(*[c for c in docs.columns if c != text_col]).alias("rest")] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *rest)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-size // batch_bytes))
    batch = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(count)).cast("int")
    rows = rows.withColumn("batch", F.when(apart(F.col("doc_id")), -1 - batch).otherwise(batch) if apart else batch)
    schema = T.StructType([T.StructField("packed", T.BinaryType()) if f.name == "text" else f for f in rows.schema.fields])
    return rows.mapInArrow(_packed, schema), count, size


def in_order(table: pa.Table) -> tuple[list[int | None], list[bytes], list[int]]:
    """Ids and UTF-8 texts of a batch in a fixed order (by id, nulls last, then text), and the rows they come from."""
    unpack = zstandard.ZstdDecompressor()
    rows = [(i is None, i or 0, unpack.decompress(x), k) for k, (i, x) in enumerate(zip(table.column("doc_id").to_pylist(), table.column("packed").to_pylist()))]
    rows.sort()
    return [None if nameless else i for nameless, i, _, _ in rows], [t for _, _, t, _ in rows], [k for _, _, _, k in rows]


def unpacked(table: pa.Table) -> tuple[list[int | None], list[bytes]]:
    return in_order(table)[:2]


def rows_of(schema: pa.Schema, columns: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def bound(f, **fixed):
    """``f`` of one group's table with its other arguments fixed, in the form that ``applyInArrow`` takes."""

    def run(table):
        out = f(table, **fixed)
        pa.default_memory_pool().release_unused()
        return out

    return run


def bound2(f, **fixed):
    """The same for two cogrouped tables."""

    def run(left, right):
        out = f(left, right, **fixed)
        pa.default_memory_pool().release_unused()
        return out

    return run
