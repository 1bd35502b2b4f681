"""What the operators share: the shared folder, batches of documents, connected components."""

from __future__ import annotations

import os
import threading
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class _Written(threading.local):
    """Folders written by :func:`stored` and not yet removed, in each thread by itself: a run removes none that another query beside it still reads."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_WRITTEN = _Written()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset a folder of this machine
    is taken by a local session, as in tests; a session with executors elsewhere is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints/leafmark"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors.

    The table stays until :func:`release`, as what is derived from it may be read at any time.
    """
    path = os.path.join(shared_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _WRITTEN.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """The stored tables so far, for :func:`release`."""
    return list(_WRITTEN.paths)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove stored tables that nothing will read again."""
    for path in paths:
        if path in _WRITTEN.paths:
            _WRITTEN.paths.remove(path)
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Tables:
    """Stored tables of one run: only that run removes them."""

    def __init__(self) -> None:
        self._paths: dict[DataFrame, str] = {}

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written to the shared folder and read back, as :func:`stored` does; its shuffle files go with the write that made them."""
        spark = df.sparkSession
        path, before = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}"), spark.conf.get(SHUFFLE_CLEANUP, "false")
        spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.set(SHUFFLE_CLEANUP, before)
        back = spark.read.schema(df.schema).parquet(path)
        self._paths[back] = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables of this run that nothing will read again."""
        for table in tables:
            where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(self._paths.pop(table))
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: rows ``(node, component)``, component = smallest node reachable.

    Alternating large-star and small-star steps. A node's smallest neighbour is
    found by ``groupBy().min`` (combined before the shuffle) and joined back, so
    the neighbours of a hub are never gathered in one place, and joins on a hub
    can be split. Each round is written to the shared folder.
    """
    two_way = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        # large: every node, its larger neighbours; small: edges point from the larger node to the smaller
        n = two_way(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = n.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        j = n.join(low, "a")
        if large:
            return j.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    digest = None
    for _ in range(max_rounds):
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if row["n"] == 0 or (row["n"], row["h"]) == digest:
            break
        digest, before = (row["n"], row["h"]), written()[-1:]
        e = stored(star(star(e, True), False), "links")
        release(e.sparkSession, before)  # the round before
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled: every edge runs from a node to the root of its star
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def dealt(rows: DataFrame, key: str, spread: str, block: int) -> DataFrame:
    """Groups of ``key`` with two rows or more, in blocks of about ``block`` rows: adds ``own, lo, hi``.

    A group of more rows is cut into blocks by the hash of ``spread``, and each row
    goes to every pair of blocks with its own, so that all rows of ``(key, lo, hi)``
    fit in memory and any two rows of a group meet: in ``(own, own)`` if they share
    a block, else in the pair of their blocks. The sizes are counted with a combine
    before the shuffle; a large group is never gathered.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("group_rows")).where("group_rows > 1")
    n = F.ceil(F.col("group_rows") / F.lit(block))
    own = F.pmod(F.xxhash64(spread), n).cast("int")
    blocks = rows.join(sizes, key).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    return blocks.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", "group_rows")
