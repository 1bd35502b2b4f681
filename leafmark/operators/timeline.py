"""Time-ordered tables: gaps and islands, coverage, offsets, revisions, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .hierarchy import overlapping


def coverage(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Length of the union of a key's intervals: each adds what reaches past all before it."""
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(end).over(w), F.col(start))
    new = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), before))
    return intervals.withColumn("new", new).groupBy(key).agg(F.sum("new").alias("covered"), F.count("*").alias("intervals"))


def flag_cues(cues: DataFrame, key: str, duration: str = "duration") -> DataFrame:
    """alignment_uncertain past the end or anywhere in a file out of order, overlapping_cue where a cue begins long before the one before ends."""
    order = Window.partitionBy(key).orderBy("start_ms", "end_ms", "ordinal")
    file_order = Window.partitionBy(key).orderBy("ordinal")
    marked = cues.withColumn("before_end", F.lag("end_ms").over(order)).withColumn("inverted", F.col("start_ms") < F.lag("start_ms").over(file_order))
    any_inverted = F.coalesce(F.max("inverted").over(Window.partitionBy(key)), F.lit(False))
    flags = F.array_compact(F.array(F.when((F.col("end_ms") > F.col(duration) + 2000) | any_inverted, "alignment_uncertain"), F.when(F.col("start_ms") < F.col("before_end") - 1000, "overlapping_cue")))
    return marked.withColumn("flags", flags).drop("before_end", "inverted")


def islands(rows: DataFrame, key: str, start: str, end: str, gap: int) -> DataFrame:
    """Runs of intervals with gaps of at most ``gap``: key, island, start, end, n."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = rows.withColumn("new", F.coalesce((F.col(start) - reach > gap).cast("int"), F.lit(0))).withColumn("island", F.sum("new").over(w))
    return cut.groupBy(key, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"))


def alignment_edges(segments: DataFrame, regions: DataFrame, key: str, width: int = 60_000) -> DataFrame:
    """Shared time of segments and regions over the segment's length, for those that overlap; they meet by stretches of ``width``."""
    j = overlapping(segments, regions, [key], ("seg_start", "seg_end"), ("reg_start", "reg_end"), width=width)
    shared = F.least("seg_end", "reg_end") - F.greatest("seg_start", "reg_start")
    return j.select(key, "seg_id", "reg_id", F.round(shared / F.greatest(F.lit(1), F.col("seg_end") - F.col("seg_start")), 4).alias("share"))


def source_status(flagged: Column, missing: Column) -> Column:
    return F.when(flagged > 0.5, "review_required").when(missing, "ready_limited").otherwise("ready")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__first") == 1).drop("__first")


def apply_edits(base: DataFrame, edits: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A new revision: edited values replace the base's and are marked reviewed."""
    e = edits.select(*keys, F.col(value).alias("__new"))
    return base.join(e, keys, "left").withColumn("reviewed", F.col("__new").isNotNull()).withColumn(value, F.coalesce("__new", value)).drop("__new")


def rate_limit(events: DataFrame, key: str, ts: str, window_seconds: int, limit: int) -> DataFrame:
    """Fixed windows whose predecessor counts by its share that a sliding window would still see.

    Per event: hits of its window so far, of the window before, the weighted sum, and whether it passes.
    """
    t = events.withColumn("second", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)
    t = t.withColumn("bucket", F.floor(F.col("second") / window_seconds)).withColumn("elapsed", (F.col("second") - F.col("bucket") * window_seconds) / window_seconds)
    counts = t.groupBy(key, "bucket").agg(F.count("*").alias("before")).select(key, (F.col("bucket") + 1).alias("bucket"), "before")
    here = F.row_number().over(Window.partitionBy(key, "bucket").orderBy("second", "event_id"))
    hits = t.withColumn("here", here).join(counts, [key, "bucket"], "left").withColumn("before", F.coalesce("before", F.lit(0)))
    weighted = F.col("here") + F.col("before") * (1 - F.col("elapsed"))
    return hits.select("event_id", key, "here", "before", F.round(weighted, 6).alias("effective"), (F.round(weighted, 6) <= limit).alias("passes"))


def sequence(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Gap-free sequence numbers of a key's events."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def replay(events: DataFrame, key: str, item: str, after: int) -> DataFrame:
    """The state that a client has after the events past ``after``: an item keeps its first place and its last payload."""
    return events.where(F.col("seq") > after).groupBy(key, item).agg(F.min("seq").alias("first_seq"), F.max_by("payload", "seq").alias("payload"))


def idempotent(requests: DataFrame, keys: list[str], body: str, order: list[str]) -> DataFrame:
    """Each request's first twin, and a conflict where the bodies differ."""
    first = F.struct(*order, F.col(body).alias("body"))
    firsts = requests.groupBy(*keys).agg(F.min(first).alias("first"))
    return requests.join(firsts, keys).select(*order, F.col(f"first.{order[-1]}").alias("first_request"), (F.col(body) != F.col("first.body")).alias("conflict"))


def keyset_page(rows: DataFrame, ts: str, ident: str, cursor: tuple | None, n: int) -> DataFrame:
    """The next ``n + 1`` rows after the cursor in order; one more than a page tells that another follows."""
    after = rows if cursor is None else rows.where(F.struct(ts, ident) > F.struct(F.lit(cursor[0]).cast(rows.schema[ts].dataType).alias(ts), F.lit(cursor[1]).cast(rows.schema[ident].dataType).alias(ident)))
    return after.orderBy(ts, ident).limit(n + 1)
