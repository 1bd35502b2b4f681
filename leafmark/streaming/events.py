"""Event streams: suppression, sequence numbers, windows with late rows apart, and incremental ingestion.

The stateful functions keep a constant amount per key, and a timer of event time removes it once it
can change nothing any more; so state is bounded by the keys that are live, not by all there ever
were. Rows that come later than the watermark allows are left out. Each has a batch form,
against which the tests hold the stream run with ``availableNow``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.governance import RATE_RULES, rate_verdict

SUPPRESS_SECONDS = 60
#: How late a row may come.
DELAY = "10 minutes"
#: A run that is quiet for longer has ended.
IDLE_SECONDS = 86_400


def _seconds(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def _expire(state: GroupState, second: float) -> None:
    """The state goes once the watermark has passed this second of event time."""
    state.setTimeoutTimestamp(max(int(second * 1000) + 1, state.getCurrentWatermarkMs() + 1))


def kept_events(times: list[float], last: float | None, seconds: int = SUPPRESS_SECONDS) -> tuple[list[bool], float | None]:
    """Which of the sorted times are stored: those ``seconds`` or more after the last stored one."""
    out = []
    for t in times:
        keep = last is None or t - last >= seconds
        out.append(keep)
        last = t if keep else last
    return out, last


def suppress_batch(events: DataFrame, keys: list[str], ts: str, ident: str, seconds: int = SUPPRESS_SECONDS) -> DataFrame:
    """Stored events of a table: the fold restarts at each stored event of its key.

    A key's events stand together and in order, and a flag marks where it begins; a task reads them once, with the time last stored as all
    it keeps. A key's events lie in one task, but never in memory at once.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keep = []
            for second, first in zip(batch.column("second").to_pylist(), batch.column("__first").to_pylist()):
                stored = first or second is None or last is None or second - last >= seconds
                last = second if stored else last
                keep.append(stored)
            yield batch.filter(pa.array(keep, pa.bool_())).drop_columns("__first")

    rows = events.select(*keys, ident, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("second"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("second", ident)) == 1
    order = [*[F.col(k) for k in keys], F.col("second"), F.col(ident)]
    return rows.withColumn("__first", first).sortWithinPartitions(*order, F.col("__first").desc()).mapInArrow(fold, rows.schema)


def suppress_stream(events: DataFrame, keys: list[str], ts: str, ident: str, seconds: int = SUPPRESS_SECONDS, delay: str = DELAY) -> DataFrame:
    """The same on a stream: one timestamp of state per key, until an event would be stored whatever came before."""
    rows = events.select(*keys, ident, _seconds(ts).alias("second"), F.col(ts).cast("timestamp").alias("__at")).withWatermark("__at", delay)
    schema = rows.drop("__at").schema

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["second", ident])
        keep, last = kept_events(pdf["second"].tolist(), state.get[0] if state.exists else None, seconds)
        state.update((last,))
        _expire(state, last + seconds)
        yield pdf.loc[keep, schema.names]

    return rows.groupBy(*keys).applyInPandasWithState(fold, schema, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def run_numbers(times: list[float], seen: int = 0, last: float | None = None, idle: float = IDLE_SECONDS) -> tuple[list[int], int, float | None]:
    """Numbers from 1 of the sorted times, beginning anew after more than ``idle`` seconds without any; with the number and time to go on from."""
    out = []
    for t in times:
        seen = 1 if last is None or t - last > idle else seen + 1
        last = t if last is None else max(last, t)
        out.append(seen)
    return out, seen, last


def sequence_batch(events: DataFrame, key: str, ident: str, ts: str = "ts", idle: float = IDLE_SECONDS) -> DataFrame:
    """``seq`` of a table: numbers within runs of a key, which end where it is quiet for more than ``idle`` seconds."""
    order = Window.partitionBy(key).orderBy(ts, ident)
    gap = F.coalesce(_seconds(ts) - F.lag(_seconds(ts)).over(order) > idle, F.lit(True)).cast("int")
    runs = events.withColumn("__gap", gap).withColumn("__run", F.sum("__gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.withColumn("seq", F.row_number().over(Window.partitionBy(key, "__run").orderBy(ts, ident)).cast("long")).drop("__gap", "__run")


def sequence_stream(events: DataFrame, key: str, order: list[str], ts: str = "ts", idle: float | None = None, delay: str = DELAY) -> DataFrame:
    """Gap-free sequence numbers of a key's run across micro-batches: one counter and time of state per key.

    With ``idle`` a run ends where its key is quiet for more than so many seconds: the numbers begin anew, and the state goes when
    the watermark is past that. Without it runs have no end, nor has their state. A run's late row that the watermark lets through takes the next number, as numbers once given stay.
    """
    schema = T.StructType([*events.schema.fields, T.StructField("seq", T.LongType())])
    timed = events.withColumn("__second", _seconds(ts)).withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", delay)

    def number(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["__second", *order])
        numbers, seen, last = run_numbers(pdf["__second"].tolist(), *(state.get if state.exists else (0, None)), float("inf") if idle is None else idle)
        state.update((seen, last))
        if idle is not None:
            _expire(state, last + idle)
        yield pdf.assign(seq=numbers)[schema.names]

    return timed.groupBy(key).applyInPandasWithState(number, schema, "seen long, last double", "append", GroupStateTimeout.EventTimeTimeout)


def window_hits(times: list[int], width: int, bucket: int | None = None, here: int = 0, before: int = 0) -> tuple[list[tuple[int, int]], tuple[int, int, int]]:
    """``(hits of the window so far, hits of the one before)`` at each of the sorted times, and the bucket and counts to go on from.

    A late hit of the window before adds to that one; earlier ones touch nothing and see only themselves.
    """
    out = []
    for t in times:
        b = t // width
        if bucket is None or b > bucket:
            bucket, here, before = b, 1, here if bucket is not None and b == bucket + 1 else 0
        elif b == bucket:
            here += 1
        elif b == bucket - 1:
            before += 1
            out.append((before, 0))
            continue
        else:
            out.append((1, 0))
            continue
        out.append((here, before))
    return out, (bucket, here, before)


def rate_stream(events: DataFrame, rules: dict[str, tuple[int, int]] = RATE_RULES, ts: str = "ts", scale: float = 1.0, delay: str = DELAY) -> DataFrame:
    """``event_id, rule, effective, passes, retry_seconds`` of a stream under named rules; ``operators.governance.rate_rules`` is the batch form.

    ``events``: event_id, rule, subject, ts; ``rules``: name to limit and window in seconds; events of other rules are left out. Two counts
    of state per rule and subject, until the window after the last one has ended. Within a micro-batch hits count in the order of time, as of arrival else.
    """
    rows = events.where(F.col("rule").isin(list(rules))).select("event_id", "rule", "subject", F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(ts).cast("timestamp").alias("__at")).withWatermark("__at", delay)
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(n, T.LongType()) for n in ("window_seconds", "rule_limit", "here", "before"))])

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        most, window = rules[key[0]]
        pdf = pd.concat(list(batches)).sort_values(["us", "event_id"])
        found, after = window_hits(pdf["us"].tolist(), window * 1_000_000, *(state.get if state.exists else ()))
        state.update(after)
        _expire(state, (after[0] + 2) * window)
        yield pdf.assign(window_seconds=window, rule_limit=most, here=[h for h, _ in found], before=[b for _, b in found])[schema.names]

    counted = rows.groupBy("rule", "subject").applyInPandasWithState(count, schema, "bucket long, here long, before long", "append", GroupStateTimeout.EventTimeTimeout)
    return rate_verdict(counted, scale)


def windowed_counts(events: DataFrame, ts: str, keys: list[str], width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums in event-time windows; later rows than the watermark allows change nothing."""
    return events.withColumn("ts", F.col(ts).cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def ingest(stream: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Runs ``step`` on each micro-batch of new documents and writes it under its batch number: a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
