"""Lecture tables: sections of speech and boards, their text with a map back to time, frames, quotes in time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from .hierarchy import overlapping

WINDOW_MS, SAME_BOARD = 180_000, 0.9
#: Milliseconds of a stretch in which cues and segments meet.
STRETCH_MS = 60_000
#: Flags of a segment that count it as doubtful.
DOUBTFUL = ["low_confidence", "possible_repetition", "alignment_uncertain"]
CAPTIONS = ["human_caption", "auto_caption"]


def clock(ms: Column) -> Column:
    """mm:ss, with hours only where there are some."""
    s = F.floor(ms / 1000)
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))).otherwise(F.format_string("%02d:%02d", F.floor(s / 60), F.pmod(s, F.lit(60))))


def _cut_long(kind: str, window_ms: int):
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_ms", "end_ms", "item_id"])
        part, first, out = -1, 0, []
        for start, end, new in zip(pdf["start_ms"], pdf["end_ms"], pdf["new"]):
            if new or end - first > window_ms:
                part, first = part + 1, start
            out.append(part)
        return pd.DataFrame({"source_id": pdf["source_id"], "item_id": pdf["item_id"], "part": out})

    return fold


def plan_sections(speech: DataFrame, board: DataFrame, slides: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """``source_id, section_pos, modality, start_ms, end_ms, item_type, item_id, item_pos, text, item_start, item_end, asset_id, flags, reviewed``.

    Speech and captions in time order are cut where a slide begins, where the kind changes, and where a section would grow
    longer than the window; the regions of a frame are a section. Sections go by their starts, speech before boards. ``speech``: source_id, item_id, text, start_ms, end_ms,
    origin, flags, reviewed, asset_id; ``board``: source_id, item_id, frame_id, timestamp_ms, visible_from_ms, visible_to_ms, text, included,
    flags, reviewed; ``slides``: source_id, start_ms. Only the length cut, which begins anew at each cut, is a fold; it holds numbers only.
    """
    said = speech.where(T.normalize_ws("text") != "").withColumn("modality", F.when(F.col("origin").isin(CAPTIONS), "caption").otherwise("speech"))
    marks = slides.select("source_id", "start_ms").distinct().select("source_id", F.col("start_ms").alias("at"), F.lit(0).alias("order"), F.lit(None).cast("string").alias("item_id"))
    both = said.select("source_id", F.col("start_ms").alias("at"), F.lit(1).alias("order"), "item_id").unionByName(marks)
    slot = F.count_if(F.col("order") == 0).over(Window.partitionBy("source_id").orderBy("at", "order").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    slots = both.withColumn("slot", slot).where("order = 1").select("source_id", "item_id", "slot")
    timed = said.join(slots, ["source_id", "item_id"])
    w = Window.partitionBy("source_id").orderBy("start_ms", "end_ms", "item_id")
    new = F.coalesce((F.col("slot") != F.lag("slot").over(w)) | (F.col("modality") != F.lag("modality").over(w)), F.lit(True))
    kind = f"source_id {speech.schema['source_id'].dataType.simpleString()}, item_id {speech.schema['item_id'].dataType.simpleString()}"
    parts = timed.withColumn("new", new).select("source_id", "item_id", "start_ms", "end_ms", "new").groupBy("source_id").applyInPandas(_cut_long(kind, window_ms), f"{kind}, part int")
    spoken = timed.join(parts, ["source_id", "item_id"]).select(
        "source_id", F.lit(0).alias("kind"), F.col("part").cast("string").alias("part"), "modality", F.lit("segment").alias("item_type"), "item_id", F.col("start_ms").alias("item_start"), F.col("end_ms").alias("item_end"), F.col("start_ms").alias("section_start"), F.col("start_ms").alias("at"), T.normalize_ws("text").alias("text"), "asset_id", "flags", "reviewed",
    )
    shown = board.where(F.col("included") & (T.normalize_ws("text") != "")).select(
        "source_id", F.lit(1).alias("kind"), F.col("frame_id").cast("string").alias("part"), F.lit("board").alias("modality"), F.lit("region").alias("item_type"), "item_id", F.col("visible_from_ms").alias("item_start"), F.col("visible_to_ms").alias("item_end"), F.col("visible_from_ms").alias("section_start"), F.col("timestamp_ms").alias("at"), T.normalize_ws("text").alias("text"), F.col("frame_id").cast("string").alias("asset_id"), "flags", "reviewed",
    )
    items = spoken.unionByName(shown)
    of_section = Window.partitionBy("source_id", "kind", "part")
    # speech ends with its last item, a board with the one that stays longest
    in_order = of_section.orderBy("at", "item_end", "item_id")
    last = F.last("item_end").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    items = items.withColumn("start_ms", F.min("section_start").over(of_section)).withColumn("end_ms", F.when(F.col("kind") == 0, last).otherwise(F.max("item_end").over(of_section))).withColumn("item_pos", F.row_number().over(in_order) - 1)
    place = F.dense_rank().over(Window.partitionBy("source_id").orderBy("start_ms", "kind", "end_ms", "part")) - 1
    return items.withColumn("section_pos", place).drop("kind", "part", "section_start", "at")


def timeline_document(plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(sections, source map)``: items joined by spaces, sections by blank lines; each item's place in the whole text with its time and asset."""
    w = Window.partitionBy("source_id", "section_pos").orderBy("item_pos")
    within = F.sum(F.length("text") + 1).over(w) - F.length("text") - 1
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_pos", "text"))), lambda x: x["text"]), " ")
    sections = plans.groupBy("source_id", "section_pos", "modality", "start_ms", "end_ms").agg(text.alias("text"))
    before = F.sum(F.length("text") + 2).over(Window.partitionBy("source_id").orderBy("section_pos")) - F.length("text") - 2
    sections = sections.withColumn("char_start", before)
    label = F.when(F.col("modality") == "board", F.concat(F.lit("Board "), clock(F.col("start_ms")))).otherwise(F.concat(F.when(F.col("modality") == "caption", "Captions ").otherwise("Speech "), clock(F.col("start_ms")), F.lit("–"), clock(F.col("end_ms"))))
    spans = plans.withColumn("within", within).join(sections.select("source_id", "section_pos", F.col("char_start").alias("offset")), ["source_id", "section_pos"])
    start = F.col("offset") + F.col("within")
    spans = spans.select("source_id", "section_pos", start.alias("char_start"), (start + F.length("text")).alias("char_end"), F.col("item_type").alias("target_type"), F.col("item_id").alias("target_id"), F.col("item_start").alias("start_ms"), F.col("item_end").alias("end_ms"), "asset_id", "modality", "flags", "reviewed")
    return sections.withColumn("title", label), spans


def locate(quotes: DataFrame, spans: DataFrame) -> DataFrame:
    """``quote_id, start_ms, end_ms, precision, items`` of quotes by character ranges; a quote out of range has no items.

    ``quotes``: quote_id, source_id, quote_start, quote_end.
    """
    met = overlapping(quotes, spans, ["source_id"], ("quote_start", "quote_end"), ("char_start", "char_end"), "left")
    item = F.when(F.col("char_start").isNotNull(), F.struct("char_start", "target_type", "target_id", "start_ms", "end_ms", "asset_id", "flags", "reviewed"))
    g = met.groupBy("quote_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.collect_set("target_type").alias("kinds"), F.array_sort(F.collect_list(item)).alias("items"))
    return g.select("quote_id", "start_ms", "end_ms", F.when(F.size("kinds") == 0, "none").when(F.size("kinds") == 1, F.col("kinds")[0]).otherwise("mixed").alias("precision"), "items")


def node_time_range(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """``node_id, modality, start_ms, end_ms`` of nodes over the spans that they meet; the modality only if there is one."""
    met = overlapping(nodes.select("node_id", "source_id", F.col("char_start").alias("a"), F.col("char_end").alias("b")), spans, ["source_id"], ("a", "b"), ("char_start", "char_end"))
    return met.groupBy("node_id").agg(F.when(F.count_distinct("modality") == 1, F.min("modality")).alias("modality"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def asset_at(instants: DataFrame, chunks: DataFrame, key: str = "source_id") -> DataFrame:
    """Adds ``asset_id``, the chunk with the instant ``ms``; past the end and in gaps the last one. ``chunks``: key, asset_id, chunk_start, chunk_end, in order of starts."""
    found = instants.join(chunks, key, "left").groupBy(*instants.columns).agg(F.min_by("asset_id", F.when((F.col("chunk_start") <= F.col("ms")) & (F.col("ms") < F.col("chunk_end")), F.col("chunk_start"))).alias("here"), F.max_by("asset_id", "chunk_start").alias("last"))
    return found.select(*instants.columns, F.coalesce("here", "last").alias("asset_id"))


def cue_offsets(cues: DataFrame, segments: DataFrame, key: str = "source_id") -> DataFrame:
    """``key, cue_id, offset_ms``: how far the earliest overlapping segment begins from each cue; null if there is none."""
    met = overlapping(cues, segments, [key], ("cue_start", "cue_end"), ("seg_start", "seg_end"), "left", STRETCH_MS)
    g = met.groupBy(key, "cue_id", "cue_start").agg(F.min("seg_start").alias("first"))
    return g.select(key, "cue_id", F.abs(F.col("first") - F.col("cue_start")).alias("offset_ms"))


def cue_offset_report(offsets: DataFrame, key: str = "source_id") -> DataFrame:
    return offsets.groupBy(key).agg(F.count("*").alias("cues"), F.count("offset_ms").alias("covered"), F.percentile("offset_ms", 0.5).alias("p50_ms"), F.max("offset_ms").alias("max_ms"))


def coverage_report(speech: DataFrame, board: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source: union of speaking time and its share, segments and doubtful ones, board regions included and left out, where reading stopped.

    ``sources``: source_id, duration_ms, visual_incomplete_from_ms.
    """
    w = Window.partitionBy("source_id").orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.coalesce(F.max("end_ms").over(w), F.col("start_ms")), F.col("start_ms"))
    doubt = F.arrays_overlap("flags", F.array(*map(F.lit, DOUBTFUL)))
    said = speech.withColumn("new", F.greatest(F.lit(0), F.col("end_ms") - reach)).groupBy("source_id").agg(F.sum("new").alias("speech_ms"), F.count("*").alias("segments"), F.count_if(doubt).alias("segments_flagged"))
    seen = board.groupBy("source_id").agg(F.count_if("included").alias("board_regions"), F.count_if(~F.col("included")).alias("board_regions_low_confidence"))
    j = sources.join(said, "source_id", "left").join(seen, "source_id", "left").na.fill(0, ["speech_ms", "segments", "segments_flagged", "board_regions", "board_regions_low_confidence"])
    return j.withColumn("speech_ratio", F.round(F.try_divide("speech_ms", "duration_ms"), 4)).withColumn("flagged_ratio", F.round(F.try_divide("segments_flagged", "segments"), 4))


def select_changed_frames(frames: DataFrame, threshold: float, most: int, pixel_delta: float = 0.12) -> tuple[DataFrame, DataFrame]:
    """``(selected, stopped)``: frames that differ from the last selected one in a share of ``threshold`` of their signature or more.

    ``frames``: video_id, ts_ms, signature array<double>, duration_ms. A selected frame is visible until the next one, the last until the
    end or, where ``most`` were taken, until the first one left unread, which ``stopped`` names. The signatures of a video form a matrix,
    in which each selected frame is compared with stretches of those after it until one differs enough; the rest is windows.
    """
    kind = frames.schema["video_id"].dataType.simpleString()

    def changed(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("ts_ms", kind="stable")
        seen = np.stack(pdf["signature"].to_numpy()).astype(float)
        taken, change, start, stretch = [0], [1.0], 1, 16
        while start < len(seen) and len(taken) <= most:
            moved = (np.abs(seen[start:start + stretch] - seen[taken[-1]]) > pixel_delta).mean(axis=1)
            far = np.flatnonzero(moved >= threshold)
            if far.size:
                taken.append(start + int(far[0]))
                change.append(float(moved[far[0]]))
            start, stretch = (taken[-1] + 1, 16) if far.size else (start + stretch, 2 * stretch)
        return pdf[["video_id", "ts_ms", "duration_ms"]].iloc[taken].assign(change=change)

    found = frames.groupBy("video_id").applyInPandas(changed, f"video_id {kind}, ts_ms long, duration_ms long, change double")
    order = Window.partitionBy("video_id").orderBy("ts_ms")
    ranked = found.select("video_id", "ts_ms", F.coalesce(F.lead("ts_ms").over(order), "duration_ms").alias("visible_to_ms"), "change", F.row_number().over(order).alias("place"))
    unread = F.max(F.when(F.col("place") > most, F.col("ts_ms")))
    return ranked.where(F.col("place") <= most).drop("place"), ranked.groupBy("video_id").agg(unread.alias("unread_from_ms"))


def merge_repeat_frames(frames: DataFrame, least: float = SAME_BOARD) -> DataFrame:
    """``video_id, ts_ms, visible_to_ms, text``: a frame whose words are those of the last kept one, to a Jaccard similarity of ``least``, only makes that one last longer.

    ``frames``: video_id, ts_ms, visible_to_ms, text of all its regions; a frame without text is left out. A video's frames come to one task in order, in batches:
    what is compared is the words last kept, which are all that is held beside a batch.
    """
    shown = ["video_id", "ts_ms", "visible_to_ms", "text"]
    lasting = lambda rows, ends: rows.set_column(2, "visible_to_ms", pa.array(ends, pa.int64()))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: set = set()
        video = ()
        held = to = None  # the frame last kept, and how long it lasts by now
        for batch in batches:
            at, ends = [], []
            columns = [batch.column(c) for c in ("video_id", "visible_to_ms", "words")] + [pc.binary_length(batch.column("text"))]
            for i, (of, end, words, size) in enumerate(zip(*columns)):
                if of.as_py() != video:
                    before, video = set(), of.as_py()
                own = set(words.as_py())
                if own and before and len(own & before) / len(own | before) >= least:
                    if ends:
                        ends[-1] = end.as_py()
                    else:
                        to = end.as_py()
                elif size.as_py():
                    at.append(i)
                    ends.append(end.as_py())
                    before = own
            if at:
                kept = lasting(batch.select(shown).take(pa.array(at)), ends)
                if held is not None:
                    yield lasting(held, [to])
                yield kept.slice(0, len(at) - 1)
                held, to = kept.take(pa.array([len(at) - 1])), ends[-1]  # a copy: it holds no batch
        if held is not None:
            yield lasting(held, [to])

    rows = frames.withColumn("said", F.coalesce("text", F.lit(""))).select("video_id", F.col("ts_ms").cast("long").alias("ts_ms"), F.col("visible_to_ms").cast("long").alias("visible_to_ms"), T.normalize_ws("said").alias("text"), T.token_set("said").alias("words"))
    return rows.repartition("video_id").sortWithinPartitions("video_id", "ts_ms").mapInArrow(fold, rows.drop("words").schema)


def edited_revision(base: DataFrame, edits: DataFrame, revision: str, key: str = "item_id") -> DataFrame:
    """The rows of a new revision: edited texts replace the base's, lose their flags and are reviewed; all others come along.

    ``base``: key, text, flags, reviewed, ...; ``edits``: key, text. The new ids are hashes of the revision and the old ones.
    """
    e = edits.select(key, T.normalize_ws("text").alias("__text"))
    j = base.join(e, key, "left")
    changed = F.col("__text").isNotNull()
    out = j.withColumn("edited_from", F.when(changed, F.col(key))).withColumn("text", F.coalesce("__text", "text")).withColumn("flags", F.when(changed, F.array().cast("array<string>")).otherwise(F.col("flags"))).withColumn("reviewed", changed | F.col("reviewed")).withColumn("origin", F.when(changed, "manual_edit").otherwise(F.lit("base")))
    return out.withColumn("revision_id", F.lit(revision)).withColumn("new_id", T.stable_id(F.lit(revision), F.col(key).cast("string"))).drop("__text")
