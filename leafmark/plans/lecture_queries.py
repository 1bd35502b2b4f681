"""Lecture tables over conversations: turns are speech, every third one a board; frames over vectors and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import lecture as L
from ..registry import query
from .text_queries import WS, put

TEXT = put(WS, "text")
PLAN = f"""sp AS (SELECT conv_id, turn, turn * 30000 AS s, turn * 30000 + 20000 AS e, CASE WHEN role = 'system' THEN 'caption' ELSE 'speech' END AS m, {TEXT} AS text FROM conversations WHERE {TEXT} <> ''),
sl AS (SELECT sp.*, (SELECT count(*) FROM conversations c WHERE c.conv_id = sp.conv_id AND c.turn % 4 = 2 AND c.turn * 30000 <= sp.s) AS slot FROM sp), o AS (SELECT *, row_number() OVER w AS i, coalesce(slot <> lag(slot) OVER w OR m <> lag(m) OVER w, TRUE) AS new FROM sl WINDOW w AS (PARTITION BY conv_id ORDER BY s, e, turn)),
r AS (SELECT conv_id, i, turn, 0 AS part, s AS first FROM o WHERE i = 1 UNION ALL SELECT o.conv_id, o.i, o.turn, CASE WHEN o.new OR o.e - r.first > 60000 THEN part + 1 ELSE part END, CASE WHEN o.new OR o.e - r.first > 60000 THEN o.s ELSE r.first END FROM r JOIN o ON o.conv_id = r.conv_id AND o.i = r.i + 1),
it AS (SELECT o.conv_id, 0 AS kind, CAST(part AS VARCHAR) AS part, m AS modality, 'segment' AS item_type, o.turn AS item, s AS a, e AS b, text FROM o JOIN r USING (conv_id, i) UNION ALL SELECT conv_id, 1, CAST(turn AS VARCHAR), 'board', 'region', turn, turn * 30000 + 5000, turn * 30000 + 45000, role FROM conversations WHERE turn % 3 = 0 AND turn % 2 = 0),
se AS (SELECT conv_id, kind, part, min(a) AS s0, CASE WHEN kind = 0 THEN max_by(b, (a, b, item)) ELSE max(b) END AS e0 FROM it GROUP BY conv_id, kind, part), de AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY s0, kind, e0, part) - 1 AS section_pos FROM se),
plan AS (SELECT it.*, s0, e0, section_pos, row_number() OVER (PARTITION BY it.conv_id, section_pos ORDER BY a, b, item) - 1 AS item_pos FROM it JOIN de USING (conv_id, kind, part)),
st AS (SELECT conv_id, section_pos, string_agg(text, ' ' ORDER BY item_pos) AS text FROM plan GROUP BY ALL), so AS (SELECT *, sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY section_pos) - length(text) - 2 AS o FROM st),
sm AS (SELECT plan.conv_id, plan.section_pos, item, item_type, a, b, modality, CAST(o + sum(length(plan.text) + 1) OVER w - length(plan.text) - 1 AS BIGINT) AS char_start, CAST(o + sum(length(plan.text) + 1) OVER w - 1 AS BIGINT) AS char_end FROM plan JOIN so USING (conv_id, section_pos) WINDOW w AS (PARTITION BY plan.conv_id, plan.section_pos ORDER BY item_pos))"""
R = "WITH RECURSIVE "


def speech(t) -> DataFrame:
    n, flags = F.col("turn").cast("long"), F.when(F.col("turn") % 5 == 0, F.array(F.lit("low_confidence"))).when(F.col("turn") % 5 == 1, F.array(F.lit("stock_phrase"))).otherwise(F.array().cast("array<string>"))
    return t("conversations").select(F.col("conv_id").alias("source_id"), F.format_string("%05d", "turn").alias("item_id"), "text", (n * 30_000).alias("start_ms"), (n * 30_000 + 20_000).alias("end_ms"), F.when(F.col("role") == "system", "human_caption").otherwise("asr").alias("origin"), flags.alias("flags"), (F.col("turn") % 2 == 0).alias("reviewed"), F.lit(None).cast("string").alias("asset_id"))


def board(t) -> DataFrame:
    n = F.col("turn").cast("long") * 30_000
    return t("conversations").where("turn % 3 = 0").select(F.col("conv_id").alias("source_id"), F.format_string("%05d", "turn").alias("item_id"), F.col("turn").alias("frame_id"), n.alias("timestamp_ms"), (n + 5_000).alias("visible_from_ms"), (n + 45_000).alias("visible_to_ms"), F.col("role").alias("text"), (F.col("turn") % 2 == 0).alias("included"), F.array().cast("array<string>").alias("flags"), F.lit(False).alias("reviewed"))


def plans(t) -> DataFrame:
    slides = t("conversations").where("turn % 4 = 2").select(F.col("conv_id").alias("source_id"), (F.col("turn").cast("long") * 30_000).alias("start_ms"))
    return L.plan_sections(speech(t), board(t), slides, window_ms=60_000)


@query("h01_plan_sections", R + PLAN + " SELECT conv_id, CAST(section_pos AS INTEGER) AS section_pos, modality, s0 AS start_ms, e0 AS end_ms, item_type, CAST(item AS BIGINT) AS item, CAST(item_pos AS INTEGER) AS item_pos FROM plan")
def plan_sections(t):
    return plans(t).select(F.col("source_id").alias("conv_id"), "section_pos", "modality", "start_ms", "end_ms", "item_type", F.col("item_id").cast("long").alias("item"), "item_pos")


@query("h02_timeline_map", R + PLAN + " SELECT conv_id, CAST(section_pos AS INTEGER) AS section_pos, item_type, CAST(item AS BIGINT) AS item, char_start, char_end FROM sm")
def timeline_map(t):
    spans = L.timeline_document(plans(t))[1]
    return spans.select(F.col("source_id").alias("conv_id"), "section_pos", F.col("target_type").alias("item_type"), F.col("target_id").cast("long").alias("item"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


@query("c11_locate", R + PLAN + """, q AS (SELECT DISTINCT conv_id, v.k, v.a AS qa, v.b AS qb FROM conversations, (VALUES (0, 10, 60), (1, 100, 101), (2, 50, 900), (3, 100000000, 100000001)) v(k, a, b)) SELECT q.conv_id, CAST(k AS INTEGER) AS k, min(sm.a) AS start_ms, max(sm.b) AS end_ms, CASE count(DISTINCT item_type) WHEN 0 THEN 'none' WHEN 1 THEN min(item_type) ELSE 'mixed' END AS precision, CAST(count(item_type) AS INTEGER) AS items FROM q LEFT JOIN sm ON sm.conv_id = q.conv_id AND char_start < qb AND char_end > qa GROUP BY q.conv_id, k""")
def locate(t):
    ranges = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).cast("long").alias("quote_start"), F.lit(b).cast("long").alias("quote_end")) for k, a, b in ((0, 10, 60), (1, 100, 101), (2, 50, 900), (3, 100_000_000, 100_000_001))])
    quotes = t("conversations").select(F.col("conv_id").alias("source_id")).distinct().select("source_id", F.inline(ranges)).withColumn("quote_id", F.struct("source_id", "k"))
    found = L.locate(quotes, L.timeline_document(plans(t))[1])
    return found.select(F.col("quote_id.source_id").alias("conv_id"), F.col("quote_id.k").alias("k"), "start_ms", "end_ms", "precision", F.size("items").alias("items"))


@query("c24_node_time_range", R + PLAN + ", n AS (SELECT DISTINCT conv_id, v.k, v.k * 200 AS x, v.k * 200 + 150 AS y FROM conversations, (VALUES (0), (1), (2)) v(k)) SELECT n.conv_id, CAST(k AS INTEGER) AS k, CASE WHEN count(DISTINCT modality) = 1 THEN min(modality) END AS modality, min(a) AS start_ms, max(b) AS end_ms FROM n JOIN sm ON sm.conv_id = n.conv_id AND char_start < y AND char_end > x GROUP BY n.conv_id, k")
def node_time_range(t):
    n = t("conversations").select(F.col("conv_id").alias("source_id")).distinct().select("source_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    n = n.select("source_id", F.struct("source_id", "k").alias("node_id"), (F.col("k") * 200).alias("char_start"), (F.col("k") * 200 + 150).alias("char_end"))
    return L.node_time_range(n, L.timeline_document(plans(t))[1]).select(F.col("node_id.source_id").alias("conv_id"), F.col("node_id.k").alias("k"), "modality", "start_ms", "end_ms")


@query("c13_asset_at", "WITH c AS (SELECT conv_id, turn, turn * 10000 AS a, turn * 10000 + 8000 AS b FROM conversations), i AS (SELECT conv_id, turn * 7000 AS ms FROM conversations) SELECT i.conv_id, i.ms, coalesce((SELECT min_by(turn, a) FROM c WHERE c.conv_id = i.conv_id AND a <= ms AND ms < b), (SELECT max(turn) FROM c WHERE c.conv_id = i.conv_id)) AS asset_id FROM i")
def asset_at(t):
    n = F.col("turn").cast("long")
    chunks = t("conversations").select("conv_id", F.col("turn").alias("asset_id"), (n * 10_000).alias("chunk_start"), (n * 10_000 + 8_000).alias("chunk_end"))
    return L.asset_at(t("conversations").select("conv_id", (n * 7_000).alias("ms")), chunks, "conv_id")


@query("c14_cue_offsets", "WITH o AS (SELECT c.conv_id, c.turn, (SELECT min(s.turn * 9000) FROM conversations s WHERE s.conv_id = c.conv_id AND s.turn % 2 = 0 AND s.turn * 9000 < c.turn * 10000 + 9000 AND s.turn * 9000 + 8000 > c.turn * 10000) AS f FROM conversations c) SELECT conv_id, count(*) AS cues, count(f) AS covered, quantile_cont(abs(f - turn * 10000), 0.5) AS p50_ms, max(abs(f - turn * 10000)) AS max_ms FROM o GROUP BY conv_id")
def cue_offset_report(t):
    n = F.col("turn").cast("long")
    cues = t("conversations").select("conv_id", F.col("turn").alias("cue_id"), (n * 10_000).alias("cue_start"), (n * 10_000 + 9_000).alias("cue_end"))
    segments = t("conversations").where("turn % 2 = 0").select("conv_id", (n * 9_000).alias("seg_start"), (n * 9_000 + 8_000).alias("seg_end"))
    return L.cue_offset_report(L.cue_offsets(cues, segments, "conv_id"), "conv_id")


@query("h03_coverage_report", "WITH s AS (SELECT conv_id, count(*) AS segments, count(*) FILTER (turn % 5 = 0) AS flagged, count(*) * 20000 AS speech_ms FROM conversations GROUP BY conv_id), b AS (SELECT conv_id, count(*) FILTER (turn % 2 = 0) AS i, count(*) FILTER (turn % 2 = 1) AS x FROM conversations WHERE turn % 3 = 0 GROUP BY conv_id) SELECT s.conv_id, speech_ms, segments, flagged AS segments_flagged, coalesce(i, 0) AS board_regions, coalesce(x, 0) AS board_regions_low_confidence, round(speech_ms / 1000000.0, 4) AS speech_ratio, round(flagged / segments, 4) AS flagged_ratio FROM s LEFT JOIN b USING (conv_id)")
def coverage_report(t):
    sources = t("conversations").select(F.col("conv_id").alias("source_id")).distinct().withColumn("duration_ms", F.lit(1_000_000)).withColumn("visual_incomplete_from_ms", F.lit(None).cast("long"))
    return L.coverage_report(speech(t), board(t), sources).select(F.col("source_id").alias("conv_id"), "speech_ms", "segments", "segments_flagged", "board_regions", "board_regions_low_confidence", "speech_ratio", "flagged_ratio")


@query("h04_changed_frames")
def changed_frames(t):
    """Vectors as frame signatures, a label's in order as a video."""
    frames = t("embeddings").select(F.col("label").alias("video_id"), F.col("vec_id").alias("ts_ms"), F.col("embedding").cast("array<double>").alias("signature"), F.lit(10**12).cast("long").alias("duration_ms")).where("embedding is not null")
    return L.select_changed_frames(frames, threshold=0.4, most=1_000_000)[0]


@query("h05_repeat_frames")
def repeat_frames(t):
    """Documents of a source in order as the boards of a video."""
    frames = t("documents").select(F.col("source").alias("video_id"), F.col("doc_id").alias("ts_ms"), (F.col("doc_id") + 1).alias("visible_to_ms"), "text")
    return L.merge_repeat_frames(frames).select("video_id", "ts_ms", "visible_to_ms", F.sha2("text", 256).alias("text_sha256"))


@query("h07_edited_revision", "SELECT conv_id, substr(sha1('r2|' || conv_id || '/' || printf('%05d', turn)), 1, 20) AS new_id, CASE WHEN turn % 4 = 1 THEN 'new ' || role ELSE text END AS text, CASE WHEN turn % 4 = 1 THEN '' WHEN turn % 5 = 0 THEN 'low_confidence' WHEN turn % 5 = 1 THEN 'stock_phrase' ELSE '' END AS flags, turn % 4 = 1 OR turn % 2 = 0 AS reviewed FROM conversations")
def edited_revision(t):
    base = speech(t).withColumn("key", F.concat_ws("/", F.col("source_id").cast("string"), "item_id"))
    edits = t("conversations").where("turn % 4 = 1").select(F.format_string("%d/%05d", "conv_id", "turn").alias("key"), F.concat(F.lit(" new  "), "role").alias("text"))
    made = L.edited_revision(base, edits, "r2", "key")
    return made.select(F.col("source_id").alias("conv_id"), "new_id", "text", F.array_join("flags", " ").alias("flags"), "reviewed")
