"""Files in and out: JSON lines, uploads by kind, captions, manifests, exported runs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as S

from ..functions import spoken, text as T

BOM = "﻿"
PDF_SIGNATURE = b"%PDF-"
TIME = r"(?:(\d{1,2}):)?(\d{1,2}):(\d{2})[,.](\d{1,3})"
CUE = rf"{TIME}\s*-->\s*{TIME}"
SAMPLES_A_SECOND = 16_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all machines share; see the README on ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints/leafmark"
    return os.path.join(base.rstrip("/"), f"{name}-{uuid.uuid4().hex}")


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key together, in as many tasks as the session shuffles to: for few bytes with much work, which would else be put together by their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


class Kept:
    """Tables of one run in the shared folder, which the run removes itself."""

    def __init__(self) -> None:
        self._paths: dict[DataFrame, str] = {}

    def keep(self, df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
        """``df`` written and read back: its lineage ends here. ``group_bytes`` is for tables of large rows: a reader decodes no more at once."""
        path = scratch(df.sparkSession, name)
        (df.write.option("parquet.block.size", group_bytes) if group_bytes else df.write).parquet(path)
        back = df.sparkSession.read.schema(df.schema).parquet(path)
        self._paths[back] = path
        return back

    def drop_all_but(self, *kept: DataFrame) -> None:
        for table in [t for t in self._paths if not any(t is k for k in kept)]:
            where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(self._paths.pop(table))
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def read_jsonl(spark: SparkSession, path: str, schema: S.StructType | str) -> DataFrame:
    """One JSON object a line; blank lines and a byte-order mark are skipped, a broken line is an error."""
    lines = spark.read.text(path).select(F.regexp_replace("value", f"^{BOM}", "").alias("value")).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def write_rows(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> str:
    """UTF-8 JSON lines, overwritten or appended to."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)
    return path


def sniff_sources(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, kind, mime, reason``: by the extension and what is inside; what is refused keeps its row and has a reason."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    pdf, text = suffix == ".pdf", suffix.isin(".md", ".markdown", ".txt")
    fine = F.when(pdf, F.startswith(F.col(content), F.lit(PDF_SIGNATURE))).when(text, F.is_valid_utf8(F.col(content).cast("string"))).otherwise(False)
    kind = F.when(pdf, "pdf").when(suffix == ".txt", "txt").otherwise("markdown")
    mime = F.when(pdf, "application/pdf").when(suffix == ".txt", "text/plain").otherwise("text/markdown")
    return files.select(path, F.when(fine, kind).alias("kind"), F.when(fine, mime).alias("mime"), F.when(~fine, "unsupported_media_type").alias("reason"))


def _ms(parts: list[Column]) -> Column:
    h, m, s, f = parts
    whole = lambda c: F.coalesce(F.nullif(c, F.lit("")).cast("long"), F.lit(0))
    return ((whole(h) * 60 + whole(m)) * 60 + whole(s)) * 1000 + F.rpad(f, 3, "0").cast("long")


def read_captions(files: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """``path, ordinal, start_ms, end_ms, text`` of the cues in SRT and WebVTT files, one row a file in.

    Blocks are parted by blank lines; the first line with two times begins a cue, its text follows. Tags go,
    character references are resolved; cues without text or that end before they begin are left out. A file
    without any cue has no rows here; see :func:`refused_captions`.
    """
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, f"^{BOM}", ""), "\r\n", "\n"), "\r", "\n")
    blocks = files.select(path, F.posexplode(F.split(text, r"\n\s*\n")).alias("block", "raw"))
    lines = blocks.select(path, "block", F.filter(F.split("raw", "\n"), lambda x: ~x.rlike(r"^\s*$")).alias("lines"))
    timed = lines.withColumn("at", F.array_position(F.transform("lines", lambda x: x.rlike(CUE)), True)).where("at > 0")
    line = F.get("lines", F.col("at").cast("int") - 1)
    group = lambda k: F.regexp_extract(line, CUE, k)
    cues = timed.select(path, "block", _ms([group(k) for k in (1, 2, 3, 4)]).alias("start_ms"), _ms([group(k) for k in (5, 6, 7, 8)]).alias("end_ms"), F.expr("slice(lines, int(at) + 1, size(lines))").alias("rest"))
    body = spoken.unescaped(F.array_join("rest", "\n")).alias("body")
    shown = cues.select(path, "block", "start_ms", "end_ms", body).withColumn("text", T.normalize_ws(F.regexp_replace("body", r"<[^>]+>", "")))
    kept = shown.where("text <> '' and end_ms > start_ms")
    ordinal = F.row_number().over(Window.partitionBy(path).orderBy("block")) - 1
    return kept.select(path, ordinal.alias("ordinal"), "start_ms", "end_ms", "text")


def refused_captions(files: DataFrame, cues: DataFrame, path: str = "path") -> DataFrame:
    """Files without any cue."""
    return files.select(path).join(cues.select(path).distinct(), path, "left_anti").select(path, F.lit("caption_invalid").alias("reason"))


def read_speech_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``id, filename, reference, seconds, gender`` of a tab-separated manifest without quotes or header."""
    columns = "sentence_id string, filename string, raw string, normalized string, chars string, samples long, gender string"
    rows = spark.read.schema(columns).csv(path, sep="\t", quote="", escape="", header=False)
    return rows.select(F.concat_ws("/", "sentence_id", "filename").alias("id"), "filename", F.col("raw").alias("reference"), (F.col("samples") / SAMPLES_A_SECOND).alias("seconds"), "gender")


def clock(ms: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(ms / 60_000), F.floor(F.pmod(ms, F.lit(60_000)) / 1000))


def export_runs(runs: DataFrame, claims: DataFrame, evidence: DataFrame, sections: DataFrame | None = None, form: str = "markdown") -> DataFrame:
    """``run_id`` and ``markdown`` or ``json`` of finished runs: query, claims with the place of their first evidence, then all evidence; what was deleted is masked.

    ``runs``: run_id, query, status, answer_status, profile; ``claims``: run_id, claim_idx, text, status;
    ``evidence``: run_id, claim_idx, ordinal, source_alias, page_start, start_ms, role, transcription_state, source_deleted, snapshot, revision;
    ``sections``: run_id, item_no, title, template_text, claim_idxs (array). In Markdown the claims of a run with sections stand under
    their sections' titles and texts. JSON has the same parts as nested values, masked alike, without nulls.
    """
    hidden = F.coalesce("source_deleted", F.lit(False))
    where = F.when(F.col("start_ms").isNotNull(), F.concat(F.lit(", "), clock(F.col("start_ms")))).when(F.col("page_start").isNotNull(), F.concat(F.lit(", p. "), F.col("page_start").cast("string"))).otherwise("")
    body = F.when(hidden, "_[source deleted, content hidden]_").otherwise(F.concat(F.lit('"'), F.coalesce("snapshot", F.lit("")), F.lit('"')))
    label = F.when(F.col("transcription_state") == "automatic", "automatic transcript").otherwise(F.col("role"))
    line = F.concat(F.lit("- **"), F.col("source_alias"), F.lit("**"), where, F.lit(" ("), label, F.lit(", revision "), F.col("revision"), F.lit("): "), body)
    shown = F.struct("ordinal", line.alias("line"), F.concat(F.col("source_alias"), where).alias("cited"), F.struct("ordinal", "source_alias", "page_start", "start_ms", "role", "transcription_state", "revision", hidden.alias("source_deleted"), F.when(~hidden, F.col("snapshot")).alias("snapshot")).alias("item"))
    proof = evidence.groupBy("run_id", "claim_idx").agg(F.array_sort(F.collect_list(shown), lambda a, b: a["ordinal"].cast("int") - b["ordinal"].cast("int")).alias("e"))
    own = F.struct("claim_idx", "text", "status", F.coalesce(F.try_element_at("e.cited", F.lit(1)), F.lit("")).alias("cited"), F.coalesce("e.line", F.array().cast("array<string>")).alias("lines"), F.col("e.item").alias("evidence"))
    parts = claims.join(proof, ["run_id", "claim_idx"], "left").groupBy("run_id").agg(F.collect_list(own).alias("c"))
    by_number = lambda a, b: F.when(a["claim_idx"] < b["claim_idx"], -1).when(a["claim_idx"] > b["claim_idx"], 1).otherwise(0)
    whole = runs.join(parts.withColumn("c", F.array_sort("c", by_number)), "run_id", "left")
    if sections is not None:
        under = sections.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("item_no", "title", "template_text", "claim_idxs"))).alias("s"))
        whole = whole.join(under, "run_id", "left")
    if form == "json":
        listed = F.transform("c", lambda c: F.struct(c["claim_idx"].alias("claim_idx"), c["text"].alias("text"), c["status"].alias("status"), c["evidence"].alias("evidence")))
        return whole.select("run_id", F.to_json(F.struct("run_id", "query", "status", "answer_status", "profile", listed.alias("claims"), *([F.col("s").alias("sections")] if sections is not None else []))).alias("json"))
    empty = F.array().cast("array<string>")
    head = F.array(F.concat(F.lit("# "), F.col("query")), F.lit(""), F.concat(F.lit("> Run "), F.col("run_id").cast("string"), F.lit(" · "), F.col("status"), F.lit(" · "), F.coalesce("answer_status", F.lit("—")), F.lit(" · profile "), F.col("profile")), F.lit(""))
    plain = F.concat(F.coalesce(F.transform("c", lambda c: F.concat(F.lit("- "), c["text"], F.lit(" ["), c["cited"], F.lit("] — "), c["status"])), empty), F.array(F.lit("")))
    if sections is not None:
        of = lambda s: F.transform(F.filter(F.transform(s["claim_idxs"], lambda i: F.try_element_at(F.filter("c", lambda c: c["claim_idx"] == i), F.lit(-1))), lambda c: c.isNotNull()), lambda c: F.concat(F.lit("- "), c["text"], F.lit(" ["), c["cited"], F.lit("]")))
        parted = F.flatten(F.transform("s", lambda s: F.concat(F.array(F.concat(F.lit("## "), s["title"]), F.lit(""), F.coalesce(s["template_text"], F.lit("")), F.lit("")), of(s), F.array(F.lit("")))))
        plain = F.when(F.size("s") > 0, parted).otherwise(plain)
    lines = F.coalesce(F.flatten(F.transform("c", lambda c: c["lines"])), empty)
    return whole.select("run_id", F.array_join(F.concat(head, plain, F.array(F.lit("## Evidence"), F.lit("")), lines), "\n").alias("markdown"))
