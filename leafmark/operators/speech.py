"""Transcripts: error rates, screening of segments, glossaries, batches for translation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import spoken, text as T

LOW_LOGPROB, REPETITIVE, SILENT, NO_SPEECH, END_TOLERANCE_MS = -1.0, 2.4, 0.8, 0.5, 1000
TERMS, TERM_CHARS, GLOSSARY_CHARS = 40, 60, 400
BATCH_CHARS, BATCH_ROWS = 5000, 30
# Closing phrases that recognizers make up in silence.
STOCK_PHRASES = (
    r"hẹn gặp lại (?:các bạn )?(?:trong|ở) (?:những |các )?(?:video|clip|tập) (?:tiếp theo|sau)"
    r"|cảm ơn (?:các bạn )?(?:đã )?(?:theo dõi|xem video|lắng nghe)(?: video)?"
    r"|(?:hãy |nhớ )?(?:subscribe|đăng ký)(?: cho)? kênh[\p{L}\p{N}_ ]*?(?= |$)"
    r"|ghiền mì gõ|để không bỏ lỡ những video hấp dẫn"
    r"|thanks? (?:you )?for watching|please subscribe|subtitles by the amara\.org community"
)


def error_rates(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """Adds ``words, word_errors, chars, char_errors, numbers, numbers_hit`` of each utterance, on normalized transcripts."""
    n = pairs.withColumn("__r", T.normalize_transcript(reference)).withColumn("__h", T.normalize_transcript(hypothesis))
    n = n.withColumn("__rw", T.spaced_tokens("__r")).withColumn("__hw", T.spaced_tokens("__h"))
    figures = F.filter("__rw", lambda w: w.rlike(r"^\p{Nd}+$"))
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    out = n.withColumn("words", F.size("__rw")).withColumn("word_errors", spoken.word_edits(F.col("__rw"), F.col("__hw"))).withColumn("chars", F.length(bare("__r"))).withColumn("char_errors", F.levenshtein(bare("__r"), bare("__h")))
    return out.withColumn("numbers", F.size(figures)).withColumn("numbers_hit", T.multiset_overlap(figures, F.col("__hw"))).drop("__r", "__h", "__rw", "__hw")


def rates() -> list[Column]:
    """Aggregates of :func:`error_rates`: errors over all words and characters, numbers found, the median utterance, processing over speaking time."""
    over = lambda a, b: F.sum(a) / F.greatest(F.lit(1), F.sum(b))
    return [
        F.count("*").alias("utterances"), over("word_errors", "words").alias("wer"), over("char_errors", "chars").alias("cer"), F.try_divide(F.sum("numbers_hit"), F.sum("numbers")).alias("number_recall"),
        F.percentile(F.col("word_errors") / F.greatest(F.lit(1), F.col("words")), 0.5).alias("median_wer"),
    ]


def error_rate_report(pairs: DataFrame, by: list[str], reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """:func:`rates` per group and form: as transcribed, and with spoken numbers of both sides as digits."""
    in_digits = pairs.withColumn(reference, spoken.digits_from_number_words(F.col(reference))).withColumn(hypothesis, spoken.digits_from_number_words(F.col(hypothesis)))
    both = error_rates(pairs, reference, hypothesis).withColumn("form", F.lit("as is")).unionByName(error_rates(in_digits, reference, hypothesis).withColumn("form", F.lit("digits")))
    return both.groupBy(*by, "form").agg(*rates())


def real_time_factor(seconds: DataFrame, by: list[str]) -> DataFrame:
    """Processing time over speaking time: ``seconds``: by..., processing, speaking."""
    return seconds.groupBy(*by).agg(F.try_divide(F.sum("processing"), F.sum("speaking")).alias("rtf"))


def worst(scored: DataFrame, by: list[str], ident: str, n: int = 5) -> DataFrame:
    """The utterances of each group with the highest word error rates."""
    rate = F.col("word_errors") / F.greatest(F.lit(1), F.col("words"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(rate.desc(), ident))
    return scored.withColumn("place", place).where(F.col("place") <= n).select(*by, "place", ident, rate.alias("wer"))


def _plain(c: Column) -> Column:
    return T.normalize_ws(F.regexp_replace(F.lower(spoken.nfc(c)), r"[^\p{L}\p{N}_\s]", " "))


def screen_segments(segments: DataFrame) -> DataFrame:
    """Adds ``keep``, ``end`` (brought into the medium) and ``flags``.

    ``segments``: start_ms, end_ms, text, duration_ms (null: unknown) and, if there, avg_logprob, no_speech_prob,
    compression_ratio. What begins after the end, or is made of closing phrases only, or is silence most likely, is not kept.
    """
    known = lambda c: F.col(c) if c in segments.columns else F.lit(None).cast("double")
    s = segments.withColumn("__plain", _plain(F.col("text")))
    stock = F.col("__plain").rlike(STOCK_PHRASES)
    late = F.coalesce(F.col("start_ms") >= F.col("duration_ms"), F.lit(False))
    beyond = F.coalesce(F.col("end_ms") > F.col("duration_ms") + END_TOLERANCE_MS, F.lit(False))
    only = stock & (F.trim(F.regexp_replace("__plain", STOCK_PHRASES, " ")) == "")
    silent = F.coalesce((known("no_speech_prob") > SILENT) & (known("avg_logprob") < LOW_LOGPROB), F.lit(False))
    flags = F.array_compact(F.array(F.when(beyond, "beyond_media_end"), F.when(stock, "stock_phrase"), F.when(known("avg_logprob") < LOW_LOGPROB, "low_confidence"), F.when(known("compression_ratio") > REPETITIVE, "possible_repetition"), F.when(known("no_speech_prob") > NO_SPEECH, "possible_non_speech")))
    keep = ~(late | only | silent)
    return s.withColumn("keep", keep).withColumn("end", F.when(beyond & ~late, F.col("duration_ms")).otherwise(F.col("end_ms"))).withColumn("flags", F.when(keep, flags).otherwise(F.array().cast("array<string>"))).drop("__plain")


def clean_glossary(terms: DataFrame) -> DataFrame:
    """``workspace_id, terms, reason``: composed forms without control characters, the first of equal ones; what passes a limit is refused whole.

    ``terms``: workspace_id, ordinal, term.
    """
    term = T.normalize_ws(F.regexp_replace(spoken.nfc(F.col("term")), r"\p{C}", ""))
    folded = terms.select("workspace_id", "ordinal", term.alias("term")).where("term <> ''").withColumn("__fold", T.fold("term"))
    firsts = folded.groupBy("workspace_id", "__fold").agg(F.min(F.struct("ordinal", "term")).alias("t"))
    g = firsts.groupBy("workspace_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["term"]).alias("terms"))
    reason = F.when(F.exists("terms", lambda t: F.length(t) > TERM_CHARS), "term too long").when(F.size("terms") > TERMS, "too many terms").when(F.length(F.array_join("terms", ", ")) > GLOSSARY_CHARS, "glossary too long")
    kept = g.withColumn("reason", reason)
    return kept.select("workspace_id", F.when(F.col("reason").isNull(), F.col("terms")).alias("terms"), "reason")


def batch_segments(segments: DataFrame, key: str = "source_id", order: str = "ordinal", text: str = "text", chars: int = BATCH_CHARS, rows: int = BATCH_ROWS) -> DataFrame:
    """Adds ``batch`` (from 0 in each source): segments in order, as many as a batch's characters and rows allow; a longer one has its own.

    Only lengths go to the fold, a few bytes a row.
    """
    kind = segments.schema[key].dataType.simpleString()
    slim = segments.select(key, order, F.length(text).alias("n"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out, batch, size, held = [], 0, 0, 0
        for n in pdf["n"]:
            if held and (size + n > chars or held >= rows):
                batch, size, held = batch + 1, 0, 0
            size, held = size + n, held + 1
            out.append(batch)
        return pd.DataFrame({key: pdf[key], order: pdf[order], "batch": out})

    placed = slim.groupBy(key).applyInPandas(fold, f"{key} {kind}, {order} {segments.schema[order].dataType.simpleString()}, batch int")
    return segments.join(placed, [key, order])
