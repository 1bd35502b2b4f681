"""Transcripts over conversation turns, texts cut to budgets, batches, prompts and generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import spoken, text as T
from ..operators import speech
from ..registry import query
from .text_queries import SENTENCES, put

WORDS = r"regexp_extract_all({c}, '[\p{L}\p{N}_]+')"


@query("b10_truncate_to_fit", rf"""WITH d AS (SELECT doc_id, text, 20 + doc_id % 300 AS budget, CAST(greatest(4, floor((20 + doc_id % 300) / 1.25)) AS INTEGER) AS lim FROM documents), s AS (SELECT doc_id, text, budget, lim, {SENTENCES} AS parts FROM d),
c AS (SELECT doc_id, i, sum(length({put(WORDS, 'p')})) OVER (PARTITION BY doc_id ORDER BY i) AS total, lim FROM (SELECT doc_id, lim, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM s)), k AS (SELECT doc_id, count(*) AS kept FROM c WHERE total <= lim GROUP BY doc_id),
t AS (SELECT s.doc_id, budget, CASE WHEN greatest(1, ceil(length({put(WORDS, 'text')}) * 1.25)) <= lim * 1.25 THEN text WHEN coalesce(kept, 0) > 0 THEN array_to_string(parts[1:kept], ' ') WHEN length(parts) > 0 THEN array_to_string(({put(WORDS, 'parts[1]')})[1:lim], ' ') ELSE array_to_string(({put(WORDS, 'text')})[1:lim], ' ') END AS t FROM s LEFT JOIN k USING (doc_id)),
e AS (SELECT *, {put(WORDS, 't')} AS w FROM t) SELECT doc_id, CASE WHEN t = '' OR greatest(1, ceil(length(w) * 1.25)) <= budget THEN t WHEN least(length(w) - 1, floor(budget / 1.25)) >= 1 THEN array_to_string(w[1:CAST(least(length(w) - 1, floor(budget / 1.25)) AS INTEGER)], ' ') ELSE '' END AS cut FROM e""")
def truncate_to_fit(t):
    budget = 20 + F.col("doc_id") % 300
    return t("documents").select("doc_id", T.truncate_to_fit("text", budget).alias("cut"))


@query("b15_spoken_numbers", "SELECT l_orderkey, l_linenumber, 'giá ' || (200 + 10 * ((CAST(l_quantity AS INTEGER) % 9) + 1) + 3) || ' đồng, ' || (10 * ((CAST(l_quantity AS INTEGER) % 9) + 1)) || '%, một phần' AS text FROM lineitem")
def spoken_numbers(t):
    """Numbers written out by a table of tens, and read back."""
    tens = F.element_at(F.array(*map(F.lit, ["mười", "hai mươi", "ba mươi", "bốn mươi", "năm mươi", "sáu mươi", "bảy mươi", "tám mươi", "chín mươi"])), (F.col("l_quantity").cast("int") % 9 + 1))
    said = F.concat(F.lit("giá hai trăm "), tens, F.lit(" ba đồng, "), tens, F.lit(" phần trăm, một phần"))
    return t("lineitem").select("l_orderkey", "l_linenumber", spoken.digits_from_number_words(said).alias("text"))


def transcripts(t) -> DataFrame:
    """Turns as references; the hypothesis loses the second word and doubles the third."""
    w = T.spaced_tokens("text")
    hyp = F.array_join(F.concat(F.slice(w, 1, 1), F.slice(w, 3, 1), F.slice(w, 3, 10_000)), " ")
    return t("conversations").where(F.size(w) >= 4).select("conv_id", "turn", "role", F.col("text").alias("reference"), hyp.alias("hypothesis"))


@query("b22_error_rate_report")
def error_rate_report(t):
    return speech.error_rate_report(transcripts(t), ["role"])


@query("b22_worst_utterances")
def worst_utterances(t):
    scored = speech.error_rates(transcripts(t)).withColumn("ident", F.format_string("%d-%d", "conv_id", "turn"))
    return speech.worst(scored, ["role"], "ident")


@query("b23_screen_segments", """SELECT event_id, CASE WHEN user_id * 1000 >= 40000 OR event_id % 5 = 0 OR (value > 80 AND event_id % 3 = 0) THEN FALSE ELSE TRUE END AS keep, CASE WHEN user_id * 1000 < 40000 AND user_id * 1000 + 5000 > 41000 THEN 40000 ELSE user_id * 1000 + 5000 END AS "end",
CASE WHEN user_id * 1000 >= 40000 OR event_id % 5 = 0 OR (value > 80 AND event_id % 3 = 0) THEN '' ELSE coalesce(array_to_string([CASE WHEN user_id * 1000 + 5000 > 41000 THEN 'beyond_media_end' END, CASE WHEN event_id % 5 = 1 THEN 'stock_phrase' END, CASE WHEN event_id % 3 = 0 THEN 'low_confidence' END, CASE WHEN value > 50 THEN 'possible_non_speech' END], ' '), '') END AS flags FROM events""")
def screen_segments(t):
    i = F.col("event_id")
    text = F.when(i % 5 == 0, "Cảm ơn các bạn đã theo dõi!").when(i % 5 == 1, "Tóm lại k bằng 60. Thanks for watching.").otherwise(F.col("event_type"))
    rows = t("events").select("event_id", (F.col("user_id") * 1000).alias("start_ms"), (F.col("user_id") * 1000 + 5000).alias("end_ms"), text.alias("text"), F.lit(40_000).cast("long").alias("duration_ms"), F.when(i % 3 == 0, -1.5).otherwise(-0.2).alias("avg_logprob"), (F.col("value") / 100).alias("no_speech_prob"), F.lit(1.0).alias("compression_ratio"))
    return speech.screen_segments(rows).select("event_id", "keep", "end", F.array_join("flags", " ").alias("flags"))


@query("b24_clean_glossary", r"""WITH e AS (SELECT p_brand AS w, p_partkey AS o, trim(regexp_replace(p_name, '\s+', ' ', 'g')) AS term FROM part), f AS (SELECT w, lower(term) AS k, min_by(term, o) AS term, min(o) AS o FROM e WHERE term <> '' GROUP BY ALL),
g AS (SELECT w, string_agg(term, ', ' ORDER BY o) AS terms, count(*) AS n, max(length(term)) AS longest FROM f GROUP BY w) SELECT w AS workspace_id, CASE WHEN longest > 60 THEN NULL WHEN n > 40 THEN NULL WHEN length(terms) > 400 THEN NULL ELSE terms END AS terms, CASE WHEN longest > 60 THEN 'term too long' WHEN n > 40 THEN 'too many terms' WHEN length(terms) > 400 THEN 'glossary too long' END AS reason FROM g""")
def clean_glossary(t):
    terms = t("part").select(F.col("p_brand").alias("workspace_id"), F.col("p_partkey").alias("ordinal"), F.concat(F.lit(" "), F.replace(F.col("p_name"), F.lit(" "), F.lit("  ")), F.lit("\u0000")).alias("term"))
    return speech.clean_glossary(terms).select("workspace_id", F.array_join("terms", ", ").alias("terms"), "reason")


@query("b30_batch_segments", """WITH RECURSIVE s AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), r AS (SELECT conv_id, turn, i, n AS size, 1 AS held, 0 AS batch FROM s WHERE i = 1
UNION ALL SELECT s.conv_id, s.turn, s.i, CASE WHEN r.size + s.n > 400 OR r.held >= 3 THEN s.n ELSE r.size + s.n END, CASE WHEN r.size + s.n > 400 OR r.held >= 3 THEN 1 ELSE r.held + 1 END, CASE WHEN r.size + s.n > 400 OR r.held >= 3 THEN r.batch + 1 ELSE r.batch END FROM r JOIN s ON s.conv_id = r.conv_id AND s.i = r.i + 1) SELECT conv_id, turn, CAST(batch AS INTEGER) AS batch FROM r""")
def batch_segments(t):
    return speech.batch_segments(t("conversations"), "conv_id", "turn", "text", 400, 3).select("conv_id", "turn", "batch")
