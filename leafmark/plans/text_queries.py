"""Queries over text columns: documents, and conversation turns as claims with the turn before as evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import spoken, text as T
from ..operators import tables
from ..registry import query

STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
NUMBERS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.NUMBER_WORDS.items()) + "}"


def put(sql: str, c: str) -> str:
    """The SQL with ``c`` in its place."""
    return sql.replace("{c}", c)


#: DuckDB forms of the expressions.
WS = r"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
TOKENS = r"list_filter(list_transform(list_filter(regexp_extract_all({c}, '[\p{L}\p{N}_]+'), lambda w: length(w) > 1), lambda w: replace(lower(w), 'ß', 'ss')), lambda w: w NOT IN (" + STOP + "))"
CANONICAL = "list_transform(" + TOKENS + ", lambda w: coalesce(" + NUMBERS + "[w], w))"
PAIRS = "pairs AS (SELECT a.conv_id, a.turn, a.text AS claim, u.text AS evidence FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant')"
COMMON = "coalesce(list_sum(list_transform(list_intersect(list_distinct(a), list_distinct(b)), lambda x: least(length(list_filter(a, lambda y: y = x)), length(list_filter(b, lambda y: y = x))))), 0)"
SENTENCES = r"list_filter(string_split(regexp_replace(" + put(WS, "text") + r", '([.!?]) ([A-ZÀ-Ỹ0-9(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: length(s) > 0)"


def pairs(t) -> DataFrame:
    return tables.claim_pairs(t("conversations"))


@query("b01_normalize_ws", f"SELECT doc_id, {put(WS, 'text')} AS text FROM documents")
def normalize_ws(t):
    return t("documents").select("doc_id", T.normalize_ws("text").alias("text"))


@query("b02_content_tokens", f"SELECT doc_id, length({put(TOKENS, 'text')}) AS n, array_to_string({put(TOKENS, 'text')}, ' ') AS tokens FROM documents")
def content_tokens(t):
    return t("documents").select("doc_id", T.content_tokens("text").alias("x")).select("doc_id", F.size("x").cast("long").alias("n"), F.array_join("x", " ").alias("tokens"))


@query("b03_canonical_tokens", f"SELECT conv_id, turn, array_to_string({put(CANONICAL, 'text')}, ' ') AS tokens FROM conversations")
def canonical_tokens(t):
    return t("conversations").select("conv_id", "turn", F.array_join(T.canonical_tokens("text"), " ").alias("tokens"))


@query("b04_claim_coverage", f"WITH {PAIRS}, s AS (SELECT conv_id, turn, {put(CANONICAL, 'claim')} AS a, {put(CANONICAL, 'evidence')} AS b FROM pairs) SELECT conv_id, turn, round(CASE WHEN length(a) = 0 THEN 0 ELSE {COMMON} / length(a) END, 6) AS coverage FROM s")
def claim_coverage(t):
    return pairs(t).select("conv_id", "turn", F.round(T.claim_coverage(T.canonical_tokens("claim"), T.canonical_tokens("evidence")), 6).alias("coverage"))


@query("b05_sentence_spans", f"""WITH s AS (SELECT doc_id, unnest({SENTENCES}) AS sentence, generate_subscripts({SENTENCES}, 1) AS pos FROM documents)
SELECT doc_id, pos, sentence, CAST(sum(length(sentence) + 1) OVER w - length(sentence) - 1 AS BIGINT) AS char_start, CAST(sum(length(sentence) + 1) OVER w - 1 AS BIGINT) AS char_end FROM s
WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""")
def sentence_spans(t):
    return tables.sentence_spans(t("documents"), "doc_id", "text")


@query("b06_token_estimate", r"SELECT doc_id, greatest(1, CAST(ceil(length(regexp_extract_all(text, '[\p{L}\p{N}_]+')) * 1.25) AS INTEGER)) AS tokens FROM documents")
def token_estimate(t):
    return t("documents").select("doc_id", T.token_estimate("text").alias("tokens"))


@query("b07_overlap_density", f"""WITH {PAIRS}, s AS (SELECT conv_id, turn, list_distinct({put(TOKENS, 'claim')}) AS q, {put(TOKENS, 'evidence')} AS t FROM pairs)
SELECT conv_id, turn, round(CASE WHEN length(q) = 0 THEN 0 ELSE length(list_intersect(q, t)) / length(q) END, 6) AS overlap,
round(CASE WHEN length(q) = 0 OR length(t) = 0 THEN 0 ELSE least(1.0, length(list_filter(t, lambda w: list_contains(q, w))) / greatest(1.0, sqrt(length(t)))) END, 6) AS density FROM s""")
def overlap_density(t):
    s = pairs(t).select("conv_id", "turn", T.token_set("claim").alias("q"), T.content_tokens("evidence").alias("t"))
    return s.select("conv_id", "turn", F.round(T.overlap(F.col("q"), F.col("t")), 6).alias("overlap"), F.round(T.density(F.col("q"), F.col("t")), 6).alias("density"))


@query("b08_jaccard_containment", f"""WITH {PAIRS}, s AS (SELECT conv_id, turn, list_distinct({put(TOKENS, 'claim')}) AS a, list_distinct({put(TOKENS, 'evidence')}) AS b FROM pairs), n AS (SELECT *, length(list_intersect(a, b)) AS k FROM s)
SELECT conv_id, turn, round(CASE WHEN length(a) + length(b) - k = 0 THEN 0 ELSE k / (length(a) + length(b) - k) END, 6) AS jaccard, round(CASE WHEN length(a) = 0 THEN 0 ELSE k / length(a) END, 6) AS containment FROM n""")
def jaccard_containment(t):
    s = pairs(t).select("conv_id", "turn", T.token_set("claim").alias("a"), T.token_set("evidence").alias("b"))
    return s.select("conv_id", "turn", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), F.round(T.containment(F.col("a"), F.col("b")), 6).alias("containment"))


@query("b11_token_f1", rf"""WITH {PAIRS}, s AS (SELECT conv_id, turn, list_filter(string_split({put(WS, 'lower(claim)')}, ' '), lambda w: w <> '') AS a, list_filter(string_split({put(WS, 'lower(evidence)')}, ' '), lambda w: w <> '') AS b FROM pairs)
SELECT conv_id, turn, round(CASE WHEN length(a) = 0 OR length(b) = 0 THEN 0 ELSE 2.0 * {COMMON} / (length(a) + length(b)) END, 6) AS f1 FROM s""")
def token_f1(t):
    return pairs(t).select("conv_id", "turn", F.round(T.token_f1(T.spaced_tokens(F.lower("claim")), T.spaced_tokens(F.lower("evidence"))), 6).alias("f1"))


SQUAD = put(WS, r"regexp_replace(' ' || replace(regexp_replace(replace(lower(text), chr(10), ' '), '[!-/:-@\[-`{-~]', '', 'g'), ' ', '  ') || ' ', '([^\p{L}\p{N}_])(a|an|the)([^\p{L}\p{N}_])', '\1 \3', 'g')")


@query("b12_normalize_answer", f"SELECT conv_id, turn, {put(WS, 'lower(text)')} AS plain, {SQUAD} AS squad FROM conversations")
def normalize_answer(t):
    return t("conversations").select("conv_id", "turn", T.normalize_answer("text").alias("plain"), T.normalize_squad_answer("text").alias("squad"))


_HAS = lambda cues: "(" + " OR ".join(f"contains(q, '{c}')" for c in cues) + ")"


@query("b13_classify_query", rf"""WITH s AS (SELECT conv_id, turn, ' ' || lower(text) || ' ' AS q FROM conversations)
SELECT conv_id, turn, CASE WHEN {_HAS(T.COMPARATIVE_CUES)} THEN 'comparative_multi_hop' WHEN {_HAS(T.GLOBAL_CUES)} THEN 'global_synthesis'
WHEN {_HAS(T.EXPLANATORY_CUES)} OR regexp_matches(q, '(^|[^\p{{L}}\p{{N}}_])(what|which)([^\p{{L}}\p{{N}}_].*[^\p{{L}}\p{{N}}_]|[^\p{{L}}\p{{N}}_])(result|lead|cause|effect)([^\p{{L}}\p{{N}}_]|$)', 's') THEN 'explanatory' ELSE 'factoid' END AS query_type FROM s""")
def classify_query(t):
    return t("conversations").select("conv_id", "turn", T.classify_query("text").alias("query_type"))


@query("b14_stable_ids", "SELECT doc_id, substring(sha1(source || '|' || CAST(doc_id AS VARCHAR) || '|' || text), 1, 20) AS stable_id, 's' || substring(sha1(source), 1, 10) AS display_id, sha256(lang || chr(0) || text || chr(0)) AS context_key FROM documents")
def stable_ids(t):
    return t("documents").select("doc_id", T.stable_id(F.col("source"), F.col("doc_id"), F.col("text")).alias("stable_id"), F.concat(F.lit("s"), F.substring(F.sha1("source"), 1, 10)).alias("display_id"), T.context_key(F.col("lang"), F.col("text")).alias("context_key"))


NUMBER_VALUE = r"CASE WHEN regexp_full_match(r, '\d{1,3}(\.\d{3})+') THEN replace(r, '.', '') ELSE replace(r, ',', '.') END"


@query("b16_numbers_in", rf"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '\d+(?:[.,]\d+)*')) AS r FROM documents), v AS (SELECT doc_id, {NUMBER_VALUE} AS v FROM r)
SELECT DISTINCT doc_id, CASE WHEN contains(v, '.') THEN regexp_replace(regexp_replace(v, '0+$', ''), '\.+$', '') WHEN regexp_replace(v, '^0+', '') = '' THEN '0' ELSE regexp_replace(v, '^0+', '') END AS number FROM v""")
def numbers_in(t):
    return t("documents").select("doc_id", F.explode(T.numbers_in("text")).alias("number"))


@query("b17_number_multiset", r"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '(\d) (\d{3})([^\d]|$)', '\1\2\3', 'g'), '\d+(?:[.,]\d+)*')) AS r FROM documents),
v AS (SELECT doc_id, CASE WHEN regexp_full_match(r, '\d{1,3}([.,]\d{3})+') AND NOT regexp_full_match(r, '0[.,]\d{3}') THEN regexp_replace(r, '[.,]', '', 'g') WHEN regexp_full_match(r, '\d+[.,]\d+') THEN replace(r, ',', '.') ELSE regexp_replace(r, '[.,]', '', 'g') END AS v FROM x),
w AS (SELECT doc_id, CASE WHEN contains(v, '.') THEN regexp_replace(regexp_replace(v, '0+$', ''), '\.$', '') ELSE v END AS v FROM v),
n AS (SELECT doc_id, CASE WHEN regexp_replace(v, '^0+', '') = '' THEN '0' ELSE regexp_replace(v, '^0+', '') END AS number FROM w)
SELECT doc_id, number, count(*) AS n FROM n GROUP BY ALL""")
def number_multiset(t):
    plain = t("documents").select("doc_id", spoken.nfkc(F.col("text")).alias("text"))
    return plain.select("doc_id", F.explode(T.number_list("text")).alias("number")).groupBy("doc_id", "number").agg(F.count("*").alias("n"))


OVER = "(?i)(^|[^\\p{L}\\p{N}_])(tốt hơn|cao hơn|nhanh hơn|vượt|vượt trội|hơn hẳn|better|outperform)"
EVEN = "(?i)(^|[^\\p{L}\\p{N}_])(không kém|không thua|tương đương|ngang bằng|non-inferior|not worse)"
NUMBER_OF = r"CASE WHEN contains(v, '.') THEN regexp_replace(regexp_replace(v, '0+$', ''), '\.+$', '') WHEN regexp_replace(v, '^0+', '') = '' THEN '0' ELSE regexp_replace(v, '^0+', '') END"


@query("b19_claim_guard", rf"""WITH {PAIRS}, b AS (SELECT conv_id, turn, 0 AS own, evidence AS text FROM pairs UNION ALL SELECT conv_id, turn, 1, claim FROM pairs), r AS (SELECT conv_id, turn, own, unnest(regexp_extract_all(text, '\d+(?:[.,]\d+)*')) AS r FROM b), v AS (SELECT conv_id, turn, own, {NUMBER_VALUE} AS v FROM r), n AS (SELECT conv_id, turn, own, {NUMBER_OF} AS number FROM v),
m AS (SELECT DISTINCT conv_id, turn FROM (SELECT conv_id, turn, number FROM n WHERE own = 1 EXCEPT SELECT conv_id, turn, number FROM n WHERE own = 0))
SELECT pairs.conv_id, pairs.turn, CASE WHEN m.turn IS NOT NULL THEN 'number_not_in_evidence' WHEN regexp_matches(claim, '{OVER}') AND regexp_matches(evidence, '{EVEN}') AND NOT regexp_matches(evidence, '{OVER}') AND NOT regexp_matches(claim, '{EVEN}') THEN 'non_inferiority_overclaimed' END AS reason FROM pairs LEFT JOIN m ON m.conv_id = pairs.conv_id AND m.turn = pairs.turn""")
def claim_guard(t):
    return pairs(t).select("conv_id", "turn", T.claim_guard("claim", "evidence").alias("reason"))


NEGATED = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.NEGATIONS) + "]"
FIGURES = r"regexp_extract_all(' ' || replace({c}, ' ', '  ') || ' ', '[^\p{L}\p{N}_](\d+(?:\.\d+)?%?)[^\p{L}\p{N}_]', 1)"


@query("b20_lexical_conflict", f"""WITH {PAIRS}, s AS (SELECT conv_id, turn, list_has_any(string_split({put(WS, 'lower(claim)')}, ' '), {NEGATED}) AS n1, list_has_any(string_split({put(WS, 'lower(evidence)')}, ' '), {NEGATED}) AS n2, {put(FIGURES, 'claim')} AS a, {put(FIGURES, 'evidence')} AS b FROM pairs)
SELECT conv_id, turn, (n1 <> n2) OR (length(a) > 0 AND length(b) > 0 AND NOT list_has_any(a, b)) AS conflict FROM s""")
def lexical_conflict(t):
    return pairs(t).select("conv_id", "turn", T.lexical_conflict("claim", "evidence").alias("conflict"))


@query("b18_translation_flags", rf"""WITH {PAIRS}, b AS (SELECT conv_id, turn, 0 AS target, evidence AS text FROM pairs UNION ALL SELECT conv_id, turn, 1, claim FROM pairs), x AS (SELECT conv_id, turn, target, unnest(regexp_extract_all(regexp_replace(text, '(\d) (\d{{3}})([^\d]|$)', '\1\2\3', 'g'), '\d+(?:[.,]\d+)*')) AS r FROM b),
v AS (SELECT conv_id, turn, target, CASE WHEN regexp_full_match(r, '\d{{1,3}}([.,]\d{{3}})+') AND NOT regexp_full_match(r, '0[.,]\d{{3}}') THEN regexp_replace(r, '[.,]', '', 'g') WHEN regexp_full_match(r, '\d+[.,]\d+') THEN replace(r, ',', '.') ELSE regexp_replace(r, '[.,]', '', 'g') END AS v FROM x),
w AS (SELECT conv_id, turn, target, CASE WHEN contains(v, '.') THEN regexp_replace(regexp_replace(v, '0+$', ''), '\.$', '') ELSE v END AS v FROM v), n AS (SELECT conv_id, turn, target, CASE WHEN regexp_replace(v, '^0+', '') = '' THEN '0' ELSE regexp_replace(v, '^0+', '') END AS number FROM w),
c AS (SELECT conv_id, turn, number, count(*) FILTER (target = 0) AS a, count(*) FILTER (target = 1) AS b FROM n GROUP BY ALL), f AS (SELECT conv_id, turn, bool_or(b > a OR (a <> b AND (contains(number, '.') OR length(number) >= 2))) AS changed FROM c GROUP BY ALL)
SELECT pairs.conv_id, pairs.turn, concat_ws(',', CASE WHEN {put(WS, 'claim')} = '' THEN 'empty' END, CASE WHEN changed THEN 'numbers_changed' END) AS flags FROM pairs LEFT JOIN f ON f.conv_id = pairs.conv_id AND f.turn = pairs.turn""")
def translation_flags(t):
    plain = pairs(t).select("conv_id", "turn", spoken.nfkc(F.col("evidence")).alias("evidence"), spoken.nfkc(F.col("claim")).alias("claim"))
    return plain.select("conv_id", "turn", F.array_join(T.translation_flags("evidence", "claim"), ",").alias("flags"))


TRANSCRIPT = put(WS, r"replace(regexp_replace(regexp_replace(lower({c}), '(\d)[.,](\d{3})([^\d]|$)', '\1\2\3', 'g'), '[!-$&-/:-@\[-`{-~]', ' ', 'g'), '%', ' % ')")


@query("b21_normalize_transcript", "SELECT conv_id, turn, " + put(TRANSCRIPT, "text") + " AS text FROM conversations")
def normalize_transcript(t):
    return t("conversations").select("conv_id", "turn", T.normalize_transcript("text").alias("text"))


@query("b22_character_error_rate")  # SQL there measures edits in bytes
def character_error_rate(t):
    s = pairs(t).select("conv_id", T.normalize_transcript("evidence").alias("r"), T.normalize_transcript("claim").alias("h"))
    return s.groupBy("conv_id").agg(F.sum(F.levenshtein("r", "h")).cast("long").alias("errors"), F.sum(F.length("r")).cast("long").alias("chars")).withColumn("cer", F.round(F.try_divide("errors", "chars"), 6))


@query("b25_video_id", r"""SELECT page_id, coalesce(nullif(regexp_extract(url, '^([A-Za-z0-9_-]{11})$', 1), ''), nullif(regexp_extract(url, '^https?://(?:www\.|m\.)?youtube\.com/watch\?(?:[^#]*&)?v=([A-Za-z0-9_-]{11})(?:[&#]|$)', 1), ''),
nullif(regexp_extract(url, '^https?://youtu\.be/([A-Za-z0-9_-]{11})(?:[?#/]|$)', 1), ''), nullif(regexp_extract(url, '^https?://(?:www\.|m\.)?youtube\.com/(?:shorts|embed|live)/([A-Za-z0-9_-]{11})(?:[?#/]|$)', 1), '')) AS video_id FROM (SELECT page_id, 'https://youtu.be/' || substring(sha1(url), 1, 11) || '?t=1' AS url FROM pages)""")
def video_id(t):
    links = t("pages").select("page_id", F.concat(F.lit("https://youtu.be/"), F.substring(F.sha1("url"), 1, 11), F.lit("?t=1")).alias("url"))
    return links.select("page_id", T.video_id("url").alias("video_id"))


@query("b26_highlight_segments", """WITH q AS (SELECT doc_id, text, 0 AS a0, length(text) AS a1, length(text) // 5 AS l0, length(text) * 4 // 5 AS l1, length(text) // 3 AS q0, length(text) // 2 AS q1 FROM documents),
p AS (SELECT DISTINCT doc_id, unnest([a0, a1, l0, l1, q0, q1]) AS x FROM q), s AS (SELECT doc_id, x, lead(x) OVER (PARTITION BY doc_id ORDER BY x) AS y FROM p),
k AS (SELECT s.doc_id, x, y, CASE WHEN x >= q0 AND y <= q1 THEN 'quote' WHEN x >= l0 AND y <= l1 THEN 'leaf' ELSE 'plain' END AS kind, substring(text, x + 1, y - x) AS part FROM s JOIN q USING (doc_id) WHERE y IS NOT NULL)
SELECT doc_id, CAST(x AS INTEGER) AS char_start, CAST(y AS INTEGER) AS char_end, kind, part FROM k""")
def highlight_segments(t):
    n = F.length("text")
    spans = t("documents").select("doc_id", "text", F.lit(0).alias("view_start"), n.alias("view_end"), F.expr("length(text) div 5").alias("leaf_start"), F.expr("length(text) * 4 div 5").alias("leaf_end"), F.expr("length(text) div 3").alias("quote_start"), F.expr("length(text) div 2").alias("quote_end"))
    return tables.highlight(spans, "doc_id")


@query("b32_fixed_word_chunks", rf"""WITH w AS (SELECT doc_id, list_filter(string_split({put(WS, 'text')}, ' '), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, w, unnest(generate_series(0, greatest(1, CAST(ceil(length(w) / 100) AS BIGINT)) - 1)) AS pos FROM w)
SELECT doc_id, pos, array_to_string(w[pos * 100 + 1:pos * 100 + 100], ' ') AS chunk FROM c""")
def fixed_word_chunks(t):
    return t("documents").select("doc_id", F.posexplode(T.word_chunks("text", 100)).alias("p", "chunk")).select("doc_id", F.col("p").cast("long").alias("pos"), "chunk")


@query("b31_best_unit", f"""WITH {PAIRS}, u AS (SELECT conv_id, turn, unnest({SENTENCES.replace('text', 'claim')}) AS s, generate_subscripts({SENTENCES.replace('text', 'claim')}, 1) AS i FROM pairs), v AS (SELECT conv_id, turn, unnest({SENTENCES.replace('text', 'evidence')}) AS e, generate_subscripts({SENTENCES.replace('text', 'evidence')}, 1) AS j FROM pairs),
m AS (SELECT u.conv_id, u.turn, i, j, list_filter(string_split({put(WS, 'lower(s)')}, ' '), lambda w: w <> '') AS a, list_filter(string_split({put(WS, 'lower(e)')}, ' '), lambda w: w <> '') AS b FROM u JOIN v ON u.conv_id = v.conv_id AND u.turn = v.turn),
f AS (SELECT conv_id, turn, i, j, round(2.0 * {COMMON} / (length(a) + length(b)), 9) AS f FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, i ORDER BY f DESC, j) AS k FROM f)
SELECT conv_id, turn, i AS sentence, j AS unit, round(f, 6) AS f1 FROM r WHERE k = 1""")
def best_unit(t):
    return tables.best_units(pairs(t))
