"""Sources and sinks: the given tables written in the formats that the loaders read, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..registry import query
from ..sources import files, papers
from .text_queries import WS, put

LINE = "string_split(text, chr(10))"
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("a01_read_jsonl", "SELECT doc_id, source, lang, n_chars FROM documents")
def read_jsonl(t):
    """Documents as JSON lines, written and read back."""
    docs = t("documents")
    path = files.write_rows(docs.select("doc_id", "source", "lang", "n_chars"), files.scratch(docs.sparkSession, "rows"))
    return files.read_jsonl(docs.sparkSession, path, "doc_id long, source string, lang string, n_chars long")


def raw_papers(t) -> str:
    """Documents as nested paper records: sections from lines, a question with two annotations each; files of many papers."""
    docs = t("documents")
    line = F.split("text", "\n")
    part = lambda a, n: F.slice(line, a, n)
    answer = lambda spans, free, yes, evidence, refuse: F.struct(refuse.alias("unanswerable"), spans.alias("extractive_spans"), free.alias("free_form_answer"), yes.alias("yes_no"), evidence.alias("evidence"))
    none = F.array().cast("array<string>")
    first = F.concat(F.lit(" "), F.coalesce(F.get(line, 1), F.lit("")), F.lit("  "))
    answers = F.array(
        F.struct(answer(F.when(F.col("doc_id") % 2 == 0, F.array(F.substring("text", 1, 5), F.substring("text", 1, 5))).otherwise(none), F.lit(""), F.lit(None).cast("boolean"), F.array(first, F.lit("no such paragraph")), F.lit(False)).alias("answer")),
        F.struct(answer(none, F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(""), F.col("doc_id") % 5 == 0, F.array(F.coalesce(F.get(line, 2), F.lit(""))), F.col("doc_id") % 7 == 0).alias("answer")),
    )
    paper = F.struct(
        F.col("source").alias("title"), F.when(F.col("doc_id") % 4 != 0, F.get(line, 0)).alias("abstract"),
        F.array(F.struct(F.lit("Start").alias("section_name"), part(2, 2).alias("paragraphs")), F.struct(F.lit(None).cast("string").alias("section_name"), part(4, 10_000).alias("paragraphs"))).alias("full_text"),
        F.array(F.struct(F.concat(F.lit(" "), F.col("lang")).alias("question"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question_id"), answers.alias("answers"))).alias("qas"),
    )
    rows = docs.select(F.pmod("doc_id", F.lit(64)).alias("file"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), paper.alias("value"))
    path = files.scratch(docs.sparkSession, "papers")
    rows.groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("value")).select("value").repartition("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


LINES = rf"l AS (SELECT doc_id, source, lang, text, CASE WHEN i <= 3 THEN 0 ELSE 1 END AS section, i, {put(WS, 'line')} AS p FROM (SELECT doc_id, source, lang, text, unnest({LINE}) AS line, generate_subscripts({LINE}, 1) AS i FROM documents) WHERE i >= 2)"
PARAGRAPHS = LINES + f""", k AS (SELECT doc_id, section, p, row_number() OVER w - 1 AS n, CAST(sum(length(p) + 1) OVER w - 1 AS BIGINT) AS e FROM l WHERE p <> '' WINDOW w AS (PARTITION BY doc_id, section ORDER BY i)),
a AS (SELECT doc_id, -1 AS section, trim(split_part(text, chr(10), 1), {BLANK}) AS p FROM documents WHERE doc_id % 4 <> 0),
pa AS (SELECT doc_id, section, 'd' || doc_id || ':section:' || section || ':paragraph:' || n AS paragraph_id, p AS text, e - length(p) AS char_start, e AS char_end FROM k UNION ALL SELECT doc_id, section, 'd' || doc_id || ':abstract:paragraph:0', p, 0, length(p) FROM a WHERE p <> '')"""


@query("a02_qasper_paragraphs", f"WITH {PARAGRAPHS} SELECT 'd' || doc_id AS paper_id, CASE section WHEN -1 THEN 'Abstract' WHEN 0 THEN 'Start' ELSE 'Section 2' END AS title, CAST(section AS INTEGER) AS position, paragraph_id, text, CAST(char_start AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end FROM pa")
def qasper_paragraphs(t):
    papers_, _, _ = papers.load_qasper(t("documents").sparkSession, raw_papers(t), "test")
    s = papers_.select("paper_id", F.explode("sections").alias("s"))
    return s.select("paper_id", "s.title", "s.position", F.explode("s.paragraphs").alias("p")).select("paper_id", "title", "position", "p.*")


@query("a02_qasper_questions", f"""WITH {PARAGRAPHS}, e AS (SELECT doc_id, source, lang, text, {put(WS, "coalesce(" + LINE + "[2], '')")} AS e1, {put(WS, "coalesce(" + LINE + "[3], '')")} AS e2, ' ' || coalesce({LINE}[2], '') || '  ' AS r1, coalesce({LINE}[3], '') AS r2 FROM documents),
n AS (SELECT doc_id, section, paragraph_id, {put(WS, 'text')} AS text FROM pa), f AS (SELECT doc_id, text, min_by(paragraph_id, (CASE WHEN section < 0 THEN 9 ELSE section END, length(paragraph_id), paragraph_id)) AS id FROM n GROUP BY ALL)
SELECT 'd' || e.doc_id AS paper_id, 'q' || e.doc_id AS question_id, lang AS query, CASE WHEN e.doc_id % 2 = 0 THEN substr(e.text, 1, 5) || ', ' || substr(e.text, 1, 5) ELSE '' END AS answer, CASE WHEN e.doc_id % 7 = 0 THEN 'Unanswerable' WHEN e.doc_id % 3 = 0 AND source <> '' THEN source WHEN e.doc_id % 5 = 0 THEN 'Yes' ELSE 'No' END AS second_answer,
array_to_string(list_sort(list_distinct(list_filter([f1.id, f2.id], lambda x: x IS NOT NULL))), ' ') AS gold, CAST(len(list_distinct(list_filter([e1, 'no such paragraph', e2], lambda x: x <> ''))) AS INTEGER) AS quotes, (f1.id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(string_split(e.text, chr(10))) AS x, generate_subscripts(string_split(e.text, chr(10)), 1) AS j) WHERE (j >= 2 OR e.doc_id % 4 <> 0) AND x = r1)) AS first_unmatchable, CAST(2 AS INTEGER) AS annotation_count
FROM e LEFT JOIN f f1 ON f1.doc_id = e.doc_id AND f1.text = e1 LEFT JOIN f f2 ON f2.doc_id = e.doc_id AND f2.text = e2""")
def qasper_questions(t):
    _, questions, _ = papers.load_qasper(t("documents").sparkSession, raw_papers(t), "test")
    return questions.select("paper_id", "question_id", "query", "answer", F.col("reference_answers")[1].alias("second_answer"), F.array_join("gold_paragraph_ids", " ").alias("gold"), F.size("gold_quotes").alias("quotes"), F.startswith(F.col("reference_evidence_sets")[0][0], F.lit(papers.UNMATCHABLE)).alias("first_unmatchable"), "annotation_count")


@query("a03_qasper_simple", f"""WITH x AS (SELECT doc_id, source, lang, doc_id % 2 = 0 AND trim(substr(text, 1, 5), {BLANK}) <> '' AS spans, trim(substr(text, 1, 5), {BLANK}) AS span FROM documents WHERE (doc_id % 4 <> 0 AND trim({LINE}[1], {BLANK}) <> '') OR trim(array_to_string({LINE}[2:], ''), {BLANK}) <> '')
SELECT 'q' || doc_id AS question_id, lang AS query, 'd' || doc_id || '.pdf' AS source, CASE WHEN spans THEN span || ' ' || span ELSE '' END AS gold_answer FROM x""")
def qasper_simple(t):
    _, questions = papers.load_qasper_simple(t("documents").sparkSession, raw_papers(t))
    return questions.select("question_id", "query", "source", "gold_answer")


@query("a04_reference_answer", "SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'Unanswerable' WHEN turn % 3 = 0 THEN role || ', ' || role WHEN turn % 3 = 1 AND text <> '' THEN text WHEN turn % 4 = 2 THEN 'Yes' WHEN turn % 4 = 1 THEN 'No' ELSE '' END AS answer FROM conversations")
def reference_answer(t):
    n = F.col("turn")
    answer = F.struct((F.col("conv_id") % 5 == 0).alias("unanswerable"), F.when(n % 3 == 0, F.array("role", "role")).alias("extractive_spans"), F.when(n % 3 == 1, F.col("text")).alias("free_form_answer"), F.when(n % 4 == 2, True).when(n % 4 == 1, False).alias("yes_no"))
    return t("conversations").withColumn("a", answer).select("conv_id", "turn", papers.reference_answer(F.col("a")).alias("answer"))


def elements(t) -> tuple[DataFrame, DataFrame]:
    """Lines of documents as elements: a title, a heading every fifth line, two lines a paragraph; a question each."""
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "content"))
    kind = F.when(F.col("idx") == 0, "title").when(F.col("idx") % 5 == 1, "heading").when(F.col("idx") % 7 == 6, "footnote").otherwise("sentence")
    e = lines.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("paper_id"), "idx", F.floor(F.col("idx") / 2).alias("pidx"), F.lit(0).alias("sidx"), kind.alias("type"), "content", F.lit(None).cast("string").alias("last_heading"))
    ids = F.array(*[F.lit(i).cast("long") for i in (3, 2, 4, 3)])
    qa = t("documents").select(F.concat(F.lit("d/"), (F.col("doc_id") + F.when(F.col("doc_id") % 11 == 0, 10**9).otherwise(0)).cast("string")).alias("paper_id"), F.col("doc_id").cast("string").alias("question_id"), F.col("source").alias("question"), F.col("lang").alias("answer_free_form"), (F.col("doc_id") % 4 != 0).alias("answerable_mapped"), F.array(F.struct(ids.alias("idx"))).alias("answer_evidence_mapped"))
    return e, qa


ELEMENTS = rf"""el AS (SELECT doc_id, i, i // 2 AS pidx, {put(WS, 'line')} AS c, CASE WHEN i = 0 THEN 'title' WHEN i % 5 = 1 THEN 'heading' WHEN i % 7 = 6 THEN 'footnote' ELSE 'sentence' END AS type FROM (SELECT doc_id, unnest({LINE}) AS line, generate_subscripts({LINE}, 1) - 1 AS i FROM documents)),
se AS (SELECT *, sum(CASE WHEN type = 'heading' OR i = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM el), na AS (SELECT doc_id, s, max(CASE WHEN type = 'heading' THEN c WHEN i = 0 THEN 'Preamble' END) AS section_title FROM se GROUP BY ALL),
pp AS (SELECT doc_id, s, pidx, min(i) AS f, {put(WS, "string_agg(c, ' ' ORDER BY i)")} AS text FROM se WHERE type = 'sentence' GROUP BY ALL), kept AS (SELECT * FROM pp WHERE text <> '')"""


@query("a05_peerqa_paragraphs", f"""WITH {ELEMENTS} SELECT 'd/' || doc_id AS paper_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS section_pos, section_title, 'd/' || doc_id || ':p' || pidx AS paragraph_id, text, CAST(sum(length(text) + 1) OVER w - 1 - length(text) AS BIGINT) AS char_start, CAST(sum(length(text) + 1) OVER w - 1 AS BIGINT) AS char_end
FROM kept JOIN na USING (doc_id, s) WINDOW w AS (PARTITION BY doc_id, s ORDER BY f)""")
def peerqa_paragraphs(t):
    return papers.load_peerqa(*elements(t))[0].drop("title")


@query("a05_peerqa_questions", f"""WITH {ELEMENTS}, la AS (SELECT doc_id, pidx, max_by(text, s) AS text FROM kept GROUP BY ALL), owner AS (SELECT se.doc_id, i, pidx, la.text FROM se JOIN la USING (doc_id, pidx) WHERE type = 'sentence'),
ci AS (SELECT d.doc_id, pidx, min(nth) AS nth, any_value(owner.text) AS text FROM documents d, (VALUES (0, 3), (1, 2), (2, 4)) v(nth, i), owner WHERE owner.i = v.i AND owner.doc_id = d.doc_id AND d.doc_id % 4 <> 0 AND d.doc_id % 11 <> 0 GROUP BY ALL)
SELECT CAST(d.doc_id AS VARCHAR) AS question_id, 'pq-' || substr(sha1('d/' || d.doc_id), 1, 10) || '.peerqa' AS source, source AS query, string_agg('d/' || d.doc_id || ':p' || pidx, ' ' ORDER BY nth) AS cited, string_agg(ci.text, '|' ORDER BY nth) AS quotes FROM documents d JOIN ci USING (doc_id) GROUP BY d.doc_id, d.source""")
def peerqa_questions(t):
    q = papers.load_peerqa(*elements(t))[1]
    return q.select("question_id", "source", "query", F.array_join("evidence_paragraph_ids", " ").alias("cited"), F.array_join("gold_quotes", "|").alias("quotes"))


@query("a06_mteb_elements", rf"""WITH u AS (SELECT doc_id, i, line, {put(WS, 'line')} AS n, CASE WHEN i % 3 = 2 THEN {LINE}[2] ELSE '' END AS title FROM (SELECT doc_id, text, unnest({LINE}) AS line, generate_subscripts({LINE}, 1) - 1 AS i FROM documents)), h AS (SELECT DISTINCT doc_id, {put(WS, 'title')} AS named FROM u WHERE {put(WS, 'title')} <> '')
SELECT 'd_' || u.doc_id AS paper_id, CAST(i AS BIGINT) AS idx, CASE WHEN i = 0 THEN 'title' WHEN {put(WS, 'title')} = '' AND named IS NOT NULL THEN 'heading' ELSE 'sentence' END AS type FROM u LEFT JOIN h ON h.doc_id = u.doc_id AND h.named = u.n""")
def mteb_elements(t):
    lines = t("documents").select("doc_id", F.split("text", "\n").alias("l")).select("doc_id", "l", F.posexplode("l").alias("i", "text"))
    corpus = lines.select(F.format_string("d_%d_%d", "doc_id", "i").alias("id"), F.when(F.col("i") % 3 == 2, F.get("l", 1)).otherwise("").alias("title"), "text")
    queries = t("documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("text"))
    qrels = lines.select(F.col("doc_id").cast("string").alias("query-id"), F.format_string("d_%d_%d", "doc_id", "i").alias("corpus-id"), (F.col("i") % 2).alias("score"))
    return papers.mteb_to_elements(corpus, queries, qrels)[0].select("paper_id", "idx", "type")


@query("a07_scifact", f"""SELECT 'scifact-' || doc_id || '-' || doc_id AS question_id, CASE WHEN doc_id % 2 = 0 THEN 'supported' ELSE 'contradicted' END AS answer, array_to_string(list_filter([{LINE}[1], {LINE}[2]], lambda x: x IS NOT NULL), '|') AS quotes FROM documents WHERE doc_id % 3 <> 0""")
def scifact(t):
    docs = t("documents")
    corpus = docs.select(F.col("doc_id").cast("int").alias("doc_id"), F.col("source").alias("title"), F.split("text", "\n").alias("abstract"))
    rationale = lambda i: F.struct(F.array(F.lit(i)).alias("sentences"), F.when(F.col("doc_id") % 2 == 0, "SUPPORT").otherwise("CONTRADICT").alias("label"))
    claims = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").cast("int").alias("id"), F.col("lang").alias("claim"), F.create_map(F.col("doc_id").cast("string"), F.array(rationale(1), rationale(0), rationale(1))).alias("evidence"))
    return papers.load_scifact(corpus, claims)[1].select("question_id", "answer", F.array_join("gold_quotes", "|").alias("quotes"))


@query("a08_papers_to_documents", f"WITH {PARAGRAPHS} SELECT 'd' || d.doc_id AS document_id, d.source AS title, CAST(count(DISTINCT section) AS INTEGER) AS sections, CAST(coalesce(sum(length(pa.text)), 0) + count(pa.text) - count(DISTINCT section) AS BIGINT) AS chars FROM documents d LEFT JOIN pa USING (doc_id) GROUP BY d.doc_id, d.source")
def papers_to_documents(t):
    found = papers.papers_to_documents(papers.load_qasper(t("documents").sparkSession, raw_papers(t), "test")[0])
    return found.select("document_id", "title", F.size("sections").alias("sections"), F.aggregate("sections", F.lit(0).cast("long"), lambda a, s: a + F.length(s["text"])).alias("chars"))


@query("a09_sniff_sources", """SELECT doc_id || CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.MD' WHEN 2 THEN '.txt' WHEN 3 THEN '.docx' WHEN 4 THEN '.markdown' ELSE '' END AS path, CASE WHEN doc_id % 6 = 0 AND doc_id % 4 = 0 THEN 'pdf' WHEN doc_id % 6 IN (1, 4) AND doc_id % 5 <> 0 THEN 'markdown' WHEN doc_id % 6 = 2 AND doc_id % 5 <> 0 THEN 'txt' END AS kind,
CASE WHEN (doc_id % 6 = 0 AND doc_id % 4 = 0) OR (doc_id % 6 IN (1, 2, 4) AND doc_id % 5 <> 0) THEN NULL ELSE 'unsupported_media_type' END AS reason FROM documents""")
def sniff_sources(t):
    """Texts as uploads of six kinds of names; some bytes are no UTF-8."""
    i = F.col("doc_id")
    name = F.concat(i.cast("string"), F.element_at(F.array(*map(F.lit, (".pdf", ".MD", ".txt", ".docx", ".markdown", ""))), (i % 6 + 1).cast("int")))
    before = F.when(i % 6 == 0, F.when(i % 4 == 0, F.lit(b"%PDF-1.7\n\xff")).otherwise(F.lit(b"PDF"))).when(i % 5 == 0, F.lit(b"\xff")).otherwise(F.lit(b""))
    found = files.sniff_sources(t("documents").select(name.alias("path"), F.concat(before, F.encode("text", "utf-8")).alias("content")))
    return found.select("path", "kind", "reason")


@query("a12_read_captions", rf"""WITH c AS (SELECT conv_id, row_number() OVER w - 1 AS n, {put(WS, "regexp_replace(text, '[<&>]', '', 'g')")} AS body, turn FROM conversations WHERE text NOT LIKE '%-->%' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT CAST(conv_id AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY n) - 1 AS INTEGER) AS ordinal, CAST(n * 61500 AS BIGINT) AS start_ms, CAST(n * 61500 + 2250 AS BIGINT) AS end_ms, '& ' || body AS text FROM c WHERE turn % 4 <> 3""")
def read_captions(t):
    """Conversations as caption files, one cue a turn; every fourth ends before it begins."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = t("conversations").where("text not like '%-->%'").withColumn("n", n)
    stamp = lambda ms: F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(F.pmod(ms, F.lit(3_600_000)) / 60_000), F.floor(F.pmod(ms, F.lit(60_000)) / 1000), F.pmod(ms, F.lit(1000)))
    start = F.col("n").cast("long") * 61_500
    body = F.regexp_replace(F.regexp_replace("text", "[<&>]", ""), r"\n\s*\n", "\n")
    cue = F.concat(F.col("n").cast("string"), F.lit("\n"), stamp(start), F.lit(" --> "), stamp(F.when(F.col("turn") % 4 == 3, start).otherwise(start + 2250)), F.lit("\r\n&amp; <i>"), body, F.lit("</i>"))
    whole = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", cue.alias("cue")))), lambda x: x["cue"]), "\n \n").alias("value"))
    return files.read_captions(whole.select(F.col("conv_id").cast("string").alias("path"), F.concat(F.lit("﻿"), "value").alias("value")))


@query("a14_speech_manifest", "SELECT p_partkey || '/' || p_partkey || '.wav' AS id, p_name AS reference, p_size * 4000 / 16000.0 AS seconds, p_brand AS gender FROM part")
def speech_manifest(t):
    parts = t("part")
    path = files.scratch(parts.sparkSession, "manifest")
    key = F.col("p_partkey").cast("string")
    parts.select(F.concat_ws("\t", key, F.concat(key, F.lit(".wav")), "p_name", F.lower("p_name"), F.lit("-"), (F.col("p_size") * 4000).cast("string"), "p_brand").alias("value")).write.text(path)
    return files.read_speech_manifest(parts.sparkSession, path).select("id", "reference", "seconds", "gender")



EXPORTED = """WITH c AS (SELECT l_orderkey AS r, l_linenumber AS i, max(l_partkey) AS part, max(l_suppkey) AS supp, max(l_returnflag) AS flag, max(l_linestatus) AS status FROM lineitem GROUP BY ALL),
l AS (SELECT *, 'S' || supp || CASE WHEN i % 2 = 0 THEN ', ' || printf('%02d:%02d', part // 60, part % 60) ELSE ', p. ' || i END AS cited FROM c),
m AS (SELECT r, '- part ' || part || ' [' || cited || ']' AS line, i, flag, status, '- **S' || supp || '**' || substr(cited, length('S' || supp) + 1) || ' (' || CASE status WHEN 'O' THEN 'automatic transcript' ELSE 'direct_support' END || ', revision r1): ' || CASE flag WHEN 'R' THEN '_[source deleted, content hidden]_' ELSE '"part ' || part || '"' END AS proof FROM l),
a AS (SELECT r, string_agg(line || ' — ' || status, chr(10) ORDER BY i) AS listed, string_agg(proof, chr(10) ORDER BY i) AS proofs, string_agg(line, chr(10) ORDER BY i DESC) FILTER (i <= 2) AS few FROM m GROUP BY r)"""


def exported(t):
    """Orders as runs, their lines as claims with one piece of evidence each."""
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("claim_idx")).agg(*[F.max(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")])
    text, even = F.concat(F.lit("part "), "l_partkey"), F.col("claim_idx") % 2 == 0
    claims = lines.select("run_id", "claim_idx", text.alias("text"), F.col("l_linestatus").alias("status"))
    evidence = lines.select("run_id", "claim_idx", F.lit(0).alias("ordinal"), F.concat(F.lit("S"), "l_suppkey").alias("source_alias"), F.when(~even, F.col("claim_idx")).alias("page_start"), F.when(even, F.col("l_partkey") * 1000).alias("start_ms"), F.lit("direct_support").alias("role"), F.when(F.col("l_linestatus") == "O", "automatic").alias("transcription_state"), (F.col("l_returnflag") == "R").alias("source_deleted"), text.alias("snapshot"), F.lit("r1").alias("revision"))
    runs = t("orders").select(F.col("o_orderkey").alias("run_id"), F.concat(F.lit("order "), "o_orderkey").alias("query"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("answer_status"), F.lit("p").alias("profile"))
    return runs, claims, evidence


@query("a17_export_runs", EXPORTED + " SELECT o_orderkey AS run_id, '# order ' || o_orderkey || chr(10) || chr(10) || '> Run ' || o_orderkey || ' · ' || o_orderstatus || ' · — · profile p' || chr(10) || chr(10) || coalesce(listed || chr(10), '') || chr(10) || '## Evidence' || chr(10) || coalesce(chr(10) || proofs, '') AS markdown FROM orders LEFT JOIN a ON r = o_orderkey")
def export_runs(t):
    return files.export_runs(*exported(t))


@query("a17_export_sections", EXPORTED + " SELECT o_orderkey AS run_id, '# order ' || o_orderkey || chr(10) || chr(10) || '> Run ' || o_orderkey || ' · ' || o_orderstatus || ' · — · profile p' || chr(10) || chr(10) || '## ' || o_orderpriority || chr(10) || chr(10) || 'As follows.' || chr(10) || chr(10) || coalesce(few || chr(10), '') || chr(10) || '## Evidence' || chr(10) || coalesce(chr(10) || proofs, '') AS markdown FROM orders LEFT JOIN a ON r = o_orderkey")
def export_sections(t):
    """One section a run, with its second and its first claim."""
    sections = t("orders").select(F.col("o_orderkey").alias("run_id"), F.lit(0).alias("item_no"), F.col("o_orderpriority").alias("title"), F.lit("As follows.").alias("template_text"), F.array(F.lit(2), F.lit(1)).alias("claim_idxs"))
    return files.export_runs(*exported(t), sections)


@query("a17_export_json", EXPORTED + " SELECT o_orderkey AS run_id, count(i) AS claims, count(i) FILTER (flag = 'R') AS hidden, max(CASE WHEN flag <> 'R' THEN 'part ' || part END) AS last FROM orders LEFT JOIN c ON r = o_orderkey GROUP BY o_orderkey")
def export_json(t):
    """The JSON form, read back."""
    back = files.export_runs(*exported(t), form="json").select(F.from_json("json", "run_id long, claims array<struct<text: string, evidence: array<struct<source_deleted: boolean, snapshot: string>>>>").alias("j")).select("j.*")
    one = F.flatten(F.col("claims.evidence"))
    return back.select("run_id", F.coalesce(F.size("claims"), F.lit(0)).cast("long").alias("claims"), F.coalesce(F.size(F.filter(one, lambda e: e["source_deleted"])), F.lit(0)).cast("long").alias("hidden"), F.array_max(F.transform(one, lambda e: e["snapshot"])).alias("last"))


@query("a18_paper_report", "SELECT (SELECT count(*) FROM documents) AS papers, count(*) AS questions, count(DISTINCT item_id) AS stable_question_ids, count(*) FILTER (length(text) > 200) AS questions_with_gold_quotes, count(*) FILTER (length(text) > 100) AS questions_with_reference_answers, count(*) FILTER (length(text) <= 80) AS all_annotations_unanswerable, count(*) FILTER (length(text) > 200) / greatest(1, count(*)) AS gold_quote_question_rate FROM benchmark")
def paper_report(t):
    """Documents as papers, the benchmark's items as questions."""
    over = lambda n: F.filter(F.array("text"), lambda x: F.length(x) > n)
    questions = t("benchmark").select(F.col("item_id").alias("question_id"), over(200).alias("gold_quotes"), over(100).alias("reference_answers"), (F.length("text") <= 80).alias("all_annotations_unanswerable"))
    return papers.conversion_report(t("documents"), questions)
