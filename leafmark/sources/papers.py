"""Question sets over papers: nested records and benchmark tables as papers and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T

ANSWER = "struct<unanswerable: boolean, extractive_spans: array<string>, free_form_answer: string, yes_no: boolean, evidence: array<string>, highlighted_evidence: array<string>>"
PAPER = f"struct<title: string, abstract: string, full_text: array<struct<section_name: string, paragraphs: array<string>>>, qas: array<struct<question: string, question_id: string, answers: array<struct<answer: {ANSWER}>>>>>"
PLACED = "array<struct<paragraph_id: string, text: string, char_start: int, char_end: int>>"
SECTIONS = f"array<struct<title: string, text: string, section_type: string, position: int, paragraphs: {PLACED}>>"
#: Before evidence that equals a paragraph in all but white space: it counts, and matches nothing.
UNMATCHABLE = "\0official-unmatchable:"
BODY_TYPES = ["sentence", "list_item", "formula", "figure", "table"]


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """``paper_id, paper`` of files that each hold one JSON object of papers by id."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    return whole.select(F.inline(F.map_entries(F.from_json("value", f"map<string, {PAPER}>", {"mode": "FAILFAST"})))).select(F.col("key").alias("paper_id"), F.col("value").alias("paper"))


def reference_answer(answer: Column) -> Column:
    """Unanswerable, else the spans, else the free answer, else Yes or No, else nothing."""
    spans, free = answer["extractive_spans"], answer["free_form_answer"]
    return (
        F.when(F.coalesce(answer["unanswerable"], F.lit(False)), "Unanswerable")
        .when(F.coalesce(F.size(spans), F.lit(0)) > 0, F.array_join(spans, ", "))
        .when(F.coalesce(free, F.lit("")) != "", free)
        .when(answer["yes_no"], "Yes").when(~answer["yes_no"], "No").otherwise("")
    )


def placed(texts: Column, name) -> Column:
    """Texts with ids and their places in the texts joined by line feeds; ``name(i)`` is the i-th one's id."""
    ends = F.aggregate(texts, F.array().cast("array<int>"), lambda done, t: F.array_append(done, F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(-1)) + F.length(t) + 1))
    return F.zip_with(F.transform(texts, lambda t, i: F.struct(name(i).alias("paragraph_id"), t.alias("text"))), ends, lambda p, e: F.struct(p["paragraph_id"].alias("paragraph_id"), p["text"].alias("text"), (e - F.length(p["text"])).alias("char_start"), e.alias("char_end")))


def _sections(paper: Column, paper_id: Column) -> Column:
    """Sections with text, with placed paragraphs; the abstract first unless a section has that title."""
    kept = lambda s: F.filter(F.transform(F.coalesce(s["paragraphs"], F.array().cast("array<string>")), lambda p: T.normalize_ws(F.coalesce(p, F.lit("")))), lambda p: p != "")
    # the paragraphs of a section are made once, then named and placed
    made = lambda s, i: F.struct(F.coalesce(F.nullif(s["section_name"], F.lit("")), F.concat(F.lit("Section "), (i + 1).cast("string"))).alias("title"), kept(s).alias("kept"))
    one = lambda s, i: F.struct(
        s["title"].alias("title"), F.array_join(s["kept"], "\n").alias("text"), F.lit("document").alias("section_type"), i.alias("position"),
        placed(s["kept"], lambda k: F.concat(paper_id, F.lit(":section:"), i.cast("string"), F.lit(":paragraph:"), k.cast("string"))).alias("paragraphs"),
    )
    parts = F.transform(F.coalesce(paper["full_text"], F.array().cast("array<struct<section_name: string, paragraphs: array<string>>>")), made)
    full = F.filter(F.transform(parts, one), lambda s: s["text"] != "")
    abstract = T.strip(F.coalesce(paper["abstract"], F.lit("")))
    first = F.array(F.struct(F.lit("Abstract").alias("title"), abstract.alias("text"), F.lit("abstract").alias("section_type"), F.lit(-1).alias("position"), F.array(F.struct(F.concat(paper_id, F.lit(":abstract:paragraph:0")).alias("paragraph_id"), abstract.alias("text"), F.lit(0).alias("char_start"), F.length(abstract).alias("char_end"))).alias("paragraphs")))
    return F.when((abstract != "") & ~F.exists(full, lambda s: F.lower(s["title"]) == "abstract"), F.concat(first.cast(SECTIONS), full.cast(SECTIONS))).otherwise(full.cast(SECTIONS))


def load_qasper(spark: SparkSession, path: str, split: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(papers, questions, report)`` of nested paper files; the questions keep one list of evidence an annotator, repeats included.

    A missing or repeated question id is an error when the questions are read.
    """
    raw = read_papers(spark, path)
    papers = raw.select(F.lit("qasper").alias("dataset"), F.lit(split).alias("split"), "paper_id", F.col("paper_id").alias("document_id"), F.concat("paper_id", F.lit(".qasper")).alias("source"), F.coalesce("paper.title", F.lit("")).alias("title"), _sections(F.col("paper"), F.col("paper_id")).alias("sections"), "paper")
    # the first paragraph with a text stands for it, the abstract last
    body = F.flatten(F.transform(F.filter("sections", lambda s: s["position"] >= 0), lambda s: s["paragraphs"]))
    abstract = F.flatten(F.transform(F.filter("sections", lambda s: s["position"] < 0), lambda s: F.transform(s["paragraphs"], lambda p: F.struct(p["paragraph_id"].alias("paragraph_id"), T.normalize_ws(p["text"]).alias("text"), p["char_start"].alias("char_start"), p["char_end"].alias("char_end")))))
    verbatim = F.concat(F.flatten(F.transform(F.coalesce("paper.full_text", F.array().cast("array<struct<section_name: string, paragraphs: array<string>>>")), lambda s: F.coalesce(s["paragraphs"], F.array().cast("array<string>")))), F.array(F.coalesce("paper.abstract", F.lit(""))))
    asked = papers.select("dataset", "split", "paper_id", "source", F.concat(body.cast(PLACED), abstract.cast(PLACED)).alias("known"), verbatim.alias("verbatim"), F.explode("paper.qas").alias("qa"))
    empty = F.array().cast("array<string>")
    answers = F.transform(F.coalesce("qa.answers", F.array().cast(f"array<struct<answer: {ANSWER}>>")), lambda a: a["answer"])
    asked = asked.withColumn("answers", answers).withColumn("raw", F.transform("answers", lambda a: F.coalesce(a["evidence"], empty))).withColumn("evidence", F.transform("raw", lambda e: F.transform(e, lambda q: T.normalize_ws(F.coalesce(q, F.lit(""))))))
    of = lambda q: F.try_element_at(F.filter("known", lambda p: p["text"] == q), F.lit(1))["paragraph_id"]
    sets = F.transform("evidence", lambda e: F.array_distinct(F.array_compact(F.transform(e, of))))
    marked = F.zip_with("raw", "evidence", lambda r, e: F.zip_with(r, e, lambda a, q: F.when(of(q).isNull() | F.array_contains("verbatim", a), q).otherwise(F.concat(F.lit(UNMATCHABLE), q))))
    references = F.transform("answers", reference_answer)
    quotes = F.array_distinct(F.filter(F.flatten("evidence"), lambda q: q != ""))
    same = F.count("*").over(Window.partitionBy("question_id"))
    questions = asked.select(
        "dataset", "split", "paper_id", "source", F.coalesce("qa.question_id", F.lit("")).alias("question_id"), T.strip(F.coalesce("qa.question", F.lit(""))).alias("query"), F.coalesce(F.try_element_at(references, F.lit(1)), F.lit("")).alias("answer"), references.alias("reference_answers"), marked.alias("reference_evidence_sets"), sets.alias("reference_paragraph_sets"),
        F.array_sort(F.array_distinct(F.flatten(sets))).alias("gold_paragraph_ids"), quotes.alias("gold_quotes"), (F.size(quotes) > 0).alias("citation_evaluable_source"), ((F.size("answers") > 0) & F.forall("answers", lambda a: F.coalesce(a["unanswerable"], F.lit(False)))).alias("all_annotations_unanswerable"), F.size("answers").alias("annotation_count"),
    ).withColumn("same", same)
    bad = F.when(F.col("question_id") == "", F.raise_error(F.concat(F.lit("question without an id in paper "), "paper_id"))).when(F.col("same") > 1, F.raise_error(F.concat(F.lit("question id twice: "), "question_id"))).cast("string")
    questions = questions.withColumn("question_id", F.coalesce(bad, "question_id")).drop("same")
    papers = papers.drop("paper")
    return papers, questions, conversion_report(papers, questions, spark.read.format("binaryFile").load(path))


def conversion_report(papers: DataFrame, questions: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row: papers, questions, questions with gold quotes and their share, unanswerable ones, and a hash over the files' contents."""
    q = questions.agg(
        F.count("*").alias("questions"), F.countDistinct("question_id").alias("stable_question_ids"), F.count_if(F.size("gold_quotes") > 0).alias("questions_with_gold_quotes"), F.count_if(F.size("reference_answers") > 0).alias("questions_with_reference_answers"),
        (F.count_if("all_annotations_unanswerable") if "all_annotations_unanswerable" in questions.columns else F.lit(0).cast("long")).alias("all_annotations_unanswerable"),
    )
    one = papers.agg(F.count("*").alias("papers")).join(q).withColumn("gold_quote_question_rate", F.col("questions_with_gold_quotes") / F.greatest(F.lit(1), "questions"))  # one row each
    if files is None:
        return one
    digests = files.select(F.sha2("content", 256).alias("digest"))
    return one.join(digests.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ""), 256).alias("source_sha256")))


def load_qasper_simple(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(documents, questions)``: sections of joined paragraphs; each question with its first answerable annotation that has any text."""
    raw = read_papers(spark, path)
    join = lambda s: T.strip(F.array_join(F.transform(F.coalesce(s["paragraphs"], F.array().cast("array<string>")), lambda p: T.strip(F.coalesce(p, F.lit("")))), "\n"))
    full = F.transform(F.coalesce("paper.full_text", F.array().cast("array<struct<section_name: string, paragraphs: array<string>>>")), lambda s, i: F.struct(F.coalesce(F.nullif(s["section_name"], F.lit("")), F.concat(F.lit("Section "), i.cast("string"))).alias("title"), join(s).alias("text")))
    abstract = T.strip(F.coalesce("paper.abstract", F.lit("")))
    sections = F.concat(F.when(abstract != "", F.array(F.struct(F.lit("Abstract").alias("title"), abstract.alias("text")))).otherwise(F.array().cast("array<struct<title: string, text: string>>")), F.filter(full, lambda s: s["text"] != ""))
    documents = raw.select(F.col("paper_id").alias("document_id"), F.concat("paper_id", F.lit(".pdf")).alias("source"), sections.alias("sections"), "paper").where(F.size("sections") > 0)
    asked = documents.select("document_id", "source", F.posexplode("paper.qas").alias("question_pos", "qa")).select("document_id", "source", "question_pos", T.strip(F.coalesce("qa.question", F.lit(""))).alias("query"), F.coalesce("qa.question_id", F.lit("")).alias("question_id"), F.posexplode("qa.answers").alias("answer_pos", "item")).where("query <> ''")
    filled = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), T.strip), lambda x: x != "")
    a = asked.withColumn("a", F.col("item.answer"))
    marked = F.when(F.coalesce(F.size("a.highlighted_evidence"), F.lit(0)) > 0, F.col("a.highlighted_evidence")).otherwise(F.col("a.evidence"))
    a = a.withColumn("spans", filled("a.extractive_spans")).withColumn("marked", filled(marked)).withColumn("free", T.strip(F.coalesce("a.free_form_answer", F.lit(""))))
    usable = a.where(~F.coalesce("a.unanswerable", F.lit(False)) & ((F.size("spans") > 0) | (F.size("marked") > 0) | (F.col("free") != "")))
    first = F.row_number().over(Window.partitionBy("document_id", "question_pos").orderBy("answer_pos"))
    questions = usable.withColumn("first", first).where("first = 1").select("query", "question_id", "source", F.when(F.size("spans") > 0, F.array_join("spans", " ")).otherwise(F.col("free")).alias("gold_answer"), F.when(F.size("spans") > 0, F.col("spans")).otherwise(F.col("marked")).alias("gold_quotes"), F.col("a.yes_no").alias("yes_no"))
    return documents.drop("paper"), questions


def short_source(paper_id: Column) -> Column:
    return F.concat(F.lit("pq-"), F.substring(F.sha1(paper_id), 1, 10), F.lit(".peerqa"))


def load_peerqa(elements: DataFrame, qa: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(paragraphs, questions, report)`` of element rows and questions.

    ``paragraphs``: paper_id, title, section_pos, section_title, paragraph_id, text, char_start, char_end. A heading
    begins a section; what stands before the first is named by its last heading, or Preamble. Elements of a section with one
    ``pidx`` are a paragraph. Sections without text don't count. Questions need evidence that some paragraph holds.
    """
    order = Window.partitionBy("paper_id").orderBy("idx")
    norm = lambda c: T.normalize_ws(F.coalesce(c, F.lit("")))
    heading = F.col("type") == "heading"
    rows = elements.withColumn("starts", (heading | (F.row_number().over(order) == 1)).cast("int")).withColumn("section", F.sum("starts").over(order))
    named = F.when(heading, norm(F.col("content"))).otherwise(F.coalesce(F.nullif(norm(F.col("last_heading")), F.lit("")), F.lit("Preamble")))
    rows = rows.withColumn("section_title", F.first(F.when(F.col("starts") == 1, named), ignorenulls=True).over(Window.partitionBy("paper_id", "section").orderBy("idx")))
    body = rows.where(F.col("type").isin(BODY_TYPES)).withColumn("paragraph_id", F.concat("paper_id", F.lit(":p"), F.col("pidx").cast("string")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", norm(F.col("content")).alias("c")))), lambda x: x["c"]), " ")
    paras = body.groupBy("paper_id", "section", "paragraph_id").agg(F.min("idx").alias("first"), F.first("section_title").alias("section_title"), T.normalize_ws(text).alias("text")).where("text <> ''")
    in_section = Window.partitionBy("paper_id", "section").orderBy("first")
    end = F.sum(F.length("text") + 1).over(in_section) - 1
    titles = elements.where("type = 'title'").groupBy("paper_id").agg(norm(F.min_by("content", "idx")).alias("title"))
    papers = elements.select("paper_id").distinct()
    position = (F.dense_rank().over(Window.partitionBy("paper_id").orderBy("section")) - 1).alias("section_pos")
    paragraphs = paras.select("paper_id", position, "section_title", "paragraph_id", "first", "text", (end - F.length("text")).alias("char_start"), end.alias("char_end")).join(titles, "paper_id", "left").withColumn("title", F.coalesce("title", F.lit("")))
    # an element's paragraph; one that goes on in a later section has that one's text
    latest = paras.groupBy("paper_id", "paragraph_id").agg(F.max_by("text", "section").alias("text"))
    of = body.select("paper_id", F.col("idx").cast("long").alias("element"), "paragraph_id").join(latest, ["paper_id", "paragraph_id"])
    asked = qa.withColumn("known", F.lit(1)).join(papers.withColumn("has_paper", F.lit(True)), "paper_id", "left")
    cited = asked.where("answerable_mapped and has_paper").select("paper_id", "question_id", F.posexplode(F.flatten(F.transform("answer_evidence_mapped", lambda e: e["idx"]))).alias("at", "element")).join(of, ["paper_id", "element"])
    once = cited.groupBy("paper_id", "question_id", "paragraph_id").agg(F.min("at").alias("at"), F.first("text").alias("text"))
    gold = once.groupBy("paper_id", "question_id").agg(F.array_sort(F.collect_list(F.struct("at", "paragraph_id", "text"))).alias("gold"))
    joined = asked.join(gold, ["paper_id", "question_id"], "left")
    questions = joined.where("answerable_mapped and has_paper and gold is not null").select(
        F.lit("peerqa").alias("dataset"), "paper_id", short_source(F.col("paper_id")).alias("source"), "question_id", norm(F.col("question")).alias("query"), norm(F.col("answer_free_form")).alias("answer"), F.array(norm(F.col("answer_free_form"))).alias("reference_answers"),
        F.transform("gold", lambda g: g["paragraph_id"]).alias("evidence_paragraph_ids"), F.array_sort(F.transform("gold", lambda g: g["paragraph_id"])).alias("gold_paragraph_ids"), F.transform("gold", lambda g: g["text"]).alias("gold_quotes"), F.lit(True).alias("citation_evaluable_source"),
    )
    answerable = F.coalesce("answerable_mapped", F.lit(False))
    report = joined.agg(F.count_if(answerable & F.col("has_paper").isNotNull() & F.col("gold").isNotNull()).alias("questions"), F.count_if(~answerable).alias("not_answerable_mapped"), F.count_if(answerable & F.col("has_paper").isNull()).alias("paper_missing"), F.count_if(answerable & F.col("has_paper").isNotNull() & F.col("gold").isNull()).alias("evidence_unmapped"))
    return paragraphs.drop("first"), questions, report


def mteb_to_elements(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A retrieval benchmark's three tables as element rows and questions for :func:`load_peerqa`.

    A unit without a title is a heading if a unit of its paper names it as its title; judgements of 0 or less
    and queries without any judgement are left out.
    """
    paper = lambda c: F.regexp_extract(c, r"^(.*)_(\d+)$", 1)
    number = lambda c: F.regexp_extract(c, r"^(.*)_(\d+)$", 2).cast("long")
    units = corpus.select(paper("id").alias("paper_id"), number("id").alias("idx"), T.normalize_ws(F.coalesce("title", F.lit(""))).alias("t"), "title", "text")
    headings = units.where("t <> ''").select(F.col("paper_id").alias("of_paper"), F.col("t").alias("named")).distinct()
    marked = units.withColumn("n", T.normalize_ws("text")).join(headings.withColumn("is_named", F.lit(True)), (F.col("paper_id") == F.col("of_paper")) & (F.col("n") == F.col("named")), "left")
    kind = F.when(F.col("idx") == 0, "title").when((F.col("t") == "") & F.col("is_named").isNotNull(), "heading").otherwise("sentence")
    elements = marked.select("paper_id", "idx", F.col("idx").alias("pidx"), F.lit(0).alias("sidx"), kind.alias("type"), F.col("text").alias("content"), F.nullif("title", F.lit("")).alias("last_heading"))
    judged = qrels.where(F.coalesce("score", F.lit(1)) > 0).select(F.col("query-id").alias("question_id"), paper("corpus-id").alias("paper_id"), number("corpus-id").alias("idx"))
    of_query = judged.groupBy("question_id").agg(F.max("paper_id").alias("paper_id"), F.array_sort(F.collect_set("idx")).alias("idx"))
    qa = queries.select(F.col("id").alias("question_id"), F.col("text").alias("question")).join(of_query, "question_id")
    return elements, qa.select("paper_id", "question_id", "question", F.lit("").alias("answer_free_form"), F.lit(True).alias("answerable_mapped"), F.array(F.struct("idx")).alias("answer_evidence_mapped"))


def load_scifact(corpus: DataFrame, claims: DataFrame, split: str = "dev") -> tuple[DataFrame, DataFrame]:
    """``(papers, questions)``: one question a claim and cited document; different labels for one such pair are an error."""
    pairs = claims.select("id", "claim", F.explode("evidence").alias("key", "rationales")).select("id", "claim", F.col("key").cast("int").alias("doc_id"), "rationales")
    labels = F.array_distinct(F.transform("rationales", lambda r: r["label"]))
    label = F.when(F.size(labels) == 1, labels[0]).otherwise(F.raise_error(F.concat(F.lit("different labels for claim "), F.col("id").cast("string"))))
    sentences = F.array_sort(F.array_distinct(F.flatten(F.transform("rationales", lambda r: F.coalesce(r["sentences"], F.array().cast("array<int>"))))))
    met = pairs.withColumn("label", label).withColumn("gold_sentence_ids", sentences).join(corpus.select("doc_id", "abstract"), "doc_id")
    quotes = F.transform("gold_sentence_ids", lambda i: F.get("abstract", i))
    questions = met.select(
        F.lit("scifact").alias("dataset"), F.lit(split).alias("split"), F.col("doc_id").cast("string").alias("paper_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".scifact")).alias("source"), F.concat_ws("-", F.lit("scifact"), F.col("id").cast("string"), F.col("doc_id").cast("string")).alias("question_id"),
        F.concat(F.lit("Is the following scientific claim supported or contradicted? "), "claim").alias("query"), F.when(F.col("label") == "SUPPORT", "supported").when(F.col("label") == "CONTRADICT", "contradicted").alias("answer"), quotes.alias("gold_quotes"), "gold_sentence_ids", F.col("label").alias("scifact_label"), (F.size("gold_sentence_ids") > 0).alias("citation_evaluable_source"),
    )
    used = corpus.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    papers = used.select(F.lit("scifact").alias("dataset"), F.lit(split).alias("split"), F.col("doc_id").cast("string").alias("paper_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".scifact")).alias("source"), F.coalesce("title", F.lit("")).alias("title"), F.array_join(F.coalesce("abstract", F.array().cast("array<string>")), "\n").alias("text"))
    return papers, questions


def papers_to_documents(papers: DataFrame) -> DataFrame:
    """``document_id, source, title, sections`` of paper records; sections without text are left out."""
    return papers.select("document_id", "source", "title", F.filter("sections", lambda s: T.strip(s["text"]) != "").alias("sections"))


