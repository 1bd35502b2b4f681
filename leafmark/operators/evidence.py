"""Gold labels of leaves and the places of evidence: quotes in leaves, what a claim can see, sentences as units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T

TAU = 0.5
#: Words that are met last when quotes look for leaves.
HOT = 1000


def label_gold(records: DataFrame, leaves: DataFrame, tau: float = TAU) -> tuple[DataFrame, DataFrame]:
    """``(query_id, node_id)`` of gold leaves, and ``(query_id, quotes)``: the quotes that a leaf matched, or all where none did.

    Gold are the leaves named, those that share a gold paragraph, and those of the question's sources that hold a quote or
    reach a token F1 of ``tau`` with it. ``records``: query_id, sources, gold_child_ids, gold_paragraph_ids, gold_quotes (arrays);
    ``leaves``: node_id, source, text, paragraph_ids. A question without a source is held against all leaves, by its quotes' words.
    """
    named = records.select("query_id", F.explode("gold_child_ids").alias("node_id"))
    wanted = records.select("query_id", F.explode("gold_paragraph_ids").alias("paragraph_id"))
    shared = leaves.select("node_id", F.explode("paragraph_ids").alias("paragraph_id")).join(wanted, "paragraph_id").select("query_id", "node_id")
    low = lambda c: T.normalize_ws(F.lower(c))
    quotes = records.select("query_id", "sources", F.posexplode("gold_quotes").alias("no", "quote")).withColumn("q", low("quote")).where("q <> ''").withColumn("a", T.spaced_tokens("q"))
    text = leaves.select("node_id", "source", low("text").alias("t")).withColumn("b", T.spaced_tokens("t"))
    # no more words are shared than there are different shared ones and repeated ones of either side
    most = F.size(F.array_intersect("a", "b")) + F.least(F.size("a") - F.size(F.array_distinct("a")), F.size("b") - F.size(F.array_distinct("b")))
    likely = 2 * most >= tau * (F.size("a") + F.size("b")) - 1e-6
    matched = _pairs(quotes, text, tau).where(F.contains("t", F.col("q")) | (likely & (F.round(T.token_f1(F.col("a"), F.col("b")), 9) >= tau)))
    gold = named.unionByName(shared).unionByName(matched.select("query_id", "node_id")).distinct()
    hits = matched.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("no", "quote"))).alias("hits"))
    found = records.select("query_id", "gold_quotes").join(hits, "query_id", "left").select("query_id", F.coalesce(F.transform("hits", lambda h: h["quote"]), "gold_quotes").alias("quotes"))
    return gold, found


def _pairs(quotes: DataFrame, text: DataFrame, tau: float) -> DataFrame:
    """Quotes with the leaves that may match them: all that do, and few that don't.

    Words have one order in which the ``HOT`` most frequent ones come last, in steps of a quarter of them. A token F1 of ``tau`` needs so many shared words
    that the first words of both, all but that many, must meet. A leaf that holds a quote holds each of its words
    but the outer two whole, so it is met by the first of these. Quotes of one or two words lie inside any word, and meet
    the leaves of their sources; without a source they meet by a word.
    """
    least = tau / (2 - tau)  # of its words either side must share
    hot = [r["w"] for r in text.select(F.explode("b").alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(HOT).collect()]
    ranks = [(len(hot) >> 2 * i, i + 1) for i in range(5) if len(hot) >> 2 * i]
    late = lambda w: reduce(lambda c, r: F.when(w.isin(hot[: r[0]]), r[1]).otherwise(c), ranks, F.lit(0))  # noqa: E731  sets are looked up, lists gone through; 0 for rare words
    in_order = lambda c: F.transform(F.array_sort(F.transform(c, lambda w: F.struct(late(w).alias("late"), w.alias("w")))), lambda x: x["w"])
    needed = lambda n: F.greatest(F.lit(1), F.ceil(F.lit(least) * n - 1e-9).cast("int"))
    first = lambda c: F.array_distinct(F.slice(in_order(c), F.lit(1), F.size(c) - needed(F.size(c)) + 1))
    inner = F.expr("slice(a, 2, size(a) - 2)")
    by_word = F.concat(F.transform(first("a"), lambda w: F.struct(w.alias("word"), F.lit(False).alias("whole"))), F.when(F.size("a") > 2, F.transform(F.slice(in_order(inner), 1, 1), lambda w: F.struct(w.alias("word"), F.lit(True).alias("whole")))).otherwise(F.transform(F.array_distinct("a"), lambda w: F.struct(w.alias("word"), F.lit(True).alias("whole")))))
    asked = quotes.withColumn("scope", F.explode(F.when(F.size("sources") > 0, F.array_distinct("sources")).otherwise(F.array(F.lit(None).cast("string"))))).withColumn("n", F.size("a")).withColumn("w", F.explode(by_word)).select("query_id", "no", "quote", "q", "a", "n", "scope", "w.word", "w.whole")
    held = text.select("node_id", "source", F.size("b").alias("m"), F.posexplode(in_order("b")).alias("at", "word")).withColumn("early", F.col("at") <= F.col("m") - needed(F.col("m")))
    near = (F.col("m") >= F.lit(least) * F.col("n") - 1e-9) & (F.col("n") >= F.lit(least) * F.col("m") - 1e-9)
    met = asked.join(held, "word").where((F.col("scope").isNull() | (F.col("scope") == F.col("source"))) & (F.col("whole") | (F.col("early") & near))).select("query_id", "no", "node_id")
    short = quotes.where((F.size("a") <= 2) & (F.size("sources") > 0)).select("query_id", "no", F.explode(F.array_distinct("sources")).alias("source")).join(text, "source").select("query_id", "no", "node_id")
    pairs = met.unionByName(short).distinct()
    # pairs meet the leaves' texts by their numbers alone; words are made where they have met
    met = pairs.join(text.select("node_id", "t"), "node_id").join(quotes.select("query_id", "no", "quote", "q", "a"), ["query_id", "no"])
    return met.withColumn("b", T.spaced_tokens("t"))


def restrict_to_visible(leaves: DataFrame, blocks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by..., node_id, text, paragraph_ids``: of each leaf only the fragments shown, once each in document order, and the paragraphs that overlap one.

    ``leaves``: node_id, paragraphs array<struct<paragraph_id, text>>; ``blocks``: by..., node_id, char_start, char_end, text.
    """
    keys = [*(by or []), "node_id"]
    shown = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("char_start", "char_end", "text"))), lambda b: b["text"]))
    g = blocks.groupBy(*keys).agg(shown.alias("fragments")).join(leaves.select("node_id", "paragraphs"), "node_id")
    plain = g.withColumn("__f", F.transform("fragments", T.normalize_ws))
    kept = F.filter("paragraphs", lambda p: F.exists("__f", lambda f: F.contains(T.normalize_ws(p["text"]), f) | F.contains(f, T.normalize_ws(p["text"]))))
    return plain.select(*keys, F.array_join("fragments", "\n").alias("text"), F.transform(kept, lambda p: p["paragraph_id"]).alias("paragraph_ids"))


def evidence_span(quotes: DataFrame, strict: bool = True) -> DataFrame:
    """Adds ``span_start, span_end``: a quote's place in the canonical text. What isn't in its block, or doesn't agree with its leaf, is an error, or null unless ``strict``.

    ``quotes``: quote, block_text, block_start, block_end, leaf_text, leaf_start, leaf_end.
    """
    at = F.when(F.col("quote") != "", F.expr("locate(quote, block_text)") - 1)
    start = F.col("block_start") + at
    end = start + F.length("quote")
    fine = F.coalesce((at >= 0) & (start >= F.col("leaf_start")) & (end <= F.col("leaf_end")) & (end <= F.col("block_end")) & (F.substring(F.col("leaf_text"), start - F.col("leaf_start") + 1, F.length("quote")) == F.col("quote")), F.lit(False))
    bad = F.raise_error(F.lit("invalid evidence span")).cast("int") if strict else F.lit(None).cast("int")
    return quotes.withColumn("span_start", F.when(fine, start).otherwise(bad)).withColumn("span_end", F.when(fine, end).otherwise(bad))


def sentence_units(leaves: DataFrame) -> DataFrame:
    """``unit_id, section_id, leaf_id, char_start, char_end, text``: sentences of leaves, those of overlapping leaves once, by the first one.

    ``leaves``: leaf_id, leaf_no (their order), section_id, text (normalized), char_start.
    """
    parts = leaves.select("leaf_id", "leaf_no", "section_id", "char_start", T.sentences("text").alias("s"))
    ends = F.transform("s", lambda _, i: F.aggregate(F.slice("s", 1, i + 1), F.lit(-1), lambda a, x: a + F.length(x) + 1))
    placed = parts.select("leaf_id", "leaf_no", "section_id", "char_start", F.inline(F.zip_with("s", ends, lambda x, e: F.struct(x.alias("text"), e.alias("e")))))
    units = placed.select("leaf_id", "leaf_no", "section_id", "text", (F.col("char_start") + F.col("e") - F.length("text")).alias("a"), (F.col("char_start") + F.col("e")).alias("b"))
    once = units.groupBy("section_id", "a", "b").agg(F.min(F.struct("leaf_no", "leaf_id", "text")).alias("f"))
    ident = F.substring(F.sha2(F.concat_ws("|", "section_id", F.col("a").cast("string"), F.col("b").cast("string")), 256), 1, 20)
    return once.select(ident.alias("unit_id"), "section_id", F.col("f.leaf_id").alias("leaf_id"), F.col("a").alias("char_start"), F.col("b").alias("char_end"), F.col("f.text").alias("text"))


def stage_diagnostics(gold: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """``query_id`` and, for each named stage (query_id, node_id), the share of gold leaves that it holds."""
    total = gold.groupBy("query_id").agg(F.count_distinct("node_id").alias("__n"))
    out = total
    for name, rows in stages.items():
        hit = rows.select("query_id", "node_id").distinct().join(gold.select("query_id", "node_id").distinct(), ["query_id", "node_id"]).groupBy("query_id").agg(F.count("*").alias(name))
        out = out.join(hit, "query_id", "left")
    return out.select("query_id", *[(F.coalesce(name, F.lit(0)) / F.greatest(F.lit(1), "__n")).alias(name) for name in stages])


def paragraph_coverage(references: DataFrame, blocks: DataFrame) -> DataFrame:
    """``query_id, best, complete``: the characters of an annotator's gold paragraphs that the context shows, for the annotator with most, and whether one's are shown whole.

    ``references``: query_id, annotator, paragraph_no, text; ``blocks``: query_id, text. A fragment covers the place where it stands first in a paragraph;
    overlapping ones count once.
    """
    p = references.select("query_id", "annotator", "paragraph_no", T.normalize_ws("text").alias("p"))
    f = blocks.groupBy("query_id").agg(F.collect_set(T.normalize_ws("text")).alias("fragments"))
    j = p.join(f, "query_id", "left").withColumn("fragments", F.filter(F.coalesce("fragments", F.array().cast("array<string>")), lambda x: x != ""))
    whole = F.exists("fragments", lambda x: F.contains(x, F.col("p")))
    spans = F.array_sort(F.filter(F.transform("fragments", lambda x: F.struct(F.call_function("locate", x, F.col("p")).alias("a"), F.length(x).alias("n"))), lambda s: s["a"] > 0))
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("total"))
    union = F.aggregate(spans, start, lambda acc, s: F.struct(F.greatest(acc["reach"], s["a"] - 1 + s["n"]).alias("reach"), (acc["total"] + F.greatest(F.lit(0), s["a"] - 1 + s["n"] - F.greatest(acc["reach"], s["a"] - 1))).alias("total")), lambda acc: acc["total"])
    share = F.when(whole, 1.0).otherwise(union / F.greatest(F.lit(1), F.length("p")))
    g = j.withColumn("share", share).groupBy("query_id", "annotator").agg(F.avg("share").alias("mean"), F.min("share").alias("least"))
    return g.groupBy("query_id").agg(F.max("mean").alias("best"), F.bool_or(F.col("least") >= 0.999).alias("complete"))
