"""Working tables that several operators share: leaves, sentences, claim pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T


def claim_pairs(conversations: DataFrame) -> DataFrame:
    """Assistant turns as claims, each with the turn before as evidence: ``conv_id, turn, claim, evidence``."""
    before = conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    return conversations.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("claim")).join(before, ["conv_id", "turn"])


def leaves(documents: DataFrame) -> DataFrame:
    """The lines of documents with a word in them: ``doc_id, source, pos`` (from 0) and ``text``."""
    lines = documents.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.where(F.regexp_count("text", F.lit(T.WORD)) > 0)


def sentence_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, pos`` (from 1), ``sentence, char_start, char_end``: offsets in the normalized text."""
    parts = df.select(key, F.posexplode(T.sentences(text)).alias("p", "sentence"))
    end = F.sum(F.length("sentence") + 1).over(Window.partitionBy(key).orderBy("p")) - 1
    return parts.select(key, (F.col("p") + 1).cast("long").alias("pos"), "sentence", (end - F.length("sentence")).alias("char_start"), end.alias("char_end"))


def highlight(spans: DataFrame, key: str) -> DataFrame:
    """Half-open runs of ``text`` that are plain, in the leaf or in the quote: cut at every border."""
    borders = F.array_sort(F.array_distinct(F.array("view_start", "view_end", "leaf_start", "leaf_end", "quote_start", "quote_end")))
    inner = F.filter(borders, lambda x: (x >= F.col("view_start")) & (x <= F.col("view_end")))
    runs = spans.withColumn("borders", inner).withColumn("run", F.explode(F.zip_with(F.expr("slice(borders, 1, size(borders) - 1)"), F.expr("slice(borders, 2, size(borders) - 1)"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    within = lambda s, e: (F.col("run.a") >= F.col(s)) & (F.col("run.b") <= F.col(e))
    kind = F.when(within("quote_start", "quote_end"), "quote").when(within("leaf_start", "leaf_end"), "leaf").otherwise("plain")
    return runs.select(key, F.col("run.a").alias("char_start"), F.col("run.b").alias("char_end"), kind.alias("kind"), F.substring("text", F.col("run.a") + 1, F.col("run.b") - F.col("run.a")).alias("part"))


def best_units(pairs: DataFrame) -> DataFrame:
    """Each sentence of a claim with the evidence sentence of the highest token F1, the first on ties."""
    s = pairs.select("conv_id", "turn", F.posexplode(T.sentences("claim")).alias("i", "s"), "evidence")
    e = s.select("conv_id", "turn", "i", T.spaced_tokens(F.lower("s")).alias("a"), F.posexplode(T.sentences("evidence")).alias("j", "e"))
    f = e.select("conv_id", "turn", "i", "j", F.round(T.token_f1(F.col("a"), T.spaced_tokens(F.lower("e"))), 9).alias("f"))
    best = f.groupBy("conv_id", "turn", "i").agg(F.max(F.struct("f", (-F.col("j")).alias("j"))).alias("best"))
    return best.select("conv_id", "turn", (F.col("i") + 1).cast("long").alias("sentence"), (1 - F.col("best.j")).cast("long").alias("unit"), F.round("best.f", 6).alias("f1"))
