"""The passage tree: leaves packed from sentences, sliding parents, sections and documents, with exact offsets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as S

from ..functions import text as T

LEAF_TOKENS, OVERLAP_SENTENCES, GROUP, GROUP_OVERLAP = 220, 1, 4, 1
#: Characters of a stretch in which intervals meet.
WIDTH = 4096


def sections(documents: DataFrame) -> DataFrame:
    """Blocks of documents at line feeds as sections: ``doc_id, source, section_pos, text`` (normalized)."""
    lines = documents.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("section_pos", "raw"))
    return lines.select("doc_id", "source", "section_pos", T.normalize_ws("raw").alias("text")).where("text <> ''")


# Names of sections, in the order in which they are looked for in a title.
SECTION_NAMES = ["abstract", "introduction", "related work", "method", "methods", "experiments", "results", "discussion", "limitations", "conclusion", "references"]
HEADERS = ["section_header", "title", "subtitle"]


def section_type(title: str | Column) -> Column:
    """The first known name in a title without its number; document if there is none."""
    value = T.fold(T.strip(F.regexp_replace(title, r"^\d+(?:\.\d+)*\.?\s*", "")))
    return F.coalesce(*[F.when(F.contains(value, F.lit(n)), n.replace(" ", "_")) for n in SECTION_NAMES], F.lit("document"))


def markdown_sections(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, section, title, section_type, body``: cut at headings of level 1 to 3; what stands before the first is Document. Empty bodies go.

    Lines stay in their document's row: headings begin sections by their places in the array of lines.
    """
    lines = documents.select(key, F.split("text", "\n").alias("lines"))
    cuts = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(r"^#{1,3}\s+\S"), i)), lambda i: i.isNotNull())
    starts = lines.withColumn("starts", F.concat(F.array(F.lit(-1)), cuts))
    part = starts.select(key, "lines", "starts", F.posexplode("starts").alias("section", "at"))
    stop = F.coalesce(F.get("starts", F.col("section") + 1), F.size("lines"))
    title = F.when(F.col("at") < 0, "Document").otherwise(T.strip(F.regexp_replace(F.get("lines", F.greatest("at", F.lit(0))), r"^#+\s+", "")))
    body = T.strip(F.array_join(F.slice("lines", F.col("at") + 2, stop - F.col("at") - 1), "\n"))
    return part.select(key, "section", title.alias("title"), body.alias("body")).where("body <> ''").withColumn("section_type", F.when(F.col("section") == 0, "document").otherwise(section_type("title"))).select(key, "section", "title", "section_type", "body")


def layout_sections(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sections of ordered layout items: ``key, section_pos, title, section_type, text, page_start, page_end, confidence, page_spans, items``.

    ``items``: key, ordinal, label, text, page, confidence. A header closes the section before it; texts are joined by line
    feeds, each with its page; what stands before the first header comes first as Document. Runs of
    blanks become one, and the spans of pages are laid anew on what is left.
    """
    head = F.col("label").isin(HEADERS)
    w = Window.partitionBy(key).orderBy("ordinal")
    numbered = items.withColumn("cut", F.sum(head.cast("int")).over(w))
    held = F.array_sort(F.collect_list(F.when(~head & (F.coalesce("text", F.lit("")) != ""), F.struct("ordinal", "text", "page", "confidence"))))
    named = F.max(F.when(head, F.struct(F.coalesce(F.nullif(T.strip("text"), F.lit("")), F.lit("Untitled Section")).alias("t"))))["t"]
    grouped = numbered.groupBy(key, "cut").agg(named.alias("title"), held.alias("held")).where(F.size("held") > 0).withColumn("title", F.coalesce("title", F.lit("Document")))
    squeezed = grouped.withColumn("parts", F.transform("held", lambda x: F.regexp_replace(x["text"], r"[ \t]+", " ")))
    ends = squeezed.withColumn("ends", F.transform("parts", lambda _, i: F.aggregate(F.slice("parts", 1, i + 1), F.lit(-1), lambda a, t: a + F.length(t) + 1)))
    spans = F.filter(F.zip_with(F.zip_with("held", "parts", lambda h, p: F.struct(h["page"].alias("page"), F.length(p).alias("n"))), "ends", lambda x, e: F.struct((e - x["n"]).alias("s"), e.alias("e"), x["page"].alias("page"))), lambda x: x["page"].isNotNull())
    sure = F.filter(F.transform("held", lambda x: x["confidence"]), lambda c: c.isNotNull())
    mean = F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda a, c: a + c) / F.size(sure)).otherwise(1.0)
    page = lambda f: F.coalesce(f(F.transform("page_spans", lambda x: x["page"])), F.lit(1))
    done = ends.withColumn("page_spans", spans).select(key, "cut", "title", F.when(F.col("title") == "Document", "document").otherwise(section_type("title")).alias("section_type"), T.strip(F.array_join("parts", "\n")).alias("text"), page(F.array_min).alias("page_start"), page(F.array_max).alias("page_end"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)), 4).alias("confidence"), "page_spans", F.size("held").alias("items")).where("text <> ''")
    order = Window.partitionBy(key).orderBy(F.col("title") != "Document", "cut")
    return done.withColumn("section_pos", F.row_number().over(order) - 1).drop("cut")


def greedy_leaves(words: list[int], target: int, overlap: int) -> list[tuple[int, int]]:
    """First and last sentence of each leaf: it closes when the estimate of its sentences and the next passes the target."""
    done, first, total = [], 0, 0
    for i, n in enumerate(words):
        if i > first and math.ceil((total + n) * 1.25) > target:
            done.append((first, i - 1))
            first = max(0, i - overlap)
            total = sum(words[first:i])
        total += n
    return [*done, (first, len(words) - 1)] if words else done


def _folded(target: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"first": a, "last": b} for a, b in greedy_leaves(w, target, overlap)] for w in batch.column("words").to_pylist()]
            yield batch.append_column("spans", pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))))

    return run


def folded_spans(rows: DataFrame, keys: list[str], text: str = "text", target: int = LEAF_TOKENS, overlap: int = OVERLAP_SENTENCES) -> DataFrame:
    """Adds the normalized text ``value``, the ``sizes`` of its sentences and the ``spans`` of sentences that are leaves; only the fold over word counts runs in Python."""
    value = rows.select(*keys, T.normalize_ws(text).alias("value"))
    counted = value.withColumn("parts", T.sentences_of("value")).select(*keys, "value", F.transform("parts", lambda s: F.regexp_count(s, F.lit(T.WORD))).alias("words"), F.transform("parts", F.length).alias("sizes"))
    schema = S.StructType([*counted.schema.fields, S.StructField("spans", S.ArrayType(S.StructType([S.StructField("first", S.IntegerType()), S.StructField("last", S.IntegerType())])))])
    return counted.mapInArrow(_folded(target, overlap), schema).drop("words")


def leaf_spans(rows: DataFrame, keys: list[str], text: str = "text", target: int = LEAF_TOKENS, overlap: int = OVERLAP_SENTENCES) -> DataFrame:
    """Greedy leaves of about ``target`` estimated tokens: ``keys, position, leaf, char_start, char_end, tokens``.

    Sentences join a leaf until the next would pass the target; the last ``overlap`` go on into the next leaf.
    Offsets are into the normalized text.
    """
    at = folded_spans(rows, keys, text, target, overlap).select(*keys, "value", "sizes", F.posexplode("spans").alias("position", "span"))
    before = lambda n: F.aggregate(F.slice(F.col("sizes"), 1, n), F.lit(0), lambda a, x: a + x + 1)
    spans = at.select(*keys, "value", "position", before(F.col("span.first")).alias("char_start"), (before(F.col("span.last") + 1) - 1).alias("char_end"))
    return spans.select(*keys, "position", F.substring("value", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")).alias("leaf"), "char_start", "char_end").withColumn("tokens", T.token_estimate("leaf"))


def parent_groups(leaves: DataFrame, keys: list[str], size: int = GROUP, overlap: int = GROUP_OVERLAP) -> DataFrame:
    """Sliding groups of leaves: one row per group and leaf, ``group_pos``; the last group is the first that reaches the end."""
    size = max(2, size)
    stride = size - min(overlap, size - 1)
    n = F.count("*").over(Window.partitionBy(*keys))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / stride)).cast("int")
    low = F.greatest(F.lit(0), F.ceil((F.col("position") - size + 1) / stride)).cast("int")
    high = F.least(last, F.floor(F.col("position") / stride).cast("int"))
    return leaves.withColumn("n", n).withColumn("group_pos", F.explode(F.sequence(low, high))).drop("n")


def parents(leaves: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(parents, leaf -> parent)``: a leaf's parent is the last group with it; a parent's text joins its leaves, offsets are their extremes."""
    members = parent_groups(leaves, keys)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "leaf"))), lambda x: x["leaf"]), " ")
    grouped = members.groupBy(*keys, "group_pos").agg(T.normalize_ws(text).alias("text"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.count("*").alias("children"))
    return grouped.withColumn("tokens", T.token_estimate("text")), members.groupBy(*keys, "position").agg(F.max("group_pos").alias("parent_pos"))


def canonical_offsets(secs: DataFrame, key: str = "doc_id", pos: str = "section_pos") -> DataFrame:
    """Where each section begins in the canonical text (sections joined by two line feeds)."""
    w = Window.partitionBy(key).orderBy(pos)
    return secs.withColumn("canonical_start", F.sum(F.length("text") + 2).over(w) - F.length("text") - 2)


def by_buckets(rows: DataFrame, start: str, end: str, width: int, name: str) -> DataFrame:
    """A row for each stretch of ``width`` that the interval touches, numbered in ``name``; a row without a place stays one, without a number."""
    return rows.withColumn(name, F.explode_outer(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(start, end) / width))))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], how: str = "inner", width: int = WIDTH) -> DataFrame:
    """Half-open interval join inside equal keys.

    Rows meet by key and stretch of ``width`` only, so that a key with many intervals is spread and gives no pairs of intervals far
    apart; a pair that shares more stretches is kept in the first. An interval takes as many rows as the stretches that it touches. With ``how="left"`` a
    row of ``left`` comes without a partner for each of its stretches that has none: aggregate over it.
    """
    one, other = by_buckets(left, *a, width, "__here").alias("__a"), by_buckets(right, *b, width, "__there").alias("__b")
    col = lambda side, c: F.col(f"{side}.`{c}`")
    a0, a1, b0, b1 = col("__a", a[0]), col("__a", a[1]), col("__b", b[0]), col("__b", b[1])
    on = [col("__a", k) == col("__b", k) for k in keys] + [F.col("__here") == F.col("__there"), F.col("__here") == F.greatest(F.floor(a0 / width), F.floor(b0 / width)), a0 < b1, a1 > b0]
    return one.join(other, on, how).select(*[col("__a", c) for c in left.columns], *[col("__b", c) for c in right.columns if c not in keys])


def attach_pages(spans: DataFrame, pages: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """Smallest and largest page over a span; without any overlap the page that begins last before it.

    ``spans``: keys, char_start, char_end; ``pages``: keys, page, page_start, page_end. Overlaps meet by stretches of text; the page
    before comes from one pass over the places of a key, pages first.
    """
    met = overlapping(spans, pages, keys, ("char_start", "char_end"), ("page_start", "page_end"), "left", width)
    over = met.groupBy(*keys, "char_start", "char_end").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
    none = F.lit(None)
    places = over.select(*keys, "char_start", "char_end", "lo", "hi", F.lit(1).alias("kind"), none.cast(pages.schema["page"].dataType).alias("page"))
    starts = pages.select(*keys, F.col("page_start").cast(spans.schema["char_start"].dataType).alias("char_start"), none.cast(spans.schema["char_end"].dataType).alias("char_end"), none.cast(pages.schema["page"].dataType).alias("lo"), none.cast(pages.schema["page"].dataType).alias("hi"), F.lit(0).alias("kind"), "page")
    so_far = Window.partitionBy(*keys).orderBy("char_start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = places.unionByName(starts).withColumn("before", F.last("page", ignorenulls=True).over(so_far)).where("kind = 1")
    return found.select(*keys, "char_start", "char_end", F.coalesce("lo", "before").alias("first_page"), F.coalesce("hi", "before").alias("last_page"))


def page_partition(starts: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """Gap-free blocks of pages by their first positions; the first begins at 0, empty ones go."""
    w = Window.partitionBy(key).orderBy("start", "page")
    first = starts.groupBy(key, "page").agg(F.min("start").alias("start")).join(lengths, key)
    blocks = first.select(key, "page", F.when(F.row_number().over(w) == 1, 0).otherwise(F.col("start")).alias("char_start"), F.coalesce(F.lead("start").over(w), F.col("length")).alias("char_end"))
    return blocks.where("char_end > char_start")
