"""The passage tree as tables: nodes and edges of documents, sections, parents and leaves, its walks and its checks.

A node carries the ids of its section and document, so a walk up is a column and a walk down one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..sources.files import Kept
from .hierarchy import GROUP, GROUP_OVERLAP, LEAF_TOKENS, OVERLAP_SENTENCES, folded_spans

LEVELS = ["child", "parent", "section", "document"]
NODE = (
    "struct<node_id: string, level: string, section_id: string, parent_id: string, position: int, text: string, embedding_text: string, token_count: int, char_start: int, char_end: int, "
    "page_start: int, page_end: int, confidence: double, paragraph_ids: array<string>, child_ids: array<string>>"
)
#: Characters of a leaf that name it.
NAMED_BY = 96


def rank_of(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level) - 1


def _optional(df: DataFrame, name: str, kind: str, otherwise: Column) -> Column:
    return F.coalesce(F.col(name).cast(kind), otherwise.cast(kind)) if name in df.columns else otherwise.cast(kind)


def _pages(spans: Column, start: Column, end: Column, section: Column) -> tuple[Column, Column]:
    """The pages under a range; else the page that begins last before it, else the section's."""
    over = F.filter(spans, lambda p: (p["s"] < end) & (p["e"] > start))
    before = F.filter(spans, lambda p: p["s"] <= start)
    last = F.try_element_at(before, F.lit(-1))["page"]
    page = lambda f, own: F.coalesce(f(F.transform(over, lambda p: p["page"])), last, own)
    return page(F.array_min, section["page_start"]), page(F.array_max, section["page_end"])


def build_hierarchy(sections: DataFrame, target: int = LEAF_TOKENS, overlap: int = OVERLAP_SENTENCES, size: int = GROUP, group_overlap: int = GROUP_OVERLAP) -> DataFrame:
    """All nodes of the sections' documents, each with its ``child_ids``; offsets of leaves and parents are within their section's normalized text.

    ``sections``: document_id, source, section_pos, title, text and, if there, section_type, page_start, page_end,
    page_spans array<struct<s, e, page>>, paragraphs array<struct<paragraph_id, text, char_start, char_end>>, confidence.
    A section's leaves and parents are made in its own row; only documents gather rows.
    """
    none = "array<string>"
    rows = sections.select(
        F.col("document_id").cast("string").alias("document_id"), "source", F.col("section_pos").cast("int").alias("section_pos"), "title", "text", _optional(sections, "section_type", "string", F.lit("document")).alias("section_type"),
        _optional(sections, "page_start", "int", F.lit(1)).alias("page_start"), _optional(sections, "page_end", "int", F.lit(1)).alias("page_end"), _optional(sections, "confidence", "double", F.lit(1.0)).alias("confidence"),
        F.array_sort(_optional(sections, "page_spans", "array<struct<s: int, e: int, page: int>>", F.array())).alias("page_spans"), _optional(sections, "paragraphs", "array<struct<paragraph_id: string, text: string, char_start: int, char_end: int>>", F.array()).alias("paragraphs"),
    )
    spans = folded_spans(rows, rows.columns, "text", target, overlap).drop("text")
    section_id = T.stable_id(F.col("document_id"), F.lit("section"), F.col("section_pos"), F.col("title"))
    spans = spans.withColumn("section_id", section_id).withColumn("head", F.concat(F.lit("Document: "), "source", F.lit("\nSection: "), "title", F.lit("\n")))
    before = lambda n: F.aggregate(F.slice("sizes", 1, n), F.lit(0), lambda a, x: a + x + 1)
    placed = spans.withColumn("placed", F.transform("spans", lambda s: F.struct(before(s["first"]).alias("a"), (before(s["last"] + 1) - 1).alias("b"))))
    texts = placed.withColumn("leaves", F.transform("placed", lambda s, i: F.struct(i.alias("i"), s["a"].alias("a"), s["b"].alias("b"), F.substring("value", s["a"] + 1, s["b"] - s["a"]).alias("text"))))
    own = {"page_start": F.col("page_start"), "page_end": F.col("page_end")}
    stride = max(2, size) - min(group_overlap, max(2, size) - 1)
    count = F.size("leaves")
    last = F.greatest(F.lit(0), F.ceil((count - max(2, size)) / stride)).cast("int")
    parent_id = lambda g: T.stable_id(F.col("section_id"), F.lit("parent"), g)

    def leaf(x: Column) -> Column:
        first, final = _pages(F.col("page_spans"), x["a"], x["b"], own)
        held = F.transform(F.filter("paragraphs", lambda p: (p["char_start"] < x["b"]) & (p["char_end"] > x["a"])), lambda p: p["paragraph_id"])
        return F.struct(
            T.stable_id(F.col("section_id"), F.lit("child"), x["i"], F.substring(x["text"], 1, NAMED_BY)).alias("node_id"), F.lit("child").alias("level"), F.col("section_id"), parent_id(F.least(last, F.floor(x["i"] / stride).cast("int"))).alias("parent_id"), x["i"].alias("position"), x["text"].alias("text"),
            F.concat("head", x["text"]).alias("embedding_text"), T.token_estimate(x["text"]).alias("token_count"), x["a"].alias("char_start"), x["b"].alias("char_end"), first.alias("page_start"), final.alias("page_end"), F.col("confidence"), held.alias("paragraph_ids"), F.array().cast(none).alias("child_ids"),
        ).cast(NODE)

    made = texts.withColumn("children", F.transform("leaves", leaf))

    def window(g: Column) -> Column:
        members = F.slice("children", g * stride + 1, max(2, size))
        return F.struct(g.alias("g"), members.alias("members"), T.normalize_ws(F.array_join(F.transform(members, lambda c: c["text"]), " ")).alias("text"))

    def parent(w: Column) -> Column:
        g, members, text = w["g"], w["members"], w["text"]
        of = lambda f, c: f(F.transform(members, lambda m: m[c]))
        return F.struct(
            parent_id(g).alias("node_id"), F.lit("parent").alias("level"), F.col("section_id"), F.col("section_id").alias("parent_id"), g.alias("position"), text.alias("text"), F.concat(F.lit("Section: "), "title", F.lit("\n"), text).alias("embedding_text"), T.token_estimate(text).alias("token_count"), of(F.array_min, "char_start").alias("char_start"),
            of(F.array_max, "char_end").alias("char_end"), of(F.array_min, "page_start").alias("page_start"), of(F.array_max, "page_end").alias("page_end"), F.col("confidence"), F.array().cast(none).alias("paragraph_ids"), F.transform(members, lambda c: c["node_id"]).alias("child_ids"),
        ).cast(NODE)

    grouped = made.withColumn("parents", F.when(F.size("children") > 0, F.transform(F.transform(F.sequence(F.lit(0), last), window), parent)).otherwise(F.array().cast(f"array<{NODE}>")))
    section = F.struct(
        F.col("section_id").alias("node_id"), F.lit("section").alias("level"), F.col("section_id"), F.col("document_id").alias("parent_id"), F.col("section_pos").alias("position"), F.col("value").alias("text"), F.concat("head", "value").alias("embedding_text"), T.token_estimate("value").alias("token_count"), F.lit(0).alias("char_start"),
        F.length("value").alias("char_end"), F.col("page_start"), F.col("page_end"), F.col("confidence"), F.array().cast(none).alias("paragraph_ids"), F.transform("parents", lambda p: p["node_id"]).alias("child_ids"),
    ).cast(NODE)
    below = grouped.select("document_id", "source", F.explode(F.concat(F.array(section), "parents", "children")).alias("n")).select("document_id", "source", "n.*")
    pages = lambda f, c, own: F.coalesce(f(F.transform("children", lambda x: x[c])), F.col(own))
    in_order = F.array_sort(F.collect_list(F.struct("section_pos", "section_id", F.col("value").alias("text"))))
    docs = grouped.groupBy("document_id", "source").agg(in_order.alias("s"), F.min(pages(F.array_min, "page_start", "page_start")).alias("page_start"), F.max(pages(F.array_max, "page_end", "page_end")).alias("page_end"))
    whole = docs.withColumn("text", T.normalize_ws(F.array_join(F.transform("s", lambda x: x["text"]), "\n\n")))
    top = whole.select(
        "document_id", "source", F.col("document_id").alias("node_id"), F.lit("document").alias("level"), F.lit(None).cast("string").alias("section_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("position"), "text", F.concat(F.lit("Document: "), "source", F.lit("\n"), "text").alias("embedding_text"), T.token_estimate("text").alias("token_count"),
        F.lit(0).alias("char_start"), F.length("text").alias("char_end"), "page_start", "page_end", F.lit(1.0).alias("confidence"), F.array().cast(none).alias("paragraph_ids"), F.transform("s", lambda x: x["section_id"]).alias("child_ids"),
    )
    return below.unionByName(top)


def edges(nodes: DataFrame) -> DataFrame:
    """``parent_id, child_id, ordinal``: a leaf in two parents' windows has an edge from each."""
    return nodes.select(F.col("node_id").alias("parent_id"), F.posexplode("child_ids").alias("ordinal", "child_id"))


def write_tree(nodes: DataFrame, path: str, revision: str) -> str:
    """An immutable revision of a tree under ``path``: nodes with hashes of their texts and edges, in a partition of their own; an existing one is an error."""
    held = Kept()
    made = held.keep(nodes.drop("embedding_text"), "tree")  # made once for nodes and edges
    made.drop("child_ids").withColumn("text_sha256", F.sha2("text", 256)).write.mode("errorifexists").parquet(f"{path}/nodes/parse_revision_id={revision}")
    edges(made).write.mode("errorifexists").parquet(f"{path}/edges/parse_revision_id={revision}")
    held.drop_all_but()
    return path


def ancestor_at_level(level: str) -> Column:
    """The node's ancestor at a level, itself included; null above the document or below the node."""
    at = LEVELS.index(level)
    own = rank_of(F.col("level"))
    known = {"child": F.col("node_id"), "parent": F.when(F.col("level") == "child", F.col("parent_id")), "section": F.col("section_id"), "document": F.col("document_id")}[level]
    return F.when(own == at, F.col("node_id")).when(own < at, known)


def members_at_level(nodes: DataFrame, candidate_level: str, member_level: str) -> DataFrame:
    """``candidate_id, member_id`` of all nodes of one level and those of a lower one under them."""
    if LEVELS.index(candidate_level) == LEVELS.index(member_level) + 1:  # windows overlap: an edge each
        return edges(nodes.where(F.col("level") == candidate_level)).select(F.col("parent_id").alias("candidate_id"), F.col("child_id").alias("member_id"))
    return nodes.where(F.col("level") == member_level).select(ancestor_at_level(candidate_level).alias("candidate_id"), F.col("node_id").alias("member_id")).where("candidate_id is not null")


def descendants(nodes: DataFrame) -> DataFrame:
    """``ancestor_id, node_id, hops``: every pair by parent links."""
    own = rank_of(F.col("level"))
    pairs = F.array(*[F.struct(ancestor_at_level(name).alias("ancestor_id"), (F.lit(i) - own).cast("int").alias("hops")) for i, name in enumerate(LEVELS)])
    return nodes.select("node_id", F.explode(pairs).alias("p")).where("p.hops > 0 and p.ancestor_id is not null").select("p.ancestor_id", "node_id", "p.hops")


def group_by_ancestor(selected: DataFrame, nodes: DataFrame, level: str) -> DataFrame:
    """``query_id, ancestor_id, node_id, score``: a selection by its ancestors at a level."""
    found = selected.join(nodes.select("node_id", "level", "parent_id", "section_id", "document_id"), "node_id")
    return found.select("query_id", ancestor_at_level(level).alias("ancestor_id"), "node_id", "score").where("ancestor_id is not null")


def effective_members(selected: DataFrame, nodes: DataFrame, level: str) -> DataFrame:
    """``query_id, candidate_id, node_id, score, place``: what is selected one level below each candidate, then what stands in for slots from further below.

    ``selected``: query_id, node_id, score.
    """
    member = LEVELS[LEVELS.index(level) - 1]
    slots = nodes.where(F.col("level") == level).select(F.col("node_id").alias("candidate_id"), F.posexplode("child_ids").alias("slot", "node_id"))
    direct = selected.join(slots, "node_id").select("query_id", "candidate_id", "node_id", "score", "slot")
    lower = nodes.where(rank_of(F.col("level")) < LEVELS.index(member)).select("node_id", ancestor_at_level(level).alias("candidate_id"))
    stand_ins = selected.join(lower, "node_id").select("query_id", "candidate_id", "node_id", "score", F.lit(None).cast("int").alias("slot"))
    both = direct.unionByName(stand_ins)
    place = F.row_number().over(Window.partitionBy("query_id", "candidate_id").orderBy(F.col("slot").asc_nulls_last(), F.col("score").desc(), "node_id"))
    return both.select("query_id", "candidate_id", "node_id", "score", place.alias("place"))


def validate_hierarchy(nodes: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``node_id, violation``: leaves without their section, pages out of the section's, characters out of the parent's, parents' pages that miss a leaf's, missing leaves."""
    links = edges(nodes) if links is None else links
    leaf, slim = nodes.where("level = 'child'"), ["char_start", "char_end", "page_start", "page_end"]
    named = lambda level, n: nodes.where(F.col("level") == level).select(F.col("node_id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in slim])
    of_section = leaf.join(named("section", "s"), F.col("section_id") == F.col("s"), "left")
    out = lambda a, b, n: (F.col(a) < F.col(f"{n}_{a}")) | (F.col(b) > F.col(f"{n}_{b}"))
    one = of_section.select("node_id", F.when(F.col("s").isNull(), "unknown section").when(out("page_start", "page_end", "s"), "pages out of the section").alias("violation"))
    two = leaf.join(named("parent", "p"), F.col("parent_id") == F.col("p")).where(out("char_start", "char_end", "p")).select("node_id", F.lit("characters out of the parent").alias("violation"))
    held = links.join(named("parent", "p"), F.col("parent_id") == F.col("p")).join(named("child", "c"), F.col("child_id") == F.col("c"), "left")
    three = held.select(F.col("p").alias("node_id"), F.when(F.col("c").isNull(), "missing leaf").when((F.col("c_page_start") < F.col("p_page_start")) | (F.col("c_page_end") > F.col("p_page_end")), "pages miss a leaf's").alias("violation"))
    return one.unionByName(two).unionByName(three).where("violation is not null")
