"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import collocations, decontamination, embeddings, html_text, language_model, licenses, oracle, packing, quality, ranked_search, simhash, substrings, token_counts, token_files
from .common import shared_dir
from .tokens import vocabulary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_segment_tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits a document, by its id: a replacement by its own last characters, a removal, an insertion of its first ones."""
    import public_tokenizers

    trees = token_counts.build_trees(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    place = lambda i: F.pmod(F.xxhash64("doc_id", F.lit(i)), F.length("text") + 1).cast("int")
    edit = lambda pos, remove, insert: F.struct(pos.alias("pos"), F.lit(remove).alias("remove"), insert.alias("insert"))
    edits = F.array(edit(place(1), 12, F.expr("right(text, 20)")), edit(place(2), 30, F.lit("")), edit(place(3), 0, F.substring("text", 1, 40)))
    return token_counts.count_after_edits(trees, edits, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_elias_fano_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = os.path.join(shared_dir(spark), f"tokens-{uuid.uuid4().hex}")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(spark, path)


def op4_smith_waterman_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_layout_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text"))


def op7_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=2048, end_id=0)
    return packing.pack(pieces, capacity=2048)


def op9_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op10_bwt_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), length=50, digest=True)


def op11_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_setm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cotraining_quality": op1_cotraining_quality,
    "op2_segment_tree_counts": op2_segment_tree_counts,
    "op3_elias_fano_token_ids": op3_elias_fano_token_ids,
    "op4_smith_waterman_decontamination": op4_smith_waterman_decontamination,
    "op5_bit_sliced_simhash": op5_bit_sliced_simhash,
    "op6_layout_html": op6_layout_html,
    "op7_deleted_interpolation": op7_deleted_interpolation,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_pivot_permutation": op9_pivot_permutation,
    "op10_bwt_substrings": op10_bwt_substrings,
    "op11_dual_tree_search": op11_dual_tree_search,
    "op12_setm_collocations": op12_setm_collocations,
    "op13_license_scan": op13_license_scan,
}
ORACLE_SQL: dict[str, str] = {"op11_dual_tree_search": oracle.RANKED, "op12_setm_collocations": oracle.COLLOCATIONS, "op13_license_scan": oracle.LICENSES}
