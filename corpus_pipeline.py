"""A corpus from documents to packed sequences: five of the operators, one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmark.llm import decontamination, near_copies, packing, quality, substrings
from leafmark.llm.common import release, stored, written
from leafmark.llm.tokens import vocabulary

#: SQL has no classifier, fingerprints or tokenizer; the tests hold each stage against plain code.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts.

    Null, empty and very long texts are scored like any other, repeated rows share their fate, other columns come along
    whatever their names. Without labels every document is accepted; an empty table stays empty.
    """
    return quality.keep_accepted(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those whose five-word shingles have a Jaccard similarity of 0.8 or more to one with a smaller id that stays.

    Null and blank texts are equal to each other. Of equal texts the smallest id stays (null ids come last), of rows
    with one id and text one. Other columns come along whatever their names; an empty table stays empty.
    """
    return near_copies.drop_near_copies(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes or more that one with a smaller id has too.

    Every row stays, a text that goes whole as an empty one; a null text becomes empty; a character that a cut goes through
    stays. Rows with one id take nothing from each other, a null id counts as the largest. n_chars is brought up to date,
    other columns come along whatever their names; an empty table stays empty.
    """
    return substrings.drop_repeats(docs, length=50)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that aligns with a benchmark item.

    Null and empty texts stay, repeated rows share their fate, an empty benchmark drops nothing. Other columns come along
    whatever their names; an empty table stays empty.
    """
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens.

    A null or empty text is one piece of the end token. Repeated rows and null ids are placed each by itself; other columns
    are left behind; an empty table gives no pieces.
    """
    return packing.pack(packing.token_pieces(docs, vocabulary("word_bpe_49k.json"), capacity=2048, end_id=0), capacity=2048)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what earlier stages wrote is removed once the next one stands."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = set(written())
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        release(spark, [path for path in written()[:-1] if path not in others])
    return STAGES[-1][1](spark, docs, sf_dir)
