"""Paragraphs of a section are placed in one pass over them."""

import time

from pyspark.sql import functions as F

from leafmark.sources import papers


def test_a_section_of_many_paragraphs(spark):
    n = 6000
    path_rows = [(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("  some  words of paragraph "), i.cast("string"))))]
    section = F.struct(F.lit("S").alias("section_name"), path_rows[0].alias("paragraphs"))
    paper = F.struct(F.lit("").alias("abstract"), F.array(section).alias("full_text"))
    rows = spark.range(1).select(paper.alias("paper"))
    began = time.time()
    got = rows.select(papers._sections(F.col("paper"), F.lit("p")).alias("s")).first()["s"]
    assert time.time() - began < 30  # minutes when each paragraph made all of them anew
    assert len(got) == 1 and got[0]["title"] == "S" and len(got[0]["paragraphs"]) == n
    assert all(got[0]["text"][p["char_start"] : p["char_end"]] == p["text"] == f"some words of paragraph {i + 1}" for i, p in enumerate(got[0]["paragraphs"]))
    assert got[0]["paragraphs"][7]["paragraph_id"] == "p:section:0:paragraph:7"
