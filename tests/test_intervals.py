"""Interval joins by stretches against all pairs, and how many pairs they look at."""

import random

from leafmark.operators import hierarchy as H


def test_overlaps_of_any_length(spark):
    r = random.Random(4)
    some = lambda n, most: [(r.randrange(3), i, s := r.randrange(0, 30_000), s + r.randrange(0, most)) for i in range(n)]
    a, b = some(400, 9_000), some(300, 40_000) + [(None, 900, 0, 10), (1, 901, None, 5), (1, 902, 3, None)]
    left = spark.createDataFrame(a, "k int, i int, s long, e long")
    right = spark.createDataFrame(b, "k int, j int, from long, to long")
    got = H.overlapping(left, right, ["k"], ("s", "e"), ("from", "to"), width=1000).select("i", "j").collect()
    want = [(i, j) for k, i, s, e in a for m, j, f, t in b if k == m and f is not None and t is not None and s < t and e > f]
    assert sorted(map(tuple, got)) == sorted(want)
    lonely = H.overlapping(left, right.limit(0), ["k"], ("s", "e"), ("from", "to"), "left").select("i", "j").distinct().collect()
    assert sorted(map(tuple, lonely)) == [(i, None) for i in range(400)]
    itself = H.overlapping(left, left.withColumnsRenamed({"i": "j", "s": "from", "e": "to"}), ["k"], ("s", "e"), ("from", "to")).count()
    assert itself == sum(k == m and s < t and e > f for k, _, s, e in a for m, _, f, t in a)


def test_pages_of_a_long_document(spark):
    spans = spark.range(100_000).selectExpr("1 as doc", "id * 300 as char_start", "id * 300 + 280 as char_end")
    pages = spark.range(20_000).where("id % 5 <> 3").selectExpr("1 as doc", "cast(id as int) as page", "id * 1500 as page_start", "id * 1500 + 1500 as page_end")
    got = {r["char_start"]: (r["first_page"], r["last_page"]) for r in H.attach_pages(spans, pages, ["doc"]).collect()}
    assert len(got) == 100_000
    for start, found in got.items():
        held = [p for p in range(start // 1500, (start + 279) // 1500 + 1) if p % 5 != 3]
        assert found == ((held[0], held[-1]) if held else (start // 1500 - 1, start // 1500 - 1))
