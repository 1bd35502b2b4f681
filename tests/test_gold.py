"""Gold leaves by quotes against every pair of quote and leaf."""

import random
from collections import Counter

from leafmark.operators import evidence as E


def test_every_match_is_met(spark):
    r = random.Random(9)
    words = ["the", "of", "and"] * 6 + [f"w{i}" for i in range(60)]
    leaves = [(f"n{i}", f"s{i % 4}", " ".join(r.choices(words, k=r.randrange(1, 14)))) for i in range(300)]
    quotes = []
    for i in range(60):
        text = r.choice(leaves)[2].split()
        cut = text[r.randrange(len(text)):][: r.randrange(1, 9)] or ["the"]
        quote = " ".join(cut)[r.randrange(2):] if r.random() < 0.3 else " ".join(w if r.random() < 0.8 else r.choice(words) for w in cut)
        quotes.append((f"q{i}", [] if i % 3 == 0 else [f"s{i % 4}", f"s{(i + 1) % 4}"], quote))
    records = spark.createDataFrame([(q, s, [], [], [t]) for q, s, t in quotes], "query_id string, sources array<string>, gold_child_ids array<string>, gold_paragraph_ids array<string>, gold_quotes array<string>")
    frame = spark.createDataFrame([(n, s, t, []) for n, s, t in leaves], "node_id string, source string, text string, paragraph_ids array<string>")
    want = set()
    for q, scope, quote in quotes:
        a = quote.split()
        for n, s, t in leaves:
            b = t.split()
            shared = sum((Counter(a) & Counter(b)).values())
            inside = quote.strip() in t if scope else quote.strip() in t and shared
            if quote.strip() and (not scope or s in scope) and (inside or round(2 * shared / (len(a) + len(b)), 9) >= 0.5):
                want.add((q, n))
    for hot in (0, 3, 1000):
        E.HOT = hot
        assert {tuple(x) for x in E.label_gold(records, frame)[0].collect()} == want
    E.HOT = 3
    low = records.selectExpr("query_id", "sources", "0 as no", "gold_quotes[0] as quote", "gold_quotes[0] as q", "split(trim(gold_quotes[0]), ' ') as a")
    met = E._pairs(low, frame.selectExpr("node_id", "source", "text as t", "split(text, ' ') as b"), 0.5).count()
    E.HOT = 1000
    assert met < 0.5 * sum(len([1 for _, s, _ in leaves if not scope or s in scope]) for _, scope, _ in quotes)


def test_pairs_meet_texts_by_numbers(spark):
    """What is shuffled to meet a leaf's text is a pair's numbers, not the quote and its words again for each pair."""
    records = spark.createDataFrame([("q", ["s"], [], [], ["one two three four"])], "query_id string, sources array<string>, gold_child_ids array<string>, gold_paragraph_ids array<string>, gold_quotes array<string>")
    leaves = spark.createDataFrame([("n", "s", "one two three five", [])], "node_id string, source string, text string, paragraph_ids array<string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        gold = E.label_gold(records, leaves)[0]
        assert [tuple(r) for r in gold.collect()] == [("q", "n")]
        plan = spark._jvm.PythonSQLUtils.explainString(gold._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [part.split("Input")[1].split("\n")[0] for part in plan.split("\n\n") if ") Exchange" in part and "hashpartitioning(node_id" in part]
    assert moved and not any(c in m for m in moved for c in (" a#", " b#", " q#", "quote#"))
