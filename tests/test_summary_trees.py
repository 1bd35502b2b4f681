"""Trees of summaries keep their rules; searches against plain loops."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from leafmark.operators import summary_trees as S


def test_groups_part_what_lies_apart_and_keep_the_limit():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.05, (12, 6)) for c in (0, 3, 6)])
    groups = S.soft_groups(x, np.full(36, 10))
    assert all(len({i // 12 for i in g}) == 1 for g in groups) and set(np.concatenate(groups)) == set(range(36))
    small = S.soft_groups(np.zeros((40, 6)), np.full(40, 100), limit=350)  # nothing to part them by
    assert all(len(g) <= 3 for g in small) and set(np.concatenate(small)) == set(range(40))
    assert [g.tolist() for g in S.soft_groups(x[:1], np.array([9999]))] == [[0]]


def test_a_vector_takes_its_tokens_once(spark):
    """256 numbers of a text cost about what one does: its words are found once, not once a number."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["River", "water", "the", "bank", "gene7", "is"], k=1500)) for _ in range(60)]
    df = spark.createDataFrame([(x,) for x in texts], "text string").repartition(1).cache()
    df.count()

    def seconds(dims):
        began = time.perf_counter()
        df.select(S.hashed_vector("text", dims)).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(1)
    assert min(seconds(256) for _ in range(2)) < 6 * min(seconds(1) for _ in range(2))
    tokens = ["river", "water", "bank", "gene7"]
    at = {w: r["at"] for w in tokens for r in spark.sql(f"select pmod(xxhash64('{w}'), 64) as at").collect()}
    for text, row in zip(texts, df.select(S.hashed_vector("text").alias("v")).collect()):
        want = [0.0] * 64
        for w in text.lower().split():
            if w in at:
                want[at[w]] += 1
        assert row["v"] == want
    df.unpersist()


def test_few_bytes_are_spread_over_tasks(spark):
    """Vectors of a layer are few bytes and much work: papers are not put into one task for their size."""
    df = spark.createDataFrame([(p, i) for p in range(40) for i in range(14)], "paper_id long, n int")
    spread = S.spread_by(df, "paper_id").groupBy("paper_id").count()
    assert spread.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_trees_keep_their_rules(spark):
    topics = [["river", "water", "bank"], ["market", "price", "trade"], ["cell", "gene", "protein"]]
    rng = random.Random(5)
    rows = [(p, f"{p}:{i:03d}", " ".join(rng.choices(topics[i % 3], k=8)).capitalize() + ".") for p, n in ((1, 60), (2, 11), (3, 30)) for i in range(n)]
    rows += [(3, "3:empty", None), (3, "3:blank", "")]
    df = spark.createDataFrame(rows, "paper_id long, node_id string, text string")
    tree = S.soft_summary_trees(df, limit=100).collect()
    nodes = {r["node_id"]: r for r in tree}
    assert len(nodes) == len(tree) and max(r["layer"] for r in tree) <= S.LAYERS
    assert {r["paper_id"] for r in tree if r["layer"] > 0} == {1, 3}  # eleven leaves get no layer
    for r in tree:
        below = [nodes[c] for c in r["children"]]
        assert all(b["layer"] == r["layer"] - 1 and b["paper_id"] == r["paper_id"] for b in below)
        assert (r["layer"] == 0) == (not below)
        if below:
            assert set(r["members"]) == {m for b in below for m in b["members"]}
            assert len(below) == 1 or sum(b["tokens"] for b in below) <= 100
    for paper in (1, 3):
        layers = sorted({r["layer"] for r in tree if r["paper_id"] == paper})
        for low, high in zip(layers, layers[1:]):
            assert {c for r in tree if r["paper_id"] == paper and r["layer"] == high for c in r["children"]} == {r["node_id"] for r in tree if r["paper_id"] == paper and r["layer"] == low}
    again = S.soft_summary_trees(df.repartition(3), limit=100).collect()
    assert sorted((r["node_id"], r["text"]) for r in again) == sorted((r["node_id"], r["text"]) for r in tree)
    assert S.soft_summary_trees(df.where("false")).count() == 0


def test_searches_against_plain_loops(spark):
    rng = random.Random(8)
    leaves = [f"l{i:03d}" for i in range(300)]
    members = {f"n{i:02d}": sorted(rng.sample(leaves, rng.randint(1, 30))) for i in range(60)}
    tokens = {n: rng.randint(1, 200) for n in members}
    nodes = spark.createDataFrame([(n, tokens[n], m) for n, m in members.items()], "node_id string, tokens int, members array<string>")
    rows = [(q, n, rng.randint(1, 40) / 8) for q in range(6) for n in members]
    scores = spark.createDataFrame(rows, "query_id int, node_id string, score double")
    hits = spark.createDataFrame([(q, x, r + 1) for q in range(6) for r, x in enumerate(rng.sample(leaves, 150))], "query_id int, leaf_id string, rank int")
    flat = {(r["query_id"], r["rank"]): (r["leaf_id"], r["score"]) for r in S.collapsed_search(scores, nodes, 25, budget=400).collect()}
    fused = {(r["query_id"], r["rank"]): r["leaf_id"] for r in S.summary_search(hits, scores.withColumnRenamed("node_id", "summary_id"), nodes.withColumnRenamed("node_id", "summary_id"), 25).collect()}
    want_flat, want_fused = {}, {}
    for q in range(6):
        ranked = sorted((-s, n) for q2, n, s in rows if q2 == q)
        used, taken = 0, []
        for minus, n in ranked[:40]:
            if len(taken) < 10 and (not taken or used + tokens[n] <= 400):
                taken.append((n, -minus))
                used += tokens[n]
        seen = {}
        for n, s in taken:
            for m in members[n]:
                seen.setdefault(m, s)
        want_flat |= {(q, i + 1): x for i, x in enumerate(list(seen.items())[:25])}
        through = []
        for _, n in ranked:
            if len(through) >= 100:
                break
            through += [m for m in members[n] if m not in through]
        a = {r["leaf_id"]: r["rank"] for r in hits.where(F.col("query_id") == q).collect() if r["rank"] <= 100}
        b = {m: i + 1 for i, m in enumerate(through)}
        score = lambda x: round((1 / (60 + a[x]) if x in a else 0) + (1 / (60 + b[x]) if x in b else 0), 12)
        order = sorted({*a, *b}, key=lambda x: (-score(x), a.get(x, 10**9), b.get(x, 10**9)))[:25]
        want_fused |= {(q, i + 1): x for i, x in enumerate(order)}
    assert flat == want_flat and fused == want_fused
