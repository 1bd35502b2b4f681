"""Benchmark items against heavily edited copies of them, held against Smith-Waterman of all pairs."""

import random

import pytest

from leafmark.llm import decontamination

from . import brute


def edited_copies(words: list[str], rng: random.Random) -> list[list[str]]:
    other = lambda: f"other{rng.randrange(50)}"
    copies = []
    for n in (1, 2, 3, 4, 5):
        for first in range(n):
            copies.append([other() if i % n == first else w for i, w in enumerate(words)])
            copies.append([w for i, w in enumerate(words) if i % n != first])
            copies.append([x for i, w in enumerate(words) for x in ([w, other()] if i % n == first else [w])])
    for share in (0.1, 0.2, 0.3, 0.4):
        copies.append([x for w in words for x in rng.choice([[other()], [], [w, other()]] if rng.random() < share else [[w]])])
    return [*copies, words]


@pytest.mark.parametrize("seed", [1, 2])
def test_edited_copies_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    plain = ["the", "of", "and", "to", "in"]
    word = lambda: rng.choice(plain) if rng.random() < 0.4 else f"w{rng.randrange(300)}"
    items = {k: [word() for _ in range(n)] for k, n in enumerate((8, 9, 15, 24, 40))}
    texts = []
    for words in items.values():
        for copy in edited_copies(words, rng):
            texts.append([*(word() for _ in range(rng.randrange(60))), *copy, *(word() for _ in range(rng.randrange(60)))])
    docs = dict(enumerate(texts))
    want = {(i, k): s for i, t in docs.items() for k, item in items.items() if (s := brute.smith_waterman(item, t) / (2 * len(item))) >= 0.5}
    found = decontamination.find_leaks(
        spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id long, text string"),
        spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string"),
    ).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found}
    assert set(got) == set(want) and len(want) > 150
    assert got == pytest.approx(want)
    for r in found:
        part = docs[r["doc_id"]][r["first_word"]:r["last_word"] + 1]
        assert brute.smith_waterman(items[r["item_id"]], part) == pytest.approx(r["similarity"] * 2 * len(items[r["item_id"]]))


def test_short_items_and_several_blocks(spark, monkeypatch):
    """Items under eight words match word for word; one block an item finds the same."""
    items = spark.createDataFrame([(1, "seven words are in this short item"), (2, "zebra"), (3, "two words"), (4, ""), (5, None), (6, "日本語の文章"), (7, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "Here: seven words are in this short item."), (2, "seven words are in that short item"), (3, "a Zebra, alone"), (4, "zebras"), (5, "two, words"), (6, "two other words"), (7, "これは日本語の文章ですね"), (8, "日本語と文章です"), (9, "one two three four other six seven eight nine ten"), (10, None), (11, "zebra zebra")],
        "doc_id long, text string",
    )
    want = {(1, 1), (3, 2), (11, 2), (5, 3), (7, 6), (9, 7)}
    found = lambda: {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs, items).collect()}
    assert found() == want
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 2)
    assert found() == want
    assert {r["doc_id"] for r in decontamination.drop_leaks(docs, items).collect()} == {2, 4, 6, 8, 10}


def test_long_items_go_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "CELLS", 5_000)
    long = " ".join(f"w{i % 97} v{i}" for i in range(1500))
    docs = spark.createDataFrame([(i, f"before {long.replace('v7', 'x')} after") for i in range(4)], "doc_id long, text string")
    assert decontamination.find_leaks(docs, spark.createDataFrame([(1, long)], "item_id long, text string")).count() == 4
