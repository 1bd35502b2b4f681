"""The registered queries over the smallest tables against plain code."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from leafmark.llm.queries import QUERIES

from . import brute


@pytest.fixture(scope="module")
def documents(small):
    return {r["doc_id"]: r["text"] for r in brute.rows(small, "documents")}


def collected(spark, small, name):
    return QUERIES[name](spark, small).collect()


def test_op1_keeps_good_documents(spark, small):
    got = {r["doc_id"]: r for r in collected(spark, small, "op1_cotraining_quality")}
    labels = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in brute.rows(small, "labels")}
    right = Counter(got[i]["accepted"] == good for i, good in labels.items())
    assert right[True] >= 0.8 * len(labels)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_op2_counts_equal_a_full_encoding(spark, small):
    import public_tokenizers

    from leafmark.llm.token_counts import encoding

    enc = encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = {r["doc_id"]: r["text"] for r in brute.rows(small, "documents")}
    from pyspark.sql import functions as F

    place = lambda i: F.pmod(F.xxhash64("doc_id", F.lit(i)), F.length("text") + 1).cast("int")
    places = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", place(1).alias("a"), place(2).alias("b"), place(3).alias("c")).collect()}
    for r in collected(spark, small, "op2_segment_tree_counts"):
        t, p = docs[r["doc_id"]], places[r["doc_id"]]
        assert r["n_tokens"] == len(enc.encode_ordinary(t))
        edits = [(p["a"], 12, t[-20:]), (p["b"], 30, ""), (p["c"], 0, t[:40])]
        for pos, remove, insert in edits:
            t = t[:pos] + insert + t[pos + remove:]
        assert r["n_tokens_edited"] == len(enc.encode_ordinary(t))


def test_op3_ids_starts_and_checksums(spark, small, documents):
    tok, start = brute.tokenizer(), 0
    got = {r["doc_id"]: r for r in collected(spark, small, "op3_elias_fano_token_ids")}
    assert len(got) == len(documents)
    for i in sorted(documents):
        ids = tok.encode(documents[i], add_special_tokens=False).ids + [2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), brute.crc(ids))
        start += len(ids)


def test_op4_against_every_pair(spark, small, documents):
    from leafmark.llm.decontamination import words_of

    items = {r["item_id"]: words_of(r["text"]) for r in brute.rows(small, "benchmark")}
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in collected(spark, small, "op4_smith_waterman_decontamination")}
    words = {i: words_of(t) for i, t in documents.items()}
    planted = {(i, k) for i, w in words.items() for k, item in items.items() if b" ".join(item) in b" ".join(w)}
    assert planted <= set(got)
    for (i, k), s in got.items():
        assert s == pytest.approx(brute.smith_waterman(items[k], words[i]) / (2 * len(items[k])))


def test_op5_fingerprints_and_components(spark, small, documents):
    got = {r["doc_id"]: r for r in collected(spark, small, "op5_bit_sliced_simhash")}
    ids = sorted(documents)
    fps = np.array([brute.fingerprint(documents[i]) for i in ids], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    root = brute.connected(ids, lambda i: np.flatnonzero(near[i]).tolist())
    for k, i in enumerate(ids):
        assert got[i]["fingerprint"] == f"{fps[k]:016x}"
        assert got[i]["component_id"] == root[k]


def test_op6_shows_all_visible_text(spark, small):
    pages = {r["page_id"]: r["html"] for r in brute.rows(small, "pages")}
    got = {r["page_id"]: r["text"] for r in collected(spark, small, "op6_layout_html")}
    assert set(got) == set(pages)
    import html
    import re

    for i, page in pages.items():
        body = re.sub(r"(?s)<!--.*?-->|<(head|script|style)\b.*?</\1>|<[^>]*>", " ", page)
        assert "".join(html.unescape(body).split()) == re.sub(r"(?m)^- ", "", got[i]).replace("\n", "").replace(" ", ""), i


def test_op7_base_and_model(spark, small, documents):
    want = brute.unigram_scores(list(documents.items()))
    model = base = 0.0
    for r in collected(spark, small, "op7_deleted_interpolation"):
        held, n, known, train, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert r["base_score"] == pytest.approx(score, abs=1e-6)
        if held:
            model, base = model + r["score"], base + r["base_score"]
    assert model > base


def test_op8_packs_whole_documents(spark, small, documents):
    tok, got, used = brute.tokenizer(), defaultdict(dict), defaultdict(list)
    for r in collected(spark, small, "op8_best_fit_packing"):
        got[r["doc_id"]][r["piece"]] = r
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in documents.items():
        ids, pieces = tok.encode(t, add_special_tokens=False).ids + [0], got[i]
        for k in range(-(-len(ids) // 2048)):
            part = ids[2048 * k:2048 * (k + 1)]
            assert (pieces[k]["start"], pieces[k]["length"], pieces[k]["ids_crc32"]) == (2048 * k, len(part), brute.crc(part))
        assert len(pieces) == -(-len(ids) // 2048)
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(n for places in used.values() for _, n in places)
    assert len(used) <= 1.05 * -(-total // 2048) + 1


def test_op9_against_all_pairs(spark, small):
    vectors = {r["vec_id"]: r["embedding"] for r in brute.rows(small, "embeddings")}
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    root = brute.connected(ids, lambda i: np.flatnonzero(near[i]).tolist())
    got = {r["vec_id"]: r for r in collected(spark, small, "op9_pivot_permutation")}
    assert len(got) == len(ids)
    for k, i in enumerate(ids):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[k].sum() - 1, root[k], root[k] == i)


def test_op10_against_every_window(spark, small, documents):
    want = brute.removed([(i, t.encode()) for i, t in documents.items()], 50)
    for r in collected(spark, small, "op10_bwt_substrings"):
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]
