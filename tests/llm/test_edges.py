"""Nulls, empty and long texts, ties, repeated rows, empty tables, and columns with clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmark.llm import decontamination, embeddings, html_text, language_model, packing, quality, simhash, substrings, token_counts, token_files
from leafmark.llm.common import components, shared_dir
from leafmark.llm.tokens import vocabulary

from . import brute

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon. " * 3
PASSAGE = "a passage of more than fifty bytes that stands in several documents, word for word and byte for byte é"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch int, packed string, fp string, rep string, `key` string, rest string, kept string, component string, label_id string, weight string"
ROWS = [
    (1, PASSAGE + " one", "en"), (2, "something before " + PASSAGE, None), (2, "something before " + PASSAGE, None), (3, None, "en"), (4, "", "de"), (5, "   \n\t ", "de"), (None, PASSAGE, "fr"), (None, None, None),
    (6, "word " * 30000, "en"), (7, LONG, "en"), (8, LONG, "en"), (9, "ünïcödé 🙂 text", "en"), (10, "x", "en"), (2**62, PASSAGE, "en"), (-5, "negative id with a text of its own", "es"), (0, "<|endoftext|> as text", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, "src", len(t) if t else None, 1, "p", "f", "r", "k", "re", "ke", "c", "l", "w") for i, t, lang in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 0), (8, 1, None), (6, 0, 0), (10, None, 1), (None, 1, 0), (9, 1, 0), (1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, rounds=2)
    assert quality.score(docs, model).count() == len(ROWS)
    kept = quality.keep_accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == quality.score(docs, model).where("accepted").count()
    assert quality.score(none, model).count() == 0
    assert quality.score(docs, quality.train(docs, labels.where("false"))).where("accepted").count() == len(ROWS)
    assert quality.score(docs, quality.train(none, labels)).count() == len(ROWS)


def test_token_counts(spark, docs, none):
    import public_tokenizers

    path, pattern = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    edits = F.expr("array(named_struct('pos', 5, 'remove', 3, 'insert', ' new'), null, named_struct('pos', cast(null as int), 'remove', cast(null as int), 'insert', cast(null as string)), named_struct('pos', 100000000, 'remove', 5, 'insert', ' end'))")
    enc = token_counts.encoding(path, pattern)
    got = token_counts.count_after_edits(token_counts.build_trees(docs, path, pattern), edits, path, pattern).collect()
    assert len(got) == len(ROWS)
    want = sorted((i is None, i or 0, len(enc.encode_ordinary((lambda t: t[:5] + " new" + t[8:] + " end")(t or "")))) for i, t, _ in ROWS)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens_edited"]) for r in got) == want
    assert token_counts.count_after_edits(token_counts.build_trees(none, path, pattern), edits, path, pattern).count() == 0


def test_token_files(spark, docs, none, tmp_path):
    tok = brute.tokenizer()
    for name, df, rows in (("all", docs, ROWS), ("none", none, [])):
        token_files.write_token_files(df, f"file://{tmp_path}/{name}", vocabulary(), block_tokens=1000)
        got = token_files.read_token_files(spark, f"file://{tmp_path}/{name}").orderBy("start").collect()
        assert [r["doc_id"] for r in got] == sorted((i for i, _, _ in rows), key=lambda i: (i is not None, i or 0))
        at = 0
        for r in got:
            assert r["start"] == at
            at += r["n_tokens"]
        want = sorted(brute.crc(tok.encode(t or "", add_special_tokens=False).ids + [2]) for _, t, _ in rows)
        assert sorted(r["ids_crc32"] for r in got) == want


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, None), (3, ""), (4, "too short"), (None, LONG[:100])], "item_id long, text string")
    got = decontamination.find_leaks(docs, items).collect()
    assert {r["doc_id"] for r in got if r["item_id"] == 1} == {1, 2, None, 2**62}
    assert {r["doc_id"] for r in got if r["item_id"] is None} == {7, 8}
    clean = decontamination.drop_leaks(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 7
    assert decontamination.find_leaks(none, items).count() == 0 and decontamination.find_leaks(docs, items.where("false")).count() == 0
    edited = PASSAGE.replace("several", "many").replace("word for word", "word by word")
    assert decontamination.find_leaks(docs.limit(1).withColumn("text", F.lit("before " + edited)), items.limit(1)).count() == 1


def test_simhash(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    of = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert of[7] == of[8] == 7 and of[3] == of[4] == of[5] == 3 and of[10] == 10
    one = simhash.drop_near_duplicates(docs)
    assert one.columns == docs.columns and one.count() == len({r["component_id"] for r in got})
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


def test_simhash_bits():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**64, 200, dtype=np.uint64)
    fps[100:] = fps[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    for radius in range(8):
        got = simhash._lanes(simhash.within(simhash.bit_planes(fps), fps, radius), len(fps))
        assert (got == (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)).all()


def test_simhash_large_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    fps = [(1 << (i % 60)) | (1 << (i // 60)) for i in range(300)]
    reps = spark.createDataFrame([(f, i) for i, f in enumerate(dict.fromkeys(fps))], "fp long, rep long")
    found = {r["component"] for r in components(simhash.links(reps, 4)).collect()}
    assert found == {0}


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", None), (2, None, ""), (None, "u", "<p>a<p hidden>b"), (3, "u", "<div>" * 5000 + "deep"), (4, "u", "<table><tr><td>a<td>bb<tr><td>ccc<td>d</table><ul><li>x<li>y</ul><a \"<b>t")], "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = [(r["page_id"], r["text"]) for r in html_text.extract(pages).collect()]
    assert sorted(got, key=repr) == sorted([(1, ""), (1, ""), (2, ""), (None, "a"), (3, "deep"), (4, "a    bb\nccc  d\n\n- x\n- y\n\nt")], key=repr)
    assert html_text.extract(pages.where("false")).count() == 0


def test_language_model(spark, docs, none):
    got = language_model.score_documents(docs).collect()
    assert len(got) == len(ROWS) and all(np.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1}
    assert language_model.score_documents(none).count() == 0
    assert len(language_model.score_documents(docs.where("doc_id = 1 or doc_id = 9")).collect()) == 2


def test_packing(spark, docs, none):
    packed = packing.pack(packing.token_pieces(docs, vocabulary(), 64), 64).collect()
    tok = brute.tokenizer()
    assert sum(r["length"] for r in packed) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in ROWS)
    spans = {}
    for r in packed:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in spans.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack(packing.token_pieces(none, vocabulary(), 64), 64).count() == 0


def test_packing_reduction_is_optimal_where_it_fixes():
    assert packing.reduce_dominated({6: 2, 4: 3, 10: 1}, 10) == ([([(10, 1)], 1), ([(6, 1), (4, 1)], 2), ([(4, 1)], 1)], {})


def test_embeddings(spark):
    v = [[1.0, 0.0, 0.5], [1.0, 0.0, 0.5], [2.0, 0.0, 1.0], [0.0, 1.0, 0.0], None, [], [0.0, 0.0, 0.0], [1.0, None, 0.0], [1.0, float("nan"), 0.0], [1.0, float("inf"), 0.0], [1e30, 0.0, 5e29], [1.0, 0.0], [0.0, 0.0, -1.0]]
    rows = spark.createDataFrame([(i, x, "a", 0) for i, x in enumerate(v)] + [(None, v[0], "a", 0), (3, v[3], "a", 0)], "vec_id long, embedding array<double>, rep string, links int")
    got = embeddings.near_duplicates(rows).collect()
    assert len(got) == len(v) + 2
    of = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is not None}
    for i in (0, 1, 2, 10):
        assert of[i] == (4, 0, i == 0)
    assert of[3] == (1, 3, True)
    for i in (4, 5, 6, 7, 8, 9, 11, 12):
        assert of[i] == (0, i, True)
    assert embeddings.near_duplicates(rows.where("false")).count() == 0
    assert embeddings.near_duplicates(rows.limit(1)).collect()[0]["n_links"] == 0


def test_embeddings_large_groups(spark, monkeypatch):
    """Recall is that of all pairs here."""
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(60, 8)), rng.normal(size=(1, 8)) + rng.normal(size=(100, 8)) * 0.05])
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(rows).collect()}
    assert sum(got.values()) >= 0.99 * (near.sum() - len(x))
    assert all(got[i] <= near[i].sum() - 1 for i in got)


def test_substrings(spark, docs, none, monkeypatch):
    for hot in (1000, 0):
        monkeypatch.setattr(substrings, "HOT_BATCHES", hot)
        got = substrings.remove_repeats(docs, digest=True).collect()
        assert len(got) == len(ROWS)
        n = {r["doc_id"]: r["n_removed"] for r in got if r["doc_id"] is not None}
        assert n[1] == 0 and n[2] == len(PASSAGE.encode()) + 0 and n[2**62] == len(PASSAGE.encode()) and n[8] == len(LONG) and n[7] == 0
        assert [r["n_removed"] for r in got if r["doc_id"] is None and r["n_bytes"]] == [len(PASSAGE.encode())]
    short = substrings.drop_repeats(docs)
    assert short.columns == docs.columns and short.count() == len(ROWS)
    assert short.where("doc_id = 8").first()["text"] == "" and short.where("doc_id = 2").first()["n_chars"] == len("something before ")
    assert substrings.drop_repeats(none).count() == 0 and substrings.remove_repeats(none).count() == 0


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(chain).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 140)}}


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark)


def test_pipeline_keeps_columns(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= rows, name
        rows = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert packed.select("doc_id").distinct().count() == rows
