"""Elias-Fano sequences and look-ups in token files."""

import numpy as np
import pytest

from leafmark.llm import token_files
from leafmark.llm.tokens import encoder, vocabulary


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 3000])
@pytest.mark.parametrize("top", [1, 100, 1 << 40, (1 << 64) - 1])
def test_select_gives_every_value(n, top):
    v = np.sort(np.random.default_rng(n).integers(0, top, size=n, dtype=np.uint64, endpoint=True))
    e = token_files.EliasFano(token_files.EliasFano.encode(v))
    assert (e.select(np.arange(n)) == v).all()
    backwards = np.arange(n)[::-1]
    assert (e.select(backwards) == v[backwards]).all()
    if n:
        assert e.find(int(v[n // 2])) == np.searchsorted(v, v[n // 2])
    with pytest.raises(IndexError):
        e.select(n)


def test_select_over_long_gaps():
    v = np.repeat(np.array([0, 10**9, 1 << 62], np.uint64), 1000)
    e = token_files.EliasFano(token_files.EliasFano.encode(v))
    assert (e.select(np.arange(3000)) == v).all()


def test_look_up_and_extreme_ids(spark, tmp_path):
    texts = {-(1 << 63): "one two", -1: "", 5: "three, four", (1 << 63) - 1: "日本 five"}
    docs = spark.createDataFrame([*texts.items(), (None, "nameless"), (5, "again")], "doc_id long, text string")
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs, path, vocabulary(), end_id=2)
    rows = token_files.read_token_files(spark, path).collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted([*texts, 5])
    want = lambda t: encoder(vocabulary()).tokenizer.encode(t, add_special_tokens=False).ids + [2]
    found = sorted((r.doc_id, r.ids) for r in token_files.read_documents(spark, path, [-(1 << 63), 5, 7, (1 << 63) - 1]).collect())
    assert found == sorted([(-(1 << 63), want("one two")), (5, want("three, four")), (5, want("again")), ((1 << 63) - 1, want("日本 five"))])
