"""The pivot-permutation index against all pairs of vectors: planted links in several shapes, large ids, tight groups."""

import numpy as np
import pytest

from leafmark.llm import embeddings


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def shaped(kind, n, d, rng):
    if kind == "even":
        return unit(rng.normal(size=(n, d)))
    if kind == "shared mean":
        return unit(unit(rng.normal(size=(n, d))) + 1.2 * unit(rng.normal(size=(1, d))))
    centres = unit(rng.normal(size=(20, d)))
    return unit(centres[rng.integers(0, 20, n)] + 0.8 * unit(rng.normal(size=(n, d))))


def planted(kind, d, rng, n=1500):
    """``n`` vectors and neighbours of 500 of them, at cosines from 0.88 to 0.99."""
    x = shaped(kind, n, d, rng)
    aside = rng.normal(size=(500, d))
    aside -= (aside * x[:500]).sum(axis=1, keepdims=True) * x[:500]
    c = rng.uniform(0.88, 0.99, size=(500, 1))
    return np.concatenate([x, c * x[:500] + np.sqrt(1 - c * c) * unit(aside)])


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(range(len(x)) if ids is None else ids, x)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("kind", ["even", "shared mean", "clusters"])
@pytest.mark.parametrize("d", [64, 256])
def test_planted_links(spark, kind, d):
    x = planted(kind, d, np.random.default_rng(d))
    near = unit(x) @ unit(x).T
    sure, possible = (near >= 0.9 + 1e-9).sum(axis=1) - 1, (near >= 0.9 - 1e-9).sum(axis=1) - 1
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(table(spark, x)).collect()}
    assert sure.sum() > 500
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * sure.sum()
    assert all(got[i]["n_links"] <= possible[i] for i in got)
    assert all(r["kept"] == (r["component_id"] == i) and r["component_id"] <= i for i, r in got.items())


def few_directions(kind, n, d, rng):
    low = lambda r: rng.normal(size=(n, r)) @ rng.normal(size=(r, d))
    if kind == "rank 6":
        return unit(low(6))
    if kind == "rank 12 and noise":
        return unit(unit(low(12)) + 0.02 * rng.normal(size=(n, d)))
    if kind == "decaying":
        return unit(rng.normal(size=(n, d)) * np.arange(1, d + 1) ** -0.8 @ unit(rng.normal(size=(d, d))))
    return unit(unit(low(8)) + (1.2 if kind == "low rank, shared mean" else 2) * unit(rng.normal(size=(1, d))))


@pytest.mark.parametrize("kind", ["rank 6", "rank 12 and noise", "decaying", "low rank, shared mean", "low rank, strong mean"])
def test_recall_where_vectors_fill_few_directions(kind):
    """Links as they fall, none planted: pairs that share two pivots of their prefixes, against all pairs."""
    x = few_directions(kind, 5000, 64, np.random.default_rng(11))
    rest, mean = embeddings.centred(x[:4096])
    pivots = embeddings.choose_pivots(rest, 128, 0.85)
    near = embeddings.nearest(x, pivots, embeddings.fit_prefix(x[:4096], pivots, 0.9, mean=mean), mean)
    member = np.zeros((len(x), len(pivots)), np.float32)
    member[np.arange(len(x))[:, None], near] = 1
    linked = np.triu(x @ x.T >= 0.9, 1)
    assert len(pivots) == 128 and linked.sum() > 100
    assert (linked & (member @ member.T >= 2)).sum() >= 0.97 * linked.sum()


def test_low_rank_end_to_end(spark):
    x = few_directions("rank 6", 1500, 64, np.random.default_rng(12))
    near = (x @ x.T >= 0.9).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(table(spark, x)).collect()}
    assert sum(got.values()) >= 0.97 * near.sum() and all(got[i] <= near[i] for i in got)


def test_exact_misses_nothing(spark):
    x = planted("even", 64, np.random.default_rng(3), 600)
    near = unit(x) @ unit(x).T
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(table(spark, x), exact=True).collect()}
    assert all((near[i] >= 0.9 + 1e-9).sum() - 1 <= got[i] <= (near[i] >= 0.9 - 1e-9).sum() - 1 for i in got)


def test_ids_over_all_64_bits(spark):
    v = np.random.default_rng(0).normal(size=(5, 16))
    rows = [((1 << 62) + 5, v[0]), ((1 << 62) + 1, v[0] * 1.01 + 0.01), ((1 << 63) - 1, v[0] + 0.02), (-(1 << 63), v[1]), (-7, v[1] + 0.01), (9, v[2]), (None, v[2] + 0.01), (None, v[3]), (None, v[3] + 0.01)]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in rows], "vec_id long, embedding array<double>")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect()), key=str)
    low, bottom = (1 << 62) + 1, -(1 << 63)
    want = [(low + 4, 2, low, False), (low, 2, low, True), ((1 << 63) - 1, 2, low, False), (bottom, 1, bottom, True), (-7, 1, bottom, False), (9, 1, 9, True), (None, 1, 9, False), (None, 1, None, False), (None, 1, None, False)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("block", [16, 100_000])
def test_a_tight_group_is_counted_whole(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(300, 24)), rng.normal(size=(1, 24)) + rng.normal(size=(150, 24)) * 0.05])
    near = (unit(x) @ unit(x).T >= 0.9).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(table(spark, x)).collect()}
    assert sum(got.values()) >= 0.99 * near.sum() and all(got[i] <= near[i] for i in got)


def test_lists_stay_short_as_vectors_grow():
    """Twice the pivots for four times the vectors: the share of the longest list falls."""
    rng = np.random.default_rng(5)
    share = []
    for n, count in ((2_000, 64), (8_000, 128), (32_000, 256)):
        x = shaped("even", n, 32, rng)
        pivots = embeddings.choose_pivots(x[:2048], count, 0.85)
        low = np.sort(embeddings.nearest(x, pivots, 8), axis=1).astype(np.int64)
        share.append(max(np.unique(low[:, i] * 4096 + low[:, j], return_counts=True)[1].max() for i in range(3) for j in range(i + 1, 4)) / n)
    assert share[0] > 1.5 * share[1] > 2 * share[2]


def test_prefix_follows_the_shape():
    rng = np.random.default_rng(1)
    for kind in ("even", "shared mean", "clusters"):
        x = shaped(kind, 4096, 64, rng)
        pivots = embeddings.choose_pivots(x, 128, 0.85)
        assert len(pivots) == 128 and 3 <= embeddings.fit_prefix(x, pivots, 0.9) <= 24
